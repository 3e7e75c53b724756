import random
import re

import numpy as np
import xxhash

from cloakframe.llm import simhash
from cloakframe.llm.components import stars


def brute_fp(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, budget=3):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def clustered(rng, n):
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        out.add(base)
        for _ in range(rng.randrange(0, 40)):
            x = base
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)[:n]


def test_trie_equals_brute_force():
    rng = random.Random(5)
    for agree, n in ((1, 300), (2, 60), (8, 200)):
        keys = clustered(rng, n)
        got = simhash.trie_links(np.array(keys, np.uint64), agree, 3, at_once=50)
        want = list(range(n))
        for i in range(n):
            for j in range(i):
                if keys[i] >> (64 - agree) == keys[j] >> (64 - agree) and (keys[i] ^ keys[j]).bit_count() <= 3:
                    a, b = want[i], want[j]
                    want = [min(a, b) if x in (a, b) else x for x in want]
        assert got.tolist() == want


def test_links_with_hot_values(spark, monkeypatch):
    rng = random.Random(11)
    base = rng.getrandbits(64)
    keys = set(clustered(rng, 400))
    while len(keys) < 3500:  # most share their first block
        x = base ^ (rng.getrandbits(48) if rng.random() < 0.3 else sum(1 << rng.randrange(48) for _ in range(3)))
        keys.add(x)
    keys = sorted(keys)
    df = spark.createDataFrame([(int(np.uint64(k).view(np.int64)),) for k in keys], "fp long")
    got = {r.u: r.root for r in stars(simhash.links(df, len(keys), 3)).collect()}
    signed = [int(np.uint64(k).view(np.int64)) for k in keys]
    want = brute_components(keys)
    root = [got.get(s, s) for s in signed]
    groups = {}
    for a, b in zip(root, want):
        assert groups.setdefault(a, b) == b
    assert len(groups) == len(set(want))


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps = [brute_fp(d.text) for d in docs]
    comp = brute_components(fps)
    least = {}
    for d, c in zip(docs, comp):
        least[c] = min(least.get(c, d.doc_id), d.doc_id)
    want = sorted((d.doc_id, f"{f:016x}", least[c]) for d, f, c in zip(docs, fps, comp))
    got = sorted(map(tuple, simhash.op3_simhash(spark, sf_dir).collect()))
    assert got == want


def test_edges(spark):
    rows = [(4, None, 1), (3, " \t", 2), (None, "", 3), (9, "a b", 4), (9, "a b", 4), (8, "A\x0bB", 5), (7, "x " * 5000, 6), (6, "é É", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.components(df, 3).collect()}
    zero = {(4, 0, 3), (3, 0, 3), (None, 0, 3)}
    assert zero <= got
    assert len({c for i, _, c in got if i in (8, 9)}) == 1 and simhash.components(df, 3).count() == len(rows)
    assert simhash.components(df.limit(0), 3).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(-5, -5), (7, 6), (2000, -9)]
    got = {r.u: r.root for r in stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(1, 61)) and all(got[k] == 1000 for k in range(1001, 1100)) and got[2000] == -9
    assert 0 not in got and -5 not in got


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(9)
    base = " ".join(f"w{rng.randrange(4000)}" for _ in range(900))
    near = base.replace(base.split()[400], "changed", 1)
    rows = [(5, base, "x"), (3, near, "y"), (8, base, None), (8, base, None), (7, "other text here", "z"), (None, near, "q"), (1, None, "n"), (2, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = simhash.near_dedup(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, None, "n"), (3, near, "y"), (7, "other text here", "z")]
    assert simhash.near_dedup(df.limit(0)).count() == 0


def test_several_seeds_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, seeds = docs.collect(), (42, 7, 8)
    fps = simhash.fingerprints([(r.text or "").encode() for r in rows], 3, seeds)
    n = len(rows)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if any((int(fps[i, s]) ^ int(fps[j, s])).bit_count() <= 6 for s in range(3)):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for r, c in zip(rows, label):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = {r.doc_id: least[c] for r, c in zip(rows, label)}
    assert {r.doc_id: r.component_id for r in simhash.components(docs, 3, 6, seeds).collect()} == want


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(150, 500))
        rows.append((k, " ".join(words)))
        changed = list(words)
        for at in range(0, len(words), 100):  # one word in a hundred: five-word Jaccard of about 0.9
            changed[at + 50 if at + 50 < len(words) else at] = "changed"
        rows.append((1000 + k, " ".join(changed)))
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(60)) <= kept and len(kept) <= 63
