import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as p
from cloakframe.llm import jaccard, simhash


def shingles(text, k=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([" ".join(words)] if words else [])


def kept_by_brute_force(rows):
    """doc_ids that stay of (doc_id, text): every pair with a shared shingle is compared."""
    sets, holders, label = [shingles(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x]} if s else [j for j in range(i) if not sets[j]]:
            if not s or 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return set(least.values())


def around_the_limit(rng, n):
    """Texts with copies whose Jaccard index is from about 0.6 to 1, some on the limit itself."""
    rows = []
    for k in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([5, 13, 40, 100, 300, 900]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.randrange(3)):
            other = list(words)
            for _ in range(rng.randrange(1, 2 + len(words) // 30)):
                other[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(other)))
    words = [f"z{k}" for k in range(404)]  # 400 shingles: 320 shared of 400 is 0.8, of 401 is less
    rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:324])), (len(rows) + 2, " ".join(words[:323]))]
    return rows


def test_pipeline_stage_finds_every_near_copy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = docs.agg({"doc_id": "max"}).first()[0]
    made = [(last + 1 + i, t, "en", "made", len(t)) for i, t in around_the_limit(random.Random(20), 250)]
    every = docs.select(*p.COLUMNS).unionByName(spark.createDataFrame(made, docs.select(*p.COLUMNS).schema))
    want = kept_by_brute_force([(r.doc_id, r.text) for r in every.collect()])
    kept = [r.doc_id for r in p.near(spark, every, sf_dir).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == want


def test_hot_groups_and_second_pass(spark):
    rng = random.Random(3)
    base, rows = [f"b{k}" for k in range(60)], []
    for k in range(1500):  # copies of one text, most near each other, many only near some
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    for k in range(500):  # a passage in unrelated texts
        rows.append((2000 + k, " ".join(base[:30] + [f"y{rng.randrange(10**6)}" for _ in range(20)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in jaccard.near_dedup(df).collect()} == kept_by_brute_force(rows)


def test_led_pairs_leave_out_only_what_shares_a_leader():
    rng = np.random.default_rng(6)
    for groups in (1, 4, 40):
        size = rng.integers(20, 30, 80)
        sets = [rng.choice(40, n, replace=False).astype(np.uint64) for n in size]
        sketch = jaccard.sketches(np.concatenate(sets), size)
        node = rng.permutation(80)  # in order within each group, as tasks sort them
        key = np.sort(rng.integers(0, groups, 80))
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        ties = jaccard.Ties(node, node)
        for _ in jaccard.led_pairs(ties, lambda i, j: jaccard.least_apart(size, sketch, i, j, (1, 2)), cut):
            pass
        found = ties.pairs()
        got = set(zip(found["u"].to_pylist(), found["v"].to_pylist(), strict=True))
        assert len(got) == found.num_rows
        follows = {(u, v): f for u, v, f in zip(*(found[c].to_pylist() for c in ("u", "v", "follows")), strict=True)}
        after = {}  # of each node, with whom it is paired, and whom it follows
        for (u, v), f in follows.items():
            after.setdefault(v if f & 1 else u, set()).add(u if f & 1 else v)
            if f == 3:
                after.setdefault(u, set()).add(v)
        near = {(node[i], node[j]) for i in range(80) for j in range(i + 1, 80) if key[i] == key[j] and 2 * len(np.intersect1d(sets[i], sets[j])) >= len(np.union1d(sets[i], sets[j]))}
        of = lambda x: after.get(x, set())
        # a near pair is there, or both follow or are one node: if a pair fails, a row of the near pair is open
        assert near and all((min(a, b), max(a, b)) in got or (of(a) | {a}) & (of(b) | {b}) for a, b in near)


def test_edges(spark):
    rows = [(4, None), (3, " \t"), (None, ""), (9, "a b"), (9, "a b"), (8, "A\x0bB"), (7, "x " * 5000), (6, "é É"), (None, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in jaccard.near_dedup(df).collect()} == {(3, " \t"), (8, "A\x0bB"), (7, "x " * 5000), (6, "é É"), (None, "a b c")}
    assert jaccard.near_dedup(df.limit(0)).count() == 0


def test_operator_equals_brute_force_at_its_default(spark):
    rows = around_the_limit(random.Random(77), 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.near_dedup(df).collect()} == kept_by_brute_force(rows)


def test_parities_never_exceed_the_differing_items():
    rng = np.random.default_rng(11)
    for n in (1, 30, 63, 64, 65, 400, 3000):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        for lost, new in ((0, 0), (0, 1), (n // 5, 0), (n // 3, n // 2), (0, 3 * n)):
            other = np.concatenate([base[lost:], rng.integers(0, 2**64, new, dtype=np.uint64)])
            a, b = jaccard.parities(np.concatenate([base, other]), np.array([n, len(other)]))
            got = jaccard.differing(a, b)
            assert got <= lost + new and got % 2 == (lost + new) % 2 and (got > 0 or lost + new != 1)


def test_texts_that_can_link_are_kept(spark):
    """Against all pairs: no text with a partner is left out, and of the rest most are."""
    rng = random.Random(5)
    passage = list(range(10**6, 10**6 + 60))
    sets = []
    for _ in range(120):
        base = [rng.randrange(10**5) for _ in range(rng.choice([1, 4, 9, 10, 30, 200]))]
        sets.append(sorted(set(base)))
        sets.append(sorted({rng.randrange(10**9) if rng.random() < rng.choice([0, 0.05, 0.11, 0.4]) else x for x in base}))
    sets += [sorted({*passage, *(rng.randrange(10**9) for _ in range(800))}) for _ in range(40)]
    like = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    whole = [frozenset(x) for x in sets]
    linked = {i for i in range(len(sets)) for j in range(len(sets)) if i != j and like(whole[i], whole[j])}
    rows = []
    for k, x in enumerate(sets):  # in the order of a hash
        x = sorted(x, key=lambda v: hash((v, 3)))
        n = jaccard.prefix_lengths(np.array([len(x)]), (4, 5), jaccard.SPARE)[0]
        rows.append((k, len(x), [hash((v, 3)) for v in x[:n]]))
    df = spark.createDataFrame(rows, "id long, size long, prefix array<long>").repartition(4)
    parts = df.mapInArrow(jaccard._packed(3), jaccard._PARTS).repartitionById(3, F.pmod("route", F.lit(3)).cast("int")).mapInArrow(jaccard._shared, jaccard._PARTS)
    got = {r.able: r.prefix for r in parts.repartition(3, "chunk").mapInArrow(jaccard._able((4, 5)), "able long, prefix array<long>").collect()}
    assert linked and linked <= set(got)
    assert not any(len(sets) - 40 <= k for k in got)  # a shared passage in long texts is not enough
    first = {k: set(x[: jaccard.prefix_lengths(np.array([n]), (4, 5))[0]]) for k, n, x in rows}
    assert all(set(got[i]) <= first[i] for i in got) and all(set(got[i]) & set(got[j]) for i in linked for j in linked if i != j and like(whole[i], whole[j]))
