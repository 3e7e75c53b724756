import hashlib
import random
from collections import Counter

import numpy as np

from cloakframe.llm import substring_dedup as sd


def brute(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_window_hashes():
    words = np.random.default_rng(1).integers(0, 9, 500).astype(np.uint64)
    for width in (1, 2, 3, 7, 35, 500, 501):
        h = sd.window_hashes(words, width)
        runs = [tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 0))]
        assert len(h) == len(runs) and len(set(h.tolist())) == len(set(runs))


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = sorted((d.doc_id, *x) for d, x in zip(docs, brute([d.text for d in docs], 35)))
    assert sorted(map(tuple, sd.op8_substring_dedup(spark, sf_dir).collect())) == want
    assert any(x[2] for x in want)


def test_overlaps_and_edges(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    texts += [None, "", " \n", "é " * 9, "é é " * 9, texts[3], texts[3], "z " * 100, "solo\x1ctwo " * 3]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(3)
    for chunk in (1 << 22, 200):
        monkeypatch.setattr(sd, "CHUNK", chunk)
        got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in sd.remove_repeated(df, 5).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, 5)
    assert sd.remove_repeated(df.limit(0), 5).count() == 0


def thue_morse(n):
    """Two different words that collide under any polynomial modulo 2**64 with an odd base."""
    w = "a"
    for _ in range(n):
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_in_polynomials_stay_apart(spark):
    one, other = thue_morse(10)
    texts = [" ".join([one] * 35), " ".join([other] * 35), " ".join([one] * 36)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in sd.remove_repeated(df, 35).collect()} == {0: 35, 1: 0, 2: 36}


def test_verification_decides_where_window_hashes_collide(spark, monkeypatch, tmp_path):
    """With a window hash that cannot tell most windows apart the result is the same."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 50))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    maybe = sd._pass
    every = lambda rows, width, verify: maybe(rows, width, verify) if verify else spark.createDataFrame(
        [(bytearray(hashlib.sha256(t.encode()).digest()), bytearray(np.array([0, len(t.split())], "<u4").tobytes())) for t in set(texts) if len(t.split()) >= 5], "key binary, intervals binary")
    monkeypatch.setattr(sd, "_pass", every)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in sd.remove_repeated(df, 5).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 5)


def test_long_text_and_hot_passage_in_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(sd, "RANGE_BYTES", 4000)
    monkeypatch.setattr(sd, "CHUNK", 3000)
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) + (" " + passage if k % 3 == 0 else "") for k in range(90)]
    texts.append(" ".join(f"v{rng.randrange(3000)}" for _ in range(30_000)) + " " + passage)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, N_Removed int").repartition(4)
    out = sd.remove_repeated(df, 35)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed", "removed", "kept"]
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 35)


def test_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr("cloakframe.llm._common.BROADCAST_BYTES", 0)
    texts = ["a b c d e f", "x b c d e y", "a b c d e f", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in sd.remove_repeated(df, 4).collect()}
    assert [got[i] for i in range(4)] == brute(texts, 4)
