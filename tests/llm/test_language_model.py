import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cloakframe.llm import _words
from cloakframe.llm import language_model as lm


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def base_scores(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(np.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x))) for i, x in rows]


def test_base_scores_and_gain(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: r for r in lm.op4_language_model(spark, d).collect()}
    assert len(got) == len(rows)
    for i, held, n, known, total, base in base_scores(rows):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > 0.96 * sum(r.base_score for r in held)
    assert np.mean([r.score > r.base_score for r in held]) > 0.9


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 5)
    rows = [(i, t) for i, t in enumerate(["a b c a", "a B d e", None, "", "x y z z z", "a\x0bb é É " * 300])] + [(3, "a b"), (3, "a b"), (None, "b q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, rare = lm.fit(df.where(lm.split_of("doc_id", 7) != 2).select("text"), updates=8)
    assert len(model.frequent) <= 5
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.score(df, model, rare).collect()), key=str)
    assert got == sorted(((i, n, k, round(float(b), 6)) for i, _, n, k, _, b in base_scores(rows)), key=str)


def spelled(word):
    raw = word.encode()
    return (raw[-1] * 257 + (raw[-2] if len(raw) > 1 else 0)) * 40503 % 65521 % lm.SPELLED


def unit(word, top):
    return 0 if word is None else 1 + top[word] if word in top else 1 + lm.HEAD + spelled(word)


def class_of(u):
    return 0 if u == 0 else 1 + (u - 1) // lm.GROUP if u <= lm.HEAD else 1 + lm.GROUPS + u - 1 - lm.HEAD


def bucket(kind, key, size):
    return int(_words.mix(np.array([(key << 3) + kind], np.uint64))[0]) % size


def probability(m, top, counts, one, two, token):
    """p(token | units before), a number at a time; None is the end, "\0" with a letter an unseen word."""
    u, c1, c2 = unit(token, top), class_of(one), class_of(two)
    keys = [0, one, c2, two, one * lm.CLASSES + c2, one * lm.UNITS + two]
    z = [sum(float(m.classes[c1, bucket(n, k, lm.ROWS), c]) for n, k in enumerate(keys)) if m.open_classes[c] else -np.inf for c in range(lm.CLASSES)]
    p = np.exp(z[class_of(u)]) / np.exp(z).sum()
    if 1 <= u <= lm.HEAD:
        group = range((u - 1) // lm.GROUP * lm.GROUP, ((u - 1) // lm.GROUP + 1) * lm.GROUP)
        pairs = lambda w: [one * lm.UNITS + w, c2 * lm.UNITS + w, (one * lm.CLASSES + c2) * lm.UNITS + w]
        names = {r: t for t, r in top.items()}
        f = {r: counts[names[r]] * np.exp(sum(float(m.words[c1, bucket(n, k, lm.PAIRS)]) for n, k in enumerate(pairs(1 + r)))) for r in group if r in names}
        p *= f[u - 1] / sum(f.values())
    elif u:
        own = [n for t, n in counts.items() if t is not None and t not in top and spelled(t) == u - 1 - lm.HEAD]
        p *= (counts.get(token, 0) + 1) / (sum(own) + len(own) + 1)
    return p


def small_corpus(spark):
    texts = ["the cat sat on the mat", "der hund und die katze und der", "a b c d e f g a b c the cat"] * 15 + ["", None, "rare once"]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_scores_equal_brute_force_and_probabilities_sum_to_one(spark):
    texts, df = small_corpus(spark)
    model, rare = lm.fit(df.select("text"), 10)
    counts = Counter(t for x in texts for t in tokens(x))
    by_hash = {int(_words.split(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])).hash[0]): t for t in counts if t is not None}
    top = {by_hash[int(h)]: r for r, h in enumerate(model.top)}
    assert len(top) == len(counts) - 1  # fewer words than units
    every = [*counts, *(f"\0{chr(k)}{chr(j)}" for k in range(33, 127) for j in range(33, 127))]
    unseen = {spelled(t): t for t in every if t is not None and t not in counts}
    assert len(unseen) == lm.SPELLED
    for one, two in ((0, 0), (1, 0), (2, 1), (lm.HEAD + 3, 1), (5, lm.HEAD + 2)):
        assert abs(sum(probability(model, top, counts, one, two, t) for t in [*counts, *unseen.values()]) - 1) < 1e-5
    tests = ["the cat sat on zebra", "der hund", None, "a b c und the unknown mat", "die die die"]
    held = spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string")
    for r in lm.score(held, model, rare).collect():
        want, one, two = 0.0, 0, 0
        for t in tokens(tests[r.doc_id]):
            want += np.log10(probability(model, top, counts, one, two, t))
            one, two = unit(t, top), one
        assert abs(r.score - want) < 1e-4 * max(1, abs(want))


def test_training_improves_the_likelihood(spark):
    _, df = small_corpus(spark)
    sums = []
    for updates in (0, 3, 25):
        model, rare = lm.fit(df.select("text"), updates)
        rows = lm.score(df, model, rare).collect()
        sums.append(sum(r.score for r in rows))
    assert sums[0] < sums[1] < sums[2] and sums[2] > sum(r.base_score for r in rows)


def test_slices_give_the_same_model(spark, monkeypatch):
    df = small_corpus(spark)[1].repartition(4)
    one, _ = lm.fit(df.select("text"), 5)
    monkeypatch.setattr(lm, "SLICE_TOKENS", 3)
    many, _ = lm.fit(df.select("text"), 5)
    np.testing.assert_allclose(one.classes, many.classes, atol=1e-5)
    np.testing.assert_allclose(one.words, many.words, atol=1e-5)


def test_contexts_stay_within_texts():
    w = _words.split(np.frombuffer(b"aa bb ccdd", np.uint8), np.array([0, 8, 8, 10]))
    units, starts, _ = lm.units_of(w, np.zeros(0, np.uint64))
    assert starts.tolist() == [0, 4, 5, 7] and units[[3, 4, 6]].tolist() == [0, 0, 0]
    n, a, b, x, y = lm.UNITS, units[0], units[1], units[2], units[5]
    assert lm.contexts(units, starts).tolist() == [0, a * n, b * n + a, x * n + b, 0, 0, y * n]


def test_clashing_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", 0.5, "q"), (1, "a b", 0.5, "q"), (2, None, 1.0, "q")], "doc_id long, text string, Score double, n_tokens string")
    model, rare = lm.fit(df.select("text"), 3)
    rows = lm.score(df, model, rare).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 3, 3] and len({r.score for r in rows if r.doc_id == 1}) == 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    model, rare = lm.fit(df.select("text"))
    assert lm.score(df, model, rare).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    r = lm.score(one, model, rare).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0)
