from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cloakframe.llm import quality as q
from cloakframe.llm._common import buffers


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def stats(*texts):
    import pyarrow as pa

    return q.statistics(*buffers(pa.array(texts, pa.string())))


def test_statistics_of_single_texts_do_not_touch():
    texts = ["The cat. The dog!\nTHE CAT ** 12\n\n# x", "", None, "a a a a b\na a\na a", "é " * 50, "x" * 5000]
    both = stats(*texts)
    for k, t in enumerate(texts):
        np.testing.assert_allclose(both[k], stats(t)[0])
    row = dict(zip(q.NAMES, both[3]))
    words = texts[3].split()
    assert np.isclose(row["distinct_words"], 2 / 9) and np.isclose(row["top_word"], 8 / 9) and np.isclose(row["distinct_lines"], 2 / 3)
    triples = Counter(zip(words, words[1:], words[2:]))
    assert np.isclose(row["distinct_triples"], len(triples) / 7) and np.isclose(row["top_triple"], max(triples.values()) / 7)
    first = dict(zip(q.NAMES, both[0]))
    assert np.isclose(first["capital_words"], 2 / 10) and np.isclose(first["digit_words"], 1 / 10) and np.isclose(first["share_upper"], 8 / len(texts[0]))
    assert np.isfinite(both).all() and not both[1][3:].any()


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    trees = q.fit_trees(x[:2000], y[:2000])
    assert auc(trees.score(x[2000:]), y[2000:]) > 0.97
    slow = [trees.base + sum(q._walk(trees, r, row[None])[0] for r in trees.roots) for row in x[:50]]
    np.testing.assert_allclose(trees.raw(x[:50]), slow)
    assert q.fit_trees(np.zeros((0, 5)), np.zeros(0)).score(np.zeros((2, 5))).tolist() == [0.5, 0.5]
    assert q.fit_trees(x[:50], np.ones(50)).score(x[:5]).min() > 0.9


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = q.op6_quality(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    held = [(r.score, y[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in y]
    s, t, p = (np.array(x, float) for x in zip(*held))
    assert auc(s, t) > 0.85 and np.mean(p == t) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "x y", "c"), (None, "z", "d")], "doc_id long, text string, stats string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    measured = q.measure(docs)
    trees = q.fit(measured, labels, F.lit(True))
    assert [r.score for r in q.score(measured, trees).collect()] == [0.5] * 4
    assert q.score(q.measure(docs.limit(0)), trees).count() == 0


def test_query_equals_single_texts(spark):
    """The query's scores against each text measured and scored by itself under trees fitted on the same rows."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    trees = q.fit(q.measure(docs), labels.select("doc_id", "quality"), ~held_out)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = q.op6_quality(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows[::7]:
        alone = trees.base + sum(q._walk(trees, root, stats(texts[r.doc_id]).astype(np.float32).astype(float))[0] for root in trees.roots)
        assert abs(r.score - 1 / (1 + np.exp(-alone))) < 1e-6 and r.predicted == (r.score >= 0.7)


def test_long_texts_and_repeated_rows(spark):
    rows = [(1, "the same words. " * 100_000), (1, "the same words. " * 100_000), (2, "short"), (2, "short")]
    measured = q.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(measured) == 4 and len({(r.doc_id, tuple(r.stats)) for r in measured}) == 2
