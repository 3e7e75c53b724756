import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from cloakframe.llm import topk


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], {}
    for i, v in ok:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_query_equals_sql(spark, sf_dir):
    got = sorted(map(tuple, topk.op9_topk(spark, sf_dir).collect()))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    assert got == sorted(con.sql(topk.OP9_SQL).fetchall())


def test_ties_bad_vectors_and_large_values(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(200)]
    rows += [(2000, None), (2010, [1.0, None]), (2020, [float("nan")] * 6), (2030, [float("inf")] * 6), (2040, []), (2041, []), (2050, [0.0] * 6), (None, [1.0] * 6), (3000, [1.0, 2.0]), (3001, [-1.0, 2.0]), (3001, [-1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 10 == 0, 5).collect())) == brute(rows, 5, 10)
    big = [(0, [1e15, -3.0]), (1, [1e15, 2.0]), (2, [1e15, 2.0]), (3, [-1e15, 7.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<float>")
    lim = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") == 0, 5).collect())) == [(q, r, i, lim(s)) for q, r, i, s in brute(big, 5, 1000)]
    assert topk.search(df.limit(0), F.col("vec_id") == 0, 5).count() == 0


def test_clashing_columns_and_many_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist(), "x", 1.0) for i in range(60)] + [(100, [1.0] * 6, "x", 1.0)] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, Query_ID string, score double").repartition(3)
    one = sorted(map(tuple, topk.search(df, F.col("vec_id") % 20 == 0, 5).collect()))
    monkeypatch.setattr(topk, "GROUP_BYTES", 500)
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 20 == 0, 5).collect())) == one and len(one) == 4 * 5
