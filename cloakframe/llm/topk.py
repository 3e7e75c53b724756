"""Exact top-k inner products by Fagin's threshold algorithm over sorted lists.

Components become integers floor(256 * x). Candidates are dealt into groups; a task sorts
each dimension of its group once, then answers queries: for a query it walks all lists
together from their favourable ends, scores every vector it meets, and stops when the kth
score beats the bound that the lists' current heads allow for vectors not yet met. The
best of all groups are then ranked; ties go to the smaller vec_id.

Scale: there are as many groups as keep one's components at about ``GROUP_BYTES``, at any dimension;
its queries arrive in blocks, after it, so a task holds one group (with a sorted copy and the lists'
order: two and a half times its bytes) and one block, however many queries there are. Of each group only
k rows a query leave the task, and Spark cuts them to k again before the shuffle. Copies of
one vector are ordinary candidates.

Defined results: vectors that are null or hold null or non-finite components take no part,
nor do rows without vec_id. Vectors of different lengths are not compared. A query is never
its own candidate, nor is any row that repeats its vec_id; of rows that repeat a query's
vec_id the smallest vector asks. A candidate's repeated rows are separate candidates.
Scores beyond a long are held at its limits. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import partitions, work_table

GROUP_BYTES = 1 << 27  # of components, as they are held in a task
BLOCK = 1024
_EXACT = 2.0**53


class SortedLists:
    """The vectors of one group, with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)  # a row for each dimension
        self.sorted = np.sort(vectors, axis=0).T
        self.largest = float(np.abs(vectors).max(initial=0))

    def score(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.largest * float(np.abs(query).max(initial=0)) * max(len(query), 1) < _EXACT:
            return self.vectors[rows] @ query  # sums of exact integers
        exact = [sum(int(a) * int(b) for a, b in zip(self.vectors[r], query, strict=True)) for r in rows]
        return np.array(exact, object)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates, best first."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met = np.zeros(n, bool)
        best, score = np.zeros(0, np.int64), np.zeros(0)
        depth, last = 0, len(up) + len(down) == 0
        while True:
            to = n if last else min(max(2 * depth, 32), n)
            rows = np.arange(n) if last else np.concatenate([self.order[up, n - to : n - depth].ravel(), self.order[down, depth:to].ravel()])
            rows = np.unique(rows[~met[rows]])
            met[rows] = True
            rows = rows[self.ids[rows] != query_id]
            ids, scores = np.concatenate([best, self.ids[rows]]), np.concatenate([score, self.score(query, rows)])
            keep = np.lexsort((ids, -scores))[:k]
            best, score = ids[keep], scores[keep]
            if to >= n or met.all():
                return best, score
            depth = to
            if len(best) == k:
                # no vector that was not met is above the heads; equal bounds may hide a smaller id
                heads = [*zip(query[up].tolist(), self.sorted[up, n - depth - 1].tolist(), strict=True), *zip(query[down].tolist(), self.sorted[down, depth].tolist(), strict=True)]
                if score[-1] > sum(int(a) * int(b) for a, b in heads):
                    return best, score


def _floor(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors of a batch (vec_id, embedding), by length; bad rows are left out."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    col = batch.column(1)
    flat = col.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    o = col.offsets.to_numpy().astype(np.int64)
    length = np.diff(o)
    good = ~np.isnan(np.asarray(ids, float)) if batch.column(0).null_count else np.ones(len(ids), bool)
    if col.null_count:
        good &= ~col.is_null().to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(length[good]):
        rows = np.flatnonzero(good & (length == d))
        m = np.floor(256.0 * flat[o[rows][:, None] + np.arange(d)])
        ok = np.isfinite(m).all(axis=1)
        if ok.any():
            out.append((ids[rows[ok]].astype(np.int64), m[ok]))
    return out


def _blocks(groups: int, queries: bool):
    """Packed blocks of vectors: queries go to every group, candidates to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for batch in batches:
            for ids, m in _floor(batch) if batch.num_rows else []:
                for s in range(0, len(ids), BLOCK):
                    body = (ids[s : s + BLOCK].tobytes(), m[s : s + BLOCK].tobytes())
                    for g in range(groups) if queries else [at % groups]:
                        yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([m.shape[1]], pa.int32()), pa.array([int(queries)], pa.int32()), pa.array([body[0]]), pa.array([body[1]])], ["grp", "dim", "kind", "ids", "body"])
                    at += 1

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, lists = None, [], None
        for batch in batches:
            for grp, dim, kind, ids, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, m = np.frombuffer(ids, np.int64), np.frombuffer(body, np.float64).reshape(-1, dim) if dim else np.zeros((len(ids) // 8, 0))
                if now != (grp, dim):
                    now, parts, lists = (grp, dim), [], None
                if not kind:
                    parts.append((ids, m))
                    continue
                if not parts:
                    continue
                lists = lists or SortedLists(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                out = [(q, *lists.top(int(q), v, k)) for q, v in zip(ids, m, strict=True)]
                query = np.repeat(ids, [len(o[1]) for o in out])
                scores = [min(max(int(s), -(2**63)), 2**63 - 1) for o in out for s in o[2]]
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([o[1] for o in out])), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows for every row where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vec"), is_query.alias("q")).where("id is not null and vec is not null")
    asked = rows.where("q and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity'))").groupBy("id").agg(F.min("vec").alias("vec"))
    n, components = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    groups = max(-(-8 * components // GROUP_BYTES), min(partitions(spark), -(-n // (2 * BLOCK))), 1)
    kind = "grp long, dim int, kind int, ids binary, body binary"
    candidates = rows.select("id", "vec").mapInArrow(_blocks(groups, False), kind)
    queries = asked.mapInArrow(_blocks(groups, True), kind)
    # a group's candidates come before its queries
    dealt = candidates.unionByName(queries).repartitionById(groups, F.col("grp").cast("int")).sortWithinPartitions("grp", "dim", "kind")
    best = work_table(dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long"), "topk")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("vec_id") % 50 == 0, k=5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
