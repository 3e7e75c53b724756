"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouping with a minimum (partial aggregation: a hub sends one row a task)
and a join whose exchanges adaptive execution may split. Every round is written to the
shared folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_since, fresh, tables_made, work_table


def _star(rows: DataFrame, keep) -> DataFrame:
    """For rows (u, v): v goes to the smallest of u and its neighbours, where ``keep`` holds."""
    least = rows.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
    joined = rows.join(least, fresh(rows["u"]) == fresh(least["k"]))
    return joined.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (u, v) of longs -> one row (u, root) for each node other than its component's
    smallest node, from a work table. Self edges and repeats are harmless. Rounds are about twice the
    logarithm of the longest path; beyond ``max_rounds`` an error is raised."""
    # each round replaces the table of the one before
    now = work_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        linked = down.join(least, fresh(down["u"]) == fresh(least["k"])).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        mark = tables_made()
        now = work_table(linked.where("u <> v").distinct(), "stars")
        drop_since(now.sparkSession, mark - 1, keep=1)  # the round before
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if state is not None and tuple(new)[:2] == tuple(state)[:2] and new[0] == new[2]:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.select("u", F.col("v").alias("root"))
