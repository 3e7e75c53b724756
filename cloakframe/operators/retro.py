"""Reports over the audit log. All are aggregations with partial sums; a log of any size
reduces to one row a tool or a type before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import category_column
from ..sources.audit import BAD


def _good(events: DataFrame) -> DataFrame:
    return events.where(F.col(BAD).isNull()) if BAD in events.columns else events


def _rate(part: str, whole: str):
    return F.coalesce(F.try_divide(100.0 * F.col(part), F.col(whole)), F.lit(0.0))


def totals(events: DataFrame) -> DataFrame:
    """One row: ``queries, queries_with_pii, fields_redacted, hit_rate, mean_overhead_ms, malformed``."""
    bad = F.col(BAD).isNotNull() if BAD in events.columns else F.lit(False)
    own = lambda c: F.when(~bad, c)
    sums = events.agg(
        F.count(own(F.lit(1))).alias("queries"), F.count_if(~bad & (F.col("fields_redacted") > 0)).alias("queries_with_pii"),
        F.coalesce(F.sum(own(F.col("fields_redacted"))), F.lit(0)).alias("fields_redacted"),
        (F.avg(own(F.when(F.col("overhead_us") > 0, F.col("overhead_us")))) / 1000.0).alias("mean_overhead_ms"),
        F.count_if(bad).alias("malformed"),
    )
    return sums.select("queries", "queries_with_pii", "fields_redacted", _rate("queries_with_pii", "queries").alias("hit_rate"), "mean_overhead_ms", "malformed")


def by_tool(events: DataFrame) -> DataFrame:
    """``tool, queries, queries_with_pii, hit_rate``, most queries first."""
    sums = _good(events).groupBy("tool").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("fields_redacted") > 0).alias("queries_with_pii"))
    return sums.withColumn("hit_rate", _rate("queries_with_pii", "queries")).orderBy(F.desc("queries"), "tool")


def by_type(events: DataFrame) -> DataFrame:
    """``label, category, count, share`` of every type."""
    sums = _good(events).select(F.explode("types").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("count"))
    whole = sums.agg(F.sum("count")).scalar()
    return sums.select("label", category_column(F.col("label")).alias("category"), "count", (100.0 * F.col("count") / whole).alias("share"))


def top_types(events: DataFrame, rows: int = 10) -> DataFrame:
    """The first rows of :func:`by_type`: categories by their total, types by count, ties by name."""
    typed = by_type(events).withColumn("total", F.sum("count").over(Window.partitionBy("category")))
    return typed.orderBy(F.desc("total"), "category", F.desc("count"), "label").limit(rows).drop("total")
