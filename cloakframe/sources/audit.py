"""The audit log: one JSON line for each query, appended by jobs and read for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts long, path string, tool string, fields_redacted long, overhead_us long, types map<string,long>"
BAD = "_bad"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events, and lines that are none with the line in ``_bad``. Blank lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return parse(lines)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    e = F.from_json(F.col(column), f"{SCHEMA}, {BAD} string", options).alias("e")
    rows = lines.select(e, F.col(column).alias("line")).select("e.*", "line")
    bad = F.col(BAD).isNotNull() | F.col("ts").isNull() | F.col("path").isNull() | F.col("tool").isNull() | F.col("fields_redacted").isNull() | F.col("types").isNull()
    return rows.select("ts", "path", "tool", "fields_redacted", F.coalesce("overhead_us", F.lit(0)).alias("overhead_us"), "types", F.when(bad, F.col("line")).alias(BAD))


def event(path: str, tool: str, total: Column, counts: Column, overhead_us: Column) -> list[Column]:
    """The columns of an event that is made now."""
    return [F.unix_millis(F.current_timestamp()).alias("ts"), F.lit(path).alias("path"), F.lit(tool).alias("tool"), total.alias("fields_redacted"), overhead_us.alias("overhead_us"), counts.alias("types")]


def made(spark: SparkSession, path: str, tool: str, total: int, types: dict[str, int], overhead_us: int) -> DataFrame:
    """One event, made now, of counts that are known."""
    row = [(path, tool, total, overhead_us, types)]
    return spark.createDataFrame(row, "path string, tool string, fields_redacted long, overhead_us long, types map<string,long>").select(F.unix_millis(F.current_timestamp()).alias("ts"), "*")


def by_day(events: DataFrame) -> DataFrame:
    """``day, queries``: good events by the (UTC) day of their time stamp, which is in milliseconds."""
    good = events.where(F.col(BAD).isNull()) if BAD in events.columns else events
    return good.groupBy(F.to_date(F.to_utc_timestamp(F.timestamp_millis("ts"), F.current_timezone())).alias("day")).agg(F.count(F.lit(1)).alias("queries"))


def append(events: DataFrame, path: str) -> None:
    events.select("ts", "path", "tool", "fields_redacted", "overhead_us", "types").write.mode("append").json(path)
