"""Sources and sinks of payloads: whole files and lines of text, tables, and JSON output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def payload_files(spark: SparkSession, path: str) -> DataFrame:
    """One payload a file, as ``value``."""
    return spark.read.text(path, wholetext=True)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One message a line, as ``value``."""
    return spark.read.text(path)


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Comma- or tab-separated values with a header; everything is a string."""
    return spark.read.option("header", True).option("escape", '"').option("sep", sep).csv(path)


def database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The result of a query in a database, by JDBC."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def as_json(df: DataFrame) -> DataFrame:
    """One compact JSON object a row, nulls included, as ``value``."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def error(message: str) -> dict:
    """What stands in place of a result that may not be shown."""
    return {"error": message}
