"""Exposure of a schema: names classified as data, grouped by category, one risk level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import category_column, classify_column
from ..functions.rules import NO_PII, RANK_OF, WEIGHT_OF


def _table(values: dict[str, int], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key), F.lit(0))


def classified(pairs: DataFrame) -> DataFrame:
    """``table_name, column_name, category, label`` of every pair."""
    label = classify_column(F.col("column_name"))
    return pairs.select("table_name", "column_name", label.alias("found")).select("table_name", "column_name", F.coalesce(category_column(F.col("found")), F.lit(NO_PII)).alias("category"), F.coalesce("found", F.lit(NO_PII)).alias("label"))


def by_label(pairs: DataFrame, examples: int = 100) -> DataFrame:
    """``category, label, count, columns``, names without a type last, then by category and count.
    ``columns`` has the first ``examples`` names in order, none of those without a type."""
    found = classified(pairs)
    counts = found.groupBy("category", "label").agg(F.count(F.lit(1)).alias("count"))
    first = _first(found, ["category", "label"], examples).groupBy("category", "label").agg(F.sort_array(F.collect_list("name")).alias("columns"))
    grouped = counts.join(first, ["category", "label"], "left").withColumn("columns", F.coalesce("columns", F.array().cast("array<string>")))
    return grouped.orderBy((F.col("category") == NO_PII).cast("int"), "category", F.desc("count"), "label")


def _first(found: DataFrame, by: list[str], examples: int) -> DataFrame:
    """``name`` (table.column) of the first typed columns of each group; Spark keeps as many a task."""
    typed = found.where(F.col("category") != NO_PII).select(*by, F.concat_ws(".", "table_name", "column_name").alias("name"))
    return typed.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("name"))).where(F.col("n") <= examples).drop("n")


def by_category(pairs: DataFrame) -> DataFrame:
    """``category, sensitivity, count, share`` in report order; the share is of all typed columns."""
    found = classified(pairs).where(F.col("category") != NO_PII).groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    share = F.round(100.0 * F.col("count") / found.agg(F.sum("count")).scalar(), 1)
    return found.select("category", sensitivity(F.col("category")).alias("sensitivity"), "count", share.alias("share")).orderBy(_table(RANK_OF, F.col("category")))


def sensitivity(category: Column) -> Column:
    w = _table(WEIGHT_OF, category)
    return F.when(w == 3, "critical").when(w == 2, "elevated").when(w == 1, "standard").otherwise("unknown")


def risk(pairs: DataFrame) -> DataFrame:
    """One row: ``risk_level, tables_scanned, columns_scanned, pii_columns, non_pii_columns, pii_percentage``."""
    w = _table(WEIGHT_OF, F.col("category"))
    typed = F.col("category") != NO_PII
    sums = classified(pairs).agg(
        F.countDistinct("table_name").alias("tables_scanned"), F.count(F.lit(1)).alias("columns_scanned"), F.count_if(typed).alias("pii_columns"),
        F.count_if(typed & (w == 3)).alias("high"), F.coalesce(F.max(F.when(typed, w)), F.lit(0)).alias("top"),
    )
    n = F.col("columns_scanned")
    ratio = F.col("pii_columns") / F.when(n > 0, n)
    level = (
        F.when((n == 0) | (F.col("pii_columns") == 0), "NONE")
        .when(F.col("top") == 3, F.when((F.col("high") >= 3) | (ratio > 0.10), "CRITICAL").otherwise("HIGH"))
        .when(F.col("top") == 2, F.when(ratio > 0.25, "CRITICAL").when(ratio > 0.05, "HIGH").otherwise("LOW"))
        .when((F.col("top") == 1) & (ratio > 0.25), "HIGH")
        .otherwise("LOW")
    )
    percentage = F.coalesce(F.round(100.0 * ratio, 1), F.lit(0.0))
    return sums.select(level.alias("risk_level"), "tables_scanned", "columns_scanned", "pii_columns", (n - F.col("pii_columns")).alias("non_pii_columns"), percentage.alias("pii_percentage"))


def report(pairs: DataFrame, examples: int = 1000) -> dict:
    """The report as a mapping: totals, and each category with the first ``examples`` of its columns in
    order; ``count`` is of all."""
    head = risk(pairs).first().asDict()
    rows = by_category(pairs).collect()  # a row for each category
    names: dict[str, list[str]] = {}
    for r in _first(classified(pairs), ["category"], examples).orderBy("category", "name").collect():
        names.setdefault(r.category, []).append(r.name)
    return head | {"categories": [{"name": r.category, "sensitivity": r.sensitivity, "count": r["count"], "columns": names[r.category]} for r in rows]}


def text_report(pairs: DataFrame, verbose: bool = False) -> str:
    """The report as text: the three largest categories with three examples each, or everything."""
    r = report(pairs)
    out = [f"Risk: {r['risk_level']}", f"{r['pii_columns']} of {r['columns_scanned']} columns in {r['tables_scanned']} tables ({r['pii_percentage']} %)"]
    cats = sorted(r["categories"], key=lambda c: -c["count"])
    for c in cats if verbose else cats[:3]:
        out.append(f"{c['name']} [{c['sensitivity']}]: {c['count']} ({100 * c['count'] / r['pii_columns']:.1f} %)")
        out += [f"  {x}" for x in (c["columns"] if verbose else c["columns"][:3])]
    return "\n".join(out)


def exposed(pairs: DataFrame) -> bool:
    """Whether any column has a type."""
    return not classified(pairs).where(F.col("category") != NO_PII).isEmpty()


def review(pairs: DataFrame, allowed: set[str]) -> DataFrame:
    """Distinct typed column names that the allowlist does not name yet, with label and count."""
    low = F.lower("column_name")
    rows = classified(pairs).where(F.col("category") != NO_PII)
    rows = rows.where(~low.isin(*sorted(allowed))) if allowed else rows
    return rows.groupBy(low.alias("column_name"), "label").count().orderBy(F.desc("count"), "column_name")
