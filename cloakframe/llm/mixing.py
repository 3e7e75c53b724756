"""Mixing sources to target weights over a domain-language-source tree (DataFrame functions only).

Budgets go from the root to the leaves. A node's token budget is shared among its children
by weight; a child that cannot use its share (its capacity is its tokens times
``max_epochs``) gets its capacity, and what it leaves goes to its siblings by weight. Only
what a whole subtree cannot use goes on to the siblings of its ancestor. Shares are whole
tokens, rounded down. A leaf takes all its documents for each full epoch that its budget
holds, then, in the order of the next epoch's seed, the longest prefix of documents whose
tokens fit into the rest.

Scale: everything but the last join works on one row a leaf, or on one row for each leaf
and one of 256 slices of the epoch's order, pre-aggregated before the shuffle. The prefix
ends inside one slice, which is sliced again, and again; only one of 16.7 million slices of
a leaf is ordered by document, so a leaf with a third of all rows is never sorted in one
task. The outcome is one cut a leaf, and each document decides
by its own order key, so texts are never shuffled while Spark can broadcast one row a leaf
(by its size), and adaptive execution splits a hot leaf beyond that.

Defined results: null domain, language and source count as ''. A null text has no tokens;
documents without tokens are taken with the prefix they stand in. Rows that repeat a doc_id
share their place in the order, and are taken together or not at all. Weights are positive
integers; a path that has none weighs 1, one with weight 0 gets nothing. An empty table
gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import work_table

LEVELS = ("_domain", "_lang", "_source")
DIGITS = (2, 4, 6)  # of the order key: slices, slices of the slice where the prefix ends, and so on
WORD = r"[^\x20\x09-\x0D]+"


def _order_key(seed: str, epoch: Column | str, doc_id: str) -> Column:
    epoch = F.col(epoch) if isinstance(epoch, str) else epoch
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def _weight(weights: dict[tuple[str, ...], int], path: tuple[str, ...]) -> Column:
    named = {k: w for k, w in weights.items() if len(k) == len(path)}
    if not named:
        return F.lit(1).cast("long")
    table = F.create_map(*[x for k, w in named.items() for x in (F.array(*map(F.lit, k)), F.lit(w).cast("long"))])
    return F.coalesce(F.try_element_at(table, F.array(*path)), F.lit(1).cast("long"))


def _fill(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Water-filling: ``budget`` of the parent over rows (child, weight, capacity) -> ``given``.

    In the order of capacity for each weight, a child is full if its capacity is no more than
    its share of what fuller children leave; the others share the rest by weight.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity").cast("double") / F.col("weight").cast("double"), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    share = F.expr("(budget - before) * weight div onward")
    return (
        children.where("weight > 0")
        .withColumn("before", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("onward", F.sum("weight").over(onward))
        .withColumn("full", F.col("capacity") <= share)
        .withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0)))
        .withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole))
        .withColumn("given", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("`left` * weight div open")))
        .drop("before", "onward", "full", "left", "open", "budget")
    )


def leaf_budgets(supply: DataFrame, weights: dict[tuple[str, ...], int], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """``supply`` (the three levels, tokens) with ``given``, the token budget of each leaf."""
    paths = [LEVELS[:n] for n in (1, 2, 3)]
    leaf = supply.withColumns({f"w{n}": _weight(weights, p) for n, p in zip((1, 2, 3), paths, strict=True)})
    live = "w1 > 0 and w2 > 0 and w3 > 0"
    leaf = leaf.withColumn("capacity", F.col("tokens") * max_epochs)
    sums = leaf.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(F.when(F.expr(live), F.col("capacity"))), F.lit(0))).first()
    usable = min(sums[0] * share[0] // share[1], sums[1])
    leaf = leaf.where(live)
    tree = {n: leaf.groupBy(*p, *[f"w{k}" for k in range(1, n + 1)]).agg(F.sum("capacity").alias("capacity")) for n, p in zip((1, 2), paths, strict=False)} | {3: leaf}
    given = _fill(tree[1].withColumns({"root": F.lit(0), "budget": F.lit(usable).cast("long"), "weight": F.col("w1")}), ["root"], LEVELS[0])
    for n in (2, 3):
        parent = list(paths[n - 2])
        above = given.select(*parent, F.col("given").alias("budget"))
        given = _fill(tree[n].join(above, parent).withColumn("weight", F.col(f"w{n}")), parent, LEVELS[n - 1])
    return given.select(*LEVELS, "tokens", "given")


def plan(docs: DataFrame, domain: Column, weights: dict[tuple[str, ...], int], share: tuple[int, int], max_epochs: int, seed: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row a leaf: the three levels, ``tokens, given, full`` (whole epochs) and ``cut``, the last
    order key that the next epoch takes (null: none)."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    tokens = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    slim = work_table(docs.select(blank(domain).alias("_domain"), blank(F.col(lang)).alias("_lang"), blank(F.col(source)).alias("_source"), F.col(doc_id).alias("_id"), tokens.alias("_tokens")), "tokens")
    supply = slim.groupBy(*LEVELS).agg(F.sum("_tokens").alias("tokens"))
    leaves = leaf_budgets(supply, weights, share, max_epochs)
    leaves = leaves.withColumn("full", F.least(F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(F.lit(0)), F.lit(max_epochs)).cast("long"))
    leaves = work_table(leaves.withColumn("rest", F.col("given") - F.col("full") * F.col("tokens")), "leaves")
    some = leaves.where("rest > 0").select(*[F.col(c).alias(f"l{c}") for c in LEVELS], "full", "rest")
    match = [F.col(c) == F.col(f"l{c}") for c in LEVELS]
    inside = slim.join(some, match).select(*LEVELS, "_tokens", "rest", _order_key(seed, F.col("full") + 1, "_id").alias("key"))
    for digits in DIGITS:
        sliced = inside.withColumn("slice", F.substring("key", 1, digits))
        sums = sliced.groupBy(*LEVELS, "slice", "rest").agg(F.sum("_tokens").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("slice"))
        ends = sums.withColumn("upto", upto).where("upto > rest and upto - n <= rest").select(*[F.col(c).alias(f"l{c}") for c in LEVELS], F.col("slice").alias("lslice"), F.expr("rest - (upto - n)").alias("room"))
        ends = work_table(ends, "ends")
        inside = sliced.join(ends, [*match, F.col("slice") == F.col("lslice")]).select(*LEVELS, "_tokens", F.col("room").alias("rest"), "key")
    run = F.sum("_tokens").over(Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    taken = inside.withColumn("upto", run).where("upto <= rest").groupBy(*LEVELS).agg(F.max("key").alias("last"))
    # without a document in the last slice the prefix ends before it
    cuts = ends.select(*[F.col(f"l{c}").alias(c) for c in LEVELS], "lslice").join(taken, list(LEVELS), "left").select(*LEVELS, F.coalesce("last", "lslice").alias("cut"))
    return leaves.join(cuts, list(LEVELS), "left").select(*LEVELS, "tokens", "given", "full", F.when(F.col("rest") > 0, F.coalesce("cut", F.lit("g"))).alias("cut"))


def mix(docs: DataFrame, domain: Column, weights: dict[tuple[str, ...], int], share: tuple[int, int] = (1, 2), max_epochs: int = 3, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The chosen rows of ``docs``, once for each epoch: ``_row`` (a struct of the columns), the
    three levels and ``epoch``. ``share`` is the budget as a fraction of all tokens."""
    leaves = work_table(plan(docs, domain, weights, share, max_epochs, seed, doc_id, text, lang, source), "mix")
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), blank(domain).alias("_domain"), blank(F.col(lang)).alias("_lang"), blank(F.col(source)).alias("_source"), F.col(doc_id).alias("_id"))
    joined = rows.join(leaves, list(LEVELS))
    more = F.col("cut").isNotNull() & (_order_key(seed, F.col("full") + 1, "_id") <= F.col("cut"))
    copies = (F.col("full") + more.cast("long")).cast("int")
    return joined.withColumn("_copies", copies).where("_copies > 0").select("_row", *LEVELS, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("epoch"))


#: Weights and domains of the registered query and of the pipeline.
WEIGHTS = {("domain0",): 5, ("domain1",): 3, ("domain2",): 2} | {(f"domain{d}", name): w for d in range(3) for name, w in (("en", 4), ("de", 2), ("fr", 2))}


def domain_of(source: str = "source") -> Column:
    number = F.expr(f"coalesce(try_cast(regexp_extract({source}, '[0-9]+$', 0) as bigint), 0)")
    return F.concat(F.lit("domain"), (number % 3).cast("string"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    chosen = mix(docs, domain_of(), WEIGHTS, share=(3, 5), max_epochs=3, seed="mix")
    return chosen.select(F.col("_row.doc_id").alias("doc_id"), F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), "epoch")


def _fill_sql(name: str, source: str, parent: str, child: str) -> str:
    return f"""
{name}_a AS (
  SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight::DOUBLE, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         (sum(weight) OVER (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight::DOUBLE, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS onward
  FROM ({source})
), {name}_b AS (
  SELECT *, (budget >= before AND capacity <= (budget - before) * weight // onward) AS is_full FROM {name}_a
), {name}_c AS (
  SELECT *, (budget - coalesce(sum(capacity) FILTER (is_full) OVER (PARTITION BY {parent}), 0))::BIGINT AS remaining,
         (sum(weight) FILTER (NOT is_full) OVER (PARTITION BY {parent}))::BIGINT AS open FROM {name}_b
), {name} AS (
  SELECT * EXCLUDE (budget), CASE WHEN is_full THEN capacity ELSE remaining * weight // open END AS given FROM {name}_c
)"""


OP7_SQL = f"""
WITH docs AS (
  SELECT doc_id, 'domain' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '[0-9]+$') AS BIGINT), 0) % 3) AS d,
         coalesce(lang, '') AS l, coalesce(source, '') AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens
  FROM documents
), leaf AS (
  SELECT d, l, s, sum(tokens)::BIGINT AS tokens, (sum(tokens) * 3)::BIGINT AS capacity,
         CASE d WHEN 'domain0' THEN 5 WHEN 'domain1' THEN 3 ELSE 2 END AS w1,
         CASE l WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w2
  FROM docs GROUP BY ALL
), root AS (SELECT least(sum(tokens)::BIGINT * 3 // 5, sum(capacity)::BIGINT) AS budget FROM leaf),
{_fill_sql("one", "SELECT d, w1 AS weight, sum(capacity)::BIGINT AS capacity, 0 AS root, any_value(budget) AS budget FROM leaf, root GROUP BY d, w1", "root", "d")},
{_fill_sql("two", "SELECT c.*, p.given AS budget FROM (SELECT d, l, w2 AS weight, sum(capacity)::BIGINT AS capacity FROM leaf GROUP BY d, l, w2) c JOIN one p USING (d)", "d", "l")},
{_fill_sql("three", "SELECT c.d, c.l, c.s, c.tokens, 1 AS weight, c.capacity, p.given AS budget FROM leaf c JOIN two p USING (d, l)", "d, l", "s")},
plan AS (
  SELECT d, l, s, least(CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END, 3) AS whole,
         given - least(CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END, 3) * tokens AS rest FROM three
), keyed AS (
  SELECT docs.*, whole, rest, md5('mix:' || (whole + 1) || ':' || coalesce(doc_id::VARCHAR, '')) AS k FROM docs JOIN plan USING (d, l, s)
), run AS (
  SELECT *, sum(tokens) OVER (PARTITION BY d, l, s ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed
), chosen AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM run)
SELECT doc_id, d AS domain, l AS lang, s AS source, unnest(range(1, copies + 1))::INTEGER AS epoch FROM chosen WHERE copies > 0
"""
