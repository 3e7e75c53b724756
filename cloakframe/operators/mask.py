"""Whole-cell masking of any DataFrame, of nested columns, and of JSON payloads.

Names are decided once, when the plan is built; a named column's values are never looked
at. Other strings go through the cascade, in projections inside the scan's own stage: no
shuffle, filters and pruning of the query below keep working. Python workers appear only
for hashing and for strings that look like JSON, and get nulls for all other rows.

Strings in structs are taken out, judged like columns and put back; those in arrays and maps are
judged by one ``transform``, whose result has value, labels and warnings of each element.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cascade
from ..functions.hashing import pseudonym_column
from ..functions.names import classify, classify_column
from ..functions.validators import CHECKS, digits, letters
from ..functions.walk import Walker, dump, parse
from ..plans.config import Config

_LABELS, _WARNINGS = "array<string>", "array<struct<column:string,pattern:string,score:double>>"
_JSON = "text string, labels array<string>, warnings array<string>"


def named(name: str, config: Config, forced: dict[str, str]) -> str | None:
    """The label that a column's name alone decides."""
    low = name.lower()
    if low in config.allowed:
        return None
    return forced.get(low) or classify(name) or (low if low in config.denied else None)


def _named_column(key: Column, config: Config, forced: dict[str, str]) -> Column:
    """:func:`named` for names that are data, the keys of a map."""
    low = F.lower(key)
    options = [F.when(low == k, F.lit(v)) for k, v in forced.items()]
    options += [classify_column(key), F.when(low.isin(*config.denied), low)]
    return F.when(~low.isin(*config.allowed) if config.allowed else F.lit(True), F.coalesce(*options))


def _placeholder(label: Column, value: Column, config: Config, inner: bool) -> Column:
    shown = label
    if config.hash_values:
        shown = F.concat_ws(":", label, (pseudonym_native if inner else pseudonym_column)(value, config.hash_salt, config.hash_digits))
    before, mark, after = config.redaction.partition("{type}")
    if not mark:
        return F.lit(config.redaction)
    return F.replace(F.lit(config.redaction), F.lit("{type}"), shown) if "{type}" in after else F.concat(F.lit(before), shown, F.lit(after))


def pseudonym_native(value: Column, salt: str, digits: int = 8) -> Column:
    """The pseudonym as an expression, for places where no Python function can stand (inside
    arrays and maps): FNV-1a on two 32-bit halves, as a product of 64 bits would overflow."""
    low32 = F.lit(0xFFFFFFFF).cast("long")
    raw = F.concat(F.lit(salt.encode() + b"\0"), F.encode(value, "UTF-8"))
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long")

    def step(h: Column, i: Column) -> Column:
        low = h["lo"].bitwiseXOR(byte(i))
        p = low * 435
        hi = (h["hi"] * 435 + F.shiftright(p, 32) + F.shiftleft(low, 8)).bitwiseAND(low32)
        return F.struct(hi.alias("hi"), p.bitwiseAND(low32).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    eight = lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))
    shown = lambda h: F.concat(eight(h["hi"]), eight(h["lo"])) if digits == 16 else eight(h["hi"].bitwiseXOR(h["lo"]))
    return F.aggregate(F.sequence(F.lit(1), F.octet_length(raw)), start, step, shown)


def json_udf(config: Config, forced: dict[str, str], key: str | None):
    """Masks JSON text; text that is not JSON gives null. A failure gives an error object, never the text."""

    @F.pandas_udf(_JSON)
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for s in values:
            try:
                parse(s)
            except (ValueError, RecursionError, TypeError):
                rows.append((None, None, None))
                continue
            try:
                w = Walker(config, forced)
                rows.append((w.text(s, key), sorted(w.summary.counts.elements()), w.summary.warnings))
            except Exception:  # noqa: BLE001  fail closed
                rows.append(('{"error":"redaction failed"}', [], []))
        return pd.DataFrame(rows, columns=["text", "labels", "warnings"])

    return run


@dataclass
class _Cell:
    value: Column
    labels: Column | None = None  # of what was masked in it; None: nothing can be
    warnings: Column | None = None


class _Layers:
    """The projections below the result: what is computed once and read by name."""

    def __init__(self, config: Config, forced: dict[str, str]):
        self.config, self.forced = config, forced
        self.json: dict[str, Column] = {}
        self.free: dict[str, Column] = {}
        self.nested: dict[str, Column] = {}

    def _name(self) -> str:
        return f"__{len(self.free) + len(self.nested)}"

    def string(self, col: Column, name: str, json: bool) -> _Cell:
        """A string outside arrays and maps."""
        own = named(name, self.config, self.forced)
        if own is not None:
            masked = col.isNotNull() & ~cascade.is_placeholder(col, self.config.redaction) if "{type}" in self.config.redaction else col.isNotNull()
            return _Cell(F.when(masked, _placeholder(F.lit(own), col, self.config, False)).otherwise(col), F.when(masked, F.array(F.lit(own))), None)
        at = self._name()
        self.free[at] = col
        found = F.col(at)
        value = F.when(found["label"].isNotNull(), _placeholder(found["label"], col, self.config, False)).otherwise(col)
        labels = F.when(found["label"].isNotNull(), F.array(found["label"]))
        warnings = F.when(found["pattern"].isNotNull(), F.array(_warning(name, found)))
        if json:
            kept = cascade.is_placeholder(col, self.config.redaction)
            self.json[f"{at}j"] = json_udf(self.config, self.forced, name)(F.when(cascade.looks_json(col) & ~kept, col))
            walked = F.col(f"{at}j")
            inside = F.transform(walked["warnings"], lambda w: F.struct(F.lit(name).alias("column"), w.alias("pattern"), F.lit(None).cast("double").alias("score")))
            value = F.when(walked["text"].isNotNull(), walked["text"]).otherwise(value)
            labels = F.when(walked["text"].isNotNull(), walked["labels"]).otherwise(labels)
            warnings = F.when(walked["text"].isNotNull(), inside).otherwise(warnings)
        return _Cell(value, labels, warnings)

    def inner(self, col: Column, name: str, kind: T.DataType, label: Column | None = None) -> Column:
        """``struct<v, l, w>`` of a value inside an array or a map."""
        none, quiet = F.array().cast(_LABELS), F.array().cast(_WARNINGS)
        three = lambda v, l, w: F.struct(v.alias("v"), l.alias("l"), w.alias("w"))  # noqa: E731, E741
        if isinstance(kind, T.StringType):
            if label is None and (own := named(name, self.config, self.forced)) is not None:
                label = F.lit(own)

            def of(x: Column) -> Column:
                h = x["h"]
                value = F.when(h["label"].isNotNull(), _placeholder(h["label"], x["s"], self.config, True)).otherwise(x["s"])
                return three(value, F.when(h["label"].isNotNull(), F.array(h["label"])).otherwise(none), F.when(h["pattern"].isNotNull(), F.array(_warning(name, h))).otherwise(quiet))

            prepared = F.struct(col.alias("s"), digits(col).alias("d"), letters(col).alias("l"))
            judge = lambda x: F.struct(x["s"].alias("s"), F.when(x["s"].isNotNull(), cascade.verdict(x["s"], x["d"], x["l"], self.config, label)).alias("h"))
            return cascade.bound(prepared, lambda x: cascade.bound(judge(x), of))
        if isinstance(kind, T.StructType):
            parts = F.struct(*[self.inner(col[f.name], f.name, f.dataType).alias(f"f{k}") for k, f in enumerate(kind.fields)])
            if not kind.fields:
                return three(col, none, quiet)

            def joined(p: Column) -> Column:
                own = [p[f"f{k}"] for k in range(len(kind.fields))]
                value = F.struct(*[x["v"].alias(f.name) for x, f in zip(own, kind.fields, strict=True)])
                return three(F.when(p["f0"].isNotNull(), value), F.concat(*[x["l"] for x in own]), F.concat(*[x["w"] for x in own]))

            return F.when(col.isNotNull(), cascade.bound(parts, joined)).otherwise(three(F.lit(None).cast(kind), none, quiet))
        if isinstance(kind, T.ArrayType):
            each = F.transform(col, lambda x: self.inner(x, name, kind.elementType, label))
            return cascade.bound(each, lambda e: three(e["v"], F.coalesce(F.flatten(e["l"]), none), F.coalesce(F.flatten(e["w"]), quiet)))
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            key = lambda k: _named_column(k, self.config, self.forced)
            each = F.transform(F.map_entries(col), lambda e: F.struct(e["key"].alias("k"), self.inner(e["value"], name, kind.valueType, key(e["key"])).alias("x")))
            return cascade.bound(each, lambda e: three(F.map_from_arrays(e["k"], e["x"]["v"]), F.coalesce(F.flatten(e["x"]["l"]), none), F.coalesce(F.flatten(e["x"]["w"]), quiet)))
        return three(col, none, quiet)

    def cell(self, col: Column, name: str, kind: T.DataType, json: bool) -> _Cell:
        """A column, or a field of structs."""
        if isinstance(kind, T.StringType):
            return self.string(col, name, json)
        if isinstance(kind, T.StructType):
            parts = {f.name: self.cell(col[f.name], f.name, f.dataType, json) for f in kind.fields}
            built = F.struct(*[p.value.alias(n) for n, p in parts.items()]) if parts else col
            return _Cell(F.when(col.isNotNull(), built), _all([p.labels for p in parts.values()], _LABELS), _all([p.warnings for p in parts.values()], _WARNINGS))
        if isinstance(kind, T.ArrayType) or (isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType)):
            at = self._name()
            self.nested[at] = self.inner(col, name, kind)
            return _Cell(F.col(at)["v"], F.col(at)["l"], F.col(at)["w"])
        return _Cell(col)

    def below(self, df: DataFrame) -> DataFrame:
        """``df`` with everything that the cells read."""
        named = {**self.json, **self.nested}
        taken = [n for n in [*named, *self.free] if n in df.columns]
        if taken:
            raise ValueError(f"the table has a column {taken[0]} of its own")
        first = df.select("*", *[c.alias(n) for n, c in named.items()]) if named else df
        return cascade.judged(first, self.free, self.config) if self.free else first


def _warning(name: str, found: Column) -> Column:
    return F.struct(F.lit(name).alias("column"), found["pattern"].alias("pattern"), found["score"].alias("score"))


def _all(parts: list[Column | None], kind: str) -> Column | None:
    have = [F.coalesce(p, F.array().cast(kind)) for p in parts if p is not None]
    return F.concat(*have) if have else None


@dataclass
class Masked:
    """The masked rows, and what was done, as DataFrames over one plan."""

    rows: DataFrame  # the masked columns, then __labels and __warnings of each row
    warnings_of_plan: list[str]
    possible: list[str]  # labels that the plan can give to columns outside maps

    @property
    def data(self) -> DataFrame:
        return self.rows.drop("__labels", "__warnings")

    def counts(self) -> DataFrame:
        """``label, count``."""
        return self._each("__labels").where("x is not null").groupBy(F.col("x").alias("label")).count()

    def warnings(self) -> DataFrame:
        """``column, pattern, score, count``: cells that look suspicious, aggregated."""
        return self._each("__warnings").where("x is not null").groupBy("x.column", "x.pattern", "x.score").count()

    def _each(self, column: str) -> DataFrame:
        # from a plain explode Catalyst infers a filter, whose copy of the cascade goes below it
        return self.rows.select(F.explode_outer(column).alias("x"))

    def summary(self) -> DataFrame:
        """One row: ``redacted, types, type_counts``."""
        agg = self.counts().agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("redacted"), F.sort_array(F.collect_list("label")).alias("types"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "count")))).alias("type_counts"))
        return agg

    def observed(self) -> tuple[DataFrame, Observation]:
        """``data``, and an observation that is filled while it is written: ``redacted``, ``warned``
        and the count of each possible label. Rows and counts then cost one scan."""
        seen = Observation()
        each = [F.sum(F.size(F.filter("__labels", (lambda n: lambda x: x == n)(name)))).alias(name) for name in self.possible]
        rows = self.rows.observe(seen, F.sum(F.size("__labels")).alias("redacted"), F.sum(F.size("__warnings")).alias("warned"), *each)
        return rows.drop("__labels", "__warnings"), seen


def mask(df: DataFrame, config: Config | None = None, forced: dict[str, str] | None = None, warnings: list[str] | None = None, json_columns: set[str] | None = None) -> Masked:
    """``df`` with sensitive strings replaced, types and column order unchanged.

    ``json_columns`` limits the search for JSON text to these columns (None: every string
    column outside arrays and maps; an empty set: none, and no Python worker).
    """
    config = config or Config()
    forced = {k.lower(): v for k, v in (forced or {}).items()}
    none, quiet = F.array().cast(_LABELS), F.array().cast(_WARNINGS)
    if not config.enabled:
        return Masked(df.select("*", none.alias("__labels"), quiet.alias("__warnings")), [], [])
    layers = _Layers(config, forced)
    cells = {f.name: layers.cell(F.col(f"`{f.name}`"), f.name, f.dataType, json_columns is None or f.name in json_columns) for f in df.schema.fields}
    labels, quiets = _all([c.labels for c in cells.values()], _LABELS), _all([c.warnings for c in cells.values()], _WARNINGS)
    rows = layers.below(df).select(*[c.value.alias(n) for n, c in cells.items()], (none if labels is None else labels).alias("__labels"), (quiet if quiets is None else quiets).alias("__warnings"))
    by_name = [own for name in _names(df.schema) if (own := named(name, config, forced)) is not None]
    by_value = [label for _, label, _ in CHECKS] + [name for name, _, c in config.rules() if config.certain(c)]
    return Masked(rows, warnings or [], sorted({*by_name, *by_value}))


def _names(kind: T.DataType) -> list[str]:
    """Names of all fields, nested ones included."""
    if isinstance(kind, T.StructType):
        return [n for f in kind.fields for n in (f.name, *_names(f.dataType))]
    if isinstance(kind, T.ArrayType):
        return _names(kind.elementType)
    return _names(kind.valueType) if isinstance(kind, T.MapType) else []


def decisions(df: DataFrame, config: Config | None = None, forced: dict[str, str] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Why each string cell was masked or not: the columns ``keys``, then ``column, step, label,
    pattern, score, name_checks``, a row for each string column outside arrays and maps, in order.

    ``step``: ``forced``, ``name``, ``denylist``, ``json`` (fields inside were masked; their labels
    joined by commas), ``json-clean``, a check's name, ``pattern``, ``doubt`` (below the threshold),
    ``placeholder`` or ``none``. ``name_checks`` is false where the allowlist switched them off.
    """
    config = config or Config()
    forced = {k.lower(): v for k, v in (forced or {}).items()}
    layers, out = _Layers(config, forced), []

    def visit(col: Column, name: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                visit(col[f.name], f.name, f.dataType)
        if not isinstance(kind, T.StringType):
            return
        low = name.lower()
        row = lambda step, label, pattern, score: F.when(col.isNotNull(), F.struct(F.lit(name).alias("column"), step.alias("step"), label.cast("string").alias("label"), pattern.cast("string").alias("pattern"), score.cast("double").alias("score"), F.lit(low not in config.allowed).alias("name_checks")))
        null = F.lit(None)
        if (own := named(name, config, forced)) is not None:
            step = "forced" if low in forced else "name" if classify(name) else "denylist"
            kept = cascade.is_placeholder(col, config.redaction)
            out.append(row(F.when(kept, "placeholder").otherwise(step), F.when(~kept, own), null, null))
            return
        layers.string(col, name, True)
        at = list(layers.free)[-1]
        found, walked = F.col(at), F.col(f"{at}j")
        inside = walked["text"].isNotNull()
        joined = F.when(F.size(walked["labels"]) > 0, F.array_join(walked["labels"], ","))
        step = F.when(inside, F.when(joined.isNotNull(), "json").otherwise("json-clean")).when(found["pattern"].isNotNull(), "doubt").otherwise(F.coalesce(found["step"], F.lit("none")))
        out.append(row(step, F.when(inside, joined).otherwise(found["label"]), F.when(~inside, found["pattern"]), F.when(~inside, found["score"])))

    for f in df.schema.fields:
        visit(F.col(f"`{f.name}`"), f.name, f.dataType)
    made = layers.below(df).select(*[f"`{k}`" for k in keys], F.explode_outer(F.array(*out)).alias("__d")).where("__d is not null")
    return made.select(*[f"`{k}`" for k in keys], "__d.*")


def mask_payloads(df: DataFrame, column: str, config: Config | None = None, forced: dict[str, str] | None = None, warnings: list[str] | None = None, out: str = "masked") -> DataFrame:
    """``df`` with ``out``: a struct of the masked JSON payload (other text passes unchanged),
    ``total`` and ``type_counts``. A failure gives an error object, never the payload."""
    config = config or Config()
    plan_warnings = warnings or []

    @F.pandas_udf("value string, total long, type_counts map<string,long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            rows = []
            for s in values:
                try:
                    tree = parse(s.strip()) if s is not None and config.enabled else None
                except (ValueError, RecursionError):
                    tree = None
                if tree is None:
                    rows.append((s, 0, {}))
                    continue
                try:
                    w = Walker(config, forced, plan_warnings)
                    rows.append((dump(w.payload(tree)), w.summary.redacted, dict(w.summary.counts)))
                except Exception:  # noqa: BLE001  fail closed
                    rows.append(('{"error":"redaction failed"}', 0, {}))
            yield pd.DataFrame(rows, columns=["value", "total", "type_counts"])

    return df.withColumn(out, run(F.col(column)))
