"""The value cascade as layers of projections: check digits, then patterns by confidence.

A value's digits are computed once, then one struct says what was found; whatever uses it reads
fields of that struct. Catalyst keeps projections apart if a costly expression is used more
than once, so nothing is evaluated or compiled twice. Inside arrays and maps, where there is
no projection, a value is bound by a ``transform`` over one element instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import Config
from .rules import PATTERNS
from .validators import DIGIT_CHECKS, NHI, digits, letters, nhi_letters, parted

FOUND = "struct<step:string,label:string,pattern:string,score:double>"

#: What a text must have for a fixed pattern to match: an @, three digits in a row, or two digits
#: after a letter. Each is far cheaper to look for than the pattern.
_AT, _RUN, _AFTER = "at", r"\p{Nd}{3}", r"\p{Nd}{2}(?<=\p{L}\p{Nd}{2})"
_PAIR = r"\p{Nd}{2}"  # what all but the first need
_NEEDS = dict(zip((r[1] for r in PATTERNS), [_AT, _RUN, _RUN, _RUN, _AFTER, _RUN, _RUN, _RUN, _AFTER, _AFTER], strict=True))


def java(regex: str) -> str:
    """A pattern as Java reads it with Unicode classes."""
    return f"(?U){regex}"


def matches(value: Column, regex: str) -> Column:
    """Whether a pattern matches somewhere, after a cheap look for what it needs."""
    need = _NEEDS.get(regex)
    full = value.rlike(java(regex))
    if need is None:
        return full
    return (value.contains("@") if need == _AT else value.rlike(need)) & full


def chain(branches: list[tuple[Column, Column]], default: Column) -> Column:
    if not branches:
        return default
    out = F.when(*branches[0])
    for b in branches[1:]:
        out = out.when(*b)
    return out.otherwise(default)


def is_placeholder(value: Column, template: str) -> Column:
    """Whether a value is already a placeholder of the template."""
    before, mark, after = template.partition("{type}")
    if not mark:
        return F.lit(False)
    return value.startswith(before) & value.endswith(after) & (F.octet_length(value) > len((before + after).encode()))


def looks_json(value: Column) -> Column:
    return value.startswith("{") | value.startswith("[")


def _found(step: str, label: str | None = None, pattern: str | None = None, score: float | None = None) -> Column:
    parts = zip(("step", "label", "pattern", "score"), (step, label, pattern, score), ("string", "string", "string", "double"), strict=True)
    return F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in parts])


def verdict(value: Column, digit: Column, letter: Column, config: Config, known: Column | None = None) -> Column:
    """``FOUND`` of a value, given its :func:`digits` and :func:`letters`: label of what masks
    it (``known``, a label by name, comes first), or pattern and score of the best match below
    the threshold, or only the step ``placeholder``; null where nothing was found.

    Which patterns are certain is known beforehand, so nothing is scored at run time and the first
    hit ends the evaluation.
    """
    rules = config.rules()
    weak = sorted([r for r in rules if not config.certain(r[2])], key=lambda r: -r[2])
    branches = [(is_placeholder(value, config.redaction), _found("placeholder"))] if "{type}" in config.redaction else []
    if known is not None:
        named = F.struct(F.lit("name").alias("step"), known.alias("label"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("double").alias("score"))
        branches.append((known.isNotNull(), named))
    branches += [(check(digit) & parted(value) if apart else check(digit), _found(name, label)) for name, label, check, apart, _ in DIGIT_CHECKS]
    branches.append((nhi_letters(letter), _found(*NHI)))
    if all(regex in _NEEDS for _, regex, _ in rules):  # most texts end here
        branches.append((~value.contains("@") & ~value.rlike(_PAIR), F.lit(None)))
    branches += [(matches(value, regex), _found("pattern", name)) for name, regex, c in rules if config.certain(c)]
    branches += [(matches(value, regex), _found("pattern", None, name, float(c))) for name, regex, c in weak]
    return chain(branches, F.lit(None))


def judged(df: DataFrame, values: dict[str, Column], config: Config) -> DataFrame:
    """``df`` with a column ``FOUND`` for each of ``values``, by two projections."""
    for name in values:
        if name in df.columns:
            raise ValueError(f"the table has a column {name} of its own")
    prepared = df.select("*", *[c for n, v in values.items() for c in (v.alias(f"{n}v"), digits(v).alias(f"{n}d"), letters(v).alias(f"{n}l"))])
    own = [verdict(F.col(f"{n}v"), F.col(f"{n}d"), F.col(f"{n}l"), config).alias(n) for n in values]
    return prepared.select(*[f"`{c}`" for c in df.columns], *own)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, where no projection can stand."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
