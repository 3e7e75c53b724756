"""Which personal-data type a column name means.

``classify`` decides names that are metadata, once per column when a plan is built;
``classify_column`` is the same decision as a Catalyst expression for names that are data
(catalog dumps of any size), with no Python worker.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import CATEGORY_OF, ID_OWNERS, JOINED, NAME_OWNERS, OTHER

_OWNED = [({"name", "names"}, set(NAME_OWNERS), "name"), ({"id", "number"}, set(ID_OWNERS), "id")]


def words(name: str) -> list[str]:
    """Lower-case words of a name: split at other characters and where camel case begins one."""
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z])([A-Z])", r"\1 \2", name))
    return ["".join(w).lower() for w in re.findall(r"[^\W_]+", spaced)]


@cache
def classify(name: str) -> str | None:
    """The type of a column name: longer phrases first, then the leftmost; then owner and noun."""
    w = words(name)
    for size in (3, 2, 1):
        for at in range(len(w) - size + 1):
            if size == 1 and w[at + 1 :] == ["at"]:
                continue  # a time stamp such as mail_at
            if (found := JOINED.get("".join(w[at : at + size]))) is not None:
                return found
    for nouns, owners, label in _OWNED:
        if any(a in owners and b in nouns for a, b in zip(w, w[1:], strict=False)):
            return label
    return None


def category(label: str) -> str:
    return CATEGORY_OF.get(label, OTHER)


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def words_column(name: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def classify_column(name: Column) -> Column:
    """:func:`classify` over a string column; null where no type fits."""
    w, table = words_column(name), _lookup(JOINED)
    n = F.size(w)

    def first(count: Column, at) -> Column:
        found = F.filter(F.transform(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), at), lambda x: x.isNotNull())
        return F.get(found, F.lit(0))

    def phrase(size: int) -> Column:
        def at(i: Column) -> Column:
            hit = F.try_element_at(table, F.array_join(F.slice(w, i, F.lit(size)), ""))
            return hit if size > 1 else F.when(~((i == n - 1) & (F.element_at(w, -1) == "at")), hit)

        return first(n - (size - 1), at)

    def owned(nouns: set[str], owners: set[str], label: str) -> Column:
        return first(n - 1, lambda i: F.when(F.get(w, i - 1).isin(*sorted(owners)) & F.get(w, i).isin(*sorted(nouns)), F.lit(label)))

    return F.coalesce(phrase(3), phrase(2), phrase(1), *(owned(*x) for x in _OWNED))


def category_column(label: Column) -> Column:
    return F.when(label.isNotNull(), F.coalesce(F.try_element_at(_lookup(CATEGORY_OF), label), F.lit(OTHER)))
