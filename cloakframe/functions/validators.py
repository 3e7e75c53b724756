"""Checks of whole values by check digit, each as a Catalyst expression and as a function.

The expressions read prepared columns: ``digits``, an array of the 8 to 19 digits of a value
made of digits, spaces and dashes (null else), and ``letters``, a value in the shape of a health
number in upper case (null else). A plan computes them once a value, in a projection
of its own; ``is_card`` and the others put both steps together for a single use.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import ABN_WEIGHTS, IRD_SECOND_WEIGHTS, IRD_WEIGHTS, MEDICARE_WEIGHTS, NHI_LETTERS, NHI_WEIGHTS, TFN_WEIGHTS

_PARTED = r"[ -]"
_DIGITAL = r"\A[ -]*+(?:[0-9][ -]*+){8,19}+\z"
_LETTERED = r"\A(?i:[a-hj-np-z]{3}(?:[0-9]{4}|[0-9]{2}[a-hj-np-z]{2}))\z"


def digits(s: Column) -> Column:
    """The digits of a value that a digit check can accept, as an array; null for other values."""
    return F.when(s.rlike(_DIGITAL), F.split(F.translate(s, " -", ""), "").cast("array<int>"))


def letters(s: Column) -> Column:
    """A value in the shape of a health number, in upper case; null for other values."""
    return F.when((F.length(s) == 7) & s.rlike(_LETTERED), F.upper(s))


def _weighted(d: Column, weights: list[int]) -> Column:
    return sum((F.get(d, F.lit(k)) * w for k, w in enumerate(weights)), F.lit(0))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def card_digits(d: Column) -> Column:
    return F.size(d).between(13, 19) & F.call_function("luhn_check", F.array_join(d.cast("array<string>"), ""))


def abn_digits(d: Column) -> Column:
    return (F.size(d) == 11) & (F.get(d, F.lit(0)) != 0) & ((_weighted(d, ABN_WEIGHTS) - ABN_WEIGHTS[0]) % 89 == 0)


def medicare_digits(d: Column) -> Column:
    return (F.size(d) == 10) & F.get(d, F.lit(0)).between(2, 6) & (_weighted(d, MEDICARE_WEIGHTS) % 10 == F.get(d, F.lit(8)))


def tfn_digits(d: Column) -> Column:
    return (F.size(d) == 9) & (_weighted(d, TFN_WEIGHTS) % 11 == 0)


def ird_digits(d: Column) -> Column:
    short = F.size(d) == 8  # a zero stands before eight digits
    first = (11 - F.when(short, _weighted(d, IRD_WEIGHTS[1:])).otherwise(_weighted(d, IRD_WEIGHTS)) % 11) % 11
    second = (11 - F.when(short, _weighted(d, IRD_SECOND_WEIGHTS[1:])).otherwise(_weighted(d, IRD_SECOND_WEIGHTS)) % 11) % 11
    last = F.element_at(d, -1)
    return F.size(d).between(8, 9) & ((first == last) | ((first == 10) & (second == last)))  # a second 10 equals no digit


def nhi_letters(u: Column) -> Column:
    """Whether the last place is the check digit (by eleven) or check letter (by 23)."""
    place = lambda k: F.call_function("locate", F.substring(u, k, 1), F.lit(NHI_LETTERS))
    digit = lambda k: F.ascii(F.substring(u, k, 1)) - 48
    head = place(1) * NHI_WEIGHTS[0] + place(2) * NHI_WEIGHTS[1] + place(3) * NHI_WEIGHTS[2] + digit(4) * NHI_WEIGHTS[3] + digit(5) * NHI_WEIGHTS[4]
    old = (head + digit(6) * NHI_WEIGHTS[5] + digit(7)) % 11 == 0
    return F.when(F.substring(u, 6, 1) <= "9", old).otherwise(place(7) == 23 - (head + place(6) * NHI_WEIGHTS[5]) % 23)


def parted(s: Column) -> Column:
    return s.rlike(_PARTED)


def is_card(s: Column) -> Column:
    return _sure(card_digits(digits(s)))


def is_abn(s: Column) -> Column:
    return _sure(abn_digits(digits(s)))


def is_medicare(s: Column) -> Column:
    return _sure(medicare_digits(digits(s)))


def is_tfn(s: Column) -> Column:
    return _sure(parted(s) & tfn_digits(digits(s)))


def is_ird(s: Column) -> Column:
    return _sure(parted(s) & ird_digits(digits(s)))


def is_nhi(s: Column) -> Column:
    return _sure(nhi_letters(letters(s)))


# the same rules over Python strings, for values inside JSON text


def _digits(s: str, low: int, high: int, parted: bool = False) -> list[int] | None:
    if not re.fullmatch(r"[0-9 -]*", s) or (parted and not re.search(_PARTED, s)):
        return None
    d = [int(c) for c in s if c.isdigit()]
    return d if low <= len(d) <= high else None


def _dot(d: list[int], weights: list[int]) -> int:
    return sum(a * w for a, w in zip(d, weights, strict=False))


def card(s: str) -> bool:
    d = _digits(s, 13, 19)
    return d is not None and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0


def abn(s: str) -> bool:
    d = _digits(s, 11, 11)
    return d is not None and d[0] != 0 and (_dot(d, ABN_WEIGHTS) - ABN_WEIGHTS[0]) % 89 == 0


def medicare(s: str) -> bool:
    d = _digits(s, 10, 10)
    return d is not None and 2 <= d[0] <= 6 and _dot(d, MEDICARE_WEIGHTS) % 10 == d[8]


def tfn(s: str) -> bool:
    d = _digits(s, 9, 9, parted=True)
    return d is not None and _dot(d, TFN_WEIGHTS) % 11 == 0


def ird(s: str) -> bool:
    d = _digits(s, 8, 9, parted=True)
    if d is None:
        return False
    d = [0] * (9 - len(d)) + d
    first = -_dot(d, IRD_WEIGHTS) % 11
    return (first if first != 10 else -_dot(d, IRD_SECOND_WEIGHTS) % 11) == d[8]


def nhi(s: str) -> bool:
    if not re.fullmatch(r"(?i)(?a:[a-hj-np-z]{3}(?:[0-9]{4}|[0-9]{2}[a-hj-np-z]{2}))", s) or not s.isascii():
        return False
    u = s.upper()
    total = sum((int(c) if c.isdigit() else NHI_LETTERS.index(c) + 1) * w for c, w in zip(u, NHI_WEIGHTS, strict=False))
    return -total % 11 == int(u[6]) if u[6].isdigit() else NHI_LETTERS[22 - total % 23] == u[6]


#: Checks of digits in the order in which they are tried: name, label, expression over the
#: digits, whether the value must have separators, function over the value.
DIGIT_CHECKS: list[tuple[str, str, Callable[[Column], Column], bool, Callable[[str], bool]]] = [
    ("luhn", "credit_card", card_digits, False, card),
    ("abn", "tax_id", abn_digits, False, abn),
    ("medicare", "health", medicare_digits, False, medicare),
    ("tfn", "tax_id", tfn_digits, True, tfn),
    ("ird", "tax_id", ird_digits, True, ird),
]
NHI = ("nhi", "health")
#: Every check over a Python string, in order: name, label, function.
CHECKS: list[tuple[str, str, Callable[[str], bool]]] = [*((name, label, f) for name, label, _, _, f in DIGIT_CHECKS), (*NHI, nhi)]
