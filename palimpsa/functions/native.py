"""Filters on typed columns: constants are clamped to what the column can hold.

A number outside a column's domain makes a leaf constant; a fraction against an
integer column moves to the next integer on the side the comparison needs.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

INT64_LOW, INT64_HIGH = -(2**63), 2**63 - 1
#: Integers up to here have a double of their own.
SAFE = 2**53


def int64_bound(op: str, value: int | float | Decimal) -> tuple[str, int] | bool:
    """An equivalent comparison with a 64-bit integer, or the constant truth of the leaf."""
    exact = Decimal(repr(value)) if isinstance(value, float) else Decimal(value)
    whole = exact == exact.to_integral_value()
    if op == "eq":
        return ("eq", int(exact)) if whole and INT64_LOW <= exact <= INT64_HIGH else False
    if op == "ne":
        return ("ne", int(exact)) if whole and INT64_LOW <= exact <= INT64_HIGH else True
    if op in ("gt", "gte"):
        low = math.floor(exact) + 1 if op == "gt" or not whole else int(exact)
        return True if low <= INT64_LOW else False if low > INT64_HIGH else ("gte", low)
    high = math.ceil(exact) - 1 if op == "lt" or not whole else int(exact)
    return True if high >= INT64_HIGH else False if high < INT64_LOW else ("lte", high)


def double_exact(value: int | Decimal) -> bool:
    """Whether a number can be compared as a double without loss."""
    return abs(value) <= SAFE and Decimal(repr(float(value))) == Decimal(value)


def int64_leaf(column: Column, op: str, value: int | float | Decimal) -> Column:
    """The leaf on an integer column; a null column satisfies nothing."""
    bound = int64_bound(op, value)
    if isinstance(bound, bool):
        return column.isNotNull() & F.lit(bound)
    op, limit = bound
    one = F.lit(limit)
    test = {"eq": column == one, "ne": column != one, "gte": column >= one, "lte": column <= one}[op]
    return F.coalesce(test, F.lit(False))


def like_literal(text: str) -> str:
    """A literal as a LIKE pattern: its wildcards stand for themselves."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
