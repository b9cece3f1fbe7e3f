"""Numbers as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value worked out once, however often ``of`` names it."""
    return F.transform(F.array(value), of)[0]


def printed(x: Column, digits: int) -> Column:
    """A double with up to three fixed digits as C prints it: its exact value is rounded, and exact halves go to the even neighbour.

    Java's formatter rounds the shortest decimal that names the double, and halves up.  What is after the point is taken in two pieces whose products are exact.
    """
    scale = 10**digits

    def rounded(below: Column, half: Column, rest: Column) -> Column:
        return below + F.when(rest > half, 1).when(rest == half, below % 2).otherwise(0)

    def units(size: Column, part: Column, high: Column) -> Column:
        return let(high * scale, lambda u: let(F.floor(size) * scale + F.floor(u), lambda below: rounded(below, 0.5 - (u - F.floor(u)), (part - high) * scale)))

    n = let(F.abs(x.cast("double")), lambda size: let(size - F.floor(size), lambda part: let(F.floor(part * 2**20) / 2**20, lambda high: units(size, part, high))))
    pattern, parts = ("^(.*)(.{%d})$" % digits, "$1.$2") if digits else ("^$", "")
    text = F.regexp_replace(let(n.cast("string"), lambda s: F.lpad(s, F.greatest(F.length(s), F.lit(digits + 1)), "0")), pattern, parts)
    signed = F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), text)
    return F.when(F.abs(x) < 2.0**50, signed).otherwise(F.format_string(f"%.{digits}f", x))
