"""Small text and number formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_space(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"\A\s+", ""), r"\s+\z", "")


def ratio_text(ratio: Column, digits: int = 2, symbol: bool = True) -> Column:
    """A share as percent with ``digits`` decimals, or as a number with two more."""
    return F.format_string(f"%.{digits}f%%", ratio * 100) if symbol else F.format_string(f"%.{digits + 2}f", ratio)


def zero_padded(n: Column, width: int = 5) -> Column:
    """At least ``width`` digits; longer numbers aren't cut."""
    s = n.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def hours_minutes_seconds(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def token_after(text: Column, mark: str, delimiter: str = " ") -> Column:
    """What follows the first ``mark`` up to the next delimiter; NULL without the mark."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring_index(F.substr(text, at + len(mark), F.length(text)), delimiter, 1))


def token_before(text: Column, mark: str, delimiter: str = " ") -> Column:
    """What precedes the first ``mark`` back to the delimiter before it; NULL without the mark."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring_index(F.substr(text, F.lit(1), at - 1), delimiter, -1))


def contained(start: Column, end: Column, pos: Column, tolerance: int = 10) -> Column:
    """Whether ``pos`` lies strictly within the bounds widened by ``tolerance``; the bounds may be swapped."""
    return (pos > F.least(start, end) - tolerance) & (pos < F.greatest(start, end) + tolerance)
