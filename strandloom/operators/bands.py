"""Joins under positional tolerance and of intervals, as equi-joins on bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions per bin of the interval join.
BIN = 1 << 14


def _near(pos: Column, tolerance: int) -> Column:
    """The bins that a position within tolerance may lie in."""
    b = F.floor(pos / (tolerance + 1))
    return F.array(b - 1, b, b + 1)


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ends: Sequence[str] = ("start_pos", "end_pos"), tolerance: int = 10, how: str = "inner") -> DataFrame:
    """Rows of ``left`` and ``right`` with equal ``keys`` whose every position in ``ends`` differs by ``tolerance`` at most.

    The right side's columns come back with the prefix ``r_``. ``how`` may be inner, left, left_semi or
    left_anti. Give each side its distinct positions with counts rather than copies: pairs of copies are not
    wanted and bins then hold a bounded number of rows. NULL keys or positions match nothing.
    """
    first = ends[0]
    a = left.withColumn("__bin", F.floor(F.col(first) / (tolerance + 1)))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("__rbin", F.explode(_near(F.col(f"r_{first}"), tolerance)))
    on = F.col("__bin") == F.col("__rbin")
    for k in keys:
        on &= F.col(k) == F.col(f"r_{k}")
    for e in ends:
        on &= F.abs(F.col(e) - F.col(f"r_{e}")) <= tolerance
    return a.join(b, on, how).drop("__bin", "__rbin")


def representatives(calls: DataFrame, keys: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Distinct calls with their number of ``copies``."""
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), *[F.sum(c).alias(c) for c in sums])


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ends: tuple[str, str], right_ends: tuple[str, str], condition: Column, bin_size: int = BIN) -> DataFrame:
    """Rows with equal ``key`` whose closed intervals overlap and that meet ``condition``.

    Both sides go to every bin they touch; a pair comes out in the bin where the later of the two begins, so
    only once. Column names of both sides must differ but for ``key``. An interval costs a row per ``bin_size``
    positions it spans, so choose it by the usual length.
    """
    def binned(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        s, e = F.floor(F.col(ends[0]) / bin_size), F.floor(F.col(ends[1]) / bin_size)
        return df.filter(F.col(ends[0]) <= F.col(ends[1])).withColumn("__bin", F.explode(F.sequence(s, e)))

    pairs = binned(left, left_ends).join(binned(right, right_ends), [key, "__bin"])
    (ls, le), (rs, re_) = left_ends, right_ends
    begins = F.floor(F.greatest(ls, rs) / bin_size)
    return pairs.filter((F.col(ls) <= F.col(re_)) & (F.col(rs) <= F.col(le)) & (begins == F.col("__bin")) & condition).drop("__bin")
