"""Aggregation pushed below a join, for keys that hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _state(df: DataFrame, keys: Sequence[str], sums: Sequence[str], count: str, prefix: str, attributes: Sequence[str] = ()) -> DataFrame:
    kept = df.select(*keys, *attributes, *sums)
    for k in keys:
        kept = kept.filter(F.col(k).isNotNull())
    return kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(count),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{prefix}sum_{c}") for c in sums],
        *[F.min(c).alias(c) for c in attributes],
    )


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
    products: Sequence[tuple[str, str]] = (),
    how: str = "left",
    roll_up: Sequence[str] | None = None,
    right_attributes: Sequence[str] = (),
) -> DataFrame:
    """Aggregate ``left JOIN right ON keys`` per key without building a joined row.

    Each side is first reduced to one compact state per join key (row count and sums, with Spark's map-side
    partial aggregation, so a hot key sends one row per map task), the states are joined, and what the join
    would have produced follows by algebra: ``pairs = n_left * n_right``, the joined sum of a left column is
    ``sum * n_right`` and the other way round, the joined sum of a product is ``sum_left * sum_right``. The
    states are then rolled up to ``roll_up`` (default: the join keys), which may be ``right_attributes``: columns that
    the right side's key determines, as a dimension's (of several values the least is taken).

    Result: the ``roll_up`` columns, ``n_left``, ``n_right``, ``pairs``, ``left_sum_<c>``, ``right_sum_<c>``
    (per-side sums), ``joined_left_sum_<c>``, ``joined_right_sum_<c>`` (over joined rows) and
    ``joined_product_<a>_<b>``. Rows with a NULL key join nothing and are left out; NULL values count as rows
    and add nothing; a key that only one side has gets zeros for the other (``how`` = left or inner or full).
    An empty side gives an empty or all-zero result; keys named as a result column raise ValueError. Only the named columns are read, so further columns of
    the same names on both sides don't matter.
    """
    roll_up = list(keys if roll_up is None else roll_up)
    if clash := {"n_left", "n_right", "pairs", "total"} & {*keys}:
        raise ValueError(f"rename the keys {sorted(clash)}: the result has columns of these names")
    a = _state(left, keys, left_sums, "n_left", "left_")
    b = _state(right, keys, right_sums, "n_right", "right_", right_attributes)
    states = a.join(b, list(keys), how)
    named = [*keys, *right_attributes]
    zero = [c for c in states.columns if c not in named]
    states = states.select(*named, *[F.coalesce(c, F.lit(0)).alias(c) for c in zero])
    pairs = F.col("n_left") * F.col("n_right")
    joined = states.select(
        *named,
        *zero,
        pairs.alias("pairs"),
        *[(F.col(f"left_sum_{c}") * F.col("n_right")).alias(f"joined_left_sum_{c}") for c in left_sums],
        *[(F.col(f"right_sum_{c}") * F.col("n_left")).alias(f"joined_right_sum_{c}") for c in right_sums],
        *[(F.col(f"left_sum_{x}") * F.col(f"right_sum_{y}")).alias(f"joined_product_{x}_{y}") for x, y in products],
    )
    if roll_up == list(keys):
        return joined
    return joined.groupBy(*roll_up).agg(*[F.sum(c).alias(c) for c in joined.columns if c not in named])


def heavy_keys(states: DataFrame, key: str, count: str, share: tuple[int, int]) -> DataFrame:
    """The states whose ``count`` is at least ``share`` (numerator, denominator) of the total, with the total.

    The total is a scalar subquery over the states: one row, whatever the input.
    """
    total = states.agg(F.coalesce(F.sum(count), F.lit(0)).alias("t")).scalar()
    return states.withColumn("total", total).filter(F.col(count) * share[1] >= F.col("total") * share[0]).filter(F.col(count) > 0)
