"""Running totals that don't gather a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Add inclusive running sums per ``keys`` in the order ``(block, *order)``.

    ``sums`` maps each new column to the column it adds up. ``block`` must rise with the order and should
    hold a bounded number of rows; only one block, and only one row per block of a key, meet in a task, so
    a key that holds a third of all rows is spread over as many tasks as it has blocks. Keys and block must
    not be NULL; rows that tie in ``order`` are taken in any order.
    """
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *[F.sum(c).over(inside).alias(out) for out, c in sums.items()])
    blocks = df.groupBy(*keys, block).agg(*[F.sum(c).alias(f"__{out}") for out, c in sums.items()])
    carried = blocks.select(*keys, block, *[F.coalesce(F.sum(f"__{out}").over(before), F.lit(0)).alias(f"__{out}") for out in sums])
    joined = local.join(carried, [*keys, block])
    return joined.select(*df.columns, *[(F.col(out) + F.col(f"__{out}")).alias(out) for out in sums])


def running_max(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], out: str, column: str, inclusive: bool = True) -> DataFrame:
    """Add the running maximum of ``column`` per ``keys`` in the order ``(block, *order)``.

    As in running_totals, only one block meets in a task. Not ``inclusive``: of the rows before. Rows that tie in
    ``order`` are taken in any order, so give a full order or distinct rows where that matters.
    """
    upto = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", F.max(column).over(inside).alias(out))
    blocks = df.groupBy(*keys, block).agg(F.max(column).alias("__max"))
    carried = blocks.select(*keys, block, F.max("__max").over(before).alias("__max"))
    joined = local.join(carried, [*keys, block])
    return joined.select(*df.columns, F.greatest(out, "__max").alias(out))


def running_both(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], sums: dict[str, str], maxima: dict[str, str]) -> DataFrame:
    """Inclusive running sums and running maxima (of numbers or structs) in one pass; otherwise as ``running_totals``."""
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    what = [(out, c, F.sum) for out, c in sums.items()] + [(out, c, F.max) for out, c in maxima.items()]
    local = df.select("*", *[f(c).over(inside).alias(out) for out, c, f in what])
    blocks = df.groupBy(*keys, block).agg(*[f(c).alias(f"__{out}") for out, c, f in what])
    carried = blocks.select(*keys, block, *[f(f"__{out}").over(before).alias(f"__{out}") for out, _, f in what])
    joined = local.join(carried, [*keys, block])
    total = [(F.col(out) + F.coalesce(f"__{out}", F.lit(0))).alias(out) for out in sums]
    return joined.select(*df.columns, *total, *[F.greatest(out, f"__{out}").alias(out) for out in maxima])


def chains(positions: DataFrame, keys: Sequence[str], pos: str, reach: int, size: int = 1 << 16) -> DataFrame:
    """Distinct (``keys``, ``pos``) with ``chain``: a number per run of positions no more than ``reach`` apart."""
    at = positions.select(*keys, pos).distinct().withColumn("block", F.floor(F.col(pos) / size))
    at = running_max(at, keys, "block", [pos], "__before", pos, inclusive=False)
    at = at.withColumn("__first", F.when(F.col("__before").isNull() | (F.col(pos) - F.col("__before") > reach), 1).otherwise(0))
    return running_totals(at, keys, "block", [pos], {"chain": "__first"}).select(*keys, pos, "chain")
