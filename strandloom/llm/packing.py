"""Filling containers of fixed capacity with items: hierarchical residual packing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import running_totals
from ..session import cut_lineage

#: Items that a first-round group holds on average; how many times fewer groups the next round has; bins that a group of
#: a later round holds on average at most (a round has as many groups as that takes, so no group outgrows a task); and
#: the fill from which a bin is finished.
GROUP = 20_000
FAN_IN = 8
CARRY = 20_000
FULL = 0.98
#: Rounds end where one leaves more than this share of the waiting bins as they are and the next has more than half as many groups.
IDLE = 0.9


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item, items taken from large to small, each into the fullest bin that has room.

    Bins are kept by the room left, and the rooms in use as bits of one number, whose lowest bit at or above
    the item's size is the best fit.
    """
    order = np.argsort(-sizes, kind="stable")
    at = np.empty(len(sizes), dtype=np.int64)
    by_room: dict[int, list[int]] = {}
    rooms, bins = 0, 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        at[i] = b
        left = room - size
        stack = by_room.setdefault(left, [])
        if not stack:
            rooms |= 1 << left
        stack.append(b)
    return at


def _first(table: pa.Table) -> pa.Table:
    sizes, capacity = table["size"].to_numpy(), table["capacity"][0].as_py()
    at = best_fit(sizes, capacity)
    fill = np.bincount(at, weights=sizes).astype(np.int64)
    table = table.append_column("bin", pa.array((np.int64(table["grp"][0].as_py()) << 24) | at))
    return table.append_column("fill", pa.array(fill[at])).append_column("done", pa.array((fill >= FULL * capacity)[at]))


def _merge(table: pa.Table) -> pa.Table:
    fills, bins, capacity = table["fill"].to_numpy(), table["bin"].to_numpy(), table["capacity"][0].as_py()
    order = np.argsort(bins)  # the result doesn't depend on the order of arrival
    fills, bins = fills[order], bins[order]
    at = best_fit(fills, capacity)
    fill = np.bincount(at, weights=fills).astype(np.int64)
    name = np.full(len(fill), np.iinfo(np.int64).max)
    np.minimum.at(name, at, bins)
    columns = {"spec": table["spec"], "capacity": table["capacity"], "bin": pa.array(bins), "into": pa.array(name[at]), "fill": pa.array(fill[at]), "done": pa.array((fill >= FULL * capacity)[at])}
    return pa.table(columns)


def _groups(waiting: DataFrame, before: dict[str, int]) -> tuple[dict[str, int], dict[str, int]]:
    """(bins, groups) of the next round per spec; one row per spec comes to the driver."""
    bins = {r["spec"]: r["n"] for r in waiting.groupBy("spec").agg(F.count(F.lit(1)).alias("n")).collect()}
    return bins, {s: max(-(-n // CARRY), -(-before[s] // FAN_IN)) for s, n in bins.items()}


def pack(items: DataFrame, item: str, size: str, capacities: Sequence[tuple[str, int]]) -> DataFrame:
    """The container of every item (or of every piece of one that exceeds the capacity), for each capacity.

    An item is cut only if it alone exceeds the capacity, into pieces that are full but for the last; full pieces
    are containers at once. Everything else is dealt out to groups of ``GROUP`` by row (so repeated or NULL ids are
    spread too) and packed best-fit within each; bins that are at least ``FULL`` are finished, the others go on as
    items of their own into rounds of best-fit over ``FAN_IN`` times fewer groups, or over more where a group would
    hold more than ``CARRY`` bins. The last round has one group, or is the one that hardly changes anything more
    (as with items above half the capacity). A group's size is thus bounded in every round, and no bin is left out.

    Result: ``spec``, ``capacity``, ``item``, ``piece`` (from 0), ``size`` (of the piece), ``container`` (unique
    per spec; negative for full pieces of cut items), ``fill`` (of the container). Items without size (NULL or 0) take
    no room and get a container too; a NULL ``item`` is an item; repeated rows are items of their own; no items give
    no rows. ``capacities`` are (name, capacity >= 1), each name once; others raise ValueError.
    """
    if any(c is None or c < 1 for _, c in capacities) or len({n for n, _ in capacities}) < len(capacities):
        raise ValueError("capacities need distinct names and a capacity of 1 at least")
    kept = items.select(F.col(item).alias("item"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("whole"), F.monotonically_increasing_id().alias("row"))
    kept = cut_lineage(kept)  # rows keep their numbers from here
    groups = max(1, -(-kept.count() // GROUP))
    specs = F.array(*[F.struct(F.lit(n).alias("spec"), F.lit(int(c)).cast("bigint").alias("capacity")) for n, c in capacities])
    parts = kept.select("*", F.inline(specs)) if capacities else kept.select("*", F.lit("").alias("spec"), F.lit(1).cast("bigint").alias("capacity")).limit(0)
    parts = parts.withColumn("full", F.greatest(F.ceil(F.col("whole") / F.col("capacity")) - 1, F.lit(0)).cast("bigint"))
    rest = F.col("whole") - F.col("full") * F.col("capacity")
    pieces = parts.select("spec", "capacity", "item", F.col("full").alias("piece"), rest.alias("size"), F.pmod(F.xxhash64("row"), F.lit(groups)).alias("grp"))
    schema = T.StructType([*pieces.schema.fields, *[T.StructField(n, t) for n, t in (("bin", T.LongType()), ("fill", T.LongType()), ("done", T.BooleanType()))]])
    packed = cut_lineage(pieces.groupBy("spec", "grp").applyInArrow(_first, schema))
    waiting = packed.filter(~F.col("done")).groupBy("spec", "capacity", "bin").agg(F.max("fill").alias("fill"))
    moved, round_, many = None, 0, {n: groups for n, _ in capacities}
    while groups > 1:
        bins, many = _groups(waiting, many)
        if not bins:
            break
        wide = F.element_at(F.create_map(*[F.lit(x) for pair in many.items() for x in pair]), F.col("spec"))
        dealt = waiting.withColumn("grp", F.pmod(F.xxhash64("bin", F.lit(round_)), wide))
        merged = cut_lineage(dealt.groupBy("spec", "grp").applyInArrow(_merge, "spec string, capacity bigint, bin bigint, into bigint, fill bigint, done boolean"))
        step = merged.select("spec", "bin", "into", "fill")
        if moved is None:
            moved = step
        else:  # where a bin of an earlier round has gone since
            later = step.select("spec", F.col("bin").alias("into"), F.col("into").alias("then"), F.col("fill").alias("later"))
            moved = moved.join(later, ["spec", "into"], "left").select("spec", "bin", F.coalesce("then", "into").alias("into"), F.coalesce("later", "fill").alias("fill"))
        waiting = merged.filter(~F.col("done")).groupBy("spec", "capacity", F.col("into").alias("bin")).agg(F.max("fill").alias("fill"))
        left = {r["spec"]: r["n"] for r in waiting.groupBy("spec").agg(F.count(F.lit(1)).alias("n")).collect()}
        # on with the specs whose bins still become fewer
        going = [s for s, g in many.items() if g > 1 and s in left and (left[s] <= IDLE * bins[s] or 2 * max(-(-left[s] // CARRY), -(-g // FAN_IN)) <= g)]
        if not going:
            break
        waiting, round_ = waiting.filter(F.col("spec").isin(going)), round_ + 1
    out = ["spec", "capacity", "item", "piece", "size", "bin", "fill"]
    if moved is not None:
        # only pieces in bins that were handed on meet the map of where these went
        open_ = packed.filter(~F.col("done")).join(moved.withColumnRenamed("fill", "merged"), ["spec", "bin"], "left")
        open_ = open_.withColumn("bin", F.coalesce("into", "bin")).withColumn("fill", F.coalesce("merged", "fill"))
        packed = packed.filter("done").select(*out).unionByName(open_.select(*out))
    cut = parts.filter("full > 0").withColumn("block", F.shiftright("row", 20))
    cut = running_totals(cut, ["spec"], "block", ["row"], {"upto": "full"})
    cut = cut.select("spec", "capacity", "item", "full", "upto", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
    cut = cut.select("spec", "capacity", "item", "piece", F.col("capacity").alias("size"), (F.col("full") - F.col("piece") - F.col("upto") - 1).alias("bin"), F.col("capacity").alias("fill"))
    return packed.select(*out).unionByName(cut).withColumnRenamed("bin", "container")


def packing_summary(packed: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, the least number of containers that could hold them, and the share of unused room."""
    bins = packed.groupBy("spec", "capacity", "container").agg(F.sum("size").alias("filled"), F.count(F.lit(1)).alias("pieces"), F.count(F.when(F.col("piece") == 1, 1)).alias("cut"))
    per = bins.groupBy("spec", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("filled").alias("total"), F.max("filled").alias("fullest"), F.sum("pieces").alias("pieces"), F.sum("cut").alias("cut_items"))
    return per.select("*", F.ceil(F.col("total") / F.col("capacity")).alias("least_containers"), (1 - F.col("total") / (F.col("capacity") * F.col("containers"))).alias("unused_share"))
