"""Most frequent items of a huge column: a hierarchical count-sketch, then a second scan."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Odd multipliers for the row hashes are drawn from this seed.
SEED = 20240229
#: Counters that travel together as one array.
CHUNK = 1024
#: Chunks that are added up in one group, sketches that a group adds up at most, and rounds of that before the last one.
BLOCK, TEAM, ROUNDS = 16, 256, 2
#: Rows that a task hashes at once.
BUFFER = 1 << 18


@dataclass(frozen=True)
class SketchShape:
    """``levels``: hash-bit prefixes from coarse to fine; ``width`` counters in each of ``depth`` rows per level.

    Its memory is levels x depth x width x 8 bytes, whatever the input. An estimate is off by more than
    sqrt(8 * F2 / width) with a chance that falls as 2^-depth; F2 is the sum of squared weights of all other
    prefixes, at most share / 2 of the squared total while none of them is itself heavy, so a width of
    64 / share keeps the error under a quarter of the threshold.
    """

    levels: tuple[int, ...] = (12, 20, 28, 36, 44)
    depth: int = 7
    width: int = 1 << 15

    @staticmethod
    def for_share(share: float) -> SketchShape:
        return SketchShape(width=1 << max(10, math.ceil(math.log2(64 / share))))

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng(SEED)
        shape = (len(self.levels), self.depth)
        return r.integers(1, 2**63, shape, dtype=np.uint64) | np.uint64(1), r.integers(0, 2**63, shape, dtype=np.uint64)

    def cells(self, prefix: np.ndarray, level: int, row: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counter and sign of each prefix: the top bits of a mixed product, and the bit below them."""
        with np.errstate(over="ignore"):
            x = prefix * a[level, row] + b[level, row]
            x ^= x >> np.uint64(31)
            x = x * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x = x * a[level, row]
        bits = int(math.log2(self.width))
        sign = ((x >> np.uint64(63 - bits)) & np.uint64(1)).astype(np.int64) * 2 - 1
        return (x >> np.uint64(64 - bits)).astype(np.int64), sign


def _partial_sketches(shape: SketchShape):
    a, b = shape.hashes()

    def add(counters: np.ndarray, h: np.ndarray, w: np.ndarray) -> None:
        h, back = np.unique(h, return_inverse=True)  # a hot item becomes one row here
        w = np.bincount(back, weights=w.astype(np.float64))
        for level, bits in enumerate(shape.levels):
            prefix = h >> np.uint64(64 - bits)
            for row in range(shape.depth):
                at, sign = shape.cells(prefix, level, row, a, b)
                counters[level, row] += np.bincount(at, weights=sign * w, minlength=shape.width).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((len(shape.levels), shape.depth, shape.width), dtype=np.int64)
        total, waiting = 0, []
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            w = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            total += int(w.sum())
            waiting.append((h, w))
            if sum(len(x) for x, _ in waiting) >= BUFFER:
                add(counters, *map(np.concatenate, zip(*waiting)))
                waiting = []
        if waiting:
            add(counters, *map(np.concatenate, zip(*waiting)))
        flat = counters.reshape(-1, CHUNK)
        used = np.flatnonzero(flat.any(axis=1))
        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * CHUNK), pa.array(flat[used].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), cells], names=["chunk", "cells"])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([[total, *[0] * (CHUNK - 1)]], pa.list_(pa.int64()))], names=["chunk", "cells"])

    return run


def _add_up(table: pa.Table) -> pa.Table:
    chunks, back = np.unique(table["chunk"].to_numpy(), return_inverse=True)
    added = np.zeros((len(chunks), CHUNK), dtype=np.int64)
    np.add.at(added, back, table["cells"].combine_chunks().flatten().to_numpy().reshape(-1, CHUNK))
    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(chunks) + 1, dtype=np.int32) * CHUNK), pa.array(added.reshape(-1)))
    out = {"chunk": pa.array(chunks), "cells": cells}
    if "team" in table.column_names:
        out["team"] = pa.array(np.full(len(chunks), table["team"][0].as_py(), dtype=np.int32))
    return pa.table(out)


@dataclass(frozen=True)
class Sketch:
    shape: SketchShape
    counters: np.ndarray
    total: int

    def estimate(self, prefix: np.ndarray, level: int) -> np.ndarray:
        """Median over the rows of signed counters."""
        a, b = self.shape.hashes()
        rows = []
        for row in range(self.shape.depth):
            at, sign = self.shape.cells(prefix, level, row, a, b)
            rows.append(self.counters[level, row, at] * sign)
        return np.median(np.stack(rows), axis=0)

    def heavy(self, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Finest prefixes that may be heavy, with their estimates: heavy prefixes are split bit group by bit group.

        A prefix goes on if it is estimated at half the threshold or more. At most 2 / share prefixes can reach
        that but for the sketch's error, so what descends is bounded by the parameter and not by the data.
        """
        least, prefixes, before = self.total * share / 2, np.zeros(1, dtype=np.uint64), 0
        estimates = np.zeros(0)
        for level, bits in enumerate(self.shape.levels):
            step = bits - before
            children = ((prefixes[:, None] << np.uint64(step)) | np.arange(1 << step, dtype=np.uint64)[None, :]).reshape(-1)
            estimates = self.estimate(children, level)
            keep = estimates >= max(least, 1)
            prefixes, estimates, before = children[keep], estimates[keep], bits
        return prefixes, estimates


def build_sketch(items: DataFrame, shape: SketchShape) -> Sketch:
    """Sketch of (hash BIGINT, weight BIGINT) rows. What comes to the driver has the sketch's fixed size.

    Every task adds to one sketch of its own and hands on only counters in use. They are added up in rounds over teams
    of ``TEAM`` tasks, then of as many teams, so a group holds that many times ``BLOCK`` chunks at most, for up to
    ``TEAM`` to the power of the rounds tasks.
    """
    added = items.mapInArrow(_partial_sketches(shape), "chunk int, cells array<bigint>").withColumn("team", F.spark_partition_id())
    for _ in range(ROUNDS):
        dealt = added.select(F.floor(F.col("team") / TEAM).cast("int").alias("team"), F.floor(F.col("chunk") / BLOCK).alias("block"), "chunk", "cells")
        added = dealt.groupBy("team", "block").applyInArrow(_add_up, "chunk int, cells array<bigint>, team int")
    added = added.withColumn("block", F.floor(F.col("chunk") / BLOCK)).drop("team").groupBy("block").applyInArrow(_add_up, "chunk int, cells array<bigint>")
    counters = np.zeros((len(shape.levels), shape.depth, shape.width), dtype=np.int64)
    flat, total = counters.reshape(-1, CHUNK), 0
    for chunk, cells in added.toLocalIterator():
        if chunk < 0:
            total = int(cells[0])
        else:
            flat[chunk] = cells
    return Sketch(shape, counters, total)


def frequent_items(df: DataFrame, item: str, weight: Column | str, share: float, shape: SketchShape | None = None) -> DataFrame:
    """Items whose total weight is at least ``share`` of the total: ``item``, ``estimate``, ``total_weight``.

    First scan: a count-sketch with signed hashes on every level of hash-bit prefixes, from which heavy prefixes
    are recovered. Second scan: rows of recovered prefixes are added up exactly, so a false candidate never
    comes out; a true one is missed only if the median of ``depth`` rows errs by half the threshold.

    ``weight`` must be a positive integer: rows with a NULL item, or a NULL or lesser weight, aren't counted.
    Ties at the threshold all come out; an empty input gives no rows. Further columns are not read.
    """
    shape = shape or SketchShape.for_share(share)
    weight = F.col(weight) if isinstance(weight, str) else weight
    rows = df.select(F.col(item).alias("item"), weight.cast("bigint").alias("w")).filter("item is not null and w >= 1")
    rows = rows.withColumn("h", F.xxhash64("item"))
    sketch = build_sketch(rows.select("h", "w"), shape)
    prefixes, estimates = sketch.heavy(share) if sketch.total else (np.zeros(0, np.uint64), np.zeros(0))
    spark = df.sparkSession
    found = {int(p): int(e) for p, e in zip(prefixes, estimates)}
    bits = shape.levels[-1]
    prefix = F.shiftrightunsigned("h", 64 - bits)
    again = rows.withColumn("prefix", prefix).filter(F.col("prefix").isin(list(found)) if found else F.lit(False))
    exact = again.groupBy("item", "prefix").agg(F.sum("w").alias("total_weight"))
    estimate = spark.createDataFrame(list(found.items()), "prefix bigint, estimate bigint")
    exact = exact.join(F.broadcast(estimate), "prefix")  # one row per candidate: bounded by the share
    # the share as a fraction of whole numbers, so that a tie with the threshold is exact
    least = -(-sketch.total * round(share * 10**9) // 10**9)
    return exact.filter(F.col("total_weight") >= F.lit(least)).select(F.col("item").alias(item), "estimate", "total_weight")
