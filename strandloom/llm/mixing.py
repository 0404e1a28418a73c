"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running_totals
from ..session import cut_lineage

#: Documents per block of a source, on average, in the running totals.
BLOCK_ROWS = 50_000
#: How far the default schedule leans: weights go from 1 - lean to 1 + lean of the target at most.
LEAN = 0.5


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


def leaning_schedule(targets: Sequence[Target], lean: float = LEAN) -> dict[str, list[tuple[float, float]]]:
    """A straight line per source over the training time 0..1, as knots (time, weight relative to its share).

    Sources that may be repeated more often come later. Leanings cancel out over the shares, so that the
    weights of all sources add up to the same at every time.
    """
    mean = sum(t.share * t.max_repeats for t in targets)
    most = max((abs(t.max_repeats - mean) for t in targets), default=0) or 1
    a = {t.source: lean * (t.max_repeats - mean) / most for t in targets}
    return {s: [(0.0, 1 - x), (1.0, 1 + x)] for s, x in a.items()}


def _segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """The integrated schedule as (demand before, time, length, weight at its start, slope), scaled to a demand of 1."""
    area = sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    out, y = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 > t0 and w0 + w1 > 0:
            out.append(tuple(map(float, (y, t0, t1 - t0, w0 / area, (w1 - w0) / (t1 - t0) / area))))
            y += (w0 + w1) / 2 * (t1 - t0) / area
    return out


@dataclass(frozen=True)
class Mix:
    chosen: DataFrame
    shares: DataFrame


def mix(docs: DataFrame, doc: str, source: str, size: str, targets: Sequence[Target], total: int | str | None = None, schedule: Mapping[str, Sequence[tuple[float, float]]] | None = None, seed: int = 7) -> Mix:
    """Choose documents so that each source gives its share of ``total`` and order them along the schedule.

    A source's demand is its share of ``total`` (default: the size of all documents of the target sources; ``"largest"``:
    the largest at which every source that has documents meets its share within its repeats), or all it has ``max_repeats`` times if that is less; what is missing then isn't made up by others, so they keep
    their proportions. Documents come in an order drawn by hash; the demand is met by whole rounds over them and
    then by the documents up to the rest, to the nearest document. The cumulative demand of a source over time
    is its integrated schedule; inverted at the cumulative size reached by a document it gives the document's
    training position, and all documents are range-sorted by it.

    ``chosen``: ``doc_id``, ``source``, ``copy`` (from 1), ``size``, ``position`` (0..1), sorted by position.
    ``shares``: one row per target with what it could give and gave, as share of all given and of ``total``. Sources match after trimming and
    lower-casing; documents with another or no source, or without size, aren't chosen. A NULL ``doc`` counts as
    a document; equal rows are documents of their own. Targets without documents have an actual share of 0.
    """
    spark = docs.sparkSession
    names = [t.source for t in targets]
    if len(set(names)) < len(names):
        raise ValueError("a source has two targets")
    rows = docs.select(F.col(doc).alias("doc_id"), F.lower(F.trim(F.col(source))).alias("source"), F.col(size).cast("bigint").alias("size"))
    rows = cut_lineage(rows.filter(F.col("source").isin(names) & (F.col("size") > 0)) if names else rows.limit(0))
    # one row per target source: bounded by the targets
    have = {r["source"]: (r["n"], r["size"]) for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()}
    if total == "largest":
        total = min((t.max_repeats * have[t.source][1] / t.share for t in targets if t.source in have and t.share > 0), default=0)
    total = sum(s for _, s in have.values()) if total is None else total
    schedule = schedule or leaning_schedule(targets)
    plan = []
    for t in targets:
        n, there = have.get(t.source, (0, 0))
        demand = min(float(t.share) * total, float(t.max_repeats * there))
        rounds = int(demand // there) if there else 0
        plan.append((t.source, float(t.share), t.max_repeats, n, there, float(t.share) * total, demand, rounds, demand - rounds * there, _segments(schedule[t.source])))
    segment = "array<struct<y:double,t:double,length:double,w:double,slope:double>>"
    plans = spark.createDataFrame(plan, f"source string, share double, max_repeats int, n bigint, there bigint, wanted double, demand double, rounds int, rest double, segments {segment}")
    bits = max(0, math.ceil(math.log2(max(1, sum(n for n, _ in have.values()) / BLOCK_ROWS))))
    drawn = rows.withColumn("draw", F.xxhash64("doc_id", F.lit(seed))).withColumn("block", F.shiftright("draw", 64 - bits) if bits else F.lit(0).cast("bigint"))
    summed = running_totals(drawn, ["source"], "block", ["draw", "doc_id"], {"upto": "size"})
    planned = summed.join(F.broadcast(plans.filter("demand > 0")), "source")  # one row per target
    middle = F.col("upto") - F.col("size") / 2
    uses = F.col("rounds") + F.when(middle <= F.col("rest"), 1).otherwise(0)
    copies = planned.withColumn("uses", uses).filter("uses > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    y = F.least(F.lit(1.0), ((F.col("copy") - 1) * F.col("there") + middle) / F.col("demand"))
    copies = copies.withColumn("reached", y)
    copies = copies.withColumn("at", F.element_at(F.expr("filter(segments, s -> s.y <= reached)"), -1))
    past = F.col("reached") - F.col("at.y")
    root = F.sqrt(F.greatest(F.lit(0.0), F.col("at.w") * F.col("at.w") + 2 * F.col("at.slope") * past))
    step = F.when(past <= 0, F.lit(0.0)).otherwise(2 * past / (F.col("at.w") + root))
    chosen = copies.select("doc_id", "source", F.col("copy").cast("int").alias("copy"), "size", (F.col("at.t") + F.least(step, F.col("at.length"))).alias("position"))
    given = chosen.groupBy("source").agg(F.sum("size").alias("given"), F.count(F.lit(1)).alias("copies"), F.max("copy").alias("most_uses"), F.countDistinct("doc_id").alias("documents_used"))
    all_given = given.agg(F.sum("given").alias("g")).scalar()
    shares = plans.select("source", "share", "max_repeats", F.col("n").alias("documents"), F.col("there").alias("size"), "wanted", "demand").join(given, "source", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("given", "copies", "most_uses", "documents_used")]
    shares = shares.select("source", F.col("share").alias("target_share"), "max_repeats", "documents", "size", "wanted", *zero, (F.coalesce("given", F.lit(0)) / all_given).alias("actual_share"), F.try_divide(F.coalesce("given", F.lit(0)) * F.col("share"), F.col("wanted")).alias("share_of_total"), (F.col("demand") < F.col("wanted") * (1 - 1e-9)).alias("short"))
    return Mix(chosen.orderBy("position", "source", "doc_id", "copy"), shares)
