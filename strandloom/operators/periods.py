"""Continuous periods and gaps of overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import running_totals

#: Positions per block. A block has at most this many distinct positions, however many rows lie in it.
BLOCK = 1 << 16


def _ranked(events: DataFrame, key: str) -> DataFrame:
    """Events (key, pos, n_start, n_end) with the running counts of both sorts, ``r_start`` and ``r_end``."""
    at = (
        events.groupBy(key, F.floor(F.col("pos") / F.lit(BLOCK)).alias("block"), "pos")
        .agg(F.sum("n_start").alias("n_start"), F.sum("n_end").alias("n_end"), F.min("next_start").alias("next_start"))
    )
    return running_totals(cut_lineage(at), [key], "block", ["pos"], {"r_start": "n_start", "r_end": "n_end"})


def _event(pos: Column, start: int, end: int, following: Column | None = None) -> Column:
    none = F.lit(None).cast("bigint")
    return F.struct(pos.alias("pos"), F.lit(start).alias("n_start"), F.lit(end).alias("n_end"), (none if following is None else following).alias("next_start"))


def _where(opening: Column, closing: Column) -> Column:
    """One or both, as the position has a start, an end or both."""
    return F.when(F.col("n_end") == 0, F.array(opening)).when(F.col("n_start") == 0, F.array(closing)).otherwise(F.array(opening, closing))


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str, touch: int = 1, longest_gap: int | None = None) -> DataFrame:
    """Maximal covered stretches per ``key`` and the gaps between them.

    ``start`` and ``end`` are inclusive integer positions. Starts and ends are sorted independently per key;
    after rank i there is a break where the start of rank i + 1 lies more than ``touch`` beyond the end of
    rank i. The k-th start that follows a break and the k-th end that precedes one bound period k.

    Both sorts run on counts per distinct position in blocks of positions, and ranks meet in a shuffle on
    (key, rank), so no key is ever gathered in a task. Result: ``key``, ``kind`` (period, gap), ``start_pos``,
    ``end_pos`` (BIGINT). Gaps longer than ``longest_gap`` are left out. Rows with a NULL key or bound, or with
    end before start, are no intervals. Repeated rows and ties change nothing; an empty input gives no rows.
    """
    rows = df.select(F.col(key).alias("k"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))
    rows = rows.filter("k is not null and s is not null and e is not null and s <= e")
    events = rows.select("k", F.inline(F.array(_event(F.col("s"), 1, 0), _event(F.col("e"), 0, 1))))
    ranked = _ranked(events, "k")
    # Both sorts meet on (key, rank). A start that isn't the first of its position, or an end that isn't the last,
    # never bounds a break and may find no partner; the last end of a key has none either, but by then as many
    # have ended as have started.
    no, never = F.lit(None).cast("bigint"), F.lit(None).cast("boolean")
    opens = F.struct((F.col("r_start") - F.col("n_start")).alias("rank"), F.col("pos").alias("q"), no.alias("p"), never.alias("covered"))
    ends = F.struct(F.col("r_end").alias("rank"), no.alias("q"), F.col("pos").alias("p"), (F.col("r_start") == F.col("r_end")).alias("covered"))
    both = ranked.select("k", F.inline(_where(opens, ends)))
    breaks = both.groupBy("k", "rank").agg(F.max("q").alias("q"), F.max("p").alias("p"), F.max("covered").alias("covered"))
    breaks = breaks.filter(f"(p is null and rank = 0) or (p is not null and (q > p + {int(touch)} or (q is null and covered)))")
    closes, starts = F.array(_event(F.col("p"), 0, 1, F.col("q"))), F.array(_event(F.col("q"), 1, 0))
    bounds = breaks.select("k", F.inline(F.when(F.col("p").isNull(), starts).when(F.col("q").isNull(), closes).otherwise(F.concat(closes, starts))))
    opening = F.struct(F.col("r_start").alias("n"), F.col("pos").alias("first"), no.alias("last"), no.alias("next_start"))
    closing = F.struct(F.col("r_end").alias("n"), no.alias("first"), F.col("pos").alias("last"), F.col("next_start"))
    paired = _ranked(bounds, "k").select("k", F.inline(_where(opening, closing)))
    paired = paired.groupBy("k", "n").agg(F.max("first").alias("first"), F.max("last").alias("last"), F.max("next_start").alias("next_start"))
    period = F.struct(F.lit("period").alias("kind"), F.col("first").alias("start_pos"), F.col("last").alias("end_pos"))
    gap = F.struct(F.lit("gap").alias("kind"), (F.col("last") + 1).alias("start_pos"), (F.col("next_start") - 1).alias("end_pos"))
    is_gap = F.col("next_start").isNotNull()
    if longest_gap is not None:
        is_gap &= F.col("next_start") - F.col("last") - 1 <= longest_gap
    out = paired.select("k", F.inline(F.when(is_gap, F.array(period, gap)).otherwise(F.array(period))))
    return out.select(F.col("k").alias(key), "kind", "start_pos", "end_pos")
