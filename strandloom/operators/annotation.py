"""Operators on transcripts, exons, splice junctions and ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bands import interval_join
from .scan import running_both, running_max, running_totals

#: Positions, or lines of a file, per block of a running computation.
BLOCK = 1 << 16


def ordinals(lines: DataFrame, file: str, line: str, feature: str, ties: Sequence[str] = ()) -> DataFrame:
    """Running numbers of genes, transcripts and exons in file order: ``gene_no``, ``tx_no``, ``exon_no`` (per file),
    and ``exon_in_tx`` from 1 within a transcript. Other rows carry the numbers of the last gene, transcript, exon.

    Lines are in order of ``line`` and then ``ties``; blocks of lines are numbered apart and one row per block of a file
    meets in a window, so a file is never gathered. Exons before the first transcript are numbered from the file's start.
    """
    flag = lambda v: F.when(F.col(feature) == v, 1).otherwise(0)
    order = [line, *ties]
    rows = lines.withColumns({"__g": flag("gene"), "__t": flag("transcript"), "__e": flag("exon"), "__block": F.floor(F.col(line) / BLOCK)})
    rows = running_totals(rows, [file], "__block", order, {"gene_no": "__g", "tx_no": "__t", "exon_no": "__e"})
    # exons before the transcript: known at its own line and carried on
    rows = rows.withColumn("__at", F.when(F.col("__t") == 1, F.col("exon_no")).otherwise(0))
    rows = running_max(rows, [file], "__block", order, "__before", "__at")
    rows = rows.withColumn("exon_in_tx", F.when(F.col("__e") == 1, F.col("exon_no") - F.col("__before")))
    return rows.drop("__g", "__t", "__e", "__block", "__at", "__before")


def exon_numbers(exons: DataFrame, tx: list[str], start: str, end: str) -> DataFrame:
    """``exon_number`` from 1 by start within a transcript, and whether the exon ``overlaps_previous``."""
    w = Window.partitionBy(*tx).orderBy(start, end)
    return exons.select("*", F.row_number().over(w).alias("exon_number"), F.coalesce(F.lag(end).over(w) >= F.col(start), F.lit(False)).alias("overlaps_previous"))


def splice_junctions(exons: DataFrame, tx: list[str], start: str, end: str, keep: list[str] = []) -> DataFrame:
    """Neighbouring exons of a transcript: (lstart, lend, rstart, rend) with the right exon's ``keep`` columns."""
    w = Window.partitionBy(*tx).orderBy(start, end)
    pairs = exons.select(*tx, *keep, F.lag(start).over(w).alias("lstart"), F.lag(end).over(w).alias("lend"), F.col(start).alias("rstart"), F.col(end).alias("rend"))
    return pairs.filter("lend is not null")


def introns(exons: DataFrame, tx: list[str], start: str, end: str, strand: str) -> DataFrame:
    """Length of the gap before each exon in reading direction (NULL for the first) and its neighbours' lengths."""
    w = Window.partitionBy(*tx).orderBy(start, end)
    length = F.col(end) - F.col(start) + 1
    rows = exons.withColumn("length", length)
    before = F.col(start) - F.lag(end).over(w) - 1
    after = F.lead(start).over(w) - F.col(end) - 1
    return rows.select("*", F.when(F.col(strand) == "-", after).otherwise(before).alias("intron"), F.lag("length").over(w).alias("previous_length"), F.lead("length").over(w).alias("next_length"))


def unify_junctions(juncs: DataFrame, seq: str, gene: str, order: str) -> DataFrame:
    """One row per splice site pair (seq, lend, rstart): number of sites, outermost bounds, the gene seen most often
    (the one seen first among equals) and the first ``order``. A gene held by most rows is counted before it moves."""
    by_gene = juncs.groupBy(seq, "lend", "rstart", gene).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.min("lstart").alias("lstart"), F.max("rend").alias("rend")
    )
    pick = F.max_by(gene, F.struct(F.col("n"), -F.col("first")))
    return by_gene.groupBy(seq, "lend", "rstart").agg(
        F.sum("n").alias("sites"), F.min("lstart").alias("lstart"), F.max("rend").alias("rend"), pick.alias(gene), F.min("first").alias("first_id")
    )


def cumulative_max(rows: DataFrame, keys: list[str], start: str, end: str, out: str = "cum_max") -> DataFrame:
    """Running maximum of ``end`` in the order (start, end) per key; rows must be distinct in (keys, start, end)."""
    blocked = rows.withColumn("__block", F.floor(F.col(start) / BLOCK))
    return running_max(blocked, keys, "__block", [start, end], out, end).drop("__block")


def unify_ranges(ranges: DataFrame, seq: str, start: str, end: str) -> DataFrame:
    """Disjoint cover of ranges, taken by start: what a range adds beyond all before it, as (begin, end, ubs).

    ``ubs`` is 0 for a range that begins beyond all before it; for one cut at its beginning, how far it had begun
    after the range kept before it had ended (never above 0). Ranges that add nothing are dropped.
    """
    rows = ranges.select(F.col(seq).alias("seq"), F.col(start).alias("s"), F.col(end).alias("e")).filter("s <= e").distinct()
    # of ranges with the same start only the one reaching farthest can add to the others' union at its end; all are kept in order
    rows = rows.withColumn("__block", F.floor(F.col("s") / BLOCK))
    rows = running_max(rows, ["seq"], "__block", ["s", "e"], "before", "e", inclusive=False)
    rows = rows.filter("before is null or e > before")
    apart = F.col("before").isNull() | (F.col("s") > F.col("before"))
    return rows.select(
        F.col("seq").alias(seq),
        F.when(apart, F.col("s")).otherwise(F.col("before") + 1).alias("begin"),
        F.col("e").alias("end"),
        F.when(apart, F.lit(0)).otherwise(F.col("s") - F.col("before")).alias("ubs"),
    )


def overlap_class(queries: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """How each query (id, qs, qe) lies to the first reference (rs, re) that ends at or after its start.

    References must be disjoint per key. Result: ``id``, ``rs``, ``re``, ``class``: n nested, l and r overhanging
    on one side, b on both, no apart (or no reference left). Starts are looked up once each, so many queries at one
    place don't meet in one block.
    """
    ends = refs.select(key, (-F.col("re")).alias("at"), F.lit(0).alias("kind"), (-F.col("re")).alias("ref"))
    asks = queries.select(key, (-F.col("qs")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("ref")).distinct()
    rows = ends.unionByName(asks).withColumn("__block", F.floor(F.col("at") / BLOCK))
    # counted backwards from the end, the last reference end seen is the next one at or after the query
    seen = running_max(rows, [key], "__block", ["at", "kind"], "next", "ref").filter("kind = 1")
    seen = seen.select(key, (-F.col("at")).alias("qs"), (-F.col("next")).alias("re")).join(refs.select(key, "rs", "re"), [key, "re"], "left")
    out = queries.select(key, "id", "qs", "qe").join(seen, [key, "qs"])
    left, right = F.col("qs") < F.col("rs"), F.col("qe") > F.col("re")
    kind = F.when(F.col("re").isNull() | (F.col("qe") < F.col("rs")), "no").when(left & right, "b").when(left, "l").when(right, "r").otherwise("n")
    hit = kind != "no"
    return out.select(key, "id", "qs", "qe", F.when(hit, F.col("rs")).alias("rs"), F.when(hit, F.col("re")).alias("re"), kind.alias("class"))


def nearest_gap(queries: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Best reference per query junction: of those overlapping it the one with the least sum of distances of the
    inner bounds (the earliest by (lstart, ref_id) among equals), with the number that overlap; 0 and NULL if none.

    Queries (id, lstart, lend, rstart, rend), references (ref_id and the same); a NULL bound or key, or a start
    beyond its end, overlaps nothing. Equal junctions are looked up once. Overlaps are counted as starts before the
    query's end less ends up to its start, by running totals. For the nearest, the reference before the query in order
    of the inner bounds gives a first distance; only references within it along ``lend`` are compared, in bins as wide as it.
    Queries that overlap references but not that one are compared with all that they overlap.
    """
    bounds = ["lstart", "lend", "rstart", "rend"]
    whole = F.col(key).isNotNull()
    for c in bounds:
        whole &= F.col(c).isNotNull()
    q = cut_lineage(queries.filter(whole & (F.col("lstart") < F.col("rend"))).select(key, *[F.col(c).cast("bigint").alias(c) for c in bounds]).distinct())
    r = refs.filter(whole & (F.col("lstart") <= F.col("rend"))).select(key, "ref_id", *[F.col(c).cast("bigint").alias(f"r_{c}") for c in bounds])
    r = cut_lineage(r.groupBy(key, *[f"r_{c}" for c in bounds]).agg(F.min("ref_id").alias("ref_id"), F.count(F.lit(1)).alias("n")))
    # three questions in one pass: how many begin before the query's end, how many end up to its start, and which one
    # comes last up to it in order of the inner bounds
    none, zero = F.lit(None).cast("struct<a:bigint,b:bigint,s:bigint,e:bigint>"), F.lit(0).cast("bigint")
    seen = F.struct(F.col("r_lend").alias("a"), F.col("r_rstart").alias("b"), F.col("r_lstart").alias("s"), F.col("r_rend").alias("e"))
    row = lambda what, at, then, kind, n, ref: F.struct(F.lit(what).alias("what"), at.alias("at"), then.alias("then"), F.lit(kind).alias("kind"), n.alias("n"), ref.alias("ref"))
    c = F.col
    told = r.select(key, F.inline(F.array(row("begun", c("r_lstart"), zero, 1, c("n"), none), row("ended", c("r_rend"), zero, 0, c("n"), none), row("before", c("r_lend"), c("r_rstart"), 0, zero, seen))))
    asked = q.select(key, F.inline(F.array(row("begun", c("rend"), zero, 0, zero, none), row("ended", c("lstart"), zero, 1, zero, none), row("before", c("lend"), c("rstart"), 1, zero, none)))).distinct()
    rows = told.withColumn("ask", F.lit(False)).unionByName(asked.withColumn("ask", F.lit(True))).withColumn("__block", F.floor(F.col("at") / BLOCK))
    answers = cut_lineage(running_both(rows, [key, "what"], "__block", ["at", "then", "kind"], {"count": "n"}, {"found": "ref"}).filter("ask").select(key, "what", "at", "then", "count", "found"))
    answer = lambda what, at, *more: answers.filter(F.col("what") == what).select(key, F.col("at").alias(at), *more)
    counted = q.join(answer("begun", "rend", F.col("count").alias("begun")), [key, "rend"]).join(answer("ended", "lstart", F.col("count").alias("ended")), [key, "lstart"])
    counted = counted.select(key, *bounds, (F.col("begun") - F.col("ended")).alias("overlaps")).filter("overlaps > 0")
    near = counted.join(answer("before", "lend", F.col("then").alias("rstart"), "found.*"), [key, "lend", "rstart"], "left")
    within = F.when((F.col("lstart") < F.col("e")) & (F.col("rend") > F.col("s")), F.abs(F.col("lend") - F.col("a")) + F.abs(F.col("rstart") - F.col("b")))
    todo = near.select(key, *bounds, "overlaps", within.alias("within"))
    todo = todo.withColumn("level", F.when(F.col("within") == 0, 0).otherwise(F.floor(F.log2("within")) + 1).cast("int"))
    todo = cut_lineage(todo)
    levels = [x["level"] for x in todo.select("level").distinct().collect() if x["level"] is not None]  # at most 64
    wide = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("bigint")
    binned = r.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("bin", wide("r_lend"))
    at = wide("lend")
    found = todo.filter("within is not null").withColumn("bin", F.explode(F.array(at - 1, at, at + 1))).join(binned, [key, "level", "bin"])
    found = found.filter((F.abs(F.col("lend") - F.col("r_lend")) <= F.col("within")) & (F.col("lstart") < F.col("r_rend")) & (F.col("rend") > F.col("r_lstart")))
    strict = (F.col("lstart") < F.col("r_rend")) & (F.col("rend") > F.col("r_lstart"))
    rest = interval_join(todo.filter("within is null").drop("within", "level"), r, key, ("lstart", "rend"), ("r_lstart", "r_rend"), strict)
    kept = [key, *bounds, "overlaps", "r_lend", "r_rstart", "r_lstart", "ref_id"]
    pairs = found.select(*kept).unionByName(rest.select(*kept))
    sod = F.abs(F.col("lend") - F.col("r_lend")) + F.abs(F.col("rstart") - F.col("r_rstart"))
    best = pairs.withColumn("sod", sod).groupBy(key, *bounds).agg(F.min_by("ref_id", F.struct("sod", "r_lstart", "ref_id")).alias("ref_id"), F.min("sod").alias("sod"), F.max("overlaps").alias("overlaps"))
    out = queries.select("id", key, *bounds).join(best, [key, *bounds], "left")
    return out.select("id", F.coalesce("ref_id", F.lit(0)).alias("ref_id"), "sod", F.coalesce("overlaps", F.lit(0)).alias("overlaps"))


def first_container(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """The first (by os, oe, outer_id) interval of ``outer`` (outer_id, os, oe) that contains each of ``inner`` (id, is_, ie).

    Only intervals that end beyond all before them can be the first to contain anything, and their starts and ends
    rise together. So the first of them that ends at or after ``ie`` is the container, or there is none. Both steps are
    running maxima over blocks; no pairs are made. A NULL key or bound is contained in nothing.
    """
    o = outer.filter("os <= oe").groupBy(key, "os", "oe").agg(F.min("outer_id").alias("outer_id")).withColumn("__block", F.floor(F.col("os") / BLOCK))
    records = running_max(o, [key], "__block", ["os", "oe"], "__before", "oe", inclusive=False).filter("__before is null or oe > __before")
    ends = records.select(key, (-F.col("oe")).alias("at"), F.lit(0).alias("kind"), (-F.col("oe")).alias("ref"))
    asks = inner.filter(F.col(key).isNotNull() & F.col("ie").isNotNull()).select(key, (-F.col("ie")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("ref")).distinct()
    rows = ends.unionByName(asks).withColumn("__block", F.floor(F.col("at") / BLOCK))
    # counted backwards from the end, the last one seen is the first that ends at or after ie
    seen = running_max(rows, [key], "__block", ["at", "kind"], "next", "ref").filter("kind = 1")
    known = seen.select(key, (-F.col("at")).alias("ie"), (-F.col("next")).alias("oe")).join(records.select(key, "oe", "os", "outer_id"), [key, "oe"])
    hit = inner.select("id", key, "is_", "ie").join(known, [key, "ie"]).filter(F.col("os") <= F.col("is_"))
    return inner.select("id").join(hit.select("id", "outer_id"), "id", "left").select("id", "outer_id")


def two_base_signals(exons: DataFrame, genome: DataFrame, chrom: str = "chrom", with_seq: bool = False) -> DataFrame:
    """Exons with ``head2`` and ``tail2``, the two bases before and after them (``with_seq``: and their own ``seq``); genome is (chrom, seq).

    A chromosome goes by the first word of its name. Exons without a sequence are left out; at a sequence's ends
    there are fewer bases.
    """
    g = genome.select(F.substring_index(F.col(chrom).cast("string"), " ", 1).alias("__chrom"), F.upper("seq").alias("__genome"))
    joined = exons.join(g, exons[chrom].cast("string") == F.col("__chrom"))
    head = F.substr("__genome", F.greatest(F.col("start_pos") - 2, F.lit(1)).cast("int"), F.least(F.col("start_pos") - 1, F.lit(2)).cast("int"))
    seq = F.substr("__genome", F.col("start_pos").cast("int"), (F.col("end_pos") - F.col("start_pos") + 1).cast("int"))
    return joined.select(*[exons[c] for c in exons.columns], head.alias("head2"), F.substr("__genome", (F.col("end_pos") + 1).cast("int"), F.lit(2)).alias("tail2"), *([seq.alias("seq")] if with_seq else []))
