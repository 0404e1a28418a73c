"""Comparison of call sets under positional tolerance, on one table of calls (tool, chrom, start_pos, end_pos, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.annotation import first_container
from ..operators.bands import band_join, representatives
from ..operators.folds import leader_clusters

PLACE = ["chrom", "start_pos", "end_pos"]
TOLERANCE = 10


def places(calls: DataFrame) -> DataFrame:
    """Distinct places per tool with their copies."""
    return representatives(calls, ["tool", *PLACE])


def pairwise(calls: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """For every ordered pair of tools: places of the first, and how many of them the second has too."""
    p = places(calls)
    both = band_join(p.select("tool", *PLACE), p.select("tool", *PLACE), ["chrom"], tolerance=tolerance).filter("tool <> r_tool")
    hits = both.select("tool", *PLACE, F.col("r_tool").alias("other")).distinct().groupBy("tool", "other").agg(F.count(F.lit(1)).alias("hits"))
    own = p.groupBy("tool").agg(F.count(F.lit(1)).alias("places"))
    return hits.join(own, "tool").select("tool", "other", "places", "hits", (F.col("hits") / F.col("places")).alias("share"))


def hit_calls(calls: DataFrame, truth: DataFrame, tolerance: int = TOLERANCE, missed: bool = False) -> DataFrame:
    """Calls that some place of ``truth`` is near to (or, ``missed``, none is)."""
    return band_join(calls, truth.select(*PLACE).distinct(), ["chrom"], tolerance=tolerance, how="left_anti" if missed else "left_semi")


def metrics(calls: DataFrame, truth: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Per tool: self and regular places, hits, precision, recall and F1 against ``truth``."""
    p = representatives(calls, ["tool", *PLACE, "circ_type"])
    t = truth.select(*PLACE).distinct()
    n_truth = t.agg(F.count(F.lit(1)).alias("n")).scalar()
    hits = hit_calls(p, t, tolerance)
    found = band_join(p.select("tool", *PLACE), t, ["chrom"], tolerance=tolerance).select("tool", *[f"r_{c}" for c in PLACE]).distinct().groupBy("tool").agg(F.count(F.lit(1)).alias("found"))
    count = lambda d, name: d.groupBy("tool").agg(F.count(F.lit(1)).alias(name))
    own = p.groupBy("tool").agg(F.count_if(F.col("circ_type") == "S").alias("self_calls"), F.count_if(F.col("circ_type") == "R").alias("regular_calls"), F.count(F.lit(1)).alias("places"))
    m = own.join(count(hits, "hits"), "tool", "left").join(found, "tool", "left").na.fill(0, ["hits", "found"]).withColumn("truth", n_truth)
    precision, recall = F.col("hits") / F.col("places"), F.when(F.col("truth") > 0, F.col("found") / F.col("truth"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return m.select("tool", "self_calls", "regular_calls", "places", "hits", "found", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def replicate_intersection(calls: DataFrame, replicate: str, tolerance: int = TOLERANCE) -> DataFrame:
    """Places of replicate 0 that replicate 1 of the same tool has too, with the ``pairs`` of rows they make."""
    p = representatives(calls, ["tool", *PLACE, replicate])
    a, b = (p.filter(F.col(replicate) == k).drop(replicate) for k in (0, 1))
    both = band_join(a, b, ["tool", "chrom"], tolerance=tolerance)
    return both.groupBy("tool", *PLACE).agg(F.sum(F.col("copies") * F.col("r_copies")).alias("pairs"))


def benchmark(shared: DataFrame) -> DataFrame:
    """Places that two tools at least share, by leader clustering in order of chromosome, place and tool."""
    return leader_clusters(shared, "chrom", ["start_pos", "end_pos", "tool"], "pairs")


def consensus_scores(shared: DataFrame, bench: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Per tool: accuracy (shared places in the benchmark), sensitivity (benchmark places it has) and F1."""
    n_bench = bench.agg(F.count(F.lit(1)).alias("n")).scalar()
    b = bench.select(*PLACE)
    both = band_join(shared.select("tool", *PLACE), b, ["chrom"], tolerance=tolerance)
    left = both.select("tool", *PLACE).distinct().groupBy("tool").agg(F.count(F.lit(1)).alias("in_benchmark"))
    right = both.select("tool", *[f"r_{c}" for c in PLACE]).distinct().groupBy("tool").agg(F.count(F.lit(1)).alias("benchmark_found"))
    own = shared.groupBy("tool").agg(F.count(F.lit(1)).alias("shared"))
    m = own.join(left, "tool", "left").join(right, "tool", "left").na.fill(0).withColumn("benchmark", n_bench)
    accuracy, sensitivity = F.col("in_benchmark") / F.col("shared"), F.when(F.col("benchmark") > 0, F.col("benchmark_found") / F.col("benchmark"))
    f1 = F.when(accuracy + sensitivity > 0, 2 * accuracy * sensitivity / (accuracy + sensitivity)).otherwise(0.0)
    return m.select("tool", "shared", "in_benchmark", "benchmark_found", "benchmark", accuracy.alias("accuracy"), sensitivity.alias("sensitivity"), f1.alias("f1"))


def boundary_hits(calls: DataFrame, exons: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Per call whether both ends hit exon boundaries of one transcript, and whether of one exon: (call_id, both, same_exon).

    Calls (call_id, chrom, start_pos, end_pos), exons (chrom, tx_id, exon_no, start_pos, end_pos).
    """
    places_ = calls.select("chrom", "start_pos", "end_pos").distinct()
    e = exons.select("chrom", "tx_id", "exon_no", "start_pos", "end_pos")
    left = band_join(places_, e.select("chrom", "tx_id", "exon_no", "start_pos"), ["chrom"], ["start_pos"], tolerance)
    right = band_join(places_, e.select("chrom", "tx_id", "exon_no", "end_pos"), ["chrom"], ["end_pos"], tolerance)
    side = lambda d, name: d.select(*PLACE, F.col("r_tx_id").alias("tx_id"), F.col("r_exon_no").alias(name))
    both = side(left, "a").join(side(right, "b"), [*PLACE, "tx_id"])
    flags = both.groupBy(*PLACE).agg(F.lit(True).alias("both"), F.bool_or(F.col("a") == F.col("b")).alias("same_exon"))
    out = calls.select("call_id", *PLACE).join(flags, PLACE, "left")
    return out.select("call_id", F.coalesce("both", F.lit(False)).alias("both"), F.coalesce("same_exon", F.lit(False)).alias("same_exon"))


def exact_calls(calls: DataFrame, truth: DataFrame) -> DataFrame:
    """Calls at exactly a place of ``truth``."""
    return calls.join(truth.select(*PLACE).distinct(), PLACE, "left_semi")


def one_side(left: DataFrame, right: DataFrame, tolerance: int = 7) -> DataFrame:
    """Pairs of distinct places of one chromosome that are near at their starts, at their ends, or both, each once."""
    at = lambda end: band_join(left.select(*PLACE), right.select(*PLACE), ["chrom"], [end], tolerance)
    both = F.abs(F.col("start_pos") - F.col("r_start_pos")) <= tolerance
    return at("start_pos").unionByName(at("end_pos").filter(~both)).drop("r_chrom")


def hit_ratio(calls: DataFrame, database: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Per tool: places, those that the database has, and their share."""
    p = places(calls)
    hits = hit_calls(p, database, tolerance).groupBy("tool").agg(F.count(F.lit(1)).alias("hits"))
    own = p.groupBy("tool").agg(F.count(F.lit(1)).alias("places")).join(hits, "tool", "left").na.fill(0, ["hits"])
    return own.select("tool", "places", "hits", (F.col("hits") / F.col("places")).alias("ratio"))


def containment(calls: DataFrame, exons: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Per call: the first gene around it, the first of its transcripts around it, and for either end whether it lies in
    an exon, else in an intron of that transcript, and how far from that one's nearer edge (``away``).

    Calls (call_id, chrom, start_pos, end_pos), exons (chrom, gene_id, tx_id, start_pos, end_pos). First is by start, end
    and id; bounds are widened by ``tolerance``. Without a gene or transcript what follows is NULL. A gene's transcripts
    and a transcript's exons are bounded by the annotation.
    """
    gene = exons.groupBy("chrom", "gene_id").agg(F.min("start_pos").alias("s"), F.max("end_pos").alias("e"))
    tx = exons.groupBy("chrom", "gene_id", "tx_id").agg(F.min("start_pos").alias("ts"), F.max("end_pos").alias("te"))
    c = calls.select(F.col("call_id").alias("id"), "chrom", F.col("start_pos").cast("bigint").alias("is_"), F.col("end_pos").cast("bigint").alias("ie"))
    outer = gene.select("chrom", F.col("gene_id").alias("outer_id"), (F.col("s") - tolerance).alias("os"), (F.col("e") + tolerance).alias("oe"))
    g = c.join(first_container(c, outer, "chrom").filter("outer_id is not null").withColumnRenamed("outer_id", "gene_id"), "id")
    inside = g.join(tx, ["chrom", "gene_id"]).filter((F.col("is_") >= F.col("ts") - tolerance) & (F.col("ie") <= F.col("te") + tolerance))
    t = inside.groupBy("id", "chrom", "gene_id", "is_", "ie").agg(F.min(F.struct("ts", "te", "tx_id"))["tx_id"].alias("tx_id"))
    w = Window.partitionBy("chrom", "tx_id").orderBy("start_pos", "end_pos")
    x = exons.select("chrom", "tx_id", "start_pos", "end_pos", F.lag("end_pos").over(w).alias("before"))
    p = t.select("id", "chrom", "tx_id", F.inline(F.array(F.struct(F.lit("l").alias("side"), F.col("is_").alias("at")), F.struct(F.lit("r").alias("side"), F.col("ie").alias("at")))))
    nearer = lambda a, b: F.when(F.col("at").between(F.col(a) - tolerance, F.col(b) + tolerance), F.least(F.abs(F.col("at") - F.col(a)), F.abs(F.col(b) - F.col("at"))))
    k = p.join(x, ["chrom", "tx_id"]).groupBy("id", "side").agg(F.min(nearer("start_pos", "end_pos")).alias("exon"), F.min(nearer("before", "start_pos")).alias("intron"))
    place = F.when(F.col("exon").isNotNull(), "exon").when(F.col("intron").isNotNull(), "intron").otherwise("none")
    k = k.select("id", "side", F.struct(place.alias("place"), F.coalesce("exon", "intron").alias("away")).alias("x"))
    k = k.groupBy("id").agg(F.max(F.when(F.col("side") == "l", F.col("x"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("x"))).alias("r"))
    out = c.select("id").join(g.select("id", "gene_id"), "id", "left").join(t.select("id", "tx_id"), "id", "left").join(k, "id", "left")
    return out.select(F.col("id").alias("call_id"), "gene_id", "tx_id", F.col("l.place").alias("left_place"), F.col("l.away").alias("left_away"), F.col("r.place").alias("right_place"), F.col("r.away").alias("right_away"))


def distance_classes(chain: DataFrame, hit: int = TOLERANCE, near: int = 200) -> DataFrame:
    """Calls by the places of their ends and whether one end hits an edge with the other near one, both are near, or neither."""
    l, r = F.col("left_away"), F.col("right_away")
    away = F.when(((l <= hit) & (r <= near)) | ((l <= near) & (r <= hit)), "edge").when((l <= near) & (r <= near), "near").otherwise("other")
    none = [F.coalesce(c, F.lit("none")).alias(c) for c in ("left_place", "right_place")]
    return chain.select(*none, away.alias("away")).groupBy("left_place", "right_place", "away").agg(F.count(F.lit(1)).alias("n"))


def tool_consensus(calls: DataFrame, order: list[str], weight: str, least: int = 2, tolerance: int = TOLERANCE) -> DataFrame:
    """(chrom, start_pos, end_pos, members, support, tools): calls of all tools merged into the first near one in ``order``,
    and kept where ``least`` tools at least are among them."""
    c = leader_clusters(calls, "chrom", order, weight, tolerance, 1, "tool").withColumnRenamed("labels", "tools")
    return c.filter(F.col("tools") >= least)


def both_directions(mine: DataFrame, union: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(direction, places, hits): distinct places of either side and how many of them the other has near."""
    a, b = (d.select(*PLACE).distinct() for d in (mine, union))
    one = lambda x, y, name: x.agg(F.count(F.lit(1)).alias("places")).select(F.lit(name).alias("direction"), "places", hit_calls(x, y, tolerance).agg(F.count(F.lit(1)).alias("hits")).scalar().alias("hits"))
    return one(a, b, "mine in union").unionByName(one(b, a, "union in mine"))


def valid_per_chromosome(calls: DataFrame, exons: DataFrame, tolerance: int = 3) -> DataFrame:
    """(chrom, calls, valid, same_exon): calls with both ends on boundaries of one transcript, and of one exon."""
    hits = calls.select("call_id", "chrom").join(boundary_hits(calls, exons, tolerance), "call_id")
    return hits.groupBy("chrom").agg(F.count(F.lit(1)).alias("calls"), F.count_if("both").alias("valid"), F.count_if("same_exon").alias("same_exon"))


def edge_classes(places_: DataFrame, exons: DataFrame, near: int = 200, exact: int = 3) -> DataFrame:
    """(chrom, left_part, right_part, strand, n): distinct places by whether their ends lie within ``exact`` or within ``near``
    of both edges of an exon."""
    pairs = band_join(places_.distinct(), exons.distinct(), ["chrom"], tolerance=near)
    part = lambda a: F.min(F.when(F.abs(F.col(a) - F.col(f"r_{a}")) < exact, "exact").otherwise("near"))
    h = pairs.groupBy(*PLACE, F.col("r_strand").alias("strand")).agg(part("start_pos").alias("left_part"), part("end_pos").alias("right_part"))
    return h.groupBy("chrom", "left_part", "right_part", "strand").agg(F.count(F.lit(1)).alias("n"))
