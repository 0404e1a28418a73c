"""Quality of calls by how their reads align over the junction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Limits of the classification.
IMBALANCE, ADDITIONAL, MIN_OFFSET, GAP_LEFT, GAP_RIGHT = 15, 8, 5, 21, 25
#: Order in which equally frequent states decide.
STATES = ["AdditionalPart", "AdditionalPart_Ref", "Imbalance", "LowQuality"]


def junction_references(donors: DataFrame, acceptors: DataFrame, on: list[str], read_length: int = 101) -> DataFrame:
    """The last ``read_length`` bases of a donor before the first of an acceptor, and where they meet."""
    j = donors.join(acceptors, on)
    left = F.right("d", F.lit(read_length))
    return j.select(*on, *[c for c in j.columns if c not in (*on, "d", "a")], F.concat(left, F.left("a", F.lit(read_length))).alias("ref"), F.length(left).alias("breakpoint"))


def alignment_references(donors: DataFrame, acceptors: DataFrame, on: list[str], read_length: int = 101) -> DataFrame:
    """(on, kind, ref, breakpoint): the junction as in ``junction_references``, and the whole donor and acceptor, which have
    no breakpoint (-1)."""
    j = junction_references(donors, acceptors, on, read_length).select(*on, F.lit("junction").alias("kind"), "ref", "breakpoint")
    pair = donors.join(acceptors, on)
    whole = lambda kind, c: pair.select(*on, F.lit(kind).alias("kind"), F.col(c).alias("ref"), F.lit(-1).alias("breakpoint"))
    return j.unionByName(whole("donor_self", "d")).unionByName(whole("acceptor_self", "a"))


def circular_references(exons: DataFrame, chrom_seq: DataFrame) -> DataFrame:
    """Per pair of bounds (chrom, start_pos, end_pos, left_end, right_start): right exon + left exon, and right exon
    + whole span; ``poor`` if the junction is shorter than 101 bases."""
    j = exons.join(chrom_seq, "chrom")
    part = lambda a, b: F.substr("seq", F.col(a), F.col(b) - F.col(a) + 1)
    junction = F.concat(part("right_start", "end_pos"), part("start_pos", "left_end"))
    return j.select("chrom", "start_pos", "end_pos", junction.alias("junction"), F.concat(part("right_start", "end_pos"), part("start_pos", "end_pos")).alias("complement"), (F.length(junction) < 101).alias("poor"))


def read_status(alignments: DataFrame, order: list[str], breakpoint: str, read_length: int = 101, k: int = 15) -> DataFrame:
    """Status of each (cand_id, read_id) by its longest alignment (the first in ``order`` among equals).

    Alignments have s, e, aln, gap, ident and the junction's ``breakpoint``.
    """
    read = Window.partitionBy("cand_id", "read_id")
    ranked = alignments.withColumn("rk", F.row_number().over(read.orderBy(F.desc("aln"), *order)))
    best = ranked.groupBy("cand_id", "read_id").agg(
        *[F.max(F.when(F.col("rk") == 1, F.col(c))).alias(c) for c in ("s", "e", "aln", "gap", "ident")], F.max(breakpoint).alias("bp"), F.collect_list(F.when(F.col("rk") > 1, F.struct("s", "e"))).alias("others")
    )
    left_end = F.array_max(F.transform(F.filter("others", lambda o: o["e"] < F.col("s")), lambda o: o["e"]))
    right_start = F.array_min(F.transform(F.filter("others", lambda o: o["s"] > F.col("e")), lambda o: o["s"]))
    beside = F.when(F.col("bp") <= F.col("s"), F.col("s") - left_end < GAP_LEFT).otherwise(right_start - F.col("e") < GAP_RIGHT)
    status = (
        F.when((F.col("bp") <= F.col("s")) | (F.col("bp") >= F.col("e")), F.when(F.coalesce(beside, F.lit(False)), "AdditionalPart_Ref").otherwise("Bad"))
        .when(F.abs(F.col("aln") - read_length) >= ADDITIONAL, "AdditionalPart")
        .when(F.col("bp") - F.col("s") <= k, "Imbalance")
        .when((F.abs(F.col("bp") - F.col("s") - k) < IMBALANCE) | (F.abs(F.col("e") - F.col("bp") - k) < IMBALANCE), "Imbalance")
        .when((F.col("gap") > 0.1) | (F.col("ident") < 0.99), "LowQuality")
        .otherwise("Good")
    )
    return best.select("cand_id", "read_id", status.alias("status"))


def major_status(statuses: DataFrame) -> DataFrame:
    """Per candidate: Good if any read is, else its most frequent state, else Bad; NULL if none applies."""
    n = {s: F.count_if(F.col("status") == s) for s in [*STATES, "Good", "Bad"]}
    per = statuses.groupBy("cand_id").agg(*[c.alias(s) for s, c in n.items()])
    ranked = F.array_max(F.array(*[F.struct(F.col(s).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(STATES)]))
    major = F.when(F.col("Good") > 0, "Good").when(ranked["n"] > 0, ranked["s"]).when(F.col("Bad") > 0, "Bad")
    return per.select("cand_id", major.alias("status"))


def status_summary(majors: DataFrame) -> DataFrame:
    """Candidates per status with their share."""
    total = majors.agg(F.count(F.lit(1)).alias("n")).scalar()
    return majors.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)


def chimeric(alignments: DataFrame, order: list[str], exon_length: int) -> DataFrame:
    """Per (cand_id, read_id) of two alignments at least: whether the two longest lie side by side in the read, one
    beginning near the exon's start and one ending near its end."""
    w = Window.partitionBy("cand_id", "read_id").orderBy(F.desc("aln"), *order)
    top = alignments.withColumn("rk", F.row_number().over(w)).filter("rk <= 2")
    one = lambda c, k: F.max(F.when(F.col("rk") == k, F.col(c))).alias(f"{c}{k}")
    t = top.groupBy("cand_id", "read_id").agg(one("s", 1), one("e", 1), one("s", 2), one("e", 2)).filter("s2 is not null")
    nested = ((F.col("s1") <= F.col("s2")) & (F.col("e2") <= F.col("e1"))) | ((F.col("s2") <= F.col("s1")) & (F.col("e1") <= F.col("e2")))
    starts, ends = F.least("s1", "s2") < MIN_OFFSET, exon_length - F.greatest("e1", "e2") < MIN_OFFSET
    return t.select("cand_id", "read_id", (~nested & starts & ends).alias("chimeric"))


def shared_reads(reads: DataFrame) -> DataFrame:
    """Pairs of candidates that share a read, counted by kind without making them: regular_regular, self_self, self_regular.

    ``reads`` has (read_seq, cand_id, circ_type). A read's candidates are counted by kind, and pairs follow.
    """
    n = reads.distinct().groupBy("read_seq").agg(F.count_if(F.col("circ_type") == "R").alias("r"), F.count_if(F.col("circ_type") == "S").alias("s"))
    two = lambda c: F.coalesce(F.sum(F.floor(F.col(c) * (F.col(c) - 1) / 2)), F.lit(0))
    return n.agg(two("r").alias("regular_regular"), two("s").alias("self_self"), F.coalesce(F.sum(F.col("s") * F.col("r")), F.lit(0)).alias("self_regular"))


def spanning_reads(alignments: DataFrame, status: DataFrame, breakpoint: str, kinds: Sequence[str]) -> DataFrame:
    """Per ``cand_id``: alignments, those that span the breakpoint (start < breakpoint < end), reads, reads with one
    that spans, whether there is any, and the number of these reads of each status in ``kinds``."""
    over = (F.col("s") < F.col(breakpoint)) & (F.col("e") > F.col(breakpoint))
    r = alignments.groupBy("cand_id", "read_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(over).alias("spans"))
    r = r.join(status.select("cand_id", "read_id", "status"), ["cand_id", "read_id"])
    hit = F.col("spans") > 0
    counts = [F.count_if(hit & (F.col("status") == k)).alias(k.lower()) for k in kinds]
    return r.groupBy("cand_id").agg(F.sum("n").alias("alignments"), F.sum("spans").alias("spanning"), F.count(F.lit(1)).alias("reads"), F.count_if(hit).alias("spanning_reads"), F.max(hit).alias("valid"), *counts)


def spanning_totals(alignments: DataFrame, breakpoint: str, margin: int = 0) -> DataFrame:
    """One row: reads aligned to a junction, those that span it by more than ``margin`` on both sides (valid), and of these the
    reversed and the other ones. ``alignments`` have cand_id, read_id, s, e and ``rc``; a read counts once per candidate."""
    over = (F.col("s") + margin < F.col(breakpoint)) & (F.col("e") - margin > F.col(breakpoint))
    r = alignments.groupBy("cand_id", "read_id", "rc").agg(F.bool_or(over).alias("valid"))
    return r.agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid"), F.count_if(F.col("valid") & F.col("rc")).alias("reversed"), F.count_if(F.col("valid") & ~F.col("rc")).alias("regular"))
