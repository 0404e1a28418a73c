"""k-mer links of exon ends: the edges by which reads are followed through exons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kmers import kmers

#: Nodes at the very end of a long and of a short exon that count as its terminal nodes.
TERMINAL_LONG, TERMINAL_SHORT = 12, 9
EXON = ["chrom", "gene_id", "tx_id", "exon_no"]


def reach(read_length: int, k: int) -> int:
    """Bases indexed at either end of a long exon."""
    return read_length - k - 4


def short_tags(length: Column, i: Column, k: int) -> Column:
    """H, S, E or T of window ``i`` of an exon that is indexed as a whole."""
    split = F.floor((length - k) / 2)
    head = F.when(split < TERMINAL_SHORT, split + 1).otherwise(TERMINAL_SHORT)
    rest = length - split - k
    tail = F.when(rest < TERMINAL_SHORT, rest).otherwise(TERMINAL_SHORT)
    return F.when(i < head, "H").when(i > length - k - tail, "T").when(i <= split, "S").otherwise("E")


def long_tags(segment: Column, i: Column, read_length: int, k: int) -> Column:
    """Tags of the head segment (0) and the tail segment (1) of a long exon."""
    b = reach(read_length, k)
    return F.when(segment == 0, F.when(i < TERMINAL_LONG, "H").otherwise("S")).otherwise(F.when(i > b - k - TERMINAL_LONG, "T").otherwise("E"))


def exon_links(exons: DataFrame, read_length: int = 101, k: int = 15) -> DataFrame:
    """One row per node of an exon: ``segment``, ``pos``, ``kmer``, ``tag`` and the node before and after with their tags.

    Exons are (chrom, gene_id, tx_id, exon_no, seq); shorter than k they have no nodes. Exons up to twice the
    reach are one segment, of longer ones both ends are. Windows with other letters than ACGT are bridged over,
    but an exon of which a segment begins with one has no nodes. Nodes at the end of a segment have no next or
    no previous one (NULL).
    """
    b = reach(read_length, k)
    e = exons.select(*EXON, F.upper("seq").alias("seq"), F.length("seq").alias("length")).filter(F.length("seq") >= k)
    is_short = F.col("length") <= 2 * b
    whole = F.array(F.struct(F.lit(0).alias("segment"), F.col("seq").alias("part")))
    ends = F.array(F.struct(F.lit(0).alias("segment"), F.substr("seq", F.lit(1), F.lit(b)).alias("part")), F.struct(F.lit(1).alias("segment"), F.substr("seq", F.col("length") - b + 1, F.lit(b)).alias("part")))
    parts = e.select(*EXON, "length", is_short.alias("is_short"), F.inline(F.when(is_short, whole).otherwise(ends)))
    clean = parts.groupBy(*EXON).agg(F.bool_and(~F.substr("part", F.lit(1), F.lit(k)).rlike("[^ACGT]")).alias("ok")).filter("ok")
    parts = parts.join(clean.select(*EXON), EXON, "left_semi")
    n = kmers(parts, "part", k, (*EXON, "length", "is_short", "segment"), positions=True)
    tag = F.when(F.col("is_short"), short_tags(F.col("length"), F.col("pos"), k)).otherwise(long_tags(F.col("segment"), F.col("pos"), read_length, k))
    n = n.withColumn("tag", tag)
    w = Window.partitionBy(*EXON, "segment").orderBy("pos")  # at most twice the reach
    near = {f"{side}_{c}": f(c).over(w) for side, f in (("pre", F.lag), ("next", F.lead)) for c in ("kmer", "tag")}
    return n.select(*EXON, "segment", "pos", "kmer", "tag", *[c.alias(a) for a, c in near.items()])
