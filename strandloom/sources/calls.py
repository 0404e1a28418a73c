"""Call sets of different tools as one table: chrom, start_pos, end_pos, strand, support, tag, circ_type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def normalized(calls: DataFrame) -> DataFrame:
    """Bounds in order, types other than S and R as M, no tag as xx; rows without a place are left out."""
    return (
        calls.filter("start_pos is not null and end_pos is not null")
        .withColumns({"start_pos": F.least("start_pos", "end_pos"), "end_pos": F.greatest("start_pos", "end_pos")})
        .withColumns({"tag": F.coalesce("tag", F.lit("xx")), "circ_type": F.when(F.col("circ_type").isin("S", "R"), F.col("circ_type")).otherwise("M")})
    )


def _cells(spark: SparkSession, path: str, by: str) -> DataFrame:
    return spark.read.text(path).select("value", F.split("value", by).alias("c")).filter("value <> '' and not startswith(value, '#')")


def _whole(c):
    return c.try_cast("int")


def read_brief(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``chrom a b support tag type``."""
    c = F.col("c")
    rows = _cells(spark, path, " +").select(c[0].alias("chrom"), _whole(F.get(c, 1)).alias("start_pos"), _whole(F.get(c, 2)).alias("end_pos"), _whole(F.get(c, 3)).alias("support"), F.get(c, 4).alias("tag"), F.get(c, 5).alias("circ_type"))
    return normalized(rows)


def _span(spark: SparkSession, path: str) -> DataFrame:
    got = lambda k: F.regexp_extract("value", r"\A\s*([^:\s]+):(\d+)\|(\d+)", k)
    rows = spark.read.text(path).filter(F.col("value").rlike(r"\A\s*[^:\s]+:\d+\|\d+"))
    a, b = got(2).try_cast("int"), got(3).try_cast("int")
    return rows.select(got(1).alias("chrom"), F.least(a, b).alias("start_pos"), F.greatest(a, b).alias("end_pos"), "value")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``chrom:a|b``, each place once."""
    return _span(spark, path).select("chrom", "start_pos", "end_pos").distinct()


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated lines whose first column is ``chrom:a|b``, each place once; the strand is always +."""
    return read_truth(spark, path).withColumn("strand", F.lit("+"))


def read_bed(spark: SparkSession, path: str, strip: int = 0) -> DataFrame:
    """Tab-separated ``chrom start end ...``: + if a plus stands anywhere after the third column; each place once.

    ``strip`` letters are taken off the chromosome's name."""
    c = F.col("c")
    rest = F.array_join(F.slice(c, 4, 1000), "\t")
    a, b = _whole(F.get(c, 1)), _whole(F.get(c, 2))
    rows = _cells(spark, path, "\t").select(F.substr(c[0], F.lit(strip + 1), F.length(c[0])).alias("chrom"), F.least(a, b).alias("start_pos"), F.greatest(a, b).alias("end_pos"), F.contains(rest, F.lit("+")).alias("plus"))
    rows = rows.filter("start_pos is not null and end_pos is not null").groupBy("chrom", "start_pos", "end_pos").agg(F.bool_or("plus").alias("plus"))
    return rows.select("chrom", "start_pos", "end_pos", F.when(F.col("plus"), "+").otherwise("-").alias("strand"))


def read_database(spark: SparkSession, path: str, tissue: str | None = None) -> DataFrame:
    """Tab-separated ``name chrN start end strand ... cells last``: cells is a comma list, the last column but one.

    With a tissue only rows of which a cell's name holds it."""
    c = F.col("c")
    cells = F.split(F.get(c, F.size(c) - 2), ",")
    rows = _cells(spark, path, "\t").select(c[0].alias("name"), F.upper(F.regexp_replace(F.get(c, 1), "(?i)^chr", "")).alias("chrom"), _whole(F.get(c, 2)).alias("start_pos"), _whole(F.get(c, 3)).alias("end_pos"), F.get(c, 4).alias("strand"), cells.alias("cells"))
    return rows if tissue is None else rows.filter(has_tissue("cells", tissue))


def has_tissue(cells: str, tissue: str):
    return F.exists(F.col(cells), lambda x: F.contains(x, F.lit(tissue)))


def first_of_each(calls: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per place, the first in ``order``; copies are thinned out before the shuffle."""
    row = F.struct(*order, *[c for c in calls.columns if c not in order and c not in keys])
    best = calls.groupBy(*keys).agg(F.min(row).alias("b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"b.{c}").alias(c) for c in calls.columns])


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of labelled lines that end in ``***``: one row per read and candidate.

    The first line has the bounds of the donor exon before ``--`` and those of the acceptor exon after it; the older
    form of a block without CircType gives NULL there. Blank blocks are left out, missing labels give NULL.
    """
    blocks = spark.read.option("lineSep", "***").text(path).select(F.regexp_replace("value", r"\r", "").alias("value")).filter(F.col("value").rlike(r"\S"))
    whole = lambda pattern, k=1: F.regexp_extract("value", pattern, k).try_cast("int")
    word = lambda label: F.nullif(F.regexp_extract("value", rf"(?m)^[ \t]*{label}:[ \t]*(\S+)[ \t]*$", 1), F.lit(""))
    exons = r"(?m)^[ \t]*Donor[^\n]*?:[ \t]*\((\d+), *(\d+)\) *-- *\((\d+), *(\d+)\)"
    bounds = r"(?m)^[ \t]*Candi Start & End: *(\d+) *: *(\d+)"
    return blocks.select(
        F.struct(whole(exons, 1).alias("start"), whole(exons, 2).alias("end")).alias("donor"),
        F.struct(whole(exons, 3).alias("start"), whole(exons, 4).alias("end")).alias("acceptor"),
        whole(bounds, 1).alias("cand_start"), whole(bounds, 2).alias("cand_end"), (word("RC") == "Yes").alias("rc"), word("Chrom").alias("chrom"),
        (word("Current Reads") == "RC").alias("read_rc"), word("CircType").try_cast("int").alias("circ_type"), F.nullif(F.regexp_extract("value", r"(?m)^[ \t]*([A-Za-z]+)[ \t]*$", 1), F.lit("")).alias("read_seq"),
    )


def detail_blocks(rows: DataFrame) -> DataFrame:
    """Rows as read_details gives them, written as blocks (``value``, with line breaks inside)."""
    pair = lambda c: F.format_string("(%d, %d)", F.col(f"{c}.start"), F.col(f"{c}.end"))
    lines = [
        F.concat(F.lit("Donor(Start, End) & Acceptor(Start, End): "), pair("donor"), F.lit(" -- "), pair("acceptor")),
        F.format_string("Candi Start & End: %d : %d", "cand_start", "cand_end"),
        F.concat(F.lit("RC: "), F.when(F.col("rc"), "Yes").otherwise("No")),
        F.concat(F.lit("Chrom: "), F.col("chrom")),
        F.concat(F.lit("Current Reads: "), F.when(F.col("read_rc"), "RC").otherwise("Reg")),
        F.concat(F.lit("CircType: "), F.col("circ_type").cast("string")),
        F.col("read_seq"),
        F.lit("***"),
    ]
    return rows.select(F.concat_ws("\n", *lines).alias("value"))


def candidate_report(calls: DataFrame) -> DataFrame:
    """(chrom, part, value): lines of the report per chromosome, by ``part``: counts, self, regular, duplicates.

    A regular candidate with the same sum of bounds as a self one of its chromosome is counted as a duplicate and not
    listed. ``calls`` are (chrom, start_pos, end_pos, support, circ_type). One row per line, so that a chromosome's
    list isn't gathered; write it partitioned by chromosome and sorted by part.
    """
    c = calls.filter("circ_type in ('S', 'R')").withColumn("total", F.col("start_pos") + F.col("end_pos"))
    own = c.filter("circ_type = 'S'").select("chrom", "total").distinct().withColumn("own", F.lit(True))
    c = c.join(own, ["chrom", "total"], "left").withColumn("twice", (F.col("circ_type") == "R") & F.coalesce("own", F.lit(False)))
    n = c.groupBy("chrom").agg(F.count_if(F.col("circ_type") == "S").alias("s"), F.count_if(F.col("circ_type") == "R").alias("r"), F.count_if("twice").alias("d"))
    part = lambda k, v: F.struct(F.lit(k).alias("part"), v.alias("value"))
    heads = F.array(
        part("0", F.format_string("Self Circular RNA   : %d", "s")),
        part("1", F.format_string("Regular Circular RNA: %d", "r")),
        part("2", F.format_string("Total RNA Number    : %d", F.col("s") + F.col("r"))),
        part("5", F.format_string("Duplicated Num: %d", "d")),
    )
    rows = c.filter("not twice").select("chrom", F.when(F.col("circ_type") == "S", "3").otherwise("4").alias("part"), F.concat(F.col("chrom").cast("string"), F.format_string("\t<%d, %d>\t%d", "start_pos", "end_pos", F.coalesce("support", F.lit(0)))).alias("value"))
    return n.select("chrom", F.inline(heads)).unionByName(rows)


def untagged_lines(calls: DataFrame) -> DataFrame:
    """Brief lines of all calls of whatever type, without their tags."""
    return calls.select(F.concat_ws(" ", "chrom", "start_pos", "end_pos", F.coalesce("support", F.lit(0)), F.lit("xx"), "circ_type").alias("value"))


def database_lines(rows: DataFrame) -> DataFrame:
    """Brief lines of database records: a record has no support, its length stands for it."""
    return rows.select(F.concat_ws(" ", "chrom", "start_pos", "end_pos", F.abs(F.col("start_pos") - F.col("end_pos")), F.lit("xx"), "circ_type").alias("value"))


def in_order_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(``key``, first): each key once with the first ``order`` it was seen at; sort by it for the order of appearance."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first"))


def brief_lines(calls: DataFrame) -> DataFrame:
    """Lines of the brief format; only types S and R, and R without its tag."""
    tag = F.when(F.col("circ_type") == "S", F.col("tag")).otherwise("xx")
    return calls.filter(F.col("circ_type").isin("S", "R")).select(F.concat_ws(" ", "chrom", "start_pos", "end_pos", F.coalesce("support", F.lit(0)), tag, "circ_type").alias("value"))
