"""FASTA and FASTQ files as DataFrames, and FASTA and FASTQ lines out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.seq import fasta_record, fill_quality
from ..operators.scan import running_totals


def read_fasta(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """(name, seq) per record. A record begins at a line that begins with >; wrapped lines are joined."""
    records = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace(F.regexp_replace("value", r"\A>", ""), r"\r", "")
    name = F.substring_index(body, "\n", 1)
    seq = F.regexp_replace(F.substr(body, F.length(name) + 1, F.length(body)), r"\s+", "")
    rows = records.select(name.alias("name"), (F.upper(seq) if upper else seq).alias("seq"))
    return rows.filter((F.col("name") != "") | (F.col("seq") != ""))


def by_keyword(fasta: DataFrame, keyword: str) -> DataFrame:
    """Records whose name holds the keyword, with their kind of segment."""
    return with_segment(fasta.filter(F.contains("name", F.lit(keyword))))


def with_segment(fasta: DataFrame) -> DataFrame:
    return fasta.withColumn("seg_type", F.when(F.contains(F.lower("name"), F.lit("scaffold")), "scaffold").otherwise("contig"))


def draft_genome(fasta: DataFrame) -> DataFrame:
    """Names cut at the first blank, with the kind of segment told from the whole name."""
    return with_segment(fasta).withColumn("name", F.substring_index("name", " ", 1))


def numbered_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, line_no from 0, value): lines counted over the splits of a file without gathering it."""
    read = spark.read if separator is None else spark.read.option("lineSep", separator)
    lines = read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "at", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(splits, ["file", "at"]).select("file", (F.col("id") - F.col("first") + F.col("before")).alias("line_no"), "value")


def fastq_records(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """(file, read_no, name, comment, seq, qual, ok) of records with wrapped or unwrapped lines; .gz works but isn't split.

    Text is cut where a line begins with @. A quality may begin with @ too; such pieces have no line that begins with +
    and belong to the record before them. Only records that aren't whole and pieces of this kind are brought together.
    ``ok``: there is a name, and as many qualities as bases. ``read_no`` rises along the file, with gaps.
    """
    pieces = numbered_lines(spark, path, "\n@").withColumn("value", F.regexp_replace("value", r"\r", ""))
    pieces = pieces.withColumn("value", F.when(F.col("line_no") == 0, F.regexp_replace("value", r"\A@", "\u0001")).otherwise(F.concat(F.lit("\u0001"), "value")))
    cut = r"(?s)\A\x01([^\n]*)\n((?:(?!\+)[^\n]*\n)*)\+([^\n]*)(?:\n(.*))?\z"

    def parsed(d: DataFrame) -> DataFrame:
        got = lambda k: F.regexp_extract("value", cut, k)
        plain = lambda k: F.regexp_replace(got(k), r"\s", "")
        return d.select("file", "line_no", "value", F.col("value").rlike(cut).alias("begins"), got(1).alias("name"), got(3).alias("comment"), plain(2).alias("seq"), plain(4).alias("qual"))

    whole = F.col("begins") & (F.length("seq") == F.length("qual"))
    first = parsed(pieces)
    rest = first.filter(~whole).select("file", "line_no", "value", F.col("begins").cast("int").alias("start")).withColumn("block", F.floor(F.col("line_no") / (1 << 16)))
    rest = running_totals(rest, ["file"], "block", ["line_no"], {"record": "start"})
    text = F.array_sort(F.collect_list(F.struct("line_no", F.when(F.col("start") == 1, F.col("value")).otherwise(F.regexp_replace("value", r"\A\x01", "@")).alias("value"))))
    joined = rest.groupBy("file", "record").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(text, lambda x: x["value"]), "\n").alias("value"))
    rows = first.filter(whole).unionByName(parsed(joined)).filter(F.col("value").rlike(r"[^\x01\s]"))
    ok = F.col("begins") & (F.col("name") != "") & (F.length("seq") == F.length("qual"))
    return rows.select("file", F.col("line_no").alias("read_no"), "name", "comment", (F.upper("seq") if upper else F.col("seq")).alias("seq"), "qual", ok.alias("ok"))


def read_fastq(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """(file, read_no, name, comment, seq, qual) of the whole records of ``fastq_records``; the others have ``ok`` false there."""
    return fastq_records(spark, path, upper).filter("ok").drop("ok")


def fasta_lines(rows: DataFrame, name: str, seq: str, width: int = 100) -> DataFrame:
    return rows.select(fasta_record(F.col(name), F.col(seq), width).alias("value"))


def fastq_lines(rows: DataFrame, name: str, seq: str) -> DataFrame:
    """FASTQ records with a constant quality."""
    return rows.select(F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), fill_quality(F.col(seq))).alias("value"))


def spliced_references(exons: DataFrame, genome: DataFrame) -> DataFrame:
    """(name, seq): a transcript's exons in order of their bounds joined into one sequence, under a name that tells them.

    ``exons`` are (chrom, gene_id, tx_id, exon_no, start_pos, end_pos), ``genome`` (chrom, seq) by the first word of its
    names. The name is ``chrom | gene | gene's bounds | transcript | its bounds | numbers | bounds of exons | length``.
    A transcript's exons are bounded by its annotation.
    """
    e = exons.select("chrom", "gene_id", "tx_id", F.least("start_pos", "end_pos").alias("s"), F.greatest("start_pos", "end_pos").alias("e"), "exon_no")
    gene = e.groupBy("chrom", "gene_id").agg(F.min("s").alias("gs"), F.max("e").alias("ge"))
    part = e.join(genome.select(F.substring_index("chrom", " ", 1).cast(e.schema["chrom"].dataType).alias("chrom"), "seq"), "chrom").withColumn("part", F.substr("seq", F.col("s").cast("int"), (F.col("e") - F.col("s") + 1).cast("int")))
    tx = part.groupBy("chrom", "gene_id", "tx_id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "exon_no", "part"))).alias("x")).join(gene, ["chrom", "gene_id"])
    seq = F.array_join(F.transform("x", lambda x: x["part"]), "")
    bounds = F.array_join(F.transform("x", lambda x: F.format_string("(%d, %d)", x["s"], x["e"])), ", ")
    numbers = F.array_join(F.transform("x", lambda x: x["exon_no"].cast("string")), ", ")
    of = lambda a, b: F.concat(a.cast("string"), F.lit(":"), b.cast("string"))
    name = F.concat_ws(" | ", F.col("chrom").cast("string"), F.col("gene_id").cast("string"), of(F.col("gs"), F.col("ge")), F.col("tx_id").cast("string"), of(F.array_min("x")["s"], F.array_max(F.transform("x", lambda x: x["e"]))), numbers, bounds, F.length(seq).cast("string"))
    return tx.select(name.alias("name"), seq.alias("seq"))


def spliced_exons(references: DataFrame, name: str = "name") -> DataFrame:
    """(chrom, gene_id, tx_id, exon_no, start_pos, end_pos, length) told by the names of ``spliced_references``, as text and numbers."""
    c = F.split(name, r" \| ")
    got = lambda k: F.transform(F.regexp_extract_all(F.get(c, 6), F.lit(r"\((\d+), (\d+)\)"), F.lit(k)), lambda x: x.try_cast("bigint"))
    at = F.arrays_zip(F.split(F.get(c, 5), ", ").alias("no"), got(1).alias("s"), got(2).alias("e"))
    rows = references.select(F.get(c, 0).alias("chrom"), F.get(c, 1).alias("gene_id"), F.get(c, 3).alias("tx_id"), F.get(c, 7).try_cast("int").alias("length"), F.explode(at).alias("x"))
    return rows.select("chrom", "gene_id", "tx_id", F.col("x.no").try_cast("int").alias("exon_no"), F.col("x.s").alias("start_pos"), F.col("x.e").alias("end_pos"), "length")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, size) of the files in a folder of any file system, folders left out; contents aren't read.

    Like Spark's own listing of an input folder this runs on the driver.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return spark.createDataFrame([(f.getPath().getName(), f.getLen()) for f in found if not f.isDirectory()], "name string, size bigint")
