"""Annotation files (nine tab-separated columns) as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import PackedFormat, split_packed
from ..operators.rowcheck import check_lines, sequence_key, whole_number
from .sequences import numbered_lines

NAMES = ("seqid", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")


def attribute_map(field: Column) -> Column:
    """Attributes of the usual writing (name "value"; ...) as a map; the last of repeated names stays."""
    pairs = F.filter(F.split(F.trim(field), r";\s*(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda x: F.trim(x) != "")
    entry = lambda x: F.struct(F.regexp_extract(x, r"\A\s*(\S+)", 1).alias("k"), F.regexp_replace(F.regexp_extract(x, r"(?s)\A\s*\S+\s*(.*?)\s*\z", 1), r'\A"|"\z', "").alias("v"))
    latest = F.aggregate(
        F.transform(pairs, entry),
        F.create_map().cast("map<string,string>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])),
    )
    return latest


def read_annotation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines with their reasons) of annotation files."""
    checked = check_lines(numbered_lines(spark, path), "value")
    good = checked.filter(F.size("reasons") == 0)
    cell = [F.get(F.col("cells"), k).alias(n) for k, n in enumerate(NAMES)]
    rows = good.select("file", "line_no", *cell).withColumn("start", whole_number(F.col("start"))).withColumn("end", whole_number(F.col("end"))).withColumn("seqid", sequence_key(F.col("seqid")))
    return rows, checked.filter(F.size("reasons") > 0).select("file", "line_no", "value", "reasons")


def attribute_rows(rows: DataFrame, row_id: str, field: str = "attributes") -> DataFrame:
    """(row_id, pos, attr_name, attr_value): one row per attribute of any writing."""
    return split_packed(rows, row_id, field, PackedFormat())


def attribute_names(attributes: DataFrame, limit: int = 1000) -> list[str]:
    """The names in use, sorted: what becomes columns. More than ``limit`` are no columns any more and raise ValueError."""
    names = [r["attr_name"] for r in attributes.select("attr_name").filter("attr_name is not null").distinct().limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"there are more than {limit} attribute names")
    return sorted(names)


def attribute_columns(attributes: DataFrame, row_id: str, names: list[str] | None = None) -> DataFrame:
    """One column per name (default: all in use), NULL where a row lacks it; the last of repeated names stays."""
    names = attribute_names(attributes) if names is None else names
    picks = [F.max_by("attr_value", F.when(F.col("attr_name") == n, F.col("pos"))).alias(n) for n in names]
    if not picks:
        return attributes.select(row_id).distinct()
    return attributes.filter(F.col("attr_name").isin(names)).groupBy(row_id).agg(*picks)


def fixed_and_rest(attributes: DataFrame, row_id: str) -> tuple[DataFrame, DataFrame]:
    """The first two attributes as gene_id and transcript_id, and all others as (row_id, type, value)."""
    first = lambda k: F.max(F.when(F.col("pos") == k, F.col("attr_value")))
    fixed = attributes.filter("pos <= 2").groupBy(row_id).agg(first(1).alias("gene_id"), first(2).alias("transcript_id"))
    return fixed, attributes.filter("pos > 2").select(row_id, F.col("attr_name").alias("type"), F.col("attr_value").alias("value"))


def exon_tree(rows: DataFrame) -> DataFrame:
    """Genes with their transcripts and exons nested, from exon rows (chrom, gene_id, tx_id, start_pos, end_pos, strand).

    A transcript's exons are bounded by its annotation; genes are built from transcripts in a second step.
    """
    exon = F.struct("start_pos", "end_pos", "strand")
    tx = rows.groupBy("chrom", "gene_id", "tx_id").agg(F.array_sort(F.collect_list(exon)).alias("exons"))
    return tx.groupBy("chrom", "gene_id").agg(F.array_sort(F.collect_list(F.struct("tx_id", "exons"))).alias("transcripts"))
