"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import semi_join
from ..plans.registry import Registry
from ..session import cut_lineage, table
from .frequent import frequent_items
from .mixing import Mix, Target, mix
from .packing import pack, packing_summary
from .residue import ResidueParameters, find_residue
from .tokens import token_count

QUERIES = Registry()


def _frequent_kmers(spark: SparkSession, folder: str) -> DataFrame:
    kmers = table(spark, folder, "st_kmerinfo").select(F.upper("strseq").alias("strseq"), "inum")
    return frequent_items(kmers.filter(F.col("strseq").rlike(r"\A[ACGT]+\z")), "strseq", "inum", 0.002)


_KMERS = "k as (select upper(strseq) as strseq, inum from st_kmerinfo where regexp_full_match(strseq, '[ACGTacgt]+') and inum >= 1)"


@QUERIES.add(f"with {_KMERS} select strseq from k group by strseq having sum(inum) * 500 >= (select sum(inum) from k)")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Strings with at least 0.2 % of the total of counted rows."""
    return _frequent_kmers(spark, folder).select("strseq")


@QUERIES.add()
def p3_frequent_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """The same strings with the sketch's estimate beside the exact total."""
    return _frequent_kmers(spark, folder).select("strseq", "estimate", F.col("total_weight").alias("total"))


def _sizes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Documents' sizes in tokens, counted once."""
    docs = table(spark, folder, "documents").select("doc_id", *columns, "text")
    return cut_lineage(docs.select("doc_id", *columns, token_count(F.col("text")).alias("tokens")))


def _containers(spark: SparkSession, folder: str) -> DataFrame:
    # a fixed table of a few capacities
    specs = [(r["spec_name"], r["capacity_tokens"]) for r in table(spark, folder, "pack_specs").filter("capacity_tokens >= 1").orderBy("spec_name").collect()]
    return pack(_sizes(spark, folder), "doc_id", "tokens", specs)


@QUERIES.add()
def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text, or of every piece of a text that exceeds the capacity, per capacity."""
    p = _containers(spark, folder)
    return p.select(F.col("spec").alias("spec_name"), F.col("item").alias("doc_id"), "piece", F.col("size").alias("tokens"), F.col("container").alias("container_id"), F.col("fill").alias("container_tokens"))


@QUERIES.add()
def p6_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and unused room per capacity."""
    return packing_summary(_containers(spark, folder)).withColumnRenamed("spec", "spec_name")


def _mix(spark: SparkSession, folder: str) -> Mix:
    # a fixed table of a few sources
    rows = table(spark, folder, "mix_targets").filter("source is not null").orderBy("source").collect()
    targets = [Target(r["source"].strip(" ").lower(), float(r["target_share"]), int(r["max_repeats"])) for r in rows]
    return mix(_sizes(spark, folder, "source"), "doc_id", "source", "tokens", targets, total="largest")


@QUERIES.add()
def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents with their repeats in training order."""
    return _mix(spark, folder).chosen


@QUERIES.add()
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of the sources."""
    return _mix(spark, folder).shares


def _residue(docs: DataFrame) -> DataFrame:
    """Residue as induced from the documents, without phrases of known pages."""
    return find_residue(docs, "doc_id", "text", "repo", ResidueParameters(known=False), marks=["author", "committed_at"]).withColumnRenamed("doc", "doc_id")


@QUERIES.add()
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records with template residue, filler, error pages or script notices in place of their content."""
    return _residue(table(spark, folder, "documents"))


@QUERIES.add()
def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without them."""
    docs = table(spark, folder, "documents")
    return semi_join(docs.select("doc_id", "repo", "source", "n_chars"), cut_lineage(_residue(docs)), "doc_id", anti=True)
