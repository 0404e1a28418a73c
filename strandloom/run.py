"""A run from files to files, as its settings say: detection of junctions, comparison of call sets, quality of calls.

    python -m strandloom.run SETTINGS OUT
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .operators.align import align
from .plans import classify as Q
from .plans import compare as C
from .plans import detect as D
from .session import cut_lineage
from .sources import calls as S
from .sources.gtf import attribute_map, read_annotation
from .sources.sequences import read_fasta, read_fastq

#: How the result files of tools are read, where not as brief lines.
READERS = {
    "ciri": S.read_spans,
    "circexplorer": lambda s, p: S.read_bed(s, p, 3), "find_circ": lambda s, p: S.read_bed(s, p, 3), "circrna_finder": lambda s, p: S.read_bed(s, p, 3),
}


def annotated_exons(spark: SparkSession, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(exons with their sequences and signals, genome) of the run's annotation and reference.

    Exons are numbered in order of the file within their transcript; those without gene, transcript or sequence, or
    shorter than a k-mer, are left out.
    """
    good, _ = read_annotation(spark, config.annotation)
    a = attribute_map(F.col("attributes"))
    exons = good.filter("feature = 'exon' and end >= start").select(F.col("seqid").alias("chrom"), F.try_element_at(a, F.lit("gene_id")).alias("gene_id"), F.try_element_at(a, F.lit("transcript_id")).alias("tx_id"), "line_no", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "strand")
    exons = exons.filter("gene_id is not null and tx_id is not null").groupBy("chrom", "gene_id", "tx_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "start_pos", "end_pos", "strand"))).alias("x"))
    exons = exons.select("chrom", "gene_id", "tx_id", F.posexplode("x").alias("exon_no", "x")).select("chrom", "gene_id", "tx_id", "exon_no", "x.start_pos", "x.end_pos", "x.strand")
    genome = read_fasta(spark, config.reference).select(F.regexp_replace(F.substring_index("name", " ", 1), "(?i)^chr", "").alias("chrom"), "seq")
    return D.with_signals(exons, genome).filter(F.length("seq") >= config.kmer_length), genome


def detection(spark: SparkSession, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(junctions, reads over them with the bounds of their exons) of the run's reads."""
    exons = cut_lineage(annotated_exons(spark, config)[0])
    reads = None
    for path in config.reads:
        one = read_fastq(spark, path).select(F.xxhash64("file", "read_no").alias("read_id"), "seq")
        reads = one if reads is None else reads.unionByName(one)
    if reads is None:
        raise ValueError("the settings name no reads")
    found = cut_lineage(D.detected_reads(reads, exons, config.read_length, config.kmer_length, config.kmer_ratio))
    junctions = D.junctions(found).filter(F.col("support") <= config.max_support)
    key = ["chrom", "gene_id", "tx_id"]
    at = lambda name: exons.select(*key, F.col("exon_no").alias(name), F.struct(F.col("start_pos").alias("start"), F.col("end_pos").alias("end")).alias(f"{name}_bounds"))
    rows = found.join(at("donor"), [*key, "donor"]).join(at("acceptor"), [*key, "acceptor"])
    details = rows.select(
        F.col("donor_bounds").alias("donor"), F.col("acceptor_bounds").alias("acceptor"), F.col("donor_end").alias("cand_start"), F.col("acceptor_start").alias("cand_end"), (F.col("strand") == "-").alias("rc"),
        F.col("chrom").cast("string").alias("chrom"), (F.col("orient") == "-").alias("read_rc"), F.when(F.col("circ_type") == "S", 0).otherwise(1).alias("circ_type"), F.col("seq").alias("read_seq"),
    )
    return junctions, details


def classification(details: DataFrame, genome: DataFrame, config: EngineConfig, wanted: DataFrame | None = None) -> DataFrame:
    """(chrom, cand_start, cand_end, status): quality of the candidates by how their reads align over the junction.

    ``details`` as read_details gives them; with ``wanted`` (chrom, start_pos, end_pos) only candidates at exactly one of
    these places.
    """
    rows = details.withColumn("start_pos", F.least("cand_start", "cand_end")).withColumn("end_pos", F.greatest("cand_start", "cand_end"))
    if wanted is not None:
        rows = C.exact_calls(rows, wanted)
    rows = rows.withColumn("cand_id", F.concat_ws(":", "cand_start", "cand_end", "chrom")).withColumn("read_id", F.xxhash64("read_seq", "read_rc"))
    ends = rows.groupBy("cand_id", "chrom").agg(F.max("donor").alias("donor"), F.max("acceptor").alias("acceptor")).join(genome.withColumnRenamed("chrom", "__chrom"), F.col("chrom") == F.col("__chrom"))
    part = lambda c: F.substr("seq", F.col(f"{c}.start").cast("int"), (F.col(f"{c}.end") - F.col(f"{c}.start") + 1).cast("int"))
    refs = cut_lineage(Q.junction_references(ends.select("cand_id", part("donor").alias("d")), ends.select("cand_id", part("acceptor").alias("a")), ["cand_id"], config.read_length))
    pairs = rows.select("cand_id", "read_id", "read_seq").distinct().join(refs, "cand_id")
    aligned = align(pairs, "read_seq", "ref", ["cand_id", "read_id", "breakpoint"])
    status = Q.major_status(Q.read_status(aligned, ["q_start", "s"], "breakpoint", config.read_length, config.kmer_length))
    c = F.split("cand_id", ":", 3)
    return status.select(F.get(c, 2).alias("chrom"), F.get(c, 0).cast("int").alias("cand_start"), F.get(c, 1).cast("int").alias("cand_end"), "status")


def comparison(spark: SparkSession, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(scores of the run's call sets against each other's consensus, hits in the truth or database per tool)."""
    sets = [READERS.get(tool, S.read_brief)(spark, path).select(F.lit(tool).alias("tool"), "chrom", "start_pos", "end_pos") for tool, path in sorted(config.call_sets.items())]
    if not sets:
        raise ValueError("the settings name no call sets")
    calls = sets[0]
    for one in sets[1:]:
        calls = calls.unionByName(one)
    shared = cut_lineage(C.places(calls).withColumnRenamed("copies", "pairs"))
    scores = C.consensus_scores(shared, cut_lineage(C.benchmark(shared)))
    known = S.read_truth(spark, config.truth) if config.truth else S.read_database(spark, config.database, config.tissue or None) if config.database else shared.limit(0)
    return scores, C.hit_ratio(calls, known.select("chrom", "start_pos", "end_pos"))


def run(spark: SparkSession, config: EngineConfig, out: str) -> None:
    """Writes below ``out``: ``brief`` and ``details`` (lines and blocks), ``candidates`` (report by chromosome), ``quality`` and
    ``good`` of a detection, ``scores`` and ``known`` of a comparison."""
    if config.detect:
        junctions, details = detection(spark, config)
        junctions = cut_lineage(junctions.withColumn("chrom", F.col("chrom").cast("string")))
        S.brief_lines(junctions.withColumn("tag", F.lit("xx"))).write.mode("overwrite").text(f"{out}/brief")
        S.detail_blocks(details).write.mode("overwrite").text(f"{out}/details")
        S.candidate_report(junctions).repartition("chrom").sortWithinPartitions("chrom", "part", "value").drop("part").write.mode("overwrite").partitionBy("chrom").text(f"{out}/candidates")
        # quality is told from what was written, as for results of an earlier run
        genome = read_fasta(spark, config.reference).select(F.regexp_replace(F.substring_index("name", " ", 1), "(?i)^chr", "").alias("chrom"), "seq")
        quality = cut_lineage(classification(S.read_details(spark, f"{out}/details"), genome, config, S.read_brief(spark, f"{out}/brief")))
        quality.write.mode("overwrite").parquet(f"{out}/quality")
        good = quality.filter("status = 'Good'").select("chrom", F.least("cand_start", "cand_end").alias("start_pos"), F.greatest("cand_start", "cand_end").alias("end_pos"))
        S.brief_lines(C.exact_calls(S.read_brief(spark, f"{out}/brief"), good)).write.mode("overwrite").text(f"{out}/good")
    if config.compare:
        scores, known = comparison(spark, config)
        scores.write.mode("overwrite").parquet(f"{out}/scores")
        known.write.mode("overwrite").parquet(f"{out}/known")


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), EngineConfig.from_ini(sys.argv[1]), sys.argv[2])
