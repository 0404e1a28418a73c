"""Reads are followed chromosome by chromosome: as the tables of nodes give it, at a small part of their disk."""

import random
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from strandloom.functions.seq import reverse_complement
from strandloom.operators.links import exon_links
from strandloom.plans import detect as D
from strandloom.plans import inputs
from strandloom.session import cut_lineage

EXONS = "chrom string, gene_id bigint, tx_id int, exon_no int, start_pos bigint, end_pos bigint, strand string, seq string, head_signal boolean, tail_signal boolean"


def by_tables(reads, exons, read_length=101, k=15):
    """The same through a table of all nodes of all exons."""
    links = cut_lineage(exon_links(exons.filter("head_signal or tail_signal"), read_length, k))
    order = F.struct("gene_id", "tx_id", "exon_no", "segment", "pos")
    nodes = links.groupBy("chrom", "kmer").agg(F.min_by("next_kmer", order).alias("first_next"), F.min_by("pre_kmer", order).alias("first_pre"))
    voted = cut_lineage(D.strand_vote(D.usable_reads(reads, read_length, k), nodes, k))
    cands = cut_lineage(D.candidates(D.seed_hits(voted, links, nodes, k), exons, read_length, k))
    pure = D.purified(cands, voted, links, exons, k)
    seqs = {(x["chrom"], x["gene_id"], x["tx_id"], x["exon_no"]): x["seq"] for x in exons.collect()}
    seq = {(x["read_id"], x["chrom"]): (x["orient"], x["seq"]) for x in voted.collect()}
    out = []
    for x in D.verified(pure, voted, links, k).collect():
        key = (x["chrom"], x["gene_id"], x["tx_id"])
        if x["circ_type"] == "S" or seqs[*key, x["donor"]] != seqs[*key, x["acceptor"]]:
            out.append((x["read_id"], x["chrom"], x["circ_type"], *seq[x["read_id"], x["chrom"]], x["donor_end"], x["acceptor_start"], x["strand"], x["gene_id"], x["tx_id"], x["donor"], x["acceptor"]))
    return out


def repeated(seed, chroms=40):
    """Exons that share stretches with those of other chromosomes, of their own and of other transcripts; some have unknown bases,
    some no signals, lengths on both sides of what is indexed as a whole."""
    r = random.Random(seed)
    base = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    often = [base(15) for _ in range(4)]
    rows = []
    for c in range(chroms):
        for tx in range(r.choice([1, 1, 2])):
            last = None
            for j in range(r.randint(3, 5)):
                s = "".join(r.choice([*often, base(15), base(15), base(15)]) for _ in range(r.randint(8, 16))) + base(r.randint(0, 14))
                s = last if last and r.random() < 0.1 else s
                s = s[:60] + "N" * r.randint(1, 4) + s[62:] if r.random() < 0.1 else s
                last, start = s, 40 + 400 * j
                rows.append((f"c{c}", c, tx, j, start, start + len(s) - 1, "+-"[c % 2], s, r.random() < 0.9, r.random() < 0.9))
    return rows


def over_junctions(rows, seed):
    r = random.Random(seed)
    by, reads = {}, []
    for x in rows:
        by.setdefault(x[:3], []).append(x[7])
    for exons in by.values():
        for i, d in enumerate(exons):
            for a in exons[max(0, i - 2) : i + 2]:
                for left in (46, 50, 55):
                    s = d[-left:] + a[: 101 - left]
                    if r.random() < 0.3:
                        at = r.randrange(len(s))
                        s = s[:at] + r.choice("ACGT") + s[at + 1 :]
                    reads.append((len(reads), s))
    return reads


def test_followed_as_by_tables(spark):
    for seed in (1, 2):
        rows = repeated(seed)
        exons = spark.createDataFrame(rows, EXONS)
        reads = spark.createDataFrame(over_junctions(rows, seed), "read_id bigint, seq string")
        reads = reads.withColumn("seq", F.when(F.col("read_id") % 3 == 0, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
        got = [tuple(x) for x in D.detected_reads(reads, exons).collect()]
        want = by_tables(reads, exons)
        assert len(want) > 100 and {x[2] for x in want} == {"R", "S"}
        assert sorted(got) == sorted(want)


def test_disk_follows_sequences(spark):
    def written():
        return sum(p.stat().st_size for p in Path(urlparse(spark.sparkContext.getCheckpointDir()).path).rglob("*") if p.is_file())

    rows = [(c, c, 0, j, 41 + 280 * j, 190 + 290 * j, "+-"[c % 2], "".join(random.Random(10 * c + j).choices("ACGT", k=150 + 10 * j)), True, True) for c in range(300) for j in range(3)]
    exons = cut_lineage(spark.createDataFrame(rows, EXONS.replace("chrom string", "chrom bigint")))
    reads, truth = inputs.planted(exons)
    before = written()
    found = D.detected_reads(reads, exons).select("read_id").distinct().count()
    assert found == 3 * truth.count()
    assert written() - before < 2 * sum(len(x[7]) for x in rows)


def test_genome_is_dealt_out_once(spark, small):
    plan = inputs.genome_whole(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") + plan.count("Exchange\n") == 1
