import random

from pyspark.sql import functions as F

from strandloom.plans import classify as Q
from strandloom.plans import detect as D
from strandloom.plans import inputs


def genome(spark, seed=9, chroms=6):
    r = random.Random(seed)
    rows = []
    for c in range(chroms):
        for j in range(3):
            n = r.randint(120, 260)
            start = 40 + 300 * j
            rows.append((c, c, 0, j, start, start + n - 1, "+" if c % 2 == 0 else "-", "".join(r.choice("ACGT") for _ in range(n)), True, True))
    return spark.createDataFrame(rows, "chrom bigint, gene_id bigint, tx_id int, exon_no int, start_pos bigint, end_pos bigint, strand string, seq string, head_signal boolean, tail_signal boolean")


def test_planted_junctions_are_found(spark):
    exons = genome(spark)
    reads, truth = inputs.planted(exons)
    r = random.Random(3)
    noise = spark.createDataFrame([(10**6 + i, "".join(r.choice("ACGT") for _ in range(101))) for i in range(50)] + [(2 * 10**6, None), (2 * 10**6 + 1, ""), (2 * 10**6 + 2, "N" * 101)], "read_id bigint, seq string")
    linear = exons.select((F.col("chrom") * 10 + F.col("exon_no") + 5 * 10**6).alias("read_id"), F.substr("seq", F.lit(5), F.lit(101)).alias("seq"))
    found = D.detect(reads.unionByName(noise).unionByName(linear), exons)
    got = {(x["chrom"], x["circ_type"], x["start_pos"], x["end_pos"]): x["support"] for x in found.collect()}
    want = {(x["chrom"], x["circ_type"], x["start_pos"], x["end_pos"]) for x in truth.collect()}
    assert set(got) == want and set(got.values()) == {3}


def test_reverse_reads_too(spark):
    from strandloom.functions.seq import reverse_complement

    exons = genome(spark, 11, 4)
    reads, truth = inputs.planted(exons)
    found = D.detect(reads.withColumn("seq", reverse_complement(F.col("seq"))), exons)
    assert {(x["chrom"], x["start_pos"], x["end_pos"]) for x in found.collect()} == {(x["chrom"], x["start_pos"], x["end_pos"]) for x in truth.collect()}


def status(spark, rows):
    df = spark.createDataFrame(rows, "cand_id int, read_id int, s int, e int, aln int, gap double, ident double, bp int, ord int")
    return {r["cand_id"]: r["status"] for r in Q.read_status(df, ["ord"], "bp").collect()}


def test_read_status(spark):
    got = status(
        spark,
        [
            (1, 1, 20, 120, 101, 0.0, 1.0, 70, 0),
            (2, 1, 70, 120, 51, 0.0, 1.0, 60, 0),
            (3, 1, 70, 120, 51, 0.0, 1.0, 60, 0),
            (3, 1, 10, 55, 46, 0.0, 1.0, 60, 1),
            (4, 1, 20, 100, 81, 0.0, 1.0, 70, 0),
            (5, 1, 60, 160, 101, 0.0, 1.0, 70, 0),
            (6, 1, 20, 120, 101, 0.0, 0.9, 70, 0),
            (7, 1, 20, 120, 101, 0.0, 1.0, 70, 0),
            (7, 1, 0, 100, 101, 0.0, 0.5, 70, 1),
        ],
    )
    assert got == {1: "Good", 2: "Bad", 3: "AdditionalPart_Ref", 4: "AdditionalPart", 5: "Imbalance", 6: "LowQuality", 7: "Good"}


def test_major_status_and_shared_reads(spark):
    df = spark.createDataFrame([(1, "Bad"), (1, "Good"), (2, "Imbalance"), (2, "AdditionalPart"), (3, "Bad"), (4, None), (5, "LowQuality"), (5, "LowQuality"), (5, "Imbalance")], "cand_id int, status string")
    assert {r["cand_id"]: r["status"] for r in Q.major_status(df).collect()} == {1: "Good", 2: "AdditionalPart", 3: "Bad", 4: None, 5: "LowQuality"}
    reads = spark.createDataFrame([("x", 1, "R"), ("x", 2, "R"), ("x", 3, "S"), ("x", 3, "S"), ("y", 1, "S")], "read_seq string, cand_id int, circ_type string")
    assert tuple(Q.shared_reads(reads).first()) == (1, 0, 2)


def test_spanning_reads(spark):
    a = spark.createDataFrame([(1, 1, 20, 90, 60), (1, 1, 60, 90, 60), (1, 2, 20, 60, 60), (2, 1, 61, 90, 60)], "cand_id int, read_id int, s int, e int, bp int")
    st = spark.createDataFrame([(1, 1, "Good"), (1, 2, "Bad"), (2, 1, "Bad")], "cand_id int, read_id int, status string")
    assert {tuple(r) for r in Q.spanning_reads(a, st, "bp", ["Good", "Bad"]).collect()} == {(1, 3, 1, 2, 1, True, 1, 0), (2, 1, 0, 1, 0, False, 0, 0)}
