import gzip

import pytest

from strandloom.config import EngineConfig, read_ini
from strandloom.sources import calls as C
from strandloom.sources import sequences as Q
from strandloom.sources.alignments import parse_report, read_reports
from strandloom.sources.gtf import attribute_map, read_annotation
from pyspark.sql import functions as F


def test_ini_and_config(tmp_path):
    p = tmp_path / "c.ini"
    p.write_text("# remark\n[run]\nkmer_length=13\nread_length=101\nkmer_ratio=60\nreads=a.fq, b.fq\n[call_sets]\nciri=x.txt")
    assert read_ini(p)["run"]["kmer_length"] == "13"
    c = EngineConfig.from_ini(p)
    assert (c.kmer_length, c.kmer_ratio, c.reads, c.call_sets) == (13, 0.6, ("a.fq", "b.fq"), {"ciri": "x.txt"})
    with pytest.raises(ValueError):
        EngineConfig(kmer_length=60).checked()


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nacg\n>scaffold_2\nTT\n")
    got = {r["name"]: r["seq"] for r in Q.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"one first": "ACGTACG", "scaffold_2": "TT"}
    assert {(r["name"], r["seg_type"]) for r in Q.draft_genome(Q.read_fasta(spark, str(tmp_path / "a.fa"))).collect()} == {("one", "contig"), ("scaffold_2", "scaffold")}
    with gzip.open(tmp_path / "r.fq.gz", "wt") as f:
        f.write("".join(f"@r{i} x\nacgt{'A' * i}\n+\n{'@' * (4 + i)}\n" for i in range(50)))
    rows = Q.read_fastq(spark, str(tmp_path / "r.fq.gz")).orderBy("read_no").collect()
    assert len(rows) == 50 and rows[7]["name"] == "r7 x" and rows[7]["seq"] == "ACGT" + "A" * 7 and rows[7]["qual"] == "@" * 11


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "l.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = Q.numbered_lines(spark, str(tmp_path / "l.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["line_no"] for r in rows) == list(range(5000)) and all(r["value"] == f"line {r['line_no']}" for r in rows)


def test_annotation_files(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('# x\nchr1\ts\texon\t5\t9\t.\t+\t.\tgene_id "G"; tag "a; b"; tag "c";\nbad line\n')
    good, bad = read_annotation(spark, str(tmp_path / "a.gtf"))
    r = good.withColumn("m", attribute_map(F.col("attributes"))).first()
    assert (r["seqid"], r["start"], r["m"]) == ("1", 5, {"gene_id": "G", "tag": "c"})
    assert [x["reasons"] for x in bad.collect()] == [["column_count"]]


def test_call_formats(spark, tmp_path):
    (tmp_path / "brief").write_text("13 50 20 1 xx S\n13 7 9 2 yy Q\nbroken\n")
    assert {(r["start_pos"], r["end_pos"], r["circ_type"]) for r in C.read_brief(spark, str(tmp_path / "brief")).collect()} == {(20, 50, "S"), (7, 9, "M")}
    (tmp_path / "truth").write_text("1:9|5\n1:5|9\n2:1|2\trest\n")
    assert {tuple(r) for r in C.read_truth(spark, str(tmp_path / "truth")).collect()} == {("1", 5, 9), ("2", 1, 2)}
    (tmp_path / "bed").write_text("# c\nchr1\t5\t9\tx\t+\nchr1\t5\t9\tx\t-\nchr2\t9\t5\t-\n")
    assert {tuple(r) for r in C.read_bed(spark, str(tmp_path / "bed"), 3).collect()} == {("1", 5, 9, "+"), ("2", 5, 9, "-")}
    (tmp_path / "db").write_text("n1\tchrX\t5\t9\t+\ta\tH9,brain\tlast\nn2\tchrY\t5\t9\t+\ta\tliver\tlast\n")
    assert [r["chrom"] for r in C.read_database(spark, str(tmp_path / "db"), "brain").collect()] == ["X"]
    lines = C.brief_lines(C.read_brief(spark, str(tmp_path / "brief"))).collect()
    assert [r["value"] for r in lines] == ["13 20 50 1 xx S"]


REPORT = """>subject one
Length=200

 Score = 200 bits (101),  Expect = 1e-50
 Identities = 100/101 (99%), Gaps = 1/101 (1%)
 Strand=Plus/Plus

Query  1    ACGTACGT  60
            ||||||||
Sbjct  50   ACGTACGT  109

Query  61   ACGT  101
            ||||
Sbjct  110  ACGT  150

 Score = 20 bits (12),  Expect = 1
 Identities = 12/12 (100%), Gaps = 0/12 (0%)

Query  5    ACGTACGTACGT  16
Sbjct  80   ACGTACGTACGT  69
"""


def test_reports(spark, tmp_path):
    got = parse_report(REPORT)
    assert [g[1] for g in got] == [101, 12] and got[0][4:] == (49, 149, 0, 100) and got[1][4:6] == (79, 68)
    (tmp_path / "r.txt").write_text(REPORT)
    assert read_reports(spark, str(tmp_path / "r.txt")).count() == 2
