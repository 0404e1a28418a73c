"""From files to files: a run finds planted junctions, writes them, tells their quality and compares call sets."""

import random

import pytest

from strandloom.config import EngineConfig
from strandloom.run import run
from strandloom.sources import calls as C
from strandloom.sources import sequences as Q
from strandloom.sources.gtf import attribute_columns, attribute_names, fixed_and_rest


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    r = random.Random(2)
    d = tmp_path_factory.mktemp("run")
    fasta, gtf, reads, truth = [], ["# made up"], [], set()
    for c, strand in (("1", "+"), ("2", "-")):
        head, tail = ("AG", "GT") if strand == "+" else ("AC", "CT")
        seq, exons = list("".join(r.choice("ACGT") for _ in range(2400))), []
        for j, n in enumerate(r.sample(range(140, 300), 5)):  # an exon as long as its neighbour passes for a repeat
            s, e = 100 + 450 * j, 100 + 450 * j + n
            seq[s - 3 : s - 1], seq[e : e + 2] = head, tail
            exons.append((s, e))
        seq[1900:1940] = "N" * 40  # within the last exon
        seq = "".join(seq)
        fasta += [f">chr{c} made up", *[seq[i : i + 60] for i in range(0, len(seq), 60)]]
        gtf.append(f'chr{c}\tx\tgene\t100\t2300\t.\t{strand}\t.\tgene_id "G{c}";')
        for n, (s, e) in enumerate(exons if strand == "+" else exons[::-1]):
            gtf.append(f'chr{c}\tx\texon\t{s}\t{e}\t.\t{strand}\t.\tgene_id "G{c}"; transcript_id "T{c}"; exon_number "{n + 1}";')
        part = lambda x: seq[x[0] - 1 : x[1]]
        for d_, a_, kind in ((2, 0, "R"), (1, 1, "S"), (3, 2, "R")):
            both = part(exons[d_])[-101:], part(exons[a_])[:101]
            for left in (46, 50, 55):
                read = both[0][-left:] + both[1][: 101 - left]
                reads.append(read if left != 50 else rc(read))
            lo, hi = sorted((exons[d_][1], exons[a_][0]))
            truth.add((c, lo, hi, kind))
        reads += [(part(exons[j])[-50:] + part(exons[j + 1])[:51]) for j in range(3)] + [part(exons[0])[5:106]]
    reads += ["".join(r.choice("ACGT") for _ in range(101)) for _ in range(20)] + ["N" * 101, "ACGT"]
    (d / "ref.fa").write_text("\n".join(fasta) + "\n")
    (d / "a.gtf").write_text("\n".join(gtf) + "\n")
    half = len(reads) // 2
    for name, part_ in (("r1.fq", reads[:half]), ("r2.fq", reads[half:])):
        (d / name).write_text("".join(f"@r{i}\n{s[:60]}\n{s[60:]}\n+\n@{'I' * (len(s) - 1)}\n" if len(s) > 60 else f"@r{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(part_)))
    (d / "ciri.txt").write_text("".join(f"{c}:{a}|{b}\tx\n" for c, a, b, _ in sorted(truth)) + "1:5|9\tx\n")
    (d / "bed.txt").write_text("".join(f"chr{c}\t{a + 3}\t{b}\tx\t+\n" for c, a, b, _ in sorted(truth)[:4]))
    (d / "truth.txt").write_text("".join(f"{c}:{a}|{b}\n" for c, a, b, _ in truth))
    (d / "run.ini").write_text(
        f"[General]\nReference={d}/ref.fa\nGTF={d}/a.gtf\nReads1={d}/r1.fq\nReads2={d}/r2.fq\n[StdCircularRNAInfo]\nCircRNADb=\nTissue=\n"
        "[Parameter]\nKmerLen=15\nReadLen=101\nKmerRatio=60\nThreadsNum=4\nDoDetection=1\nDoComparison=1\nMaxSupportNum=999\n"
        f"[Comparison]\nMyResult={d}/out/brief\nCiriResult={d}/ciri.txt\nCIRCExplorerResult={d}/bed.txt\nSimulatorBenchmark={d}/truth.txt\n"
    )
    return d, truth


def test_run(spark, files):
    d, truth = files
    config = EngineConfig.from_ini(d / "run.ini")
    assert config.kmer_ratio == 0.6 and len(config.reads) == 2 and set(config.call_sets) == {"dbg", "ciri", "circexplorer"} and config.compare
    run(spark, config, str(d / "out"))
    brief = C.read_brief(spark, str(d / "out/brief")).collect()
    assert {(r["chrom"], r["start_pos"], r["end_pos"], r["circ_type"]) for r in brief} == truth and {r["support"] for r in brief} == {3}
    details = C.read_details(spark, str(d / "out/details")).collect()
    assert len(details) == 18 and sum(r["read_rc"] for r in details) == 6
    assert {(r["chrom"], r["cand_start"], r["cand_end"]) for r in details} == {(r["chrom"], r["donor"]["end"], r["acceptor"]["start"]) for r in details}
    quality = spark.read.parquet(str(d / "out/quality")).collect()
    assert len(quality) == 6 and {r["status"] for r in quality} == {"Good"}
    assert C.read_brief(spark, str(d / "out/good")).count() == 6
    report = spark.read.text(str(d / "out/candidates/chrom=1")).collect()
    assert [r["value"] for r in report][:3] == ["Self Circular RNA   : 1", "Regular Circular RNA: 2", "Total RNA Number    : 3"] and report[-1]["value"] == "Duplicated Num: 0"
    scores = {r["tool"]: r for r in spark.read.parquet(str(d / "out/scores")).collect()}
    assert scores["dbg"]["accuracy"] == 1 and scores["ciri"]["shared"] == 7 and scores["circexplorer"]["benchmark_found"] == 4
    known = {r["tool"]: r["hits"] for r in spark.read.parquet(str(d / "out/known")).collect()}
    assert known == {"dbg": 6, "ciri": 6, "circexplorer": 4}
    # only candidates of few reads
    few = EngineConfig(reference=config.reference, annotation=config.annotation, reads=config.reads[:1], max_support=2)
    run(spark, few, str(d / "few"))
    assert all(r["support"] <= 2 for r in C.read_brief(spark, str(d / "few/brief")).collect())


def test_settings(tmp_path):
    (tmp_path / "a.ini").write_text("[Parameter]\nKmerLen=13\nReadLen=150\nKmerRatio=40\nMaxSupportNum=7\nDoDetection=0\n")
    c = EngineConfig.from_ini(tmp_path / "a.ini")
    assert (c.kmer_length, c.read_length, c.kmer_ratio, c.max_support, c.detect) == (13, 150, 0.4, 7, False)
    (tmp_path / "b.ini").write_text("[Parameter]\nKmerLength=13\n")
    with pytest.raises(ValueError):
        EngineConfig.from_ini(tmp_path / "b.ini")


DETAILS = """Donor(Start, End) & Acceptor(Start, End): (500, 720) -- (100, 260)
Candi Start & End: 720 : 100
RC: Yes
Chrom: 13
Current Reads: Reg
CircType: 1
ACGTACGTACGTNACGT
***
Donor(Start, End) & Acceptor(Start, End): (5, 7) -- (5, 7)\r
Candi Start & End: 7 : 5\r
RC: No\r
Chrom: X\r
Current Reads: RC\r
GATTACA\r
***

"""


def test_details(spark, tmp_path):
    (tmp_path / "d.txt").write_text(DETAILS)
    rows = C.read_details(spark, str(tmp_path / "d.txt")).orderBy("cand_start").collect()
    assert len(rows) == 2
    assert (rows[1]["donor"]["start"], rows[1]["donor"]["end"], rows[1]["acceptor"]["start"], rows[1]["acceptor"]["end"]) == (500, 720, 100, 260)
    assert (rows[1]["cand_start"], rows[1]["cand_end"], rows[1]["rc"], rows[1]["chrom"], rows[1]["read_rc"], rows[1]["circ_type"], rows[1]["read_seq"]) == (720, 100, True, "13", False, 1, "ACGTACGTACGTNACGT")
    assert (rows[0]["chrom"], rows[0]["read_rc"], rows[0]["circ_type"], rows[0]["read_seq"]) == ("X", True, None, "GATTACA")
    again = C.detail_blocks(C.read_details(spark, str(tmp_path / "d.txt")).filter("chrom = '13'")).first()["value"]
    assert again == DETAILS[: DETAILS.index("***")] + "***"


def test_fastq_of_any_wrapping(spark, tmp_path):
    r = random.Random(1)
    records = [(f"n{i}", "".join(r.choice("ACGTN") for _ in range(n)), "".join(r.choice("@+I!") for _ in range(n))) for i, n in enumerate([1, 5, 61, 130, 200, 7] * 10)]
    wrap = lambda s, w: "\n".join(s[i : i + w] for i in range(0, len(s), w))
    for w in (1000, 60):
        # a wrapped quality line that begins with + can't be told from a separator by its piece, so none does here
        kept = [(n, s, q if w == 1000 and not q.startswith("+") else q.replace("+", "#")) for n, s, q in records]
        (tmp_path / f"{w}.fq").write_text("".join(f"@{n} c\n{wrap(s, w)}\n+\n{wrap(q, w)}\n" for n, s, q in kept))
        got = Q.read_fastq(spark, str(tmp_path / f"{w}.fq")).orderBy("read_no").collect()
        assert [(g["name"], g["seq"], g["qual"]) for g in got] == [(f"{n} c", s, q) for n, s, q in kept]
    (tmp_path / "bad.fq").write_text("@a\nACGT\n+\nIIII\n@b\nACGT\n+\nIII\n@c\nACGT\nIIII\n")
    rows = Q.fastq_records(spark, str(tmp_path / "bad.fq")).collect()
    assert [x["name"] for x in rows if x["ok"]] == ["a"] and sum(not x["ok"] for x in rows) >= 1
    (tmp_path / "none.fq").write_text("")
    assert Q.fastq_records(spark, str(tmp_path / "none.fq")).count() == 0


def test_attribute_columns_are_discovered(spark):
    a = spark.createDataFrame([(1, 1, "gene_id", "G"), (1, 2, "transcript_id", "T"), (1, 3, "tag", "x"), (1, 4, "tag", "y"), (2, 1, "gene_id", "H"), (3, 1, "gene_id", "K"), (3, 2, "note", None)], "id int, pos int, attr_name string, attr_value string")
    rows = {r["id"]: r.asDict() for r in attribute_columns(a, "id").collect()}
    assert attribute_names(a) == ["gene_id", "note", "tag", "transcript_id"] and rows[1]["tag"] == "y" and rows[2] == {"id": 2, "gene_id": "H", "note": None, "tag": None, "transcript_id": None}
    with pytest.raises(ValueError):
        attribute_names(a, 3)
    fixed, rest = fixed_and_rest(a, "id")
    assert fixed.join(rest, "id", "left").count() == 4
    assert attribute_columns(a.limit(0), "id").count() == 0


def test_names_of_spliced_references(spark):
    exons = spark.createDataFrame([("1", "g", "t", 0, 3, 5), ("1", "g", "t", 1, 8, 9), ("1", "g", "u", 0, 2, 4), ("2", "h", "v", 0, 1, 2)], "chrom string, gene_id string, tx_id string, exon_no int, start_pos int, end_pos int")
    genome = spark.createDataFrame([("1 first", "AACCGGTTAACC"), ("3", "A")], "chrom string, seq string")
    rows = Q.spliced_references(exons, genome)
    got = {r["name"]: r["seq"] for r in rows.collect()}
    assert got == {"1 | g | 2:9 | t | 3:9 | 0, 1 | (3, 5), (8, 9) | 5": "CCGTA", "1 | g | 2:9 | u | 2:4 | 0 | (2, 4) | 3": "ACC"}
    back = {tuple(r)[:6] for r in Q.spliced_exons(rows).collect()}
    assert back == {("1", "g", "t", 0, 3, 5), ("1", "g", "t", 1, 8, 9), ("1", "g", "u", 0, 2, 4)}


def test_files_and_flanks(spark, tmp_path):
    from pyspark.sql import functions as F

    from strandloom.functions.seq import flanks

    (tmp_path / "a.txt").write_text("xyz")
    (tmp_path / "b.txt").write_text("")
    assert {(r["name"], r["size"]) for r in Q.list_files(spark, str(tmp_path)).collect()} == {("a.txt", 3), ("b.txt", 0)}
    df = spark.createDataFrame([("AACCGGTT", 3, 4), ("AACCGGTT", 4, 3), ("AACCGGTT", 1, 8), (None, 1, 2)], "seq string, s int, e int")
    assert [tuple(r) for r in df.select(*flanks(F.col("seq"), F.col("s"), F.col("e"), 3)).collect()] == [("AA", "GGT"), ("TGG", "AA"), ("", ""), (None, None)]
