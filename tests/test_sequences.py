import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.functions import text as X
from strandloom.operators import kmers as K
from strandloom.operators.align import local_alignments
from strandloom.operators.links import exon_links


def bases(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_codes_and_complements(spark):
    r = random.Random(2)
    words = ["".join(r.choice("ACGT") for _ in range(15)) for _ in range(100)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for row in df.select("w", S.decode_kmer(S.encode_kmer(F.col("w")), 15).alias("back"), S.reverse_complement(S.reverse_complement(F.col("w"))).alias("twice")).collect():
        assert row["w"] == row["back"] == row["twice"]
    assert one(spark, S.encode_kmer(F.lit("ATGC"))) == 0 * 64 + 1 * 16 + 2 * 4 + 3
    assert one(spark, S.encode_kmer(F.lit("ANG"))) is None and one(spark, S.decode_kmer(F.lit(0), 3)) == "AAA"
    assert one(spark, S.reverse_complement(F.lit("ACGNx"))) == "NNCGT"


def test_small_functions(spark):
    assert one(spark, S.loose_match(F.lit("AAACCCGGG"), F.lit("AAATTTGGG"), 9)) is True
    assert one(spark, S.loose_match(F.lit("AAACCCGGG"), F.lit("TTTTTTGGG"), 9)) is False
    assert len(one(spark, S.neighbours(F.lit("ACG")))) == 10
    assert one(spark, S.wrap(F.lit("a" * 250))).count("\n") == 2
    assert one(spark, S.fasta_record(F.lit("n"), F.lit("a" * 200))) == ">n\n" + "a" * 100 + "\n" + "a" * 100
    assert one(spark, S.has_unknown(F.lit("acn"))) and one(spark, S.next_unknown(F.lit("ACNAN"), 4)) == 5
    assert one(spark, X.ratio_text(F.lit(0.1234))) == "12.34%" and one(spark, X.ratio_text(F.lit(0.1234), 2, False)) == "0.1234"
    assert one(spark, X.zero_padded(F.lit(123456))) == "123456" and one(spark, X.zero_padded(F.lit(7))) == "00007"
    assert one(spark, X.hours_minutes_seconds(F.lit(3725))) == "1h 2m 5s"
    assert one(spark, X.token_after(F.lit("a id=7 b"), "id=")) == "7" and one(spark, X.token_before(F.lit("a id=7 b"), "=")) == "id"
    assert one(spark, X.contained(F.lit(50), F.lit(10), F.lit(59))) and not one(spark, X.contained(F.lit(50), F.lit(10), F.lit(60)))


def test_kmers_of_long_and_odd_sequences(spark):
    r = random.Random(4)
    long = "".join(r.choice("ACGTN") if i % 97 == 0 else r.choice("acgt") for i in range(3000))
    df = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "ACG")], "i int, seq string")
    got = sorted((x["i"], x["pos"], x["kmer"]) for x in K.kmers(df, "seq", 15, ("i",), positions=True).collect())
    up = long.upper()
    assert got == [(1, p, up[p : p + 15]) for p in range(len(up) - 14) if "N" not in up[p : p + 15]]


def links_of(seq, read_length, k):
    """The tags of an exon by the plain rules."""
    b, n, out = read_length - k - 4, len(seq), []
    if n <= 2 * b:
        split = (n - k) // 2
        head = 9 if split >= 9 else split + 1
        tail = 9 if n - split - k >= 9 else n - split - k
        for i in range(n - k + 1):
            out.append((0, i, "H" if i < head else "T" if i > n - k - tail else "S" if i <= split else "E"))
    else:
        out += [(0, i, "H" if i < 12 else "S") for i in range(b - k + 1)]
        out += [(1, i, "T" if i > b - k - 12 else "E") for i in range(b - k + 1)]
    return out


@pytest.mark.parametrize("n", [15, 20, 33, 60, 164, 165, 400])
def test_tags(spark, n):
    seq = bases(n, n)
    df = spark.createDataFrame([(1, 1, 1, 1, seq)], "chrom int, gene_id int, tx_id int, exon_no int, seq string")
    rows = exon_links(df).orderBy("segment", "pos").collect()
    assert [(r["segment"], r["pos"], r["tag"]) for r in rows] == links_of(seq, 101, 15)
    assert rows[0]["pre_kmer"] is None and rows[-1]["next_kmer"] is None


def test_unknown_bases_are_bridged_but_not_at_the_start(spark):
    seq = bases(1, 60)
    rows = [(1, 1, 1, 1, seq[:30] + "N" + seq[31:]), (1, 1, 1, 2, "N" + seq[1:])]
    got = exon_links(spark.createDataFrame(rows, "chrom int, gene_id int, tx_id int, exon_no int, seq string")).orderBy("pos").collect()
    assert {r["exon_no"] for r in got} == {1}
    after = next(r for r in got if r["pos"] == 31)
    assert after["pre_kmer"] == seq[15:30]


def test_local_alignment():
    ref = bases(6, 202)
    read = ref[50:151]
    assert local_alignments([read], [ref])[0] == (101, 0, 100, 50, 150, 1.0, 0.0)
    worse = read[:50] + ("A" if read[50] != "A" else "C") + read[51:]
    got = local_alignments([worse, "", "AAAA"], [ref, ref, "TTTT"])
    assert got[0][0] == 101 and round(got[0][5] * 101) == 100 and got[1] is None and got[2] is None


def test_counts_in_stretches_are_those_of_all_windows(spark, monkeypatch):
    import random

    from strandloom.operators import kmers as K

    r = random.Random(5)
    texts = ["".join(r.choice("ACGTacgtN") if r.random() < 0.2 else r.choice("ACGT") for _ in range(n)) for n in (0, 3, 4, 5, 40, 900, 5000)] + [None, "ACGT" * 3, "äACGTö", "A" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    want = {x["code"]: x["n"] for x in K.kmer_counts(K.kmers(df, "s", 4), "kmer").collect()}
    assert {x["code"]: x["n"] for x in K.sequence_kmer_counts(df, "s", 4).collect()} == want and len(want) == 256
    assert K.sequence_kmer_counts(df.limit(0), "s", 4).count() == 0
    # windows over the cuts between stretches
    text = texts[6].encode()
    cut = [K._codes(text[i : i + 64 + 14], 15) for i in range(0, len(text) - 14, 64)]
    assert sorted(x for c in cut for x in c.tolist()) == sorted(K._codes(text, 15).tolist())
