"""Inputs derived from the given tables, each with the SQL that derives the same rows."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rowcheck import GFF_COLUMNS, check_elements, sequence_key, usable_sequence, whole_number
from ..session import table

# letters mapped cyclically onto the bases
LETTERS = string.ascii_lowercase + string.ascii_uppercase
BASES = ("ACGT" * 7)[:26] * 2

KEY = "regexp_replace(trim({0}, ' '), '^[cC][hH][rR]', '')"
USABLE = "regexp_full_match(trim(coalesce({0}, ''), ' '), '[A-Za-z0-9._-]+')"

SEQS = f"seqs as (select doc_id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{BASES}') as seq from documents where length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 100)"


def seqs(spark: SparkSession, folder: str) -> DataFrame:
    """DNA-like texts: (doc_id, seq)."""
    docs = table(spark, folder, "documents")
    seq = F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), LETTERS, BASES)
    return docs.select("doc_id", seq.alias("seq")).filter(F.length("seq") >= 100)


EXONS = """exons as (select l_orderkey % 5 as chrom, l_orderkey as tx_id, l_orderkey // 4 as gene_id, cast(rn as bigint) as exon_no,
    (l_orderkey // 20) * 20000 + rn * 1000 + l_partkey % 400 as start_pos,
    (l_orderkey // 20) * 20000 + rn * 1000 + l_partkey % 400 + 50 + cast(floor(l_quantity) as bigint) * 5 as end_pos,
    case when l_orderkey % 2 = 0 then '+' else '-' end as strand
    from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as rn from lineitem) x)"""


def exons(spark: SparkSession, folder: str) -> DataFrame:
    """Exons, disjoint within a transcript and overlapping between them."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    x = table(spark, folder, "lineitem").withColumn("rn", F.row_number().over(w).cast("bigint"))
    start = F.floor(F.col("l_orderkey") / 20) * 20000 + F.col("rn") * 1000 + F.col("l_partkey") % 400
    return x.select(
        (F.col("l_orderkey") % 5).alias("chrom"), F.col("l_orderkey").alias("tx_id"), F.floor(F.col("l_orderkey") / 4).alias("gene_id"), F.col("rn").alias("exon_no"),
        start.alias("start_pos"), (start + 50 + F.floor("l_quantity") * 5).alias("end_pos"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


CALLS = f"""calls as (select call_id, tool, {KEY.format('chrom')} as chrom, least(start_pos, end_pos) as start_pos, greatest(start_pos, end_pos) as end_pos,
    support, coalesce(tag, 'xx') as tag, case when circ_type in ('S', 'R') then circ_type else 'M' end as circ_type
    from brief_calls where {USABLE.format('chrom')} and tool is not null and start_pos is not null and end_pos is not null)"""


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls with bounds in order and chromosomes under one spelling; rows without tool or place left out."""
    from ..sources.calls import normalized

    b = table(spark, folder, "brief_calls").filter(usable_sequence(F.col("chrom")) & F.col("tool").isNotNull())
    b = normalized(b.withColumn("chrom", sequence_key(F.col("chrom"))))
    return b.select("call_id", "tool", "chrom", "start_pos", "end_pos", "support", "tag", "circ_type")


def elements(spark: SparkSession, folder: str) -> DataFrame:
    """Good annotation records with bounds that are positions (up to 2^31 - 1), typed."""
    rows = check_elements(table(spark, folder, "gff_element").select("id_", *GFF_COLUMNS)).filter(F.size("reasons") == 0)
    rows = rows.select(F.col("id_").alias("id"), sequence_key(F.col("seqname_")).alias("chrom"), whole_number(F.col("start_")).alias("start_pos"), whole_number(F.col("end_")).alias("end_pos"), F.trim("strand_").alias("strand"), F.trim("feature_").alias("feature"))
    return rows.filter("end_pos <= 2147483647")


ALIGNMENTS = """alignments as (select l_orderkey % 1000 as cand_id, l_orderkey as read_id, l_partkey % 60 as s, l_partkey % 60 + 40 + cast(floor(l_quantity) as bigint) * 2 as e,
    41 + cast(floor(l_quantity) as bigint) * 2 as aln, l_discount as gap, 1 - l_tax / 4 as ident, l_partkey as ord, l_suppkey as ord2 from lineitem)"""


def alignments(spark: SparkSession, folder: str) -> DataFrame:
    """Alignments of reads to junctions of candidates."""
    li = table(spark, folder, "lineitem")
    q, s = F.floor("l_quantity") * 2, F.col("l_partkey") % 60
    return li.select(
        (F.col("l_orderkey") % 1000).alias("cand_id"), F.col("l_orderkey").alias("read_id"), s.alias("s"), (s + 40 + q).alias("e"), (41 + q).alias("aln"),
        F.col("l_discount").alias("gap"), (1 - F.col("l_tax") / 4).alias("ident"), F.col("l_partkey").alias("ord"), F.col("l_suppkey").alias("ord2"),
    )


#: Genome out of k-mers that occur once, 128 ids to a chromosome.
GENOME = """rare as (select upper(strseq) as kmer, min(iid) as iid from st_kmerinfo where regexp_full_match(strseq, '[ACGTacgt]{15}') group by 1 having count(*) = 1),
genome as (select iid // 128 as chrom, string_agg(kmer, '' order by iid) as seq from rare group by 1)"""
GEXONS = f"""{GENOME}, gexons as (select chrom, chrom as gene_id, 0 as tx_id, j as exon_no, cast(41 + 280 * j as bigint) as start_pos, cast(41 + 280 * j + 129 + (chrom * 7 + j * 13) % 100 as bigint) as end_pos,
    case when chrom % 2 = 0 then '+' else '-' end as strand, substring(seq, cast(41 + 280 * j as bigint), cast(130 + (chrom * 7 + j * 13) % 100 as bigint)) as seq
    from genome, unnest([0, 1, 2]) as t(j) where length(seq) >= 41 + 280 * j + 240)"""


def genome(spark: SparkSession, folder: str) -> DataFrame:
    """(chrom, seq) out of k-mers that occur once."""
    k = table(spark, folder, "st_kmerinfo").select("iid", F.upper("strseq").alias("kmer")).filter(F.col("kmer").rlike(r"\A[ACGT]{15}\z"))
    rare = k.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.min("iid").alias("iid")).filter("n = 1")
    parts = rare.groupBy(F.floor(F.col("iid") / 128).alias("chrom")).agg(F.array_sort(F.collect_list(F.struct("iid", "kmer"))).alias("p"))
    return parts.select("chrom", F.array_join(F.transform("p", lambda x: x["kmer"]), "").alias("seq"))


def genome_exons(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three exons per chromosome of that genome, both signals taken as there."""
    g = genome(spark, folder).select("chrom", "seq", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("exon_no"))
    g = g.filter(F.length("seq") >= 41 + 280 * F.col("exon_no") + 240)
    start, size = 41 + 280 * F.col("exon_no"), 130 + (F.col("chrom") * 7 + F.col("exon_no") * 13) % 100
    return g.select(
        "chrom", F.col("chrom").alias("gene_id"), F.lit(0).alias("tx_id"), "exon_no", start.cast("bigint").alias("start_pos"), (start + size - 1).cast("bigint").alias("end_pos"),
        F.when(F.col("chrom") % 2 == 0, "+").otherwise("-").alias("strand"), F.substr("seq", start, size.cast("int")).alias("seq"), F.lit(True).alias("head_signal"), F.lit(True).alias("tail_signal"),
    )


def planted(exons_: DataFrame, read_length: int = 101) -> tuple[DataFrame, DataFrame]:
    """Reads over planted back-splices of those exons, and the junctions: every exon onto itself, and the later
    of two exons (in reading direction) onto the one two before it."""
    e = exons_.select("chrom", "exon_no", "start_pos", "end_pos", "strand", "seq")
    selfs = e.filter(F.col("exon_no") == 1).select("chrom", F.lit("S").alias("circ_type"), "end_pos", "start_pos", F.col("seq").alias("d"), F.col("seq").alias("a"))
    plus = F.col("strand") == "+"
    end = e.filter(F.when(plus, F.col("exon_no") == 2).otherwise(F.col("exon_no") == 0)).select("chrom", "end_pos", F.col("seq").alias("d"))
    begin = e.filter(F.when(plus, F.col("exon_no") == 0).otherwise(F.col("exon_no") == 2)).select("chrom", "start_pos", F.col("seq").alias("a"))
    pairs = end.join(begin, "chrom").select("chrom", F.lit("R").alias("circ_type"), "end_pos", "start_pos", "d", "a")
    j = selfs.unionByName(pairs).filter((F.col("chrom") % 3 == 0) == (F.col("circ_type") == "S"))
    cut = j.select("*", F.explode(F.array(F.lit(46), F.lit(50), F.lit(55))).alias("left"))
    seq = F.concat(F.right("d", F.col("left")), F.left("a", read_length - F.col("left")))
    reads = cut.select((F.col("chrom") * 1000 + F.col("left") + F.when(F.col("circ_type") == "S", 500).otherwise(0)).alias("read_id"), seq.alias("seq"))
    truth = j.select("chrom", "circ_type", F.least("start_pos", "end_pos").alias("start_pos"), F.greatest("start_pos", "end_pos").alias("end_pos"))
    return reads, truth


def genome_whole(spark: SparkSession, folder: str) -> DataFrame:
    """(chrom, seq) out of all k-mers in order of their ids, 128 rows to a chromosome: the same stretches come back in other
    chromosomes, and where a string has other letters there is a run of N."""
    k = table(spark, folder, "st_kmerinfo").select(F.floor(F.col("iid") / 128).alias("chrom"), "iid", F.regexp_replace(F.upper("strseq"), "[^ACGT]", "N").alias("kmer"))
    # dealt out once: both groupings go by the chromosome
    k = k.filter("kmer is not null").repartition("chrom").groupBy("chrom", "kmer").agg(F.min("iid").alias("iid"))
    parts = k.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("iid", "kmer"))).alias("p"))
    return parts.select("chrom", F.array_join(F.transform("p", lambda x: x["kmer"]), "").alias("seq"))


def spliced_exons(genome_: DataFrame) -> DataFrame:
    """Up to six exons per chromosome of ``genome_whole``, most between splice signals and every fourth between any bases.

    Chromosomes alternate in strand; exons are numbered in reading direction, ``at`` is their order along the chromosome.
    """
    g = genome_.select("chrom", "seq", F.when(F.col("chrom") % 2 == 0, "+").otherwise("-").alias("strand"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("at"))
    g = g.withColumns({"base": 41 + 280 * F.col("at"), "before": F.when(F.col("strand") == "+", "AG").otherwise("AC"), "after": F.when(F.col("strand") == "+", "GT").otherwise("CT")})
    any_ = F.col("at") % 4 == 3
    g = g.withColumn("start_pos", F.when(any_, F.col("base")).otherwise(F.expr("locate(before, seq, cast(base as int))") + 2))
    g = g.withColumn("least", F.col("start_pos") + 100 + (F.col("chrom") * 7 + F.col("at") * 13) % 80)
    g = g.withColumn("end_pos", F.when(any_, F.col("least")).otherwise(F.expr("locate(after, seq, cast(least as int))") - 1))
    g = g.filter((F.col("start_pos") >= F.col("base")) & (F.col("start_pos") <= F.col("base") + 42) & (F.col("end_pos") >= F.col("least") - 1) & (F.col("end_pos") <= F.col("least") + 30) & (F.col("end_pos") + 2 <= F.length("seq")))
    return g.select(
        "chrom", F.col("chrom").alias("gene_id"), F.lit(0).alias("tx_id"), F.when(F.col("strand") == "+", F.col("at")).otherwise(5 - F.col("at")).alias("exon_no"), "at",
        F.col("start_pos").cast("bigint").alias("start_pos"), F.col("end_pos").cast("bigint").alias("end_pos"), "strand",
    )


def hard_reads(exons_: DataFrame, read_length: int = 101) -> tuple[DataFrame, DataFrame]:
    """(reads, junctions): reads over back-splices between exons that have the signals, and others that are over none.

    Junctions are every other exon onto itself, and every exon onto the one two before it along the chromosome. Three
    reads lie over each, one of them with a wrong base and one reversed and complemented. No junction lies within 55
    bases of an unknown one. Reads over the splices between neighbours and from within exons are over no back-splice.
    """
    from ..functions.seq import reverse_complement

    e = exons_.select("chrom", "at", "start_pos", "end_pos", "seq", "head_signal", "tail_signal")
    d = e.select("chrom", F.col("at").alias("d"), "end_pos", F.col("seq").alias("ds"), "tail_signal")
    a = e.select("chrom", F.col("at").alias("a"), "start_pos", F.col("seq").alias("as"), "head_signal")
    pairs = d.join(a, "chrom")
    kind = F.when((F.col("d") == F.col("a")) & (F.col("d") % 2 == 1), "S").when(F.col("d") == F.col("a") + 2, "R").when(F.col("d") == F.col("a") - 1, "L")
    pairs = pairs.withColumn("circ_type", kind).filter("circ_type is not null and (circ_type = 'L' or (tail_signal and head_signal))")
    pairs = pairs.filter(~F.contains(F.concat(F.right("ds", F.lit(55)), F.left("as", F.lit(55))), F.lit("N")))
    cut = pairs.select("*", F.posexplode(F.array(F.lit(46), F.lit(50), F.lit(55))).alias("way", "left"))
    seq = F.concat(F.right("ds", F.col("left")), F.left("as", read_length - F.col("left")))
    wrong = F.concat(F.left(seq, F.lit(19)), F.translate(F.substr(seq, F.lit(20), F.lit(1)), "ACGT", "CATG"), F.substr(seq, F.lit(21), F.lit(read_length)))
    seq = F.when(F.col("way") == 1, wrong).when(F.col("way") == 2, reverse_complement(seq)).otherwise(seq)
    over = cut.select(F.xxhash64("chrom", "d", "a", "way").alias("read_id"), seq.alias("seq"))
    inside = e.select(F.xxhash64("chrom", "at", F.lit("inside")).alias("read_id"), F.left("seq", F.lit(read_length)).alias("seq"))
    truth = pairs.filter("circ_type <> 'L'").select("chrom", "circ_type", F.least("start_pos", "end_pos").alias("start_pos"), F.greatest("start_pos", "end_pos").alias("end_pos"))
    return over.unionByName(inside), truth
