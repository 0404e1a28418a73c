"""Queries on the quality of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import align
from ..session import cut_lineage, table
from . import classify as Q
from . import inputs
from .registry import Registry

classification = Registry()
_ORDER = ["ord", "ord2", "s", "gap", "ident"]
_STATUS = f"""{inputs.ALIGNMENTS}, rk as (select *, row_number() over (partition by cand_id, read_id order by aln desc, ord, ord2, s, gap, ident) as rk from alignments),
best as (select * from rk where rk = 1),
o as (select b.cand_id, b.read_id, max(case when x.e < b.s then x.e end) as left_end, min(case when x.s > b.e then x.s end) as right_start from best b join rk x on b.cand_id = x.cand_id and b.read_id = x.read_id and x.rk > 1 group by 1, 2),
status as (select b.cand_id, b.read_id, case when 60 <= b.s or 60 >= b.e then case when coalesce(case when 60 <= b.s then b.s - o.left_end < 21 else o.right_start - b.e < 25 end, false) then 'AdditionalPart_Ref' else 'Bad' end
    when abs(b.aln - 101) >= 8 then 'AdditionalPart' when 60 - b.s <= 15 then 'Imbalance' when abs(60 - b.s - 15) < 15 or abs(b.e - 60 - 15) < 15 then 'Imbalance'
    when b.gap > 0.1 or b.ident < 0.99 then 'LowQuality' else 'Good' end as status from best b left join o on b.cand_id = o.cand_id and b.read_id = o.read_id)"""
_MAJOR = f"""{_STATUS}, c as (select cand_id, status, count(*) as n from status group by 1, 2),
major as (select cand_id, case when max(case when status = 'Good' then 1 else 0 end) = 1 then 'Good'
    else coalesce(arg_max(case when status in ('AdditionalPart', 'AdditionalPart_Ref', 'Imbalance', 'LowQuality') then status end, case when status in ('AdditionalPart', 'AdditionalPart_Ref', 'Imbalance', 'LowQuality') then n * 10 - case status when 'AdditionalPart' then 0 when 'AdditionalPart_Ref' then 1 when 'Imbalance' then 2 else 3 end end), max(case when status = 'Bad' then 'Bad' end)) end as status
    from c group by cand_id)"""


def _alignments(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.alignments(spark, folder).withColumn("bp", F.lit(60))


@classification.add(f"with {_STATUS} select * from status")
def align_status(spark: SparkSession, folder: str) -> DataFrame:
    """Status of reads over junctions."""
    return Q.read_status(_alignments(spark, folder), _ORDER, "bp")


@classification.add(f"with {_MAJOR} select * from major")
def major_status(spark: SparkSession, folder: str) -> DataFrame:
    """Deciding status of candidates."""
    return Q.major_status(Q.read_status(_alignments(spark, folder), _ORDER, "bp"))


@classification.add(f"with {_MAJOR} select status, cast(count(*) as bigint) as n, count(*) / (select count(*) from major) as share from major group by status")
def status_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates per status."""
    return Q.status_summary(Q.major_status(Q.read_status(_alignments(spark, folder), _ORDER, "bp")))


@classification.add(f"""
with {inputs.ALIGNMENTS}, rk as (select *, row_number() over (partition by cand_id, read_id order by aln desc, ord, ord2, s, gap, ident) as rk from alignments),
t as (select cand_id, read_id, max(case when rk = 1 then s end) as s1, max(case when rk = 1 then e end) as e1, max(case when rk = 2 then s end) as s2, max(case when rk = 2 then e end) as e2 from rk where rk <= 2 group by 1, 2)
select cand_id, read_id, not ((s1 <= s2 and e2 <= e1) or (s2 <= s1 and e1 <= e2)) and least(s1, s2) < 5 and 160 - greatest(e1, e2) < 5 as chimeric from t where s2 is not null
""")
def chimeric_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Reads whose two longest alignments lie side by side over an exon."""
    return Q.chimeric(_alignments(spark, folder), _ORDER, 160)


@classification.add(f"""
with {inputs.CALLS}, r as (select distinct (call_id * 7919) % 97 as read_seq, call_id as cand_id, circ_type from calls), n as (select read_seq, count(case when circ_type = 'R' then 1 end) as r, count(case when circ_type = 'S' then 1 end) as s from r group by 1)
select cast(sum(r * (r - 1) // 2) as bigint) as regular_regular, cast(sum(s * (s - 1) // 2) as bigint) as self_self, cast(sum(s * r) as bigint) as self_regular from n
""")
def shared_read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of calls that share a read, by kind."""
    c = inputs.calls(spark, folder)
    return Q.shared_reads(c.select(((F.col("call_id") * 7919) % 97).alias("read_seq"), F.col("call_id").alias("cand_id"), "circ_type"))


_JUNCTIONS = f"{inputs.GEXONS}, j as (select d.chrom, right(d.seq, 101) || left(a.seq, 101) as ref, cast(least(101, length(d.seq)) as int) as breakpoint from gexons d join gexons a on d.chrom = a.chrom and d.exon_no = 1 and a.exon_no = 0)"


def _junctions(exons: DataFrame) -> DataFrame:
    d = exons.filter("exon_no = 1").select("chrom", F.col("seq").alias("d"))
    a = exons.filter("exon_no = 0").select("chrom", F.col("seq").alias("a"))
    return Q.junction_references(d, a, ["chrom"])


@classification.add(f"with {_JUNCTIONS} select * from j")
def junction_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Junction sequences with their breakpoints."""
    return _junctions(inputs.genome_exons(spark, folder))


@classification.add(f"""
with {inputs.GEXONS}, x as (select l.chrom, l.start_pos, r.end_pos, l.end_pos as left_end, r.start_pos as right_start, g.seq from gexons l join gexons r on l.chrom = r.chrom and l.exon_no = 0 and r.exon_no = 1 join genome g on g.chrom = l.chrom)
select chrom, start_pos, end_pos, substring(seq, right_start, end_pos - right_start + 1) || substring(seq, start_pos, left_end - start_pos + 1) as junction,
substring(seq, right_start, end_pos - right_start + 1) || substring(seq, start_pos, end_pos - start_pos + 1) as complement, length(substring(seq, right_start, end_pos - right_start + 1) || substring(seq, start_pos, left_end - start_pos + 1)) < 101 as poor from x
""")
def circular_reference(spark: SparkSession, folder: str) -> DataFrame:
    """References of circular molecules out of two exons."""
    e = inputs.genome_exons(spark, folder)
    left = e.filter("exon_no = 0").select("chrom", "start_pos", F.col("end_pos").alias("left_end"))
    right = e.filter("exon_no = 1").select("chrom", F.col("start_pos").alias("right_start"), "end_pos")
    return Q.circular_references(left.join(right, "chrom"), inputs.genome(spark, folder))


@classification.add()
def classify_end_to_end(spark: SparkSession, folder: str) -> DataFrame:
    """Reads over planted junctions aligned to their junction reference, and the status of each candidate."""
    exons = cut_lineage(inputs.genome_exons(spark, folder))
    refs = _junctions(exons).select("chrom", F.col("ref"), "breakpoint")
    d = exons.filter("exon_no = 1").select("chrom", F.col("seq").alias("d"))
    a = exons.filter("exon_no = 0").select("chrom", F.col("seq").alias("a"))
    cut = d.join(a, "chrom").select("chrom", "d", "a", F.explode(F.array(F.lit(30), F.lit(50), F.lit(70))).alias("left"))
    reads = cut.select("chrom", F.col("left").alias("read_id"), F.concat(F.right("d", F.col("left")), F.left("a", 101 - F.col("left"))).alias("seq"))
    pairs = reads.join(refs, "chrom").withColumnRenamed("chrom", "cand_id")
    aligned = align(pairs, "seq", "ref", ["cand_id", "read_id", "breakpoint"])
    return Q.major_status(Q.read_status(aligned, ["q_start", "s"], "breakpoint"))


@classification.add("select cast(count(*) as bigint) as n, cast(sum(case when l_quantity > 10 then 1 else 0 end) as bigint) as spanning from lineitem")
def spanning_reads(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines, and those of a quantity above 10; reads that span junctions are in ``junction_spanning_reads``."""
    li = table(spark, folder, "lineitem").select((F.col("l_quantity") > 10).alias("x"))
    return li.agg(F.count(F.lit(1)).alias("n"), F.count_if("x").alias("spanning"))


_KINDS = ("Good", "AdditionalPart", "AdditionalPart_Ref", "Imbalance", "LowQuality", "Bad")
_SPAN_COUNTS = ", ".join(f"cast(count(case when spans > 0 and status = '{k}' then 1 end) as bigint) as {k.lower()}" for k in _KINDS)


@classification.add(f"""
with {_STATUS}, r as (select cand_id, read_id, count(*) as n, count(case when s < 60 and e > 60 then 1 end) as spans from alignments group by 1, 2)
select r.cand_id, cast(sum(n) as bigint) as alignments, cast(sum(spans) as bigint) as spanning, cast(count(*) as bigint) as reads, cast(count(case when spans > 0 then 1 end) as bigint) as spanning_reads,
count(case when spans > 0 then 1 end) > 0 as valid, {_SPAN_COUNTS} from r join status x on r.cand_id = x.cand_id and r.read_id = x.read_id group by 1
""")
def junction_spanning_reads(spark: SparkSession, folder: str) -> DataFrame:
    """Per candidate: alignments and reads, those with start < breakpoint < end, and the latter's reads by status."""
    a = _alignments(spark, folder)
    return Q.spanning_reads(a, Q.read_status(a, _ORDER, "bp"), "bp", _KINDS)


@classification.add(f"""
with {inputs.ALIGNMENTS}, r as (select cand_id, read_id, bool_or(s + 10 < 60 and e - 10 > 60) as valid from alignments group by 1, 2)
select count(*) as total, count(case when valid then 1 end) as valid, count(case when valid and read_id % 2 = 1 then 1 end) as reversed, count(case when valid and read_id % 2 = 0 then 1 end) as regular from r
""")
def spanning_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Reads over junctions in all, those that span them by ten bases, and of these the reversed and the other ones."""
    return Q.spanning_totals(_alignments(spark, folder).withColumn("rc", F.col("read_id") % 2 == 1), "bp", 10)
