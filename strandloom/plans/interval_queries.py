"""Queries on exons, junctions and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotation as A
from ..operators.packed import split_packed
from ..operators.rowcheck import check_lines
from ..session import table
from ..sources.gtf import attribute_columns, fixed_and_rest
from . import inputs
from .annotation_problems import ELEMENT_OK
from .registry import Registry

intervals = Registry()
TX = ["chrom", "tx_id"]

_ELEMENTS = f"""elements as (select id_ as id, {inputs.KEY.format('seqname_')} as chrom, try_cast(trim(start_, ' ') as bigint) as start_pos, try_cast(trim(end_, ' ') as bigint) as end_pos,
    trim(strand_, ' ') as strand, trim(feature_, ' ') as feature from gff_element where {ELEMENT_OK} and regexp_full_match(trim(coalesce(end_, ''), ' '), '[0-9]+') and try_cast(trim(end_, ' ') as bigint) <= 2147483647)"""
_RANGES = f"{_ELEMENTS}, ranges as (select distinct chrom, start_pos, end_pos from elements where feature = 'exon')"


def _ranges(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.elements(spark, folder).filter("feature = 'exon'").select("chrom", "start_pos", "end_pos").distinct()


@intervals.add(f"""
with {inputs.EXONS} select chrom, tx_id, start_pos, end_pos, cast(row_number() over w as int) as exon_number, coalesce(lag(end_pos) over w >= start_pos, false) as overlaps_previous
from exons window w as (partition by chrom, tx_id order by start_pos, end_pos)
""")
def exon_number(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of exons within their transcripts."""
    return A.exon_numbers(inputs.exons(spark, folder), TX, "start_pos", "end_pos").select(*TX, "start_pos", "end_pos", "exon_number", "overlaps_previous")


_JUNCS = f"""{inputs.EXONS}, juncs as (select * from (select chrom, tx_id, gene_id, exon_no, lag(start_pos) over w as lstart, lag(end_pos) over w as lend, start_pos as rstart, end_pos as rend
    from exons window w as (partition by chrom, tx_id order by start_pos, end_pos)) where lend is not null)"""


def _juncs(spark: SparkSession, folder: str) -> DataFrame:
    return A.splice_junctions(inputs.exons(spark, folder), TX, "start_pos", "end_pos", ["gene_id", "exon_no"])


@intervals.add(f"with {_JUNCS} select * from juncs")
def splice_juncs(spark: SparkSession, folder: str) -> DataFrame:
    """Splice junctions between neighbouring exons."""
    return _juncs(spark, folder)


@intervals.add(f"""
with {_JUNCS}, o as (select *, tx_id * 100 + exon_no as ord from juncs),
g as (select chrom, lend, rstart, gene_id, count(*) as n, min(ord) as first, min(lstart) as lstart, max(rend) as rend from o group by all),
p as (select *, row_number() over (partition by chrom, lend, rstart order by n desc, first) as rk from g)
select chrom, lend, rstart, cast(sum(n) as bigint) as sites, min(lstart) as lstart, max(rend) as rend, max(case when rk = 1 then gene_id end) as gene_id, min(first) as first_id from p group by chrom, lend, rstart
""")
def unify_juncs(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct splice site pairs with their outermost bounds and most frequent gene."""
    j = _juncs(spark, folder).withColumn("ord", F.col("tx_id") * 100 + F.col("exon_no"))
    return A.unify_junctions(j, "chrom", "gene_id", "ord")


@intervals.add(f"""
with {inputs.EXONS} select chrom, tx_id, start_pos, case when strand = '-' then lead(start_pos) over w - end_pos - 1 else start_pos - lag(end_pos) over w - 1 end as intron,
lag(end_pos - start_pos + 1) over w as previous_length, lead(end_pos - start_pos + 1) over w as next_length
from exons window w as (partition by chrom, tx_id order by start_pos, end_pos)
""")
def intron_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Introns before exons in reading direction, and the neighbours' lengths."""
    return A.introns(inputs.exons(spark, folder), TX, "start_pos", "end_pos", "strand").select(*TX, "start_pos", "intron", "previous_length", "next_length")


@intervals.add(f"with {_RANGES} select *, max(end_pos) over (partition by chrom order by start_pos, end_pos rows unbounded preceding) as cum_max from ranges")
def cum_max(spark: SparkSession, folder: str) -> DataFrame:
    """Running maximum of the ends of exons along each sequence."""
    return A.cumulative_max(_ranges(spark, folder), ["chrom"], "start_pos", "end_pos")


_UNIFIED = f"""{_RANGES}, m as (select *, max(end_pos) over (partition by chrom order by start_pos, end_pos rows between unbounded preceding and 1 preceding) as before from ranges),
unified as (select chrom, case when before is null or start_pos > before then start_pos else before + 1 end as begin, end_pos as "end",
    case when before is null or start_pos > before then 0 else start_pos - before end as ubs from m where before is null or end_pos > before)"""


@intervals.add(f'with {_UNIFIED} select chrom, begin, "end", ubs from unified')
def unify_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Disjoint cover of the exons."""
    return A.unify_ranges(_ranges(spark, folder), "chrom", "start_pos", "end_pos")


@intervals.add(f"""
with {_UNIFIED}, {inputs.CALLS}, q as (select call_id as id, chrom, start_pos as qs, end_pos as qe from calls),
x as (select q.*, u.begin as rs, u."end" as re from q asof left join unified u on q.chrom = u.chrom and q.qs <= u."end"),
k as (select *, case when re is null or qe < rs then 'no' when qs < rs and qe > re then 'b' when qs < rs then 'l' when qe > re then 'r' else 'n' end as class from x)
select chrom, id, qs, qe, case when class <> 'no' then rs end as rs, case when class <> 'no' then re end as re, class from k
""")
def overlap_class(spark: SparkSession, folder: str) -> DataFrame:
    """How each call lies to the covered range at or after its start."""
    refs = A.unify_ranges(_ranges(spark, folder), "chrom", "start_pos", "end_pos").select("chrom", F.col("begin").alias("rs"), F.col("end").alias("re"))
    q = inputs.calls(spark, folder).select(F.col("call_id").alias("id"), "chrom", F.col("start_pos").cast("bigint").alias("qs"), F.col("end_pos").cast("bigint").alias("qe"))
    return A.overlap_class(q, refs, "chrom")


@intervals.add(f"""
with {_JUNCS}, q as (select chrom, tx_id * 100 + exon_no as id, lstart, lend, rstart, rend from juncs where tx_id % 4 <> 0), r as (select chrom, tx_id * 100 + exon_no as ref_id, lstart, lend, rstart, rend from juncs where tx_id % 4 = 0),
p as (select q.id, r.ref_id, r.lstart, abs(q.lend - r.lend) + abs(q.rstart - r.rstart) as sod from q join r on q.chrom = r.chrom and q.lstart < r.rend and q.rend > r.lstart),
k as (select *, row_number() over (partition by id order by sod, lstart, ref_id) as rk, count(*) over (partition by id) as n from p)
select q.id, coalesce(k.ref_id, 0) as ref_id, k.sod, cast(coalesce(k.n, 0) as bigint) as overlaps from q left join k on q.id = k.id and k.rk = 1
""")
def gap_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest reference junction of each junction, by inner bounds."""
    j = _juncs(spark, folder).withColumn("id", F.col("tx_id") * 100 + F.col("exon_no"))
    return A.nearest_gap(j.filter("tx_id % 4 <> 0"), j.filter("tx_id % 4 = 0").withColumnRenamed("id", "ref_id"), "chrom")


@intervals.add(f"""
with {_ELEMENTS}, {inputs.CALLS}, g as (select id as outer_id, chrom, start_pos as os, end_pos as oe from elements where feature = 'gene'),
p as (select c.call_id, g.*, row_number() over (partition by call_id order by os, oe, outer_id) as rk from calls c join g on c.chrom = g.chrom and g.os <= c.start_pos and c.start_pos + 100 <= g.oe)
select c.call_id as id, p.outer_id from calls c left join p on c.call_id = p.call_id and p.rk = 1
""")
def containment_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first gene that contains the beginning of each call."""
    g = inputs.elements(spark, folder).filter("feature = 'gene'").select(F.col("id").alias("outer_id"), "chrom", F.col("start_pos").alias("os"), F.col("end_pos").alias("oe"))
    c = inputs.calls(spark, folder).select(F.col("call_id").alias("id"), "chrom", F.col("start_pos").cast("bigint").alias("is_"), (F.col("start_pos") + 100).cast("bigint").alias("ie"))
    return A.first_container(c, g, "chrom")


@intervals.add(f"with {inputs.EXONS} select strand, cast(count(*) as bigint) as distinct_exons, cast(count(case when end_pos - start_pos + 1 < 100 then 1 end) as bigint) as short from (select distinct chrom, start_pos, end_pos, strand from exons) group by strand")
def distinct_exons(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct exons and how many of them are short, per strand."""
    e = inputs.exons(spark, folder).select("chrom", "start_pos", "end_pos", "strand").distinct()
    return e.groupBy("strand").agg(F.count(F.lit(1)).alias("distinct_exons"), F.count(F.when(F.col("end_pos") - F.col("start_pos") + 1 < 100, 1)).alias("short"))


@intervals.add("""
with l as (select *, string_split(line, chr(9)) as cells from gtf_line where line is not null and line <> '' and line not like '#%'),
r as (select line_id, gff_file, line_no, cells[3] as feature from l where len(cells) = 9),
n as (select *, sum((feature = 'gene')::int) over w as gene_no, sum((feature = 'transcript')::int) over w as tx_no, sum((feature = 'exon')::int) over w as exon_no from r window w as (partition by gff_file order by line_no, line_id))
select line_id, cast(gene_no as bigint) as gene_no, cast(tx_no as bigint) as tx_no, cast(exon_no as bigint) as exon_no,
cast(case when feature = 'exon' then exon_no - min(case when feature = 'exon' then exon_no end) over (partition by gff_file, tx_no) + 1 end as bigint) as exon_in_tx from n
""")
def file_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    """Running numbers of genes, transcripts and exons along annotation files."""
    rows = check_lines(table(spark, folder, "gtf_line").select("line_id", "gff_file", "line_no", "line")).filter(F.size("cells") == 9)
    rows = rows.select("line_id", "gff_file", "line_no", F.get("cells", F.lit(2)).alias("feature"))
    return A.ordinals(rows, "gff_file", "line_no", "feature", ["line_id"]).select("line_id", "gene_no", "tx_no", "exon_no", "exon_in_tx")


def _attributes(spark: SparkSession, folder: str) -> DataFrame:
    return split_packed(table(spark, folder, "split_gtf_attr"), "id_vec", "attr_vec")


@intervals.add()
def attribute_columns_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Attributes as one column per name that is in use."""
    return attribute_columns(_attributes(spark, folder), "id_vec")


@intervals.add()
def attribute_fixed_and_rest(spark: SparkSession, folder: str) -> DataFrame:
    """The first two attributes of each field, with those beyond them as rows (one without any, if there are none)."""
    fixed, rest = fixed_and_rest(_attributes(spark, folder), "id_vec")
    return fixed.join(rest, "id_vec", "left")


@intervals.add(f"with {inputs.EXONS} select chrom, gene_id, cast(count(distinct tx_id) as int) as transcripts, cast(count(*) as bigint) as exons, min(start_pos) as first_start from exons group by chrom, gene_id")
def exon_tree_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Genes as nested transcripts and exons, measured."""
    from ..sources.gtf import exon_tree

    t = exon_tree(inputs.exons(spark, folder))
    flat = F.flatten(F.transform("transcripts", lambda x: x["exons"]))
    return t.select("chrom", "gene_id", F.size("transcripts").alias("transcripts"), F.size(flat).cast("bigint").alias("exons"), F.array_min(F.transform(flat, lambda e: e["start_pos"])).alias("first_start"))
