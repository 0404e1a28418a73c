"""Queries on what a run writes, on references out of exons, and on how calls lie in genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import flanks, is_reversed
from ..sources import calls as S
from ..sources.sequences import spliced_exons, spliced_references
from . import classify as Q
from . import compare as C
from . import inputs
from .detect import with_signals
from .registry import Registry

reports = Registry()
_LINE = "chrom || ' ' || start_pos || ' ' || end_pos || ' '"


@reports.add(f"""
with {inputs.CALLS}, c as (select *, start_pos + end_pos as total from calls where circ_type in ('S', 'R')), own as (select distinct chrom, total from c where circ_type = 'S'),
t as (select c.*, circ_type = 'R' and own.total is not null as twice from c left join own on c.chrom = own.chrom and c.total = own.total),
n as (select chrom, count(case when circ_type = 'S' then 1 end) as s, count(case when circ_type = 'R' then 1 end) as r, count(case when twice then 1 end) as d from t group by chrom)
select chrom, '0' as part, 'Self Circular RNA   : ' || s as value from n union all select chrom, '1', 'Regular Circular RNA: ' || r from n union all
select chrom, '2', 'Total RNA Number    : ' || (s + r) from n union all select chrom, '5', 'Duplicated Num: ' || d from n union all
select chrom, case when circ_type = 'S' then '3' else '4' end, chrom || chr(9) || '<' || start_pos || ', ' || end_pos || '>' || chr(9) || coalesce(support, 0) from t where not twice
""")
def candidate_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report of candidates per chromosome, by parts."""
    return S.candidate_report(inputs.calls(spark, folder))


@reports.add(f"with {inputs.CALLS} select {_LINE} || coalesce(support, 0) || ' xx ' || circ_type as value from calls")
def untagged_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Brief lines of all calls without their tags."""
    return S.untagged_lines(inputs.calls(spark, folder))


@reports.add(f"with {inputs.CALLS} select {_LINE} || (end_pos - start_pos) || ' xx ' || circ_type as value from calls")
def database_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Brief lines of records without support: their length stands for it."""
    return S.database_lines(inputs.calls(spark, folder))


@reports.add(f"with {inputs.CALLS} select chrom, min(call_id) as first from calls group by chrom")
def first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """Chromosomes with the first call they appear in."""
    return S.in_order_seen(inputs.calls(spark, folder), "chrom", "call_id")


@reports.add(f"with {inputs.CALLS} select call_id from calls a where tool = 'ciri' and exists (select 1 from calls b where b.tool <> 'ciri' and a.chrom = b.chrom and a.start_pos = b.start_pos and a.end_pos = b.end_pos)")
def exact_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of one tool at exactly a place that another tool has."""
    c = inputs.calls(spark, folder)
    return C.exact_calls(c.filter("tool = 'ciri'"), c.filter("tool <> 'ciri'")).select("call_id")


@reports.add(f"""
with {inputs.CALLS}, p as (select distinct tool, chrom, start_pos, end_pos from calls)
select a.chrom, a.start_pos, a.end_pos, b.start_pos as r_start_pos, b.end_pos as r_end_pos from p a join p b on a.tool = 'ciri' and b.tool = 'dbg' and a.chrom = b.chrom and (abs(a.start_pos - b.start_pos) < 8 or abs(a.end_pos - b.end_pos) < 8)
""")
def one_side_near(spark: SparkSession, folder: str) -> DataFrame:
    """Places of two tools that are near each other at one end at least."""
    p = C.places(inputs.calls(spark, folder)).drop("copies")
    a, b = (p.filter(F.col("tool") == t).drop("tool") for t in ("ciri", "dbg"))
    return C.one_side(a, b)


@reports.add(f"""
with {inputs.CALLS}, p as (select distinct tool, chrom, start_pos, end_pos from calls), t as (select distinct chrom, start_pos, end_pos from calls where tool = 'circexplorer'),
h as (select tool, count(*) as hits from p a where exists (select 1 from t b where a.chrom = b.chrom and abs(a.start_pos - b.start_pos) <= 10 and abs(a.end_pos - b.end_pos) <= 10) group by tool)
select p.tool, count(*) as places, coalesce(max(hits), 0) as hits, coalesce(max(hits), 0) / count(*) as ratio from p left join h on p.tool = h.tool group by p.tool
""")
def database_hit_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each tool's places that a database has."""
    c = inputs.calls(spark, folder)
    return C.hit_ratio(c, c.filter("tool = 'circexplorer'"))


_SIGNALS = f"""{inputs.GEXONS}, s as (select e.chrom, e.exon_no, e.strand, substring(g.seq, start_pos - 2, 2) as head2, substring(g.seq, end_pos + 1, 2) as tail2 from gexons e join genome g on e.chrom = g.chrom),
signals as (select *, case when strand = '+' then head2 = 'AG' else head2 = 'AC' end as head_signal, case when strand = '+' then tail2 = 'GT' else tail2 = 'CT' end as tail_signal from s)"""


@reports.add(f"with {_SIGNALS} select chrom, exon_no, head_signal, tail_signal, head_signal or tail_signal as either, head_signal and tail_signal as both from signals")
def splice_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the bases beside exons are splice signals."""
    e = inputs.genome_exons(spark, folder).drop("seq", "head_signal", "tail_signal")
    s = with_signals(e, inputs.genome(spark, folder))
    return s.select("chrom", "exon_no", "head_signal", "tail_signal", (F.col("head_signal") | F.col("tail_signal")).alias("either"), (F.col("head_signal") & F.col("tail_signal")).alias("both"))


_WAY = "case when e.strand = '+' then {0} else {1} end"


@reports.add(f"""
with {inputs.GEXONS}, f as (select e.chrom, e.exon_no, e.strand = '-' as reversed, substring(g.seq, greatest(start_pos - 50, 1), least(start_pos - 1, 50)) as l, substring(g.seq, end_pos + 1, 50) as r, e.strand from gexons e join genome g on e.chrom = g.chrom)
select chrom, exon_no, reversed, {_WAY.format('l', 'reverse(r)')} as before, {_WAY.format('r', 'reverse(l)')} as after from f e
""")
def flank_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty bases on either side of exons, read backwards where the exon runs backwards."""
    e = inputs.genome_exons(spark, folder).drop("seq").join(inputs.genome(spark, folder), "chrom")
    plus = F.col("strand") == "+"
    start, end = F.when(plus, F.col("start_pos")).otherwise(F.col("end_pos")), F.when(plus, F.col("end_pos")).otherwise(F.col("start_pos"))
    before, after = flanks(F.col("seq"), start, end)
    return e.select("chrom", "exon_no", is_reversed(start, end).alias("reversed"), before.alias("before"), after.alias("after"))


_SPLICED = f"""{inputs.GEXONS}, r as (select chrom, chrom || ' | ' || chrom || ' | ' || min(start_pos) || ':' || max(end_pos) || ' | 0 | ' || min(start_pos) || ':' || max(end_pos) || ' | ' || string_agg(exon_no, ', ' order by start_pos)
    || ' | ' || string_agg('(' || start_pos || ', ' || end_pos || ')', ', ' order by start_pos) || ' | ' || sum(length(seq)) as name, string_agg(seq, '' order by start_pos) as seq from gexons group by chrom)"""


@reports.add(f"with {_SPLICED} select name, seq from r")
def spliced_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts' exons joined into one sequence under names that tell them."""
    return spliced_references(inputs.genome_exons(spark, folder), inputs.genome(spark, folder))


@reports.add(f"with {_SPLICED} select cast(e.chrom as varchar) as chrom, cast(gene_id as varchar) as gene_id, '0' as tx_id, exon_no, start_pos, end_pos, cast(length(r.seq) as int) as length from gexons e join r on e.chrom = r.chrom")
def spliced_reference_exons(spark: SparkSession, folder: str) -> DataFrame:
    """Exons told back from the names of such sequences."""
    return spliced_exons(spliced_reference(spark, folder))


@reports.add(f"""
with {inputs.GEXONS} select 'Donor(Start, End) & Acceptor(Start, End): (' || d.start_pos || ', ' || d.end_pos || ') -- (' || a.start_pos || ', ' || a.end_pos || ')' || chr(10) || 'Candi Start & End: ' || d.end_pos || ' : ' || a.start_pos || chr(10)
    || 'RC: ' || case when d.strand = '-' then 'Yes' else 'No' end || chr(10) || 'Chrom: ' || d.chrom || chr(10) || 'Current Reads: Reg' || chr(10) || 'CircType: 1' || chr(10) || right(d.seq, 50) || left(a.seq, 51) || chr(10) || '***' as value
from gexons d join gexons a on d.chrom = a.chrom and d.exon_no = 1 and a.exon_no = 0
""")
def detail_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks that tell of each read its donor, acceptor and junction."""
    e = inputs.genome_exons(spark, folder)
    side = lambda n, to: e.filter(F.col("exon_no") == n).select("chrom", "strand", F.struct(F.col("start_pos").alias("start"), F.col("end_pos").alias("end")).alias(to), F.col("seq").alias(f"{to}_seq"))
    rows = side(1, "donor").join(side(0, "acceptor").drop("strand"), "chrom")
    return S.detail_blocks(rows.select("donor", "acceptor", F.col("donor.end").alias("cand_start"), F.col("acceptor.start").alias("cand_end"), (F.col("strand") == "-").alias("rc"), F.col("chrom").cast("string").alias("chrom"), F.lit(False).alias("read_rc"), F.lit(1).alias("circ_type"), F.concat(F.right("donor_seq", F.lit(50)), F.left("acceptor_seq", F.lit(51))).alias("read_seq")))


@reports.add(f"""
with {inputs.GEXONS}, j as (select d.chrom, d.seq as d, a.seq as a from gexons d join gexons a on d.chrom = a.chrom and d.exon_no = 1 and a.exon_no = 0)
select chrom, 'junction' as kind, right(d, 101) || left(a, 101) as ref, cast(least(101, length(d)) as int) as breakpoint from j
union all select chrom, 'donor_self', d, -1 from j union all select chrom, 'acceptor_self', a, -1 from j
""")
def alignment_references(spark: SparkSession, folder: str) -> DataFrame:
    """What reads of a candidate are aligned to: its junction, the whole donor and the whole acceptor."""
    e = inputs.genome_exons(spark, folder)
    d, a = (e.filter(F.col("exon_no") == n).select("chrom", F.col("seq").alias(c)) for n, c in ((1, "d"), (0, "a")))
    return Q.alignment_references(d, a, ["chrom"])


_OCALLS = """ocalls as (select o_orderkey as call_id, o_custkey % 5 as chrom, least(o_custkey * 1000 + (o_orderkey * 7) % 400, o_custkey * 1000 + 500 + (o_orderkey * 3) % 400) as s,
    greatest(o_custkey * 1000 + (o_orderkey * 7) % 400, o_custkey * 1000 + 500 + (o_orderkey * 3) % 400) as e from orders)"""
_CHAIN = f"""{inputs.EXONS}, {_OCALLS}, genes as (select chrom, gene_id, min(start_pos) as gs, max(end_pos) as ge from exons group by 1, 2), txs as (select chrom, gene_id, tx_id, min(start_pos) as ts, max(end_pos) as te from exons group by 1, 2, 3),
g as (select * from (select c.*, gene_id, row_number() over (partition by call_id order by gs, ge, gene_id) as rk from ocalls c join genes on c.chrom = genes.chrom and c.s >= gs - 10 and c.e <= ge + 10) where rk = 1),
t as (select * from (select g.call_id, g.chrom, g.s, g.e, g.gene_id, tx_id, row_number() over (partition by call_id order by ts, te, tx_id) as rk from g join txs on g.chrom = txs.chrom and g.gene_id = txs.gene_id and g.s >= ts - 10 and g.e <= te + 10) where rk = 1),
x as (select *, lag(end_pos) over (partition by chrom, tx_id order by start_pos, end_pos) as before from exons),
p as (select call_id, 'l' as side, s as spot, t.chrom, tx_id from t union all select call_id, 'r', e, chrom, tx_id from t),
k as (select call_id, side, min(case when spot between start_pos - 10 and end_pos + 10 then least(abs(spot - start_pos), abs(end_pos - spot)) end) as exon, min(case when spot between before - 10 and start_pos + 10 then least(abs(spot - before), abs(start_pos - spot)) end) as intron
    from p join x on p.chrom = x.chrom and p.tx_id = x.tx_id group by 1, 2),
w as (select call_id, side, case when exon is not null then 'exon' when intron is not null then 'intron' else 'none' end as place, coalesce(exon, intron) as away from k),
chain as (select c.call_id, g.gene_id, t.tx_id, l.place as left_place, l.away as left_away, r.place as right_place, r.away as right_away from ocalls c left join g on c.call_id = g.call_id left join t on c.call_id = t.call_id
    left join w l on c.call_id = l.call_id and l.side = 'l' left join w r on c.call_id = r.call_id and r.side = 'r')"""


def _chain(spark: SparkSession, folder: str) -> DataFrame:
    from .compare_queries import _order_calls

    return C.containment(_order_calls(spark, folder), inputs.exons(spark, folder))


@reports.add(f"with {_CHAIN} select * from chain")
def containment_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The first gene around each call, its first transcript around it, and the exon or intron that either end lies in."""
    return _chain(spark, folder)


@reports.add(f"""
with {_CHAIN}, c as (select coalesce(left_place, 'none') as left_place, coalesce(right_place, 'none') as right_place, case when left_away <= 10 and right_away <= 200 or left_away <= 200 and right_away <= 10 then 'edge' when left_away <= 200 and right_away <= 200 then 'near' else 'other' end as away from chain)
select left_place, right_place, away, count(*) as n from c group by all
""")
def distance_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Calls by where their ends lie and how far from the edges there."""
    return C.distance_classes(_chain(spark, folder))
