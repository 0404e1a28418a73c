"""Queries on call sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators.bands import band_join
from ..operators.folds import drop_later_similar, merge_support
from ..session import cut_lineage, table
from ..sources.calls import brief_lines, first_of_each
from . import compare as C
from . import inputs
from .registry import Registry

comparison = Registry()
_NEAR = "a.chrom = b.chrom and abs(a.start_pos - b.start_pos) <= 10 and abs(a.end_pos - b.end_pos) <= 10"
_PLACES = f"{inputs.CALLS}, p as (select tool, chrom, start_pos, end_pos, cast(count(*) as bigint) as copies from calls group by all)"


@comparison.add(f"with {inputs.CALLS} select * from calls")
def calls_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Calls with bounds in order, one spelling of chromosomes, defaults for tags and types."""
    return inputs.calls(spark, folder)


@comparison.add(f"with {_PLACES} select a.chrom, a.start_pos, a.end_pos, a.copies, b.start_pos as r_start_pos, b.end_pos as r_end_pos, b.copies as r_copies from p a join p b on a.tool = 'ciri' and b.tool = 'dbg' and {_NEAR}")
def band_intersect(spark: SparkSession, folder: str) -> DataFrame:
    """Places of two tools that are near each other."""
    p = C.places(inputs.calls(spark, folder))
    a, b = (p.filter(F.col("tool") == t).drop("tool") for t in ("ciri", "dbg"))
    return band_join(a, b, ["chrom"]).drop("r_chrom")


@comparison.add(f"with {inputs.CALLS} select call_id from calls a where tool = 'ciri' and exists (select 1 from calls b where b.tool = 'dbg' and {_NEAR})")
def band_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of one tool that another has too."""
    c = inputs.calls(spark, folder)
    return C.hit_calls(c.filter("tool = 'ciri'"), c.filter("tool = 'dbg'")).select("call_id")


@comparison.add(f"with {inputs.CALLS} select call_id from calls a where tool = 'ciri' and not exists (select 1 from calls b where b.tool = 'dbg' and {_NEAR})")
def band_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of one tool that another lacks."""
    c = inputs.calls(spark, folder)
    return C.hit_calls(c.filter("tool = 'ciri'"), c.filter("tool = 'dbg'"), missed=True).select("call_id")


@comparison.add(f"""
with {_PLACES}, h as (select a.tool, b.tool as other, count(distinct (a.chrom, a.start_pos, a.end_pos)) as hits from p a join p b on a.tool <> b.tool and {_NEAR} group by 1, 2), n as (select tool, count(*) as places from p group by 1)
select h.tool, h.other, cast(places as bigint) as places, cast(hits as bigint) as hits, hits / places as share from h join n on h.tool = n.tool
""")
def pairwise_tools(spark: SparkSession, folder: str) -> DataFrame:
    """Every ordered pair of tools."""
    return C.pairwise(inputs.calls(spark, folder))


@comparison.add(f"""
with {inputs.CALLS}, t as (select distinct chrom, start_pos, end_pos from calls where tool = 'circexplorer'),
p as (select distinct tool, chrom, start_pos, end_pos, circ_type from calls where tool <> 'circexplorer'),
h as (select tool, count(*) as hits from p a where exists (select 1 from t b where {_NEAR}) group by tool),
f as (select a.tool, count(distinct (b.chrom, b.start_pos, b.end_pos)) as found from p a join t b on {_NEAR} group by a.tool),
o as (select tool, count(case when circ_type = 'S' then 1 end) as self_calls, count(case when circ_type = 'R' then 1 end) as regular_calls, count(*) as places from p group by tool),
m as (select o.*, coalesce(hits, 0) as hits, coalesce(found, 0) as found, coalesce(hits, 0) / places as precision, coalesce(found, 0) / (select count(*) from t) as recall from o left join h on o.tool = h.tool left join f on o.tool = f.tool)
select tool, cast(self_calls as bigint) as self_calls, cast(regular_calls as bigint) as regular_calls, cast(places as bigint) as places, cast(hits as bigint) as hits, cast(found as bigint) as found, precision, recall,
case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from m
""")
def tool_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 of tools against one of them."""
    c = inputs.calls(spark, folder)
    return C.metrics(c.filter("tool <> 'circexplorer'"), c.filter("tool = 'circexplorer'"))


def _folded(rows: str, reach: int, moves: bool) -> str:
    """SQL that folds ``rows`` (chrom, s, e, w, rn from 1 per chrom) in order into ``folded`` (chrom, x: s, e, n, w): each joins
    the first element near it or becomes one; with ``moves`` a shorter one gives the element its place."""
    near = f"list_position(list_transform(els, lambda x: abs(x.s - r.s) <= {reach} and abs(x.e - r.e) <= {reach}), true)"
    shorter = "r.e - r.s < x.e - x.s" if moves else "false"
    gain = f"{{'s': case when {shorter} then r.s else x.s end, 'e': case when {shorter} then r.e else x.e end, 'n': x.n + 1, 'w': x.w + r.w, 't': list_distinct(list_append(x.t, r.t))}}".replace("r.", "q.")
    return f"""{rows},
    steps as (select chrom, cast(0 as bigint) as rn, cast([] as struct(s bigint, e bigint, n bigint, w bigint, t varchar[])[]) as els from (select distinct chrom from r)
        union all select q.chrom, q.rn, case when i = 0 then list_append(els, {{'s': q.s, 'e': q.e, 'n': cast(1 as bigint), 'w': q.w, 't': [q.t]}}) else list_transform(els, lambda x, k: case when k = i then {gain} else x end) end
        from (select r.*, els, coalesce({near}, 0) as i from steps join r on r.chrom = steps.chrom and r.rn = steps.rn + 1) q),
    folded as (select chrom, unnest(els) as x from (select chrom, arg_max(els, rn) as els from steps group by chrom))"""


def _ordered(source: str, weight: str, order: str, label: str = "''") -> str:
    return f"r as (select chrom, cast({label} as varchar) as t, cast(start_pos as bigint) as s, cast(end_pos as bigint) as e, cast(coalesce({weight}, 0) as bigint) as w, row_number() over (partition by chrom order by {order}, start_pos, end_pos) as rn from {source})"


_REPLICATED = f"""{inputs.CALLS}, rep as (select tool, chrom, start_pos, end_pos, call_id % 2 as rep, count(*) as copies from calls group by all),
shared as (select a.tool, a.chrom, a.start_pos, a.end_pos, cast(sum(a.copies * b.copies) as bigint) as pairs from rep a join rep b on a.rep = 0 and b.rep = 1 and a.tool = b.tool and {_NEAR} group by all)"""
_ALL_SHARED = f"{inputs.CALLS}, shared as (select tool, chrom, start_pos, end_pos, cast(count(*) as bigint) as pairs from calls group by all)"
_BENCH = ", bench as (select chrom, x.s as start_pos, x.e as end_pos, x.n as members, x.w as support from folded where x.n >= 2)"
_SCORES = f"""{_BENCH}, near as (select distinct a.tool, a.chrom, a.start_pos, a.end_pos, b.start_pos as bs, b.end_pos as be from shared a join bench b on {_NEAR}),
m as (select o.tool, o.shared, coalesce(l.n, 0) as in_benchmark, coalesce(r.n, 0) as benchmark_found, (select count(*) from bench) as benchmark from (select tool, count(*) as shared from shared group by tool) o
    left join (select tool, count(distinct (chrom, start_pos, end_pos)) as n from near group by tool) l on o.tool = l.tool left join (select tool, count(distinct (chrom, bs, be)) as n from near group by tool) r on o.tool = r.tool),
s as (select *, in_benchmark / shared as accuracy, case when benchmark > 0 then benchmark_found / benchmark end as sensitivity from m)
select *, case when accuracy + sensitivity > 0 then 2 * accuracy * sensitivity / (accuracy + sensitivity) else 0 end as f1 from s"""


def _shared(spark: SparkSession, folder: str) -> DataFrame:
    return C.replicate_intersection(inputs.calls(spark, folder).withColumn("replicate", F.col("call_id") % 2), "replicate")


@comparison.add(f"""
with {inputs.CALLS}, p as (select tool, chrom, start_pos, end_pos, call_id % 2 as rep, count(*) as copies from calls group by all)
select a.tool, a.chrom, a.start_pos, a.end_pos, cast(sum(a.copies * b.copies) as bigint) as pairs from p a join p b on a.rep = 0 and b.rep = 1 and a.tool = b.tool and {_NEAR} group by all
""")
def replicate_intersect(spark: SparkSession, folder: str) -> DataFrame:
    """Places that both replicates of a tool have."""
    return _shared(spark, folder)


@comparison.add("with recursive " + _folded(f"{_ALL_SHARED}, " + _ordered("shared", "pairs", "start_pos, end_pos, tool"), 10, False) + f"{_BENCH} select * from bench")
def consensus_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """Places that several tools share, by leader clustering."""
    calls = inputs.calls(spark, folder)
    return C.benchmark(C.places(calls).withColumnRenamed("copies", "pairs"))


@comparison.add("with recursive " + _folded(f"{_ALL_SHARED}, " + _ordered("shared", "pairs", "start_pos, end_pos, tool"), 10, False) + _SCORES)
def consensus_f1(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy, sensitivity and F1 of the tools against the benchmark they make."""
    p = C.places(inputs.calls(spark, folder)).withColumnRenamed("copies", "pairs")
    return C.consensus_scores(p, cut_lineage(C.benchmark(p)))


@comparison.add("with recursive " + _folded(f"{_REPLICATED}, " + _ordered("shared", "pairs", "start_pos, end_pos, tool"), 10, False) + _SCORES)
def consensus_replicates(spark: SparkSession, folder: str) -> DataFrame:
    """Replicates intersected per tool, the benchmark of what tools share, and the tools' scores against it."""
    shared = cut_lineage(_shared(spark, folder))
    return C.consensus_scores(shared, cut_lineage(C.benchmark(shared)))


@comparison.add("with recursive " + _folded(f"{inputs.CALLS}, " + _ordered("calls", "support", "tool, call_id", "tool"), 10, False) + " select chrom, x.s as start_pos, x.e as end_pos, x.n as members, x.w as support, cast(len(x.t) as bigint) as tools from folded where len(x.t) >= 2")
def consensus_tools(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of all tools merged in order, tool after tool, with their support; places that two tools at least have."""
    return C.tool_consensus(inputs.calls(spark, folder), ["tool", "call_id"], "support")


@comparison.add("with recursive " + _folded(f"{inputs.CALLS}, " + _ordered("(select * from calls where tool <> 'dbg')", "support", "call_id"), 10, False) + f"""
, a as (select distinct chrom, start_pos, end_pos from calls where tool = 'dbg'), b as (select distinct chrom, x.s as start_pos, x.e as end_pos from folded)
select 'mine in union' as direction, (select count(*) from a) as places, (select count(*) from a where exists (select 1 from b where {_NEAR})) as hits
union all select 'union in mine', (select count(*) from b), (select count(*) from b where exists (select 1 from a where {_NEAR}))
""")
def mine_and_union(spark: SparkSession, folder: str) -> DataFrame:
    """One tool's places against the union of the others' without near copies, in both directions."""
    c = inputs.calls(spark, folder)
    union = cut_lineage(drop_later_similar(c.filter("tool <> 'dbg'"), "chrom", ["call_id"], "support"))
    return C.both_directions(c.filter("tool = 'dbg'"), union)


@comparison.add("with recursive " + _folded(f"{inputs.CALLS}, " + _ordered("calls", "support", "call_id"), 7, True) + " select chrom, x.s as start_pos, x.e as end_pos, x.w as support from folded")
def support_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Near calls merged in order of arrival, with their support added up."""
    return merge_support(inputs.calls(spark, folder), "chrom", ["call_id"], "support")


@comparison.add("with recursive " + _folded(f"{inputs.CALLS}, " + _ordered("calls", "support", "call_id"), 10, False) + " select chrom, x.s as start_pos, x.e as end_pos, x.n as members, x.w as support from folded")
def similar_self_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Calls that no earlier kept one is near to."""
    return drop_later_similar(inputs.calls(spark, folder), "chrom", ["call_id"], "support")


@comparison.add(f"with {inputs.CALLS} select * exclude (rk) from (select *, row_number() over (partition by tool, chrom, start_pos, end_pos order by call_id) as rk from calls) where rk = 1")
def exact_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """The first call of each place and tool."""
    return first_of_each(inputs.calls(spark, folder), ["tool", *C.PLACE], ["call_id"])


@comparison.add(f"""
with {inputs.CALLS}, s as (select *, start_pos + end_pos as total from calls) select call_id from s a where circ_type = 'R' and not exists (select 1 from s b where b.circ_type = 'S' and a.tool = b.tool and a.chrom = b.chrom and a.total = b.total)
""")
def self_regular_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Regular calls without a self call of the same sum of bounds."""
    c = inputs.calls(spark, folder).withColumn("total", F.col("start_pos") + F.col("end_pos"))
    own = c.filter("circ_type = 'S'").select("tool", "chrom", "total").distinct()
    return c.filter("circ_type = 'R'").join(own, ["tool", "chrom", "total"], "left_anti").select("call_id")


@comparison.add(f"with {inputs.CALLS} select chrom || ' ' || start_pos || ' ' || end_pos || ' ' || coalesce(support, 0) || ' ' || case when circ_type = 'S' then tag else 'xx' end || ' ' || circ_type as value from calls where circ_type in ('S', 'R') and coalesce(support, 0) <= 5")
def brief_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the brief format of calls with limited support."""
    return brief_lines(inputs.calls(spark, folder).filter("coalesce(support, 0) <= 5"))


@comparison.add(f"with {inputs.CALLS} select chrom || ' ' || start_pos || ' ' || end_pos || ' ' || coalesce(support, 0) || ' ' || case when circ_type = 'S' then tag else 'xx' end || ' ' || circ_type as value from calls where circ_type in ('S', 'R') and coalesce(support, 0) <= {EngineConfig().max_support}")
def brief_sink_all(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the brief format of calls up to the support limit of a run."""
    return brief_lines(inputs.calls(spark, folder).filter(F.coalesce("support", F.lit(0)) <= EngineConfig().max_support))


@comparison.add(f"with {inputs.CALLS} select tool, chrom, cast(count(*) as bigint) as n, cast(sum(support) as bigint) as support from calls group by tool, chrom union all select 'all', chrom, cast(count(*) as bigint), cast(sum(support) as bigint) from calls group by chrom")
def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Calls per tool and chromosome, and of all tools together."""
    c = inputs.calls(spark, folder)
    agg = [F.count(F.lit(1)).alias("n"), F.sum("support").alias("support")]
    return c.groupBy("tool", "chrom").agg(*agg).unionByName(c.groupBy("chrom").agg(*agg).withColumn("tool", F.lit("all")))


@comparison.add(f"""
with {inputs.CALLS}, c as (select chrom, start_pos, end_pos, array_agg(distinct tool order by tool) as cells from calls group by all) select chrom, start_pos, end_pos, cells from c where len(list_filter(cells, lambda x: contains(x, 'circ'))) > 0
""")
def tissue_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Places of which some cell's name holds a word."""
    from ..sources.calls import has_tissue

    c = inputs.calls(spark, folder).groupBy(*C.PLACE).agg(F.array_sort(F.collect_set("tool")).alias("cells"))
    return c.filter(has_tissue("cells", "circ"))


_OCALLS = """ocalls as (select o_orderkey as call_id, o_custkey % 5 as chrom, least(o_custkey * 1000 + (o_orderkey * 7) % 400, o_custkey * 1000 + 500 + (o_orderkey * 3) % 400) as start_pos,
    greatest(o_custkey * 1000 + (o_orderkey * 7) % 400, o_custkey * 1000 + 500 + (o_orderkey * 3) % 400) as end_pos from orders)"""


def _order_calls(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    a, b = F.col("o_custkey") * 1000 + (F.col("o_orderkey") * 7) % 400, F.col("o_custkey") * 1000 + 500 + (F.col("o_orderkey") * 3) % 400
    return o.select(F.col("o_orderkey").alias("call_id"), (F.col("o_custkey") % 5).alias("chrom"), F.least(a, b).alias("start_pos"), F.greatest(a, b).alias("end_pos"))


@comparison.add(f"""
with {inputs.EXONS}, {_OCALLS}, l as (select c.call_id, e.tx_id, e.exon_no from ocalls c join exons e on c.chrom = e.chrom and abs(c.start_pos - e.start_pos) <= 10),
r as (select c.call_id, e.tx_id, e.exon_no from ocalls c join exons e on c.chrom = e.chrom and abs(c.end_pos - e.end_pos) <= 10),
f as (select l.call_id, bool_or(l.exon_no = r.exon_no) as same_exon from l join r on l.call_id = r.call_id and l.tx_id = r.tx_id group by l.call_id)
select c.call_id, f.call_id is not null as "both", coalesce(same_exon, false) as same_exon from ocalls c left join f on c.call_id = f.call_id
""")
def boundary_hit_type(spark: SparkSession, folder: str) -> DataFrame:
    """Calls whose ends hit exon boundaries of one transcript, or of one exon."""
    return C.boundary_hits(_order_calls(spark, folder), inputs.exons(spark, folder))


@comparison.add(f"""
with {inputs.EXONS}, {_OCALLS}, h as (select c.call_id, e.strand, min(case when abs(c.start_pos - e.start_pos) < 3 then 'exact' when abs(c.start_pos - e.start_pos) <= 200 then 'near' end) as left_part,
    min(case when abs(c.end_pos - e.end_pos) < 3 then 'exact' when abs(c.end_pos - e.end_pos) <= 200 then 'near' end) as right_part
    from ocalls c join exons e on c.chrom = e.chrom and abs(c.start_pos - e.start_pos) <= 200 and abs(c.end_pos - e.end_pos) <= 200 group by 1, 2)
select left_part, right_part, strand, cast(count(*) as bigint) as n from h group by all
""")
def edge_contingency(spark: SparkSession, folder: str) -> DataFrame:
    """Calls by how exactly their ends meet exon edges, per strand."""
    e = inputs.exons(spark, folder).groupBy("chrom", "start_pos", "end_pos", "strand").agg(F.count(F.lit(1)).alias("copies"))
    near = band_join(_order_calls(spark, folder), e, ["chrom"], tolerance=200)
    part = lambda a: F.min(F.when(F.abs(F.col(a) - F.col(f"r_{a}")) < 3, "exact").otherwise("near"))
    h = near.groupBy("call_id", F.col("r_strand").alias("strand")).agg(part("start_pos").alias("left_part"), part("end_pos").alias("right_part"))
    return h.groupBy("left_part", "right_part", "strand").agg(F.count(F.lit(1)).alias("n"))


@comparison.add(f"""
with {inputs.EXONS}, {_OCALLS}, l as (select c.call_id, e.tx_id, e.exon_no from ocalls c join exons e on c.chrom = e.chrom and abs(c.start_pos - e.start_pos) <= 3),
r as (select c.call_id, e.tx_id, e.exon_no from ocalls c join exons e on c.chrom = e.chrom and abs(c.end_pos - e.end_pos) <= 3),
f as (select l.call_id, bool_or(l.exon_no = r.exon_no) as same_exon from l join r on l.call_id = r.call_id and l.tx_id = r.tx_id group by l.call_id)
select c.chrom, count(*) as calls, count(f.call_id) as valid, count(case when same_exon then 1 end) as same_exon from ocalls c left join f on c.call_id = f.call_id group by c.chrom
""")
def valid_by_chrom(spark: SparkSession, folder: str) -> DataFrame:
    """Calls per chromosome, those with both ends on exon boundaries of one transcript, and of one exon."""
    calls = _order_calls(spark, folder)
    return C.valid_per_chromosome(calls, inputs.exons(spark, folder), 3)


@comparison.add(f"""
with {inputs.EXONS}, {_OCALLS}, c as (select chrom, start_pos, end_pos, array_agg(distinct o_orderpriority) as cells from ocalls join orders on call_id = o_orderkey group by all),
t as (select * from c where len(list_filter(cells, lambda x: contains(x, 'URGENT'))) > 0),
h as (select t.chrom, t.start_pos, t.end_pos, e.strand, min(case when abs(t.start_pos - e.start_pos) < 3 then 'exact' else 'near' end) as left_part, min(case when abs(t.end_pos - e.end_pos) < 3 then 'exact' else 'near' end) as right_part
    from t join exons e on t.chrom = e.chrom and abs(t.start_pos - e.start_pos) <= 200 and abs(t.end_pos - e.end_pos) <= 200 group by 1, 2, 3, 4)
select chrom, left_part, right_part, strand, count(*) as n from h group by all
""")
def pre_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Places of one group per chromosome by how exactly they meet exon edges, per strand."""
    from ..sources.calls import has_tissue

    cells = table(spark, folder, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderpriority").alias("cell"))
    c = _order_calls(spark, folder).join(cells, "call_id").groupBy(*C.PLACE).agg(F.collect_set("cell").alias("cells"))
    return C.edge_classes(c.filter(has_tissue("cells", "URGENT")).select(*C.PLACE), inputs.exons(spark, folder).select("chrom", "start_pos", "end_pos", "strand"))
