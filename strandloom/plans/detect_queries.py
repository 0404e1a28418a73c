"""Queries on the link index and on detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators.bands import band_join
from ..operators.links import exon_links
from ..session import cut_lineage, cut_packed
from . import detect as D
from . import inputs
from .registry import Registry

detection = Registry()

_TAGS = """case when l <= 164 then
        case when i < case when (l - 15) // 2 < 9 then (l - 15) // 2 + 1 else 9 end then 'H'
             when i > l - 15 - case when l - (l - 15) // 2 - 15 < 9 then l - (l - 15) // 2 - 15 else 9 end then 'T'
             when i <= (l - 15) // 2 then 'S' else 'E' end
    when segment = 0 then case when i < 12 then 'H' else 'S' end else case when i > 82 - 15 - 12 then 'T' else 'E' end end"""
_LINKS = f"""{inputs.GEXONS},
seg as (select chrom, exon_no, length(seq) as l, 0 as segment, case when length(seq) <= 164 then seq else substring(seq, 1, 82) end as part from gexons
    union all select chrom, exon_no, length(seq), 1, substring(seq, length(seq) - 81, 82) from gexons where length(seq) > 164),
win as (select chrom, exon_no, l, segment, cast(i as bigint) as i, substring(part, cast(i as bigint) + 1, 15) as kmer from seg, unnest(range(0, length(part) - 14)) as t(i)),
tagged as (select *, {_TAGS} as tag from win),
links as (select chrom, exon_no, segment, i as pos, kmer, tag, lag(kmer) over w as pre_kmer, lead(kmer) over w as next_kmer, lag(tag) over w as pre_tag, lead(tag) over w as next_tag from tagged window w as (partition by chrom, exon_no, segment order by i))"""


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return exon_links(inputs.genome_exons(spark, folder))


@detection.add(f"with {_LINKS} select * from links")
def dbg_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of all exons with their neighbours."""
    return _links(spark, folder).drop("gene_id", "tx_id")


@detection.add(f"with {_LINKS} select chrom, exon_no, segment, tag, cast(count(*) as bigint) as nodes, min(pos) as first, max(pos) as last from links group by all")
def dbg_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of tags along exons, short and long."""
    return _links(spark, folder).groupBy("chrom", "exon_no", "segment", "tag").agg(F.count(F.lit(1)).alias("nodes"), F.min("pos").alias("first"), F.max("pos").alias("last"))


_VOTES = f"""{_LINKS}, two as (select chrom, max(case when exon_no = 0 then seq end) as s0, max(case when exon_no = 1 then seq end) as s1, max(case when exon_no = 2 then seq end) as s2, max(strand) as strand from gexons group by chrom),
j as (select chrom, 'S' as circ_type, s1 as d, s1 as a from two where chrom % 3 = 0 and s1 is not null union all
    select chrom, 'R', case when strand = '+' then s2 else s0 end, case when strand = '+' then s0 else s2 end from two where chrom % 3 <> 0 and s0 is not null and s2 is not null),
reads as (select chrom * 1000 + w + case when circ_type = 'S' then 500 else 0 end as read_id, right(d, w) || left(a, 101 - w) as seq from j, unnest([46, 50, 55]) as t(w)),
ends as (select chrom, kmer, next_kmer as first_next, pre_kmer as first_pre from (select *, row_number() over (partition by chrom, kmer order by exon_no, segment, pos) as rk from links) where rk = 1),
picks as (select read_id, substring(seq, p + 1, 15) as kmer from reads, unnest([10, 20, 30, 40, 50, 60, 70, 80]) as t(p)),
ways as (select read_id, 1 as fwd, kmer from picks union all select read_id, 0, translate(reverse(kmer), 'ACGT', 'TGCA') from picks),
fr as (select read_id, chrom, sum(fwd) as f, sum(1 - fwd) as r from ways join ends on ways.kmer = ends.kmer group by 1, 2),
orients as (select read_id, chrom, case when f >= 3 or (f >= r and f >= 2) then '+' when r >= 2 then '-' end as orient from fr),
voted as (select o.read_id, o.chrom, orient, case when orient = '+' then seq else translate(reverse(seq), 'ACGT', 'TGCA') end as seq from orients o join reads on o.read_id = reads.read_id where orient is not null)"""
_SEEDS = f"""{_VOTES}, seeds(side, ord, spot) as (values ('head', 0, 1), ('head', 1, 5), ('head', 2, 15), ('head', 3, 22), ('tail', 0, 85), ('tail', 1, 81), ('tail', 2, 71), ('tail', 3, 64)),
sown as (select v.read_id, v.chrom, side, ord, e.kmer from voted v cross join seeds join ends e on v.chrom = e.chrom and substring(v.seq, spot + 1, 15) = e.kmer
    where case when side = 'head' then instr(substring(v.seq, spot + 1), first_next) > 0 else instr(substring(v.seq, 1, spot + 15), first_pre) > 0 end),
met as (select read_id, side, s.chrom, exon_no, count(*) as n, arg_min(s.kmer, ord) as kmer from sown s join (select distinct chrom, exon_no, kmer from links) l on s.chrom = l.chrom and s.kmer = l.kmer group by 1, 2, 3, 4),
most as (select *, max(n) over (partition by read_id, chrom, side) as best from met),
alone as (select *, count(*) over (partition by read_id, side, chrom) as twice from most where n = best and n >= 2),
hits as (select * exclude (twice, best, veto) from (select *, max(twice) over (partition by read_id, chrom) as veto from alone) where veto = 1)"""
_PAIRS = f"""{_SEEDS}, lit as (select h.read_id, h.side, h.chrom, h.exon_no, list({{'segment': segment, 'pos': pos, 'tag': tag}} order by segment, pos, tag) as tags from hits h join links l on h.chrom = l.chrom and h.exon_no = l.exon_no and h.kmer = l.kmer group by 1, 2, 3, 4),
placed as (select lit.*, start_pos, end_pos, strand, end_pos - start_pos + 1 as length from lit join gexons g on lit.chrom = g.chrom and lit.exon_no = g.exon_no),
p as (select d.read_id, d.chrom, d.strand, d.exon_no as donor, a.exon_no as acceptor, d.end_pos as donor_end, a.start_pos as acceptor_start, d.length as d_length, a.length as a_length, unnest(d.tags) as d_link, a.tags as a_tags
    from placed d join placed a on d.side = 'head' and a.side = 'tail' and d.read_id = a.read_id and d.chrom = a.chrom),
q as (select *, len(list_filter(a_tags, lambda x: x.tag in ('H', 'S'))) > 0 as enters, case when strand = '-' then donor < acceptor else donor > acceptor end as back,
    (d_link.tag in ('H', 'S') and d_length <= 174) or (a_tags[1].tag in ('T', 'E') and a_length <= 174) as early from p),
kinds as (select *, case when enters and donor = acceptor then 'S' when enters and back then 'R' when not enters and early and back then 'R' end as circ_type from q)"""


def _prepared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    exons = cut_lineage(inputs.genome_exons(spark, folder))
    reads, truth = inputs.planted(exons)
    links = cut_lineage(exon_links(exons))
    order = F.struct("gene_id", "tx_id", "exon_no", "segment", "pos")
    nodes = links.groupBy("chrom", "kmer").agg(F.min_by("next_kmer", order).alias("first_next"), F.min_by("pre_kmer", order).alias("first_pre"))
    return exons, reads, truth, links, nodes


@detection.add(f"with {_VOTES} select * from voted")
def strand_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Orientation of reads on the chromosomes they have nodes on."""
    _, reads, _, _, nodes = _prepared(spark, folder)
    return D.strand_vote(D.usable_reads(reads, 101, 15), nodes, 15)


@detection.add(f"with {_SEEDS} select read_id, side, chrom, chrom as gene_id, 0 as tx_id, exon_no, n, kmer from hits")
def seed_vote_argmax(spark: SparkSession, folder: str) -> DataFrame:
    """Exons hit by most seeds of either side of a read."""
    _, reads, _, links, nodes = _prepared(spark, folder)
    voted = D.strand_vote(D.usable_reads(reads, 101, 15), nodes, 15)
    return D.seed_hits(voted, links, nodes, 15).drop("tags")


@detection.add(f"""
with {_PAIRS} select read_id, chrom, circ_type, chrom as gene_id, 0 as tx_id, donor, acceptor, count(*) as n, max(donor_end) as donor_end, max(acceptor_start) as acceptor_start, max(d_length) as d_length, max(a_length) as a_length, max(strand) as strand, true as signal
from kinds where circ_type is not null group by 1, 2, 3, 6, 7
""")
def backsplice_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate junctions per read before purification."""
    exons, reads, _, links, nodes = _prepared(spark, folder)
    voted = cut_lineage(D.strand_vote(D.usable_reads(reads, 101, 15), nodes, 15))
    return D.candidates(D.seed_hits(voted, links, nodes, 15), exons, 101, 15)


def _hard(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exons, reads, junctions) of the genome with repeats and runs of N, signals told from its bases."""
    genome = cut_packed(inputs.genome_whole(spark, folder))
    places = inputs.spliced_exons(genome)
    exons = cut_packed(D.with_signals(places, genome))
    reads, truth = inputs.hard_reads(exons)
    return exons.drop("at"), reads, truth


@detection.add()
def detect_end_to_end(spark: SparkSession, folder: str) -> DataFrame:
    """Detected junctions of reads over planted ones and others."""
    run = EngineConfig()
    exons, reads, _ = _hard(spark, folder)
    return D.detect(reads, exons, run.read_length, run.kmer_length, run.kmer_ratio, run.max_support)


@detection.add()
def detect_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Per type: planted junctions, detected ones, how many of either agree within ten positions, recall and precision."""
    exons, reads, truth = _hard(spark, folder)
    truth = cut_lineage(truth)
    found = cut_lineage(D.detect(reads, exons))
    place = ["chrom", "circ_type", "start_pos", "end_pos"]
    hit = band_join(truth, found.select(*place), ["chrom", "circ_type"], how="left_semi")
    right = band_join(found.select(*place), truth, ["chrom", "circ_type"], how="left_semi")
    count = lambda d, n: d.groupBy("circ_type").agg(F.count(F.lit(1)).alias(n))
    rows = count(truth, "planted").join(count(found, "detected"), "circ_type", "left").join(count(hit, "recovered"), "circ_type", "left").join(count(right, "correct"), "circ_type", "left").na.fill(0)
    return rows.select("*", (F.col("recovered") / F.col("planted")).alias("recall"), F.try_divide("correct", "detected").alias("precision"))
