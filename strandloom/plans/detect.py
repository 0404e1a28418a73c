"""Detection of back-splice junctions from reads: vote, seeds, candidates, purification, verification, merging."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.seq import donor_acceptor_signal, reverse_complement
from ..operators.annotation import two_base_signals
from ..operators.folds import merge_support
from ..operators.links import EXON, exon_links, reach
from ..operators.seeds import places_of_reads
from ..session import cut_packed
from .follow import EXTRA, SAMPLES, Chromosome, Exon
from .walk import supports

#: Reads of a chromosome that are followed at once.
AT_ONCE = 20_000
_FOUR = [a + b + c + d for a in "ACGT" for b in "ACGT" for c in "ACGT" for d in "ACGT"]


def with_signals(exons: DataFrame, genome: DataFrame) -> DataFrame:
    """Exons (chrom, gene_id, tx_id, exon_no, start_pos, end_pos, strand) with their ``seq`` and whether the bases beside them
    are splice signals: ``head_signal``, ``tail_signal``. ``genome`` is (chrom, seq), by the first word of its names."""
    e = two_base_signals(exons, genome, with_seq=True)
    head, tail = donor_acceptor_signal(F.col("head2"), F.col("tail2"), F.col("strand"))
    return e.select(*exons.columns, "seq", F.coalesce(head, F.lit(False)).alias("head_signal"), F.coalesce(tail, F.lit(False)).alias("tail_signal"))


def usable_reads(reads: DataFrame, read_length: int, k: int) -> DataFrame:
    """Reads (read_id, seq) of nearly the full length, of two k-mers at least and without unknown bases."""
    s = F.upper("seq")
    return reads.select("read_id", s.alias("seq")).filter((F.length("seq") >= max(read_length - 5, 2 * k)) & ~F.col("seq").rlike("[^ACGT]"))


def strand_vote(reads: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(read_id, chrom, orient, seq in that orientation) of reads with enough sampled k-mers on a chromosome."""
    at = F.array(*[F.floor(F.length("seq").cast("float") * F.lit(x).cast("float")) for x in SAMPLES])
    picks = reads.select("read_id", F.explode(at).alias("p"), "seq").select("read_id", F.substr("seq", F.col("p").cast("int") + 1, F.lit(k)).alias("kmer")).filter(F.length("kmer") == k)
    both = picks.select("read_id", F.inline(F.array(F.struct(F.lit(1).alias("fwd"), F.col("kmer")), F.struct(F.lit(0).alias("fwd"), reverse_complement(F.col("kmer")).alias("kmer")))))
    hits = both.join(nodes.select("chrom", "kmer"), "kmer").groupBy("read_id", "chrom").agg(F.sum("fwd").alias("f"), F.sum(1 - F.col("fwd")).alias("r"))
    orient = F.when((F.col("f") >= 3) | ((F.col("f") >= F.col("r")) & (F.col("f") >= 2)), "+").when(F.col("r") >= 2, "-")
    voted = hits.select("read_id", "chrom", orient.alias("orient")).filter("orient is not null")
    joined = voted.join(reads, "read_id")
    return joined.select("read_id", "chrom", "orient", F.when(F.col("orient") == "+", F.col("seq")).otherwise(reverse_complement(F.col("seq"))).alias("seq"))


def node_exons(links: DataFrame) -> DataFrame:
    """(exon, kmer, tags): each k-mer of an exon once, with the segments, positions and tags it has there."""
    return links.groupBy(*EXON, "kmer").agg(F.array_sort(F.collect_list(F.struct("segment", "pos", "tag"))).alias("tags"))


def seed_hits(voted: DataFrame, links: DataFrame, nodes: DataFrame, k: int, on: DataFrame | None = None) -> DataFrame:
    """(read_id, chrom, side, exon, n, kmer, tags): exons hit by most seeds of a side, two at least, with the first seed and
    where it lies on the exon."""
    last = F.length("seq") - k
    offsets = {"head": [F.lit(x) for x in (1, 5, k, int(1.5 * k))], "tail": [last - x for x in (1, 5, k, int(1.5 * k))]}
    seeds = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(i).alias("ord"), o.cast("int").alias("at")) for side, offs in offsets.items() for i, o in enumerate(offs)])
    s = voted.select("read_id", "chrom", "seq", F.inline(seeds)).withColumn("kmer", F.substr("seq", F.col("at") + 1, F.lit(k)))
    s = s.filter((F.col("at") >= 0) & (F.length("kmer") == k)).join(nodes, ["chrom", "kmer"])
    ahead = F.instr(F.substr("seq", F.col("at") + 1, F.length("seq")), F.col("first_next")) > 0
    behind = F.instr(F.substr("seq", F.lit(1), F.col("at") + k), F.col("first_pre")) > 0
    s = s.filter(F.when(F.col("side") == "head", ahead).otherwise(behind)).select("read_id", "chrom", "side", "ord", "kmer")
    on = node_exons(links) if on is None else on
    hits = s.join(on, ["chrom", "kmer"]).groupBy("read_id", "side", *EXON).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("kmer", "tags"), "ord").alias("first"))
    hits = hits.select("read_id", "side", *EXON, "n", "first.kmer", "first.tags")
    best = F.max("n").over(Window.partitionBy("read_id", "chrom", "side"))
    hits = hits.withColumn("best", best).filter("n = best and n >= 2").drop("best")
    twice = F.count(F.lit(1)).over(Window.partitionBy("read_id", "side", "chrom", "gene_id", "tx_id"))
    # two exons of one transcript on one side: the read doesn't tell them apart
    hits = hits.withColumn("twice", twice)
    vetoed = F.max("twice").over(Window.partitionBy("read_id", "chrom"))
    return hits.withColumn("vetoed", vetoed).filter("vetoed = 1").drop("twice", "vetoed")


def candidates(hits: DataFrame, exons: DataFrame, read_length: int, k: int) -> DataFrame:
    """Per read: self candidates (one exon end to its own start) and regular ones (a later exon's end to an earlier start).

    Exons carry start_pos, end_pos, strand, head_signal, tail_signal.
    """
    place = exons.select(*EXON, "start_pos", "end_pos", "strand", "head_signal", "tail_signal", (F.col("end_pos") - F.col("start_pos") + 1).alias("length"))
    lit = hits.select("read_id", "side", *EXON, "tags").join(place, EXON)

    def side(name: str, to: str) -> DataFrame:
        d = lit.filter(F.col("side") == name)
        return d.select("read_id", "chrom", *[F.col(c).alias(f"{to}_{c}") for c in ("gene_id", "tx_id", "exon_no", "start_pos", "end_pos", "head_signal", "tail_signal", "length", "tags")], *([F.col("strand")] if to == "d" else []))

    p = side("head", "d").join(side("tail", "a"), ["read_id", "chrom"])
    same_tx = (F.col("d_gene_id") == F.col("a_gene_id")) & (F.col("d_tx_id") == F.col("a_tx_id"))
    p = p.filter(same_tx)
    same = F.col("d_exon_no") == F.col("a_exon_no")
    back = F.when(F.col("strand") == "-", F.col("d_exon_no") < F.col("a_exon_no")).otherwise(F.col("d_exon_no") > F.col("a_exon_no"))
    enters = F.exists("a_tags", lambda x: x["tag"].isin("H", "S"))
    room = 2 * (read_length - k + 1)
    p = p.withColumn("d_link", F.explode("d_tags"))
    early = (F.col("d_link.tag").isin("H", "S") & (F.col("d_length") <= room)) | (F.col("a_tags")[0]["tag"].isin("T", "E") & (F.col("a_length") <= room))
    kind = F.when(enters & same, "S").when(enters & back, "R").when(~enters & early & F.col("d_tail_signal") & F.col("a_head_signal") & back, "R")
    p = p.withColumn("circ_type", kind).filter("circ_type is not null")
    return p.groupBy("read_id", "chrom", "circ_type", F.col("d_gene_id").alias("gene_id"), F.col("d_tx_id").alias("tx_id"), F.col("d_exon_no").alias("donor"), F.col("a_exon_no").alias("acceptor")).agg(
        F.count(F.lit(1)).alias("n"), F.first("d_end_pos").alias("donor_end"), F.first("a_start_pos").alias("acceptor_start"), F.first("d_length").alias("d_length"), F.first("a_length").alias("a_length"), F.first("strand").alias("strand"),
        F.first(F.col("d_tail_signal") | F.col("a_head_signal")).alias("signal"),
    )


def purified(cands: DataFrame, voted: DataFrame, links: DataFrame, exons: DataFrame, k: int, on: DataFrame | None = None) -> DataFrame:
    """At most two candidates per read and kind: those with most links, then most extra nodes."""
    around = exons.select(*EXON, (F.col("end_pos") - F.col("start_pos") + 1).alias("own"))
    w = Window.partitionBy("chrom", "gene_id", "tx_id").orderBy("exon_no")
    around = around.select("chrom", "gene_id", "tx_id", F.col("exon_no").alias("donor"), F.lag("own").over(w).alias("before"), F.lead("own").over(w).alias("after"))
    c = cands.join(around, ["chrom", "gene_id", "tx_id", "donor"], "left")
    read = Window.partitionBy("read_id", "chrom")
    regular, selfs = F.count_if(F.col("circ_type") == "R").over(read), F.count_if(F.col("circ_type") == "S").over(read)
    beside = F.max(F.when((F.col("circ_type") == "R") & (F.abs(F.col("donor") - F.col("acceptor")) == 1), 1).otherwise(0)).over(read)
    repeat = (F.col("circ_type") == "S") & ((F.col("d_length") == F.col("before")) | (F.col("d_length") == F.col("after")))
    c = c.withColumns({"r": regular, "s": selfs, "beside": beside, "repeat": F.coalesce(repeat, F.lit(False))})
    c = c.filter(~((F.col("r") == 1) & (F.col("s") == 1) & (F.col("beside") == 1)) & ~((F.col("s") == 1) & F.col("repeat")))
    at = F.array(*[F.floor((F.length("seq") - k) * x).cast("int") for x in EXTRA])
    extra = voted.select("read_id", "chrom", F.explode(at).alias("at"), "seq").select("read_id", "chrom", F.substr("seq", F.col("at") + 1, F.lit(k)).alias("kmer"), "at")
    on = extra.join(node_exons(links) if on is None else on, ["chrom", "kmer"]).select("read_id", "at", *EXON)
    d, a = on.withColumnRenamed("exon_no", "donor"), on.withColumnRenamed("exon_no", "acceptor")
    key = ["read_id", "chrom", "gene_id", "tx_id"]
    cd = c.select(*key, "circ_type", "donor", "acceptor")
    seen = cd.join(d, [*key, "donor"]).select(*key, "circ_type", "donor", "acceptor", "at").unionByName(cd.join(a, [*key, "acceptor"]).select(*key, "circ_type", "donor", "acceptor", "at")).distinct()
    adds = seen.groupBy(*key, "circ_type", "donor", "acceptor").agg(F.count(F.lit(1)).alias("extra"))
    c = c.join(adds, [*key, "circ_type", "donor", "acceptor"], "left").na.fill(0, ["extra"])
    kind = Window.partitionBy("read_id", "chrom", "circ_type")
    c = c.withColumn("of_kind", F.count(F.lit(1)).over(kind)).withColumn("best", F.max(F.struct("n", "extra")).over(kind)).withColumn("least", F.min("n").over(kind)).withColumn("least_extra", F.min("extra").over(kind))
    pair = (F.col("circ_type") == "R") & (F.col("of_kind") == 2) & (F.col("least_extra") == 2) & (F.col("best.n") - F.col("least") <= 2)
    c = c.filter((F.col("of_kind") == 1) | pair | (F.struct("n", "extra") == F.col("best")))
    c = c.withColumn("left", F.count(F.lit(1)).over(kind)).withColumn("lengths", F.size(F.collect_set("d_length").over(kind)))
    return c.filter("left <= 2 and not (circ_type = 'S' and left = 2 and lengths = 1)").drop("of_kind", "best", "least", "least_extra", "left", "lengths", "r", "s", "beside", "repeat", "before", "after")


def verified(cands: DataFrame, voted: DataFrame, links: DataFrame, k: int, ratio: float = 0.6) -> DataFrame:
    """Candidates whose read runs through the donor's end into the acceptor's start."""
    # an exon's nodes in order as three texts: k-mers end to end, their tags, their segments; at most twice the
    # reach of a read
    nodes = F.array_sort(F.collect_list(F.struct("segment", "pos", "kmer", "tag")))
    per_exon = links.groupBy(*EXON).agg(nodes.alias("n"))
    text = lambda c: F.array_join(F.transform("n", lambda x: x[c].cast("string")), "")
    per_exon = per_exon.select(*EXON, F.struct(text("kmer").alias("kmers"), text("tag").alias("tags"), text("segment").alias("segments")).alias("nodes"))
    d = per_exon.select("chrom", "gene_id", "tx_id", F.col("exon_no").alias("donor"), *[F.col(f"nodes.{c}").alias(f"d_{c}") for c in ("kmers", "tags", "segments")])
    a = per_exon.select("chrom", "gene_id", "tx_id", F.col("exon_no").alias("acceptor"), *[F.col(f"nodes.{c}").alias(f"a_{c}") for c in ("kmers", "tags", "segments")])
    key = ["chrom", "gene_id", "tx_id"]
    rows = cands.filter("circ_type = 'R' or signal").join(voted.select("read_id", "chrom", "seq"), ["read_id", "chrom"]).join(d, [*key, "donor"]).join(a, [*key, "acceptor"])
    texts = [f"{side}_{c}" for side in "da" for c in ("kmers", "tags", "segments")]
    kept = [c for c in rows.columns if c not in ("seq", *texts)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)

    def links_of(kmers: str, tags: str, segments: str) -> dict[str, list]:
        """Per k-mer the nodes it has on the exon: (before, after, tag)."""
        at = [kmers[i : i + k] for i in range(0, len(kmers), k)]
        out: dict[str, list] = {}
        for i, x in enumerate(at):
            before = at[i - 1] if i and segments[i - 1] == segments[i] else None
            after = at[i + 1] if i + 1 < len(at) and segments[i + 1] == segments[i] else None
            out.setdefault(x, []).append((before, after, tags[i]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [supports(s, links_of(*x[:3]), links_of(*x[3:]), t == "S", k, ratio) for s, t, *x in zip(b["seq"], b["circ_type"], *[b[c] for c in texts])]
            yield b.loc[good, kept]

    return rows.select(*rows.columns).mapInPandas(run, schema)


def detected_reads(reads: DataFrame, exons: DataFrame, read_length: int = 101, k: int = 15, ratio: float = 0.6) -> DataFrame:
    """One row per read and junction that it runs over: read_id, chrom, circ_type, orient, the read's seq in that
    orientation, donor_end, acceptor_start, strand, gene_id, tx_id, donor and acceptor (exon numbers).

    ``reads`` (read_id, seq); ``exons`` (chrom, gene_id, tx_id, exon_no, start_pos, end_pos, strand, seq,
    head_signal, tail_signal). Every read is tried on every chromosome it has nodes on. Exons without either
    signal, or shorter than k, aren't indexed. No reads or no exons give no rows.
    """
    placed = exons.filter("chrom is not null and gene_id is not null and tx_id is not null and exon_no is not null and start_pos is not null and end_pos is not null")
    kept = usable_reads(reads, read_length, k).filter("read_id is not null")
    kept = cut_packed(kept.select(F.monotonically_increasing_id().alias("rid"), "read_id", "seq"))
    b = reach(read_length, k)
    ends = F.when(F.length("seq") <= 2 * b, F.col("seq")).otherwise(F.concat(F.left("seq", F.lit(b)), F.lit(" "), F.right("seq", F.lit(b))))
    pairs = places_of_reads(kept, placed.filter("head_signal or tail_signal").select("chrom", ends.alias("seq")), k)
    small = kept.mapInArrow(_two_bits, StructType([kept.schema["rid"], kept.schema["read_id"]]).simpleString()[7:-1].replace(":", " ") + ", seq binary")
    there = pairs.repartition("rid").dropDuplicates(["rid", "chrom"]).join(small, "rid").drop("rid")
    known = [*EXON, "start_pos", "end_pos", "strand", "head_signal", "tail_signal"]
    # a chromosome's exons in order, then its reads
    rows = placed.select(*known, F.lit(0).alias("kind"), F.coalesce("seq", F.lit("")).cast("binary").alias("seq"), F.lit(None).cast(kept.schema["read_id"].dataType).alias("read_id"))
    none = [F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in known[1:]]
    rows = rows.unionByName(there.select("chrom", *none, F.lit(1).alias("kind"), "seq", "read_id"))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chrom").sortWithinPartitions("chrom", "kind", "gene_id", "tx_id", "exon_no")
    like = placed.select(F.lit("").alias("circ_type"), F.lit("").alias("orient"), F.lit("").alias("seq"), "chrom", F.col("end_pos").alias("donor_end"), F.col("start_pos").alias("acceptor_start"), "strand", "gene_id", "tx_id", F.col("exon_no").alias("donor"), F.col("exon_no").alias("acceptor"))
    names = ["read_id", "chrom", "circ_type", "orient", "seq", "donor_end", "acceptor_start", "strand", "gene_id", "tx_id", "donor", "acceptor"]
    schema = StructType([(kept if c == "read_id" else like).schema[c] for c in names])
    for f in schema.fields:
        f.nullable = True
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of, held = None, [], []

        def followed() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held and of:
                place = Chromosome(of, read_length, k, ratio)
                out = [(i, now, kind, orient, s, d.end_pos, a.start_pos, d.strand, d.gene_id, d.tx_id, d.exon_no, a.exon_no) for i, kind, orient, s, d, a in place.follow(held)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), arrow.types)], schema=arrow)
            held = []

        for batch in batches:
            for chrom, kind, seq, read_id, *exon in zip(*[batch.column(c).to_pylist() for c in ("chrom", "kind", "seq", "read_id", *known[1:])]):
                if chrom != now or len(held) >= AT_ONCE:
                    yield from followed()
                if chrom != now:
                    now, of = chrom, []
                if kind == 0:
                    of.append(Exon(*exon, seq.decode()))
                else:
                    held.append((read_id, _bases(seq)))
        yield from followed()

    return rows.mapInArrow(run, schema)


def _two_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads with two bits a base, after two bytes for their length."""
    digits = str.maketrans("ACGT", "0123")
    for b in batches:
        seqs = [len(s).to_bytes(2) + int((s + "A" * (-len(s) % 4)).translate(digits), 4).to_bytes(-(-len(s) // 4)) for s in b.column("seq").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("read_id"), pa.array(seqs, pa.binary())], names=["rid", "read_id", "seq"])


def _bases(two_bits: bytes) -> str:
    return "".join([_FOUR[x] for x in two_bits[2:]])[: int.from_bytes(two_bits[:2])]


def junctions(found: DataFrame) -> DataFrame:
    """Junctions (chrom, circ_type, start_pos, end_pos, support) of detected reads.

    Support is merged in order of reads, self and regular junctions apart; a regular one with the same sum of
    bounds as a self one is left out.
    """
    found = found.select("read_id", "chrom", "circ_type", F.least("donor_end", "acceptor_start").alias("start_pos"), F.greatest("donor_end", "acceptor_start").alias("end_pos"), F.lit(1).alias("one")).distinct()
    merged = merge_support(found.withColumn("place", F.struct("chrom", "circ_type")), "place", ["read_id"], "one")
    merged = merged.select("place.chrom", "place.circ_type", "start_pos", "end_pos", "support").withColumn("total", F.col("start_pos") + F.col("end_pos"))
    own = merged.filter("circ_type = 'S'").select("chrom", "total").distinct()
    regular = merged.filter("circ_type = 'R'").join(own, ["chrom", "total"], "left_anti")
    return merged.filter("circ_type = 'S'").unionByName(regular.select(*merged.columns)).drop("total")


def detect(reads: DataFrame, exons: DataFrame, read_length: int = 101, k: int = 15, ratio: float = 0.6, max_support: int | None = None) -> DataFrame:
    """Back-splice junctions: chrom, start_pos, end_pos, support, circ_type (see ``detected_reads`` and ``junctions``).

    ``ratio`` is the share of a read's nodes from which the number that must be met follows; with ``max_support``
    junctions of more reads are left out.
    """
    out = junctions(detected_reads(reads, exons, read_length, k, ratio))
    return out if max_support is None else out.filter(F.col("support") <= max_support)
