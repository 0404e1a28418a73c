"""Queries on sequences and k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions import text as X
from ..operators import kmers as K
from ..session import spread, table
from . import inputs
from .registry import Registry

sequences = Registry()
K_LEN = 15

_KM = """k as (select upper(strseq) as kmer, inum as n from st_kmerinfo where regexp_full_match(strseq, '[ACGTacgt]{15}') and inum >= 1)"""
#: Code of a k-mer in SQL, bases A T G C as digits 0 1 2 3.
_CODE = "list_reduce(list_transform(string_split({0}, ''), lambda c: cast(instr('ATGC', c) - 1 as bigint)), lambda a, c: a * 4 + c)"
_RC = "reverse(translate({0}, 'ATGC', 'TACG'))"


def _kmers(spark: SparkSession, folder: str) -> DataFrame:
    k = table(spark, folder, "st_kmerinfo").select("iid", F.upper("strseq").alias("kmer"), F.col("inum").alias("n"))
    return k.filter(F.col("kmer").rlike(r"\A[ACGT]{15}\z") & (F.col("n") >= 1))


@sequences.add(f"with {_KM} select distinct kmer, {_CODE.format('kmer')} as code, {_CODE.format(_RC.format('kmer'))} as rc_code, {_RC.format('kmer')} as rc from k")
def seq_encode(spark: SparkSession, folder: str) -> DataFrame:
    """Two-bit codes of the distinct k-mers and of their reverse complements."""
    k = _kmers(spark, folder).select("kmer").distinct()
    rc = S.reverse_complement(F.col("kmer"))
    return k.select("kmer", S.encode_kmer(F.col("kmer")).alias("code"), S.encode_kmer(rc).alias("rc_code"), rc.alias("rc"))


@sequences.add(f"with {_KM} select {_CODE.format('kmer')} as code, kmer from (select distinct kmer from k)")
def seq_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Codes turned back into bases."""
    code = _kmers(spark, folder).select(S.encode_kmer(F.col("kmer")).alias("code")).distinct()
    return code.select("code", S.decode_kmer(F.col("code"), K_LEN).alias("kmer"))


@sequences.add(f"with {inputs.SEQS} select doc_id, cast(length(seq) as bigint) as n, reverse(translate(seq, 'ATGC', 'TACG')) as rc from seqs")
def revcomp(spark: SparkSession, folder: str) -> DataFrame:
    """Reverse complements of whole sequences."""
    return inputs.seqs(spark, folder).select("doc_id", F.length("seq").cast("bigint").alias("n"), S.reverse_complement(F.col("seq")).alias("rc"))


_WINDOWS = f"{inputs.SEQS}, w as (select doc_id, i as pos, substring(seq, cast(i as bigint) + 1, 15) as kmer from seqs, unnest(range(0, length(seq) - 14)) as t(i))"


@sequences.add(f"with {_WINDOWS} select doc_id, cast(count(*) as bigint) as windows, cast(count(distinct kmer) as bigint) as kmers, cast(max(pos) as bigint) as last_pos from w group by doc_id")
def kmer_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Windows and distinct k-mers of every sequence."""
    k = K.kmers(spread(inputs.seqs(spark, folder)), "seq", K_LEN, ("doc_id",), positions=True)
    return k.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("kmer").alias("kmers"), F.max("pos").alias("last_pos"))


@sequences.add(f"with {_WINDOWS}, c as (select kmer, cast(count(*) as bigint) as n from w group by kmer having count(*) > 50) select {_CODE.format('kmer')} as code, n from c")
def kmer_count(spark: SparkSession, folder: str) -> DataFrame:
    """k-mers of all sequences that occur more than 50 times, by code."""
    return K.sequence_kmer_counts(spread(inputs.seqs(spark, folder)), "seq", K_LEN).filter("n > 50")


_CANON = f"{_KM}, d as (select kmer, sum(n) as n from k group by kmer), c as (select least({_CODE.format('kmer')}, {_CODE.format(_RC.format('kmer'))}) as code, cast(sum(n) as bigint) as n from d group by 1)"


def _canonical(spark: SparkSession, folder: str) -> DataFrame:
    return K.canonical_counts(_kmers(spark, folder), "kmer", "n")


@sequences.add(f"with {_CANON} select code, n from c")
def kmer_canonical_count(spark: SparkSession, folder: str) -> DataFrame:
    """Total count per canonical k-mer."""
    return _canonical(spark, folder)


@sequences.add(f"with {_CANON} select n, cast(count(*) as bigint) as kmers from c group by n")
def kmer_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """How many canonical k-mers have each count."""
    return K.histogram(_canonical(spark, folder))


@sequences.add(f"with {_CANON}, h as (select n, count(*) as kmers from c group by n) select code, n from c where n > (select sum(n * kmers) / sum(kmers) from h where n > (select min(n) from h))")
def kmer_solid(spark: SparkSession, folder: str) -> DataFrame:
    """k-mers above the average count, singletons left out of the average."""
    return K.solid(_canonical(spark, folder))


_ABSORB = f"""{_KM}, d as (select kmer, cast(sum(n) as bigint) as n from k group by kmer), a as (select kmer as anchor from d where n >= 200),
nb as (select distinct anchor, substring(anchor, 1, cast(i as bigint)) || b || substring(anchor, cast(i as bigint) + 2) as kmer from a, unnest(range(0, 15)) as t(i), unnest(['A', 'T', 'G', 'C']) as u(b))"""


@sequences.add(f"with {_ABSORB} select anchor, cast(count(d.n) as bigint) as members, cast(coalesce(sum(d.n), 0) as bigint) as total from nb left join d using (kmer) group by anchor")
def kmer_hamming1_absorb(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of all k-mers within one substitution of a frequent one."""
    counts = _kmers(spark, folder).groupBy("kmer").agg(F.sum("n").alias("n"))
    return K.absorb_neighbours(counts, counts.filter("n >= 200"), "kmer", "n")


@sequences.add(f"with {_ABSORB} select d.kmer, d.n from d where not exists (select 1 from nb where nb.kmer = d.kmer)")
def kmer_unabsorbed(spark: SparkSession, folder: str) -> DataFrame:
    """k-mers that are near no frequent one."""
    counts = _kmers(spark, folder).groupBy("kmer").agg(F.sum("n").alias("n"))
    return K.unabsorbed(counts, counts.filter("n >= 200"), "kmer")


@sequences.add("""
with k as (select iid, upper(strseq) as s from st_kmerinfo where length(strseq) = 15),
p as (select iid // 2 as pair, max(case when iid % 2 = 0 then s end) as a, max(case when iid % 2 = 1 then s end) as b from k group by 1)
select pair, (substring(a, 1, 5) = substring(b, 1, 5))::int + (substring(a, 6, 5) = substring(b, 6, 5))::int + (substring(a, 11, 5) = substring(b, 11, 5))::int >= 2 as matches
from p where a is not null and b is not null
""")
def loose_match(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring k-mers (ids 2m and 2m + 1) that agree in two thirds."""
    k = table(spark, folder, "st_kmerinfo").filter("length(strseq) = 15").withColumn("s", F.upper("strseq"))
    one = lambda r: F.max(F.when(F.col("iid") % 2 == r, F.col("s")))
    p = k.groupBy(F.floor(F.col("iid") / 2).alias("pair")).agg(one(0).alias("a"), one(1).alias("b")).filter("a is not null and b is not null")
    return p.select("pair", S.loose_match(F.col("a"), F.col("b"), K_LEN).alias("matches"))


@sequences.add("""
select event_id, printf('%.2f%%', round(value, 6)) as percent, printf('%.4f', round(value, 6)) as plain, case when length(cast(user_id as varchar)) < 5 then lpad(cast(user_id as varchar), 5, '0') else cast(user_id as varchar) end as code,
printf('%dh %dm %ds', event_id // 3600, event_id % 3600 // 60, event_id % 60) as span from events
""")
def number_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Ratios, padded codes and time spans as text."""
    e = table(spark, folder, "events")
    v = F.round("value", 6)
    return e.select("event_id", X.ratio_text(v / 100).alias("percent"), X.ratio_text(v, 2, False).alias("plain"), X.zero_padded(F.col("user_id")).alias("code"), X.hours_minutes_seconds(F.col("event_id")).alias("span"))


@sequences.add(f"""
with {inputs.CALLS} select call_id, ((start_pos + end_pos) // 2 > start_pos - 10 and (start_pos + end_pos) // 2 < end_pos + 10) as inside,
(start_pos + 2000 > start_pos - 10 and start_pos + 2000 < end_pos + 10) as far from calls
""")
def contain_state(spark: SparkSession, folder: str) -> DataFrame:
    """Positions within bounds that may be swapped, under tolerance."""
    c = inputs.calls(spark, folder)
    middle = F.floor((F.col("start_pos") + F.col("end_pos")) / 2)
    return c.select("call_id", X.contained(F.col("end_pos"), F.col("start_pos"), middle).alias("inside"), X.contained(F.col("start_pos"), F.col("end_pos"), F.col("start_pos") + 2000).alias("far"))


@sequences.add(f"with {inputs.SEQS} select '>doc ' || doc_id || chr(10) || regexp_replace(regexp_replace(seq, '(.{{100}})', '\\1' || chr(10), 'g'), '\\n$', '') as value from seqs")
def fasta_wrap(spark: SparkSession, folder: str) -> DataFrame:
    """FASTA records wrapped at 100 bases."""
    from ..sources.sequences import fasta_lines

    return fasta_lines(inputs.seqs(spark, folder).withColumn("name", F.concat(F.lit("doc "), "doc_id")), "name", "seq")


@sequences.add(f"with {inputs.SEQS} select '@r' || doc_id || chr(10) || seq || chr(10) || '+' || chr(10) || repeat('I', length(seq)) as value from seqs")
def fastq_quality_fill(spark: SparkSession, folder: str) -> DataFrame:
    """FASTQ records with a constant quality."""
    from ..sources.sequences import fastq_lines

    return fastq_lines(inputs.seqs(spark, folder).withColumn("name", F.concat(F.lit("r"), "doc_id")), "name", "seq")


@sequences.add(f"with {inputs.SEQS}, n as (select case when doc_id % 3 = 0 then 'scaffold_' else 'contig_' end || doc_id as name, seq from seqs) select name, length(seq) as bases, case when name like 'scaffold%' then 'scaffold' else 'contig' end as seg_type from n where contains(name, '_1')")
def keyword_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose name holds a keyword, with their length and kind of segment."""
    from ..sources.sequences import by_keyword

    kind = F.when(F.col("doc_id") % 3 == 0, "scaffold_").otherwise("contig_")
    named = inputs.seqs(spark, folder).select(F.concat(kind, F.col("doc_id").cast("string")).alias("name"), "seq")
    return by_keyword(named, "_1").select("name", F.length("seq").cast("bigint").alias("bases"), "seg_type")


@sequences.add("""
select seqname_ as name, case when contains(lower(seqname_), 'scf') then 'scaffold' else 'contig' end as seg_type, cast(count(*) as bigint) as n
from gff_element where seqname_ is not null and contains(seqname_, '1') group by 1, 2
""")
def segment_names(spark: SparkSession, folder: str) -> DataFrame:
    """Sequence names with a keyword and their kind of segment."""
    from ..sources.sequences import with_segment

    names = table(spark, folder, "gff_element").filter(F.contains("seqname_", F.lit("1"))).groupBy(F.col("seqname_").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return with_segment(names.withColumn("old", F.col("name")).withColumn("name", F.regexp_replace("name", "(?i)scf", "scaffold"))).select(F.col("old").alias("name"), "seg_type", "n")


@sequences.add("""
select cast(event_id as bigint) as event_id, case when instr(event_type, 'i') > 0 then split_part(substring(event_type, instr(event_type, 'i') + 1), 'e', 1) end as after_i,
trim(event_type) as trimmed, upper(event_type) as up, reverse(event_type) as back from events
""")
def text_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of texts after a mark, trimmed, upper and reversed."""
    e = table(spark, folder, "events")
    t = F.col("event_type")
    return e.select("event_id", X.token_after(t, "i", "e").alias("after_i"), X.trim_space(t).alias("trimmed"), F.upper(t).alias("up"), F.reverse(t).alias("back"))
