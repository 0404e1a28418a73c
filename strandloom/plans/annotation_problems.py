"""Queries on annotation records: hot sequences, periods and gaps, packed attributes, rows that can't be loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.eager import eager_join_aggregate, heavy_keys
from ..operators.packed import split_packed
from ..operators.periods import periods_and_gaps
from ..operators.rowcheck import GFF_COLUMNS, check_elements, check_lines, sequence_key, usable_sequence, whole_number
from ..session import table
from .registry import Registry

annotation = Registry()

_KEY = "regexp_replace(trim({0}, ' '), '^[cC][hH][rR]', '')"
_USABLE = "regexp_full_match(trim(coalesce({0}, ''), ' '), '[A-Za-z0-9._-]+')"


def _sequence_states(spark: SparkSession, folder: str) -> DataFrame:
    elements = table(spark, folder, "gff_element").filter(usable_sequence(F.col("seqname_")))
    elements = elements.select(
        sequence_key(F.col("seqname_")).alias("seq_key"),
        (F.col("feature_") == "exon").cast("bigint").alias("exons"),
        (F.col("feature_") == "gene").cast("bigint").alias("genes"),
    )
    calls = table(spark, folder, "brief_calls").filter(usable_sequence(F.col("chrom")))
    calls = calls.select(sequence_key(F.col("chrom")).alias("seq_key"), F.col("support").cast("bigint").alias("support"))
    return eager_join_aggregate(elements, calls, ["seq_key"], ["exons", "genes"], ["support"], [("exons", "support")])


@annotation.add(f"""
with s as (select {_KEY.format('seqname_')} as seq_key from gff_element where {_USABLE.format('seqname_')})
select seq_key from s group by seq_key having count(*) * 25 >= (select count(*) from s)
""")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences that hold at least 4 % of the usable records.

    Records meet the dictionary of names that both tables use: one state per spelling on either side, joined, the
    counts multiplied and rolled up to the sequence that the dictionary gives the spelling.
    """
    elements = table(spark, folder, "gff_element").select(F.col("seqname_").alias("name"))
    names = elements.unionByName(table(spark, folder, "brief_calls").select(F.col("chrom").alias("name"))).distinct()
    names = names.filter(usable_sequence(F.col("name"))).select("name", sequence_key(F.col("name")).alias("seq_key"))
    states = eager_join_aggregate(elements, names, ["name"], how="inner", roll_up=["seq_key"], right_attributes=["seq_key"])
    return heavy_keys(states, "seq_key", "pairs", (4, 100)).select("seq_key")


@annotation.add(f"""
with e as (select {_KEY.format('seqname_')} as seq_key, feature_ from gff_element where {_USABLE.format('seqname_')}),
c as (select {_KEY.format('chrom')} as seq_key, support, 1 as there from brief_calls where {_USABLE.format('chrom')})
select e.seq_key, cast(count(there) as bigint) as pairs,
    cast(coalesce(sum(case when feature_ = 'exon' and there = 1 then 1 end), 0) as bigint) as exon_pairs,
    cast(coalesce(sum(case when feature_ = 'gene' and there = 1 then 1 end), 0) as bigint) as gene_pairs,
    cast(coalesce(sum(support), 0) as bigint) as support_over_pairs,
    cast(coalesce(sum(case when feature_ = 'exon' then support end), 0) as bigint) as exon_support
from e left join c on e.seq_key = c.seq_key group by e.seq_key
""")
def p1_sequence_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """What joining every record with every call of its sequence gives per sequence, from the two sides' states."""
    s = _sequence_states(spark, folder)
    return s.select(
        "seq_key",
        "pairs",
        F.col("joined_left_sum_exons").alias("exon_pairs"),
        F.col("joined_left_sum_genes").alias("gene_pairs"),
        F.col("joined_right_sum_support").alias("support_over_pairs"),
        F.col("joined_product_exons_support").alias("exon_support"),
    )


#: SQL of the rules on fields, for oracles: numbers are compared as texts without leading zeros.
_START_OK = "(regexp_full_match(trim(coalesce({s},''), ' '), '[0-9]+') and try_cast(trim({s}, ' ') as hugeint) between 1 and 2147483647 and not (regexp_full_match(trim(coalesce({e},''), ' '), '[0-9]+') and try_cast(trim({s}, ' ') as hugeint) > coalesce(try_cast(trim({e}, ' ') as hugeint), 170141183460469231731687303715884105727)))"
_FRAME_OK = "regexp_full_match(trim(coalesce({f},''), ' '), '[.012]')"
ELEMENT_OK = f"{_USABLE.format('seqname_')} and {_START_OK.format(s='start_', e='end_')} and {_FRAME_OK.format(f='frame_')}"

_PERIODS = f"""
with g as (select distinct {_KEY.format('seqname_')} as seq_key, try_cast(trim(start_, ' ') as bigint) as s, try_cast(trim(end_, ' ') as bigint) as e
    from gff_element where {ELEMENT_OK} and regexp_full_match(trim(coalesce(end_, ''), ' '), '[0-9]+')),
m as (select *, max(e) over (partition by seq_key order by s, e rows between unbounded preceding and 1 preceding) as before from g),
b as (select *, sum(case when before is null or s > before + 1 then 1 else 0 end) over (partition by seq_key order by s, e rows unbounded preceding) as n from m),
p as (select seq_key, n, min(s) as s, max(e) as e from b group by seq_key, n),
q as (select *, lead(s) over (partition by seq_key order by n) as following from p)
select seq_key, 'period' as kind, s as start_pos, e as end_pos from p
union all
select seq_key, 'gap' as kind, e + 1 as start_pos, following - 1 as end_pos from q where following - e - 1 <= 1000000
"""


@annotation.add(_PERIODS)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous periods per sequence, and gaps of at most a million bases between them."""
    rows = check_elements(table(spark, folder, "gff_element").select(*GFF_COLUMNS)).filter(F.size("reasons") == 0)
    rows = rows.select(sequence_key(F.col("seqname_")).alias("seq_key"), whole_number(F.col("start_")).alias("s"), whole_number(F.col("end_")).alias("e"))
    return periods_and_gaps(rows, "seq_key", "s", "e", longest_gap=1_000_000)


@annotation.add()
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per attribute of the packed field, with its position."""
    return split_packed(table(spark, folder, "split_gtf_attr"), "id_vec", "attr_vec")


#: In the ninth column, with quotes after a backslash made plain: the parts between the quotes left.
_PARTS = """string_split(replace(cells[9], '\\"', 'xx'), '"')"""
_QUOTES_OK = f"""(len({_PARTS}) % 2 = 1 and (len({_PARTS}) = 1 or (
    ({_PARTS}[1] = '' or {_PARTS}[1] like '% ')
    and len(list_filter(list_slice({_PARTS}, 1, -1), lambda x, i: i % 2 = 1 and i > 1 and i < len({_PARTS}) and not (regexp_matches(x, '^ *;') and x like '% '))) = 0
    and regexp_matches({_PARTS}[len({_PARTS})], '^ *(;|$)'))))"""
_LINES = "l as (select *, string_split(line, chr(9)) as cells from gtf_line where line is not null and line <> '' and line not like '#%'), n as (select * from l where len(cells) = 9)"


@annotation.add(f"""
with {_LINES}
select 'gff_element' as table_name, id_ as row_key, 'seqname' as reason from gff_element where not {_USABLE.format('seqname_')}
union all select 'gff_element', id_, 'start' from gff_element where not {_START_OK.format(s='start_', e='end_')}
union all select 'gff_element', id_, 'frame' from gff_element where not {_FRAME_OK.format(f='frame_')}
union all select 'gtf_line', line_id, 'column_count' from l where len(cells) <> 9
union all select 'gtf_line', line_id, 'quoting' from n where not {_QUOTES_OK}
union all select 'gtf_line', line_id, 'seqname' from n where not {_USABLE.format('cells[1]')}
union all select 'gtf_line', line_id, 'start' from n where not {_START_OK.format(s='cells[4]', e='cells[5]')}
union all select 'gtf_line', line_id, 'frame' from n where not {_FRAME_OK.format(f='cells[8]')}
""")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of both tables that can't be loaded, one row per reason."""
    elements = check_elements(table(spark, folder, "gff_element").select("id_", *GFF_COLUMNS))
    lines = check_lines(table(spark, folder, "gtf_line").select("line_id", "line"))
    parts = [
        d.filter(F.size("reasons") > 0).select(F.lit(name).alias("table_name"), F.col(key).alias("row_key"), F.explode("reasons").alias("reason"))
        for d, name, key in ((elements, "gff_element", "id_"), (lines, "gtf_line", "line_id"))
    ]
    return parts[0].unionByName(parts[1])


@annotation.add(f"""
with {_LINES}
select 'gff_element' as table_name, id_ as row_key, {_KEY.format('seqname_')} as seq_key, try_cast(trim(start_, ' ') as bigint) as start_pos,
    case when regexp_full_match(trim(coalesce(end_, ''), ' '), '[0-9]+') then try_cast(trim(end_, ' ') as bigint) end as end_pos, trim(frame_, ' ') as frame, feature_ as feature
from gff_element where {ELEMENT_OK}
union all
select 'gtf_line', line_id, {_KEY.format('cells[1]')}, try_cast(trim(cells[4], ' ') as bigint),
    case when regexp_full_match(trim(cells[5], ' '), '[0-9]+') then try_cast(trim(cells[5], ' ') as bigint) end, trim(cells[8], ' '), cells[3]
from n where {_QUOTES_OK} and {_USABLE.format('cells[1]')} and {_START_OK.format(s='cells[4]', e='cells[5]')} and {_FRAME_OK.format(f='cells[8]')}
""")
def p5_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The good rows of both tables, typed."""
    elements = check_elements(table(spark, folder, "gff_element").select("id_", *GFF_COLUMNS)).filter(F.size("reasons") == 0)
    lines = check_lines(table(spark, folder, "gtf_line").select("line_id", "line")).filter(F.size("reasons") == 0)

    def typed(d: DataFrame, name: str, key: str, c: list) -> DataFrame:
        return d.select(
            F.lit(name).alias("table_name"), F.col(key).alias("row_key"), sequence_key(c[0]).alias("seq_key"),
            whole_number(c[1]).alias("start_pos"), whole_number(c[2]).alias("end_pos"), F.trim(c[3]).alias("frame"), c[4].alias("feature"),
        )

    a = typed(elements, "gff_element", "id_", [F.col(c) for c in ("seqname_", "start_", "end_", "frame_", "feature_")])
    b = typed(lines, "gtf_line", "line_id", [F.get(F.col("cells"), k) for k in (0, 3, 4, 7, 2)])
    return a.unionByName(b)
