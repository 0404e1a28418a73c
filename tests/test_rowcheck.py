import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.operators.rowcheck import GFF_COLUMNS, FieldRule, RowSchema, check_elements, check_lines, integer_pattern

GOOD = "13\thavex\texon\t5\t9\t.\t+\t.\t"


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 5000), st.integers(0, 5000), st.integers(0, 99999))
def test_integer_pattern(a, b, n):
    low, high = min(a, b), max(a, b)
    assert bool(re.fullmatch(integer_pattern(low, high), str(n))) == (low <= n <= high)


def test_integer_pattern_edges():
    p = re.compile(integer_pattern(1, 2147483647))
    assert p.fullmatch("2147483647") and p.fullmatch("0001") and not p.fullmatch("0") and not p.fullmatch("2147483648") and not p.fullmatch("99999999999")


def test_patterns_are_generated():
    s = RowSchema([FieldRule("a", "[0-9]+", "a"), FieldRule("b"), FieldRule("c", "x", "c")])
    assert re.search(s.whole().replace(r"\z", r"\Z"), "1\tfree\tx")
    assert not re.search(s.prefix(1).replace(r"\z", r"\Z"), "z\tfree\tx")
    assert re.search(s.only(3).replace(r"\z", r"\Z"), "z\tfree\tx")


@pytest.mark.parametrize(
    "line, want",
    [
        (GOOD + 'gene_id "G"; tag "a b";', []),
        (GOOD + "gene_id G; tag", []),
        (GOOD + r'note "the \"short\" form";', []),
        (GOOD + 'gene_id "G; tag b', ["quoting"]),
        (GOOD + 'gene_id="G";', ["quoting"]),
        (GOOD + 'gene_id "G" tag "b";', ["quoting"]),
        (GOOD + 'gene_id "G" ; tag "b"', []),
        (GOOD + '"x"', []),
        ("13 havex exon", ["column_count"]),
        (GOOD + "a\tb", ["column_count"]),
        ("x y\ts\tf\t0\t9\t.\t+\t3\ta", ["seqname", "start", "frame"]),
        ("chr1\ts\tf\t10\t9\t.\t+\t 1 \ta", ["start"]),
        ("chr1\ts\tf\t10\t.\t.\t+\t.\ta", []),
        ("chr1\ts\tf\t10\t99999999999999999999999\t.\t+\t.\ta", []),
        (" 1 \ts\tf\t 7\t9\t.\t+\t.\ta", []),
        ("1 \ts\tf\t7\t9\t.\t+\t.\ta", ["seqname"]),
        ("\ts\tf\t-7\t9\t.\t+\t\ta", ["seqname", "start", "frame"]),
        (GOOD + ("a \"b c\"; " * 20000), []),
        (GOOD + "\\\"" * 20000, []),
    ],
)
def test_lines(spark, line, want):
    got = check_lines(spark.createDataFrame([(1, line)], "id int, line string")).collect()
    assert [r["reasons"] for r in got] == [want]


def test_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "# x"), (4, "#!y")], "id int, line string")
    assert check_lines(df).count() == 0
    assert check_lines(df.limit(0)).count() == 0


def test_elements_with_nulls_and_tabs(spark):
    names = ", ".join(f"{c} string" for c in GFF_COLUMNS)
    base = dict(zip(GFF_COLUMNS, ("1", "s", "f", "5", "9", ".", "+", ".")))
    cases = [({}, []), *[({c: None}, [r] if r else []) for c, r in zip(GFF_COLUMNS, ("seqname", "", "", "start", "", "", "", "frame"))], ({"source_": "a\tb"}, []), ({"seqname_": "a\tb"}, ["seqname"]), ({"start_": "9", "end_": "8"}, ["start"]), ({"start_": "1,000"}, ["start"]), ({"frame_": "0.0"}, ["frame"])]
    df = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(cases)], f"reasons_ int, {names}")
    got = {r["reasons_"]: r["reasons"] for r in check_elements(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}
