import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.operators.packed import PackedFormat, Tokenizer, split_packed

T = Tokenizer(PackedFormat())


@pytest.mark.parametrize(
    "text, want",
    [
        ('gene_id "G1"; tag "a; b"; tag "x == y"', [("gene_id", "G1"), ("tag", "a; b"), ("tag", "x == y")]),
        ("gene_id = G1;; name=N|src : havex, id:cat:v2:1\ttag core", [("gene_id", "G1"), ("name", "N"), ("src", "havex"), ("id", "cat:v2:1"), ("tag", "core")]),
        ("note 'curator''s call' ; v ''", [("note", "curator's call"), ("v", "")]),
        (r'note "the \"short\" form"; v ""', [("note", 'the "short" form'), ("v", "")]),
        ("note ';' ; n=';'\tm=\"a\tb\"", [("note", ";"), ("n", ";"), ("m", "a\tb")]),
        ("a=;b;c 1", [("a", ""), ("b", ""), ("c", "1")]),
        ('a "open to the end; b 2', [("a", "open to the end; b 2")]),
        (" ; ;; ", []),
        ("", []),
        ('note """x"', [("note", '"x')]),
        ("k it's", [("k", "it's")]),
    ],
)
def test_tokens(text, want):
    assert list(T.tokens(text)) == want


def test_nesting():
    t = Tokenizer(PackedFormat(nesting="()[]"))
    assert list(t.tokens("f g(a; [b; c]); x (1")) == [("f", "g(a; [b; c])"), ("x", "(1")]


names = st.text("abcXYZ_09", min_size=1, max_size=6)
values = st.text("abc ;|,=:'\"\\\t", max_size=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(names, values), max_size=6), st.sampled_from([";", "; ", " | ", ",", "\t"]))
def test_round_trip(pairs, sep):
    # every quote inside is doubled; a backslash would escape what follows, so it is left out
    pairs = [(n, v.replace("\\", "")) for n, v in pairs]
    text = sep.join(n + ' "' + v.replace('"', '""') + '"' for n, v in pairs)
    assert list(T.tokens(text)) == pairs


def test_rows(spark):
    long = ";".join(f"n{i}={i}" for i in range(20000))
    rows = [(1, 'a "x"; b 2', "z"), (2, None, "z"), (3, "  ", "z"), (4, long, None), (None, "c=3", "z"), (1, "d 4", "z")]
    df = spark.createDataFrame(rows, "pos int, field string, name string")
    got = split_packed(df, "pos", "field", names=("at", "n", "v")).collect()
    assert sorted((r["pos"], r["at"], r["n"], r["v"]) for r in got if r["pos"] == 1) == [(1, 1, "a", "x"), (1, 1, "d", "4"), (1, 2, "b", "2")]
    assert sum(r["pos"] == 4 for r in got) == 20000 and sum(r["n"] == "c" for r in got) == 1
    assert split_packed(df.limit(0), "pos", "field").count() == 0
