import random

from strandloom.operators import periods as P
from strandloom.operators.scan import chains, running_max, running_totals


def brute(intervals, longest=None):
    out = set()
    for k in {k for k, _, _ in intervals}:
        now = []
        for s, e in sorted((s, e) for key, s, e in intervals if key == k):
            if now and s <= now[-1][1] + 1:
                now[-1][1] = max(now[-1][1], e)
            else:
                now.append([s, e])
        out |= {(k, "period", s, e) for s, e in now}
        for (_, e), (s, _) in zip(now, now[1:]):
            if longest is None or s - e - 1 <= longest:
                out.add((k, "gap", e + 1, s - 1))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 16)  # many blocks
    r = random.Random(1)
    rows = []
    for _ in range(600):
        s = r.randint(1, 2000)
        rows.append((r.choice("aaab"), s, s + r.choice([0, 0, 1, 3, 5, 60])))
    rows += rows[:50]
    got = P.periods_and_gaps(spark.createDataFrame(rows, "q string, s int, e int"), "q", "s", "e", longest_gap=7)
    got = [tuple(x) for x in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 7)


def test_nulls_reversed_touching_and_clashing_columns(spark):
    rows = [("a", 1, 5, "z"), ("a", 6, 6, "z"), ("a", 8, 9, "z"), ("a", 20, 10, "z"), (None, 1, 2, "z"), ("a", None, 4, "z"), ("a", 3, None, None)]
    df = spark.createDataFrame(rows, "k string, pos int, rank int, kind string")
    got = {tuple(x) for x in P.periods_and_gaps(df, "k", "pos", "rank").collect()}
    assert got == {("a", "period", 1, 6), ("a", "gap", 7, 7), ("a", "period", 8, 9)}


def test_empty(spark):
    assert P.periods_and_gaps(spark.createDataFrame([], "k string, s int, e int"), "k", "s", "e").count() == 0


def test_running_over_blocks(spark):
    df = spark.range(500).selectExpr("id % 3 as k", "id as at", "floor(id / 20) as b", "(id * 37) % 101 as v")
    sums = {(r["k"], r["at"]): r["t"] for r in running_totals(df, ["k"], "b", ["at"], {"t": "v"}).collect()}
    tops = {(r["k"], r["at"]): r["m"] for r in running_max(df, ["k"], "b", ["at"], "m", "v", inclusive=False).collect()}
    total, top = {}, {}
    for r in df.orderBy("at").collect():
        assert tops[r["k"], r["at"]] == top.get(r["k"])
        total[r["k"]] = total.get(r["k"], 0) + r["v"]
        top[r["k"]] = max(top.get(r["k"], -1), r["v"])
        assert sums[r["k"], r["at"]] == total[r["k"]]


def test_chains(spark):
    df = spark.createDataFrame([("a", p) for p in (1, 3, 3, 9, 17, 30)] + [("b", 4)], "k string, p int")
    got = {(r["k"], r["p"]): r["chain"] for r in chains(df, ["k"], "p", 8, size=4).collect()}
    assert got == {("a", 1): 1, ("a", 3): 1, ("a", 9): 1, ("a", 17): 1, ("a", 30): 2, ("b", 4): 1}


def test_ordinals_block_by_block(spark):
    import random

    from strandloom.operators import annotation as A

    r = random.Random(4)
    lines = [("f" if r.random() < 0.9 else "g", i * 40000 // 1000 * 1000, (1 << 20) + i, r.choice(["gene", "transcript", "exon", "exon", "CDS"])) for i in range(300)]
    df = spark.createDataFrame(lines, "file string, line bigint, line_id bigint, feature string")
    assert df.filter("file = 'f'").selectExpr("floor(line / 65536) as b").distinct().count() > 50  # one file, many blocks
    got = {x["line_id"]: (x["gene_no"], x["tx_no"], x["exon_no"], x["exon_in_tx"]) for x in A.ordinals(df, "file", "line", "feature", ["line_id"]).collect()}
    n = {}
    for f, _, i, kind in sorted(lines, key=lambda x: (x[1], x[2])):
        c = n.setdefault(f, [0, 0, 0, 0])
        if kind == "transcript":
            c[3] = 0
        for k, v in enumerate(("gene", "transcript", "exon", "exon")):
            c[k] += kind == v
        assert got[i] == (c[0], c[1], c[2], c[3] if kind == "exon" else None)


def test_first_container_is_the_plain_search(spark):
    import random

    from strandloom.operators import annotation as A

    r = random.Random(7)
    outer = [(i, r.choice("xy"), s, s + r.choice([0, 10, 100, 200000])) for i in range(200) for s in [r.randint(0, 300000)]]
    inner = [(i, r.choice("xyz"), s, s + r.choice([0, 5, 50, 1000])) for i in range(300) for s in [r.randint(0, 300000)]] + [(900, None, 1, 2), (901, "x", 5, 5)]
    o = spark.createDataFrame(outer, "outer_id int, k string, os bigint, oe bigint")
    i = spark.createDataFrame(inner, "id int, k string, is_ bigint, ie bigint")
    want = {n: min(((a, b, m) for m, kk, a, b in outer if kk == k and a <= s and e <= b), default=(0, 0, None))[2] for n, k, s, e in inner}
    assert {x["id"]: x["outer_id"] for x in A.first_container(i, o, "k").collect()} == want


def test_nearest_gap_is_the_plain_search(spark):
    import random

    from strandloom.operators import annotation as A

    r = random.Random(3)

    def some(n, dense):
        out = []
        for i in range(n):
            a = r.randint(0, 3000 if dense else 2000000)
            b = a + r.randint(1, 200)
            c = b + r.choice([5, 50, 500, 100000])
            out.append((i + 1, r.choice("xy"), a, b, c, c + r.randint(1, 200)))
        return out

    for dense in (True, False):
        q, f = some(200, dense), some(250, dense)
        f += [(1000 + x[0], *x[1:]) for x in f[:40]]  # copies
        columns = "k string, lstart bigint, lend bigint, rstart bigint, rend bigint"
        nulls = [(901, None, 1, 2, 3, 4), (902, "x", 1, None, 3, 4)]
        got = {x["id"]: (x["ref_id"], x["sod"], x["overlaps"]) for x in A.nearest_gap(spark.createDataFrame(q + nulls, "id bigint, " + columns), spark.createDataFrame(f + nulls, "ref_id bigint, " + columns), "k").collect()}
        for i, k, a, b, c, d in q:
            over = [(abs(b - y[3]) + abs(c - y[4]), y[2], y[0]) for y in f if y[1] == k and a < y[5] and d > y[2]]
            assert got[i] == ((min(over)[2], min(over)[0], len(over)) if over else (0, None, 0))
        assert got[901] == got[902] == (0, None, 0)
