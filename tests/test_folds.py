import random

from strandloom.operators.bands import band_join, interval_join
from strandloom.operators.folds import drop_later_similar, leader_clusters, leader_fold, merge_support, support_fold
from pyspark.sql import functions as F


def calls(seed, n=300):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.choice([100, 130, 400]) + r.randint(0, 25)
        out.append((i, r.choice(["1", "2", "3"]), s, s + r.choice([200, 230]) + r.randint(0, 12), r.randint(1, 5)))
    return out


def per_chrom(rows, fold):
    out = []
    for c in {r[1] for r in rows}:
        out += [(c, *x) for x in fold([(s, e, w) for _, k, s, e, w in rows if k == c])]
    return sorted(out)


def test_folds_are_the_sequential_ones(spark):
    rows = calls(3)
    df = spark.createDataFrame(rows, "id int, chrom string, start_pos int, end_pos int, support int")
    assert sorted(map(tuple, merge_support(df, "chrom", ["id"], "support").collect())) == per_chrom(rows, support_fold)
    assert sorted(map(tuple, leader_clusters(df, "chrom", ["id"], "support").collect())) == per_chrom(rows, leader_fold)
    assert sorted(map(tuple, drop_later_similar(df, "chrom", ["id"], "support").collect())) == per_chrom(rows, lambda x: leader_fold(x, 10, 1))


def test_folds_without_rows_and_with_nulls(spark):
    df = spark.createDataFrame([(1, None, 1, 2, 1), (2, "a", None, 2, 1), (3, "a", 1, 2, None)], "id int, chrom string, start_pos int, end_pos int, support int")
    assert [tuple(r) for r in merge_support(df, "chrom", ["id"], "support").collect()] == [("a", 1, 2, 0)]
    assert merge_support(df.limit(0), "chrom", ["id"], "support").count() == 0


def test_support_fold_rules():
    assert support_fold([(100, 300, 1), (100, 300, 1), (104, 302, 1)]) == [(104, 302, 3)]  # the shorter place stays
    assert support_fold([(100, 300, 1), (108, 300, 1)]) == [(100, 300, 1), (108, 300, 1)]


def test_band_join_is_the_plain_predicate(spark):
    r = random.Random(5)
    a = spark.createDataFrame([(r.choice("xy"), r.randint(0, 300), r.randint(300, 500)) for _ in range(300)], "chrom string, start_pos int, end_pos int").distinct()
    b = spark.createDataFrame([(r.choice("xy"), r.randint(0, 300), r.randint(300, 500)) for _ in range(300)], "chrom string, start_pos int, end_pos int").distinct()
    got = {tuple(x) for x in band_join(a, b, ["chrom"]).collect()}
    want = {(*x, *y) for x in map(tuple, a.collect()) for y in map(tuple, b.collect()) if x[0] == y[0] and abs(x[1] - y[1]) <= 10 and abs(x[2] - y[2]) <= 10}
    assert got == want and want
    semi = {tuple(x) for x in band_join(a, b, ["chrom"], how="left_semi").collect()}
    anti = {tuple(x) for x in band_join(a, b, ["chrom"], how="left_anti").collect()}
    assert semi == {w[:3] for w in want} and semi | anti == {tuple(x) for x in a.collect()} and not semi & anti


def test_interval_join_pairs_once(spark):
    r = random.Random(8)
    mk = lambda n: [(r.choice("xy"), i, s, s + r.randint(0, 60)) for i in range(n) for s in [r.randint(0, 400)]]
    x, y = mk(120), mk(120)
    a, b = spark.createDataFrame(x, "k string, i int, s int, e int"), spark.createDataFrame(y, "k string, j int, t int, f int")
    got = [(r["i"], r["j"]) for r in interval_join(a, b, "k", ("s", "e"), ("t", "f"), F.lit(True), bin_size=16).collect()]
    want = [(p[1], q[1]) for p in x for q in y if p[0] == q[0] and p[2] <= q[3] and q[2] <= p[3]]
    assert sorted(got) == sorted(want)


def test_moving_elements_are_folded_row_by_row(spark):
    # the element moves from 100 over 106 to 112, away from its first place, whose later row then stands alone
    rows = [(1, "a", 100, 300, 1), (2, "a", 106, 300, 1), (3, "a", 112, 300, 1), (4, "a", 100, 300, 1), (5, "b", 100, 300, 1), (6, "b", 104, 300, 1), (7, "b", 100, 300, 1)]
    df = spark.createDataFrame(rows, "id int, chrom string, start_pos int, end_pos int, support int")
    assert sorted(map(tuple, merge_support(df, "chrom", ["id"], "support").collect())) == per_chrom(rows, support_fold) == [("a", 100, 300, 1), ("a", 112, 300, 3), ("b", 104, 300, 3)]
    for seed in range(8):
        many = [(i, c, s, s + n, w) for i, (_, c, s, n, w) in enumerate((0, random.Random(seed * 99 + j).choice("ab"), random.Random(seed * 77 + j).randint(0, 60), 300 - random.Random(seed * 55 + j).randint(0, 60), 1) for j in range(120))]
        df = spark.createDataFrame(many, "id int, chrom string, start_pos int, end_pos int, support int")
        assert sorted(map(tuple, merge_support(df, "chrom", ["id"], "support").collect())) == per_chrom(many, support_fold)


def test_a_place_with_most_rows_is_one_row(spark):
    from strandloom.operators.folds import _places

    df = spark.range(50000).selectExpr("id", "'a' as chrom", "cast(if(id % 100 = 0, 400 + id % 700, 100) as int) as start_pos", "cast(900 as int) as end_pos", "1 as support")
    assert _places(df, "chrom", ["id"], "support", 7).count() <= 8
    got = {(r["start_pos"], r["support"]) for r in merge_support(df, "chrom", ["id"], "support").collect()}
    assert (100, 49500) in got and sum(n for _, n in got) == 50000
