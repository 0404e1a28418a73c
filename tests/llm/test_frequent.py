import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm.frequent import Sketch, SketchShape, build_sketch, frequent_items


def data(seed, n=20000):
    r = random.Random(seed)
    hot = [f"hot{i}" for i in range(9)]
    return [(r.choice(hot) if r.random() < 0.5 else f"rare{r.randint(0, 10**9)}", r.choice([1, 1, 2])) for _ in range(n)]


def test_exactly_the_heavy_ones(spark):
    rows = data(1)
    total = Counter()
    for s, w in rows:
        total[s] += w
    all_ = sum(total.values())
    got = {r["s"]: (r["estimate"], r["total_weight"]) for r in frequent_items(spark.createDataFrame(rows, "s string, w int"), "s", "w", 0.01).collect()}
    assert {s: t for s, (_, t) in got.items()} == {s: t for s, t in total.items() if t * 100 >= all_}
    assert all(abs(e - t) < 0.0025 * all_ for e, t in got.values())


def test_sketch_is_bounded_and_unbiased():
    shape = SketchShape(levels=(8, 16), depth=5, width=1024)
    a, b = shape.hashes()
    cell, sign = shape.cells(np.arange(200000, dtype=np.uint64), 1, 0, a, b)
    assert cell.min() >= 0 and cell.max() < 1024 and abs(sign.mean()) < 0.02
    assert np.bincount(cell, minlength=1024).std() < 60
    empty = Sketch(shape, np.zeros((2, 5, 1024), dtype=np.int64), 0)
    assert len(empty.heavy(0.1)[0]) == 0


def test_partitions_add_up(spark):
    df = spark.createDataFrame(data(2, 4000), "s string, w bigint").select(F.xxhash64("s").alias("h"), "w")
    shape = SketchShape(levels=(8, 16), depth=3, width=1024)
    one, many = build_sketch(df.coalesce(1), shape), build_sketch(df.repartition(9), shape)
    assert one.total == many.total and (one.counters == many.counters).all()


def test_ties_nulls_and_uncounted_rows(spark):
    rows = [("a", 5), ("b", 5), (None, 100), ("c", 0), ("c", -3), ("d", None), ("", 5)]
    df = spark.createDataFrame(rows, "item string, h int")  # names that the operator uses itself
    assert {r["item"] for r in frequent_items(df, "item", "h", 1 / 3).collect()} == {"a", "b", ""}
    assert frequent_items(df.limit(0), "item", "h", 0.1).count() == 0
    assert frequent_items(df.filter("item is null"), "item", "h", 0.1).count() == 0
