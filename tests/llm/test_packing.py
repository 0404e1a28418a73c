import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import packing as P


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(0, c), max_size=60))))
def test_best_fit_against_plain(case):
    capacity, sizes = case
    at = P.best_fit(np.array(sizes, dtype=np.int64), capacity)
    fill = {}
    for b, s in zip(at.tolist(), sizes):
        fill[b] = fill.get(b, 0) + s
    assert all(f <= capacity for f in fill.values())
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    assert len(fill) == len(rooms) and sorted(fill.values()) == sorted(capacity - r for r in rooms)


def check(rows, sizes, capacity):
    pieces, fills = {}, {}
    for r in rows:
        pieces.setdefault(r["item"], []).append((r["piece"], r["size"]))
        fills.setdefault(r["container"], [0, r["fill"]])
        fills[r["container"]][0] += r["size"]
    assert all(a == b and a <= capacity for a, b in fills.values())
    for i, n in sizes.items():
        got = sorted(pieces[i])
        assert sum(s for _, s in got) == (n or 0) and [p for p, _ in got] == list(range(len(got)))
        assert len(got) == max(1, -(-(n or 0) // capacity)) and all(s == capacity for _, s in got[:-1])
    return len(fills)


def test_many_groups_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP", 40)
    monkeypatch.setattr(P, "FAN_IN", 3)
    r = random.Random(4)
    sizes = {i: r.choice([0, None, r.randint(1, 90), r.randint(1, 400), 1000]) for i in range(1500)}
    df = spark.createDataFrame(list(sizes.items()), "spec int, size int")  # clashing names
    rows = P.pack(df, "spec", "size", [("s", 128), ("t", 512)]).collect()
    for name, capacity in (("s", 128), ("t", 512)):
        bins = check([x for x in rows if x["spec"] == name], sizes, capacity)
        least = -(-sum(n or 0 for n in sizes.values()) // capacity)
        assert bins <= least * 1.05 + 2
    summary = {x["spec"]: x for x in P.packing_summary(P.pack(df, "spec", "size", [("s", 128)])).collect()}
    assert summary["s"]["total"] == sum(n or 0 for n in sizes.values())


def test_bound_on_what_is_handed_on_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP", 50)
    monkeypatch.setattr(P, "FAN_IN", 2)
    monkeypatch.setattr(P, "CARRY", 3)
    sizes = {i: 60 for i in range(400)}
    check(P.pack(spark.createDataFrame(list(sizes.items()), "i int, n int"), "i", "n", [("s", 100)]).collect(), sizes, 100)


def test_edges(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (None, 7)], "i bigint, n int")
    rows = P.pack(df, "i", "n", [("s", 10)]).collect()
    assert len(rows) == 3 and {r["item"] for r in rows} == {1, None} and len({r["container"] for r in rows}) == 2
    assert P.pack(df.limit(0), "i", "n", [("s", 10)]).count() == 0
    assert P.pack(df, "i", "n", []).count() == 0
    with pytest.raises(ValueError):
        P.pack(df, "i", "n", [("s", 0)])


def test_repeated_and_null_ids_and_long_texts_are_spread(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP", 100)
    r = random.Random(6)
    rows = [(None, r.randint(1, 60)) for _ in range(600)] + [(7, r.randint(1, 60)) for _ in range(600)] + [(8, 1000 * 64 + 5), (9, 64 * 3)]
    got = P.pack(spark.createDataFrame(rows, "id int, n int"), "id", "n", [("s", 64)]).collect()
    fills = {}
    for x in got:
        fills.setdefault(x["container"], [0, x["fill"]])[0] += x["size"]
    assert all(a == b and a <= 64 for a, b in fills.values())
    assert sum(x["size"] for x in got) == sum(n for _, n in rows) and len(got) == 1200 + 1001 + 3
    assert sorted(x["piece"] for x in got if x["item"] == 8) == list(range(1001))
    at_once = P.best_fit(np.array([n if n <= 64 else n % 64 or 64 for _, n in rows]), 64).max() + 1 + 1000 + 2
    assert len(fills) <= at_once * 1.03


def test_items_above_half_the_capacity_end_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP", 20)
    monkeypatch.setattr(P, "CARRY", 10)
    sizes = {i: 51 for i in range(300)}
    assert check(P.pack(spark.createDataFrame(list(sizes.items()), "i int, n int"), "i", "n", [("s", 100)]).collect(), sizes, 100) == 300
