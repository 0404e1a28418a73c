import random

import pytest

from strandloom.llm import mixing as M


def docs(spark, counts, seed=1):
    r = random.Random(seed)
    rows = [(f"{s}{i}", s if i % 9 else f" {s.upper()} ", r.randint(1, 50)) for s, n in counts.items() for i in range(n)]
    return spark.createDataFrame([*rows, ("x", None, 5), ("y", "other", 5), ("z", "a", 0), ("w", "a", None)], "copy string, source string, tokens int"), rows


def test_shares_repeats_and_order(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 50)  # many blocks
    df, rows = docs(spark, {"a": 900, "b": 100, "c": 20})
    targets = [M.Target("a", 0.5, 1), M.Target("b", 0.3, 4), M.Target("c", 0.19, 2), M.Target("d", 0.01, 3)]
    m = M.mix(df, "copy", "source", "tokens", targets)
    shares = {r["source"]: r for r in m.shares.collect()}
    total = sum(n for *_, n in rows)
    for t in targets[:2]:
        assert abs(shares[t.source]["given"] - t.share * total) <= 50
    assert shares["c"]["short"] and shares["c"]["most_uses"] == 2 and shares["d"]["given"] == 0
    assert abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    chosen = m.chosen.collect()
    uses = {}
    for r in chosen:
        uses.setdefault((r["source"], r["doc_id"]), []).append(r["copy"])
    limit = {t.source: t.max_repeats for t in targets}
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= limit[s] for (s, _), c in uses.items())
    positions = [r["position"] for r in chosen]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    # whole rounds before the next one begins
    for s in ("b", "c"):
        n = [len(c) for (x, _), c in uses.items() if x == s]
        assert max(n) - min(n) <= 1


def test_positions_follow_the_schedule(spark):
    df, _ = docs(spark, {"a": 2000, "b": 2000}, 3)
    schedule = {"a": [(0, 2.0), (0.5, 2.0), (0.5, 0.0), (1, 0.0)], "b": [(0, 0.0), (1, 2.0)]}
    m = M.mix(df, "copy", "source", "tokens", [M.Target("a", 0.5, 1), M.Target("b", 0.5, 1)], schedule=schedule)
    a = [r["position"] for r in m.chosen.filter("source = 'a'").collect()]
    b = [r["position"] for r in m.chosen.filter("source = 'b'").collect()]
    assert max(a) <= 0.5 + 1e-9
    for x in (0.25, 0.5, 0.75):
        assert abs(sum(p <= x for p in b) / len(b) - x * x) < 0.03
        assert abs(sum(p <= x for p in a) / len(a) - min(1, 2 * x)) < 0.03


def test_leanings_cancel_out():
    targets = [M.Target("a", 0.6, 1), M.Target("b", 0.3, 2), M.Target("c", 0.1, 5)]
    s = M.leaning_schedule(targets)
    for k in (0, 1):
        assert abs(sum(t.share * s[t.source][k][1] for t in targets) - 1) < 1e-9


def test_edges(spark):
    df, _ = docs(spark, {"a": 5})
    assert M.mix(df.limit(0), "copy", "source", "tokens", [M.Target("a", 1.0, 1)]).chosen.count() == 0
    assert M.mix(df, "copy", "source", "tokens", []).chosen.count() == 0
    none = M.mix(df, "copy", "source", "tokens", [M.Target("q", 1.0, 1)])
    assert none.chosen.count() == 0 and none.shares.first()["given"] == 0
    with pytest.raises(ValueError):
        M.mix(df, "copy", "source", "tokens", [M.Target("a", 0.5, 1), M.Target("a", 0.5, 1)])


def test_largest_total_meets_every_share(spark):
    df, rows = docs(spark, {"a": 900, "b": 100, "c": 200})
    targets = [M.Target("a", 0.5, 1), M.Target("b", 0.3, 4), M.Target("c", 0.19, 2), M.Target("d", 0.01, 3)]
    shares = {r["source"]: r for r in M.mix(df, "copy", "source", "tokens", targets, total="largest").shares.collect()}
    for s in "abc":
        assert not shares[s]["short"] and abs(shares[s]["share_of_total"] - shares[s]["target_share"]) < 0.005
    assert shares["d"]["given"] == 0
    assert max(shares[t.source]["wanted"] / (t.max_repeats * shares[t.source]["size"]) for t in targets[:3]) > 0.999
