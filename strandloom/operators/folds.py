"""Order-dependent merging of near places, on distinct places cut into clusters that can't touch each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import chains

Row = tuple[int, int, int]  # start, end, weight
CLUSTER = ["key", "c1", "c2"]


def clustered(rows: DataFrame, key: str, reach: int, start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """``rows`` with ``cluster``: places in different clusters are more than ``reach`` apart in start or end.

    Runs of starts, then runs of ends within them, are found on distinct positions in blocks. NULL keys and
    places are left out.
    """
    rows = rows.filter(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    one = chains(rows, [key], start, reach).withColumnRenamed("chain", "__c1")
    rows = rows.join(one, [key, start])
    two = chains(rows, [key, "__c1"], end, reach).withColumnRenamed("chain", "__c2")
    rows = rows.join(two, [key, "__c1", end])
    return rows.withColumn("cluster", F.struct("__c1", "__c2")).drop("__c1", "__c2")


class Near:
    """Elements by the square they lie in, so that those near a place are found without looking at all others."""

    def __init__(self, reach: int) -> None:
        self.reach, self.size, self.squares = reach, reach + 1, {}
        self.at: list[tuple[int, int]] = []

    def add(self, s: int, e: int) -> int:
        self.at.append((s, e))
        self.squares.setdefault((s // self.size, e // self.size), []).append(len(self.at) - 1)
        return len(self.at) - 1

    def move(self, i: int, s: int, e: int) -> None:
        a, b = self.at[i]
        self.squares[a // self.size, b // self.size].remove(i)
        self.at[i] = (s, e)
        self.squares.setdefault((s // self.size, e // self.size), []).append(i)

    def first(self, s: int, e: int) -> int | None:
        """The earliest element within reach at both ends."""
        x, y, best = s // self.size, e // self.size, None
        for i in (x - 1, x, x + 1):
            for j in (y - 1, y, y + 1):
                for n in self.squares.get((i, j), ()):
                    a, b = self.at[n]
                    if abs(a - s) <= self.reach and abs(b - e) <= self.reach and (best is None or n < best):
                        best = n
        return best

    def around(self, s: int, e: int) -> Iterator[int]:
        """Elements within reach, and some beyond."""
        x, y = s // self.size, e // self.size
        for i in (x - 1, x, x + 1):
            for j in (y - 1, y, y + 1):
                yield from self.squares.get((i, j), ())


class SupportFold:
    """The first element in order of appearance that equals or is near a place gains its support; a near and shorter
    place becomes the element's place."""

    columns = "support bigint"

    def __init__(self, reach: int = 7) -> None:
        self.elements, self.weights = Near(reach), []

    def add(self, s: int, e: int, n: int, w: int) -> tuple[int, bool]:
        """(element, whether an element has moved)."""
        x = self.elements.first(s, e)
        if x is None:
            x = self.elements.add(s, e)
            self.weights.append(w)
            return x, False
        self.weights[x] += w
        a, b = self.elements.at[x]
        if (s, e) != (a, b) and e - s < b - a:
            self.elements.move(x, s, e)
            return x, True
        return x, False

    def rows(self) -> list[tuple]:
        return [(s, e, w) for (s, e), w in zip(self.elements.at, self.weights)]


class PlaceFold:
    """SupportFold over distinct places in the order they first appear, with all rows of a place added at once.

    That is what row by row gives as long as later rows of a place go where its first one went. Elements only change
    by moving, so after each move the places seen around it are looked up again; if one would now go elsewhere the
    cluster isn't ``settled`` and has to be folded row by row.
    """

    columns = "support bigint, settled boolean"

    def __init__(self, reach: int = 7) -> None:
        self.fold, self.seen, self.went, self.members, self.settled = SupportFold(reach), Near(2 * reach), [], {}, True

    def add(self, s: int, e: int, n: int, w: int) -> None:
        x, moved = self.fold.add(s, e, n, w)
        self.members.setdefault(x, []).append(self.seen.add(s, e))
        self.went.append(x)
        if moved and self.settled:
            # those that the element had absorbed, and those that it has come near to
            again = {*self.members[x], *self.seen.around(s, e)}
            self.settled = all(self.fold.elements.first(*self.seen.at[p]) == self.went[p] for p in again)

    def rows(self) -> list[tuple]:
        return [(*r, self.settled) for r in self.fold.rows()] if self.settled else [(0, 0, 0, False)]


class LeaderFold:
    """Every place that is near no earlier leader leads and the others join the earliest leader near them; clusters
    of ``least`` rows at least come out with their size and weight.

    Leaders don't move, so the rows of a place all go where its first one goes.
    """

    columns = "members bigint, support bigint, labels bigint"

    def __init__(self, reach: int = 10, least: int = 2) -> None:
        self.leaders, self.members, self.least = Near(reach), [], least

    def add(self, s: int, e: int, n: int, w: int, labels: Sequence[str] = ()) -> None:
        x = self.leaders.first(s, e)
        if x is None:
            x = self.leaders.add(s, e)
            self.members.append([0, 0, set()])
        self.members[x][0] += n
        self.members[x][1] += w
        self.members[x][2].update(labels)

    def rows(self) -> list[tuple]:
        return [(s, e, n, w, len(t)) for (s, e), (n, w, t) in zip(self.leaders.at, self.members) if n >= self.least]


def _places(rows: DataFrame, key: str, order: Sequence[str], weight: str, reach: int, label: str | None = None) -> DataFrame:
    """(key, c1, c2, s, e, o0.., n, w): each distinct place once, with the order of its first row, its rows and weight.

    Rows of a place are added up before they move, so a place that holds a third of all rows is one row per task.
    """
    of = rows.filter(F.col(key).isNotNull() & F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull())
    of = of.groupBy(key, "start_pos", "end_pos").agg(F.min(F.struct(*order)).alias("o"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(weight).cast("bigint")), F.lit(0)).alias("w"), *([F.collect_set(label).alias("labels")] if label else []))
    c = clustered(cut_lineage(of), key, reach)
    return c.select(F.col(key).alias("key"), F.col("cluster.__c1").alias("c1"), F.col("cluster.__c2").alias("c2"), F.col("start_pos").cast("bigint").alias("s"), F.col("end_pos").cast("bigint").alias("e"), "o", "n", "w", *(["labels"] if label else []))


def _fold(places: DataFrame, fold: Callable, reach_columns: str) -> DataFrame:
    """Feed the rows of each cluster, in the order ``o``, to a fold of its own; only its elements are held."""
    key_type = places.schema["key"].dataType.simpleString()
    names = [*CLUSTER, "start_pos", "end_pos", *[c.split()[0] for c in reach_columns.split(", ")]]
    given = ["s", "e", "n", "w", *(["labels"] if "labels" in places.columns else [])]
    c = places.repartition(*CLUSTER).sortWithinPartitions(*CLUSTER, "o", "s", "e").drop("o")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            done = []
            for k, c1, c2, s, e, n, w, *labels in zip(*[batch[x] for x in (*CLUSTER, *given)]):
                if (k, c1, c2) != now:
                    if state is not None:
                        done += [(*now, *r) for r in state.rows()]
                    now, state = (k, c1, c2), fold()
                state.add(int(s), int(e), int(n), int(w), *labels)
            if done:
                yield pd.DataFrame(done, columns=names)
        if state is not None:
            yield pd.DataFrame([(*now, *r) for r in state.rows()], columns=names)

    return c.mapInPandas(run, f"key {key_type}, c1 bigint, c2 bigint, start_pos bigint, end_pos bigint, {reach_columns}")


def support_fold(rows: list[Row], reach: int = 7) -> list[tuple]:
    """The rule of SupportFold over rows in order, plainly: what the operator must give."""
    out: list[list[int]] = []
    for s, e, w in rows:
        for x in out:
            if abs(x[0] - s) <= reach and abs(x[1] - e) <= reach:
                x[2] += w
                if (s, e) != (x[0], x[1]) and e - s < x[1] - x[0]:
                    x[0], x[1] = s, e
                break
        else:
            out.append([s, e, w])
    return [tuple(x) for x in out]


def leader_fold(rows: list[Row], reach: int = 10, least: int = 2) -> list[tuple]:
    """The rule of LeaderFold over rows in order, plainly."""
    out, taken = [], [False] * len(rows)
    for i, a in enumerate(rows):
        if taken[i]:
            continue
        size, weight = 1, a[2]
        for j in range(i + 1, len(rows)):
            if not taken[j] and abs(a[0] - rows[j][0]) <= reach and abs(a[1] - rows[j][1]) <= reach:
                taken[j] = True
                size += 1
                weight += rows[j][2]
        if size >= least:
            out.append((a[0], a[1], size, weight))
    return out


def merge_support(calls: DataFrame, key: str, order: Sequence[str], weight: str, reach: int = 7) -> DataFrame:
    """(key, start_pos, end_pos, support): places within ``reach`` positions at both ends merged in order.

    Distinct places are folded with their summed weight; only clusters in which that could differ from row by row
    (see PlaceFold) are folded once more from their rows, streamed in order.
    """
    rows = cut_lineage(calls.select(*dict.fromkeys([key, "start_pos", "end_pos", *order, weight])))
    places = cut_lineage(_places(rows, key, order, weight, reach))
    first = cut_lineage(_fold(places, lambda: PlaceFold(reach), PlaceFold.columns))
    out = first.filter("settled").select(F.col("key").alias(key), "start_pos", "end_pos", "support")
    open_ = first.filter("not settled").select(*CLUSTER)
    if open_.isEmpty():
        return out
    of = places.join(open_, CLUSTER, "left_semi").select(*CLUSTER, "s", "e")
    again = rows.select(F.col(key).alias("key"), F.col("start_pos").cast("bigint").alias("s"), F.col("end_pos").cast("bigint").alias("e"), F.struct(*order).alias("o"), F.lit(1).alias("n"), F.coalesce(F.col(weight).cast("bigint"), F.lit(0)).alias("w"))
    redone = _fold(again.join(of, ["key", "s", "e"]).select(*CLUSTER, "s", "e", "o", "n", "w"), lambda: SupportFold(reach), SupportFold.columns)
    return out.unionByName(redone.select(F.col("key").alias(key), "start_pos", "end_pos", "support"))


def leader_clusters(calls: DataFrame, key: str, order: Sequence[str], weight: str, reach: int = 10, least: int = 2, label: str | None = None) -> DataFrame:
    """(key, start_pos, end_pos, members, support) of clusters led by their first call; with ``label`` (a column of few values)
    also ``labels``, how many different ones a cluster has."""
    folded = _fold(_places(calls, key, order, weight, reach, label), lambda: LeaderFold(reach, least), LeaderFold.columns)
    return folded.select(F.col("key").alias(key), "start_pos", "end_pos", "members", "support", *(["labels"] if label else []))


def drop_later_similar(calls: DataFrame, key: str, order: Sequence[str], weight: str, reach: int = 10) -> DataFrame:
    """Calls that no earlier kept one is near to."""
    return leader_clusters(calls, key, order, weight, reach, 1)
