"""Local alignment of short reads to short references, pair by pair inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH, MISMATCH, GAP = 1, -2, -3


#: Cells of the score tables that are filled at once.
CELLS = 1 << 23


def _scores(queries: list[np.ndarray], subjects: list[np.ndarray]) -> np.ndarray:
    """Score tables of many pairs, filled along anti-diagonals of all of them together."""
    n, m = max(map(len, queries)), max(map(len, subjects))
    q, s = np.zeros((len(queries), n), np.uint8), np.ones((len(subjects), m), np.uint8)  # padding matches nothing
    for k, (x, y) in enumerate(zip(queries, subjects)):
        q[k, : len(x)], s[k, : len(y)] = x, y
    h = np.zeros((len(queries), n + 1, m + 1), dtype=np.int32)
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        best = h[:, i - 1, j - 1] + np.where(q[:, i - 1] == s[:, j - 1], MATCH, MISMATCH)
        np.maximum(best, h[:, i - 1, j] + GAP, out=best)
        np.maximum(best, h[:, i, j - 1] + GAP, out=best)
        h[:, i, j] = np.maximum(best, 0)
    return h


def _trace(h: np.ndarray, q: np.ndarray, s: np.ndarray) -> tuple | None:
    i, j = (int(x) for x in np.unravel_index(int(h.argmax()), h.shape))
    if not h[i, j]:
        return None
    q_end, s_end, length, same, gaps = i - 1, j - 1, 0, 0, 0
    while i and j and h[i, j]:
        equal = q[i - 1] == s[j - 1]
        if h[i, j] == h[i - 1, j - 1] + (MATCH if equal else MISMATCH):
            same += int(equal)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            gaps, i = gaps + 1, i - 1
        else:
            gaps, j = gaps + 1, j - 1
        length += 1
    return length, i, q_end, j, s_end, same / length, gaps / length


def local_alignments(queries: list[str], subjects: list[str]) -> list[tuple | None]:
    """(aligned length, q_start, q_end, s_start, s_end, identity, gap share) of the best local alignment of each
    pair, positions from 0, ends inclusive; None without a matching base."""
    code = [[np.frombuffer(x.encode("latin-1", "replace"), dtype=np.uint8) for x in side] for side in (queries, subjects)]
    out: list[tuple | None] = [None] * len(queries)
    order = sorted((k for k in range(len(queries)) if queries[k] and subjects[k]), key=lambda k: len(queries[k]) * len(subjects[k]))
    while order:
        n, m = len(code[0][order[-1]]) + 1, len(code[1][order[-1]]) + 1
        take, order = order[-max(1, CELLS // (n * m)) :], order[: -max(1, CELLS // (n * m))]
        h = _scores([code[0][k] for k in take], [code[1][k] for k in take])
        for at, k in enumerate(take):
            out[k] = _trace(h[at, : len(code[0][k]) + 1, : len(code[1][k]) + 1], code[0][k], code[1][k])
    return out


def align(pairs: DataFrame, query: str, subject: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with aln, q_start, q_end, s, e, ident and gap of each pair's best local alignment.

    Pairs without one, or with a NULL side, are left out. The cost of a pair is the product of both lengths.
    """
    rows = pairs.select(*keep, F.upper(query).alias("__q"), F.upper(subject).alias("__s")).filter("__q is not null and __s is not null")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["aln", "q_start", "q_end", "s", "e", "ident", "gap"]
        for b in batches:
            got = local_alignments(b["__q"].tolist(), b["__s"].tolist())
            there = [g is not None for g in got]
            found = pd.DataFrame([g for g in got if g is not None], columns=names)
            yield pd.concat([b.loc[there, keep].reset_index(drop=True), found], axis=1)

    return rows.mapInPandas(run, kept + ", aln bigint, q_start bigint, q_end bigint, s bigint, e bigint, ident double, gap double")
