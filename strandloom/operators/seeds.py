"""Which reads may lie on which chromosomes: an exact join of seeds and nodes, of which little is shuffled."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import BASES
from ..session import packed, unpacked

#: Nodes or probes that are dealt out at once.
STRETCH = 1 << 20
#: Exons that are looked at to tell which k-mers are frequent; that only decides which seeds are looked up.
LOOKED_AT = 4096
#: Times a k-mer is met in these to be called frequent.
FREQUENT = 3

_DIGIT = np.full(256, 4, dtype=np.int64)
for _i, _b in enumerate(BASES):
    _DIGIT[ord(_b)] = _DIGIT[ord(_b.lower())] = _i


def seed_offsets(k: int) -> tuple[int, ...]:
    """Where a read's seeds begin, counted from either end."""
    return 1, 5, k, int(1.5 * k)


def window_codes(text: bytes, k: int) -> np.ndarray:
    """The code of every window of ``k`` bases, -1 for those with other letters."""
    d = _DIGIT[np.frombuffer(text, dtype=np.uint8)]
    n = len(d) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    code = np.zeros(n, dtype=np.int64)
    for j in range(k):
        code = code * 4 + (d[j : j + n] & 3)
    wrong = np.concatenate([[0], np.cumsum(d == 4)])
    return np.where(wrong[k:] == wrong[:-k], code, -1)


def _nodes(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, row of the batch) of all windows of its texts."""
    texts = [(x or "").encode() for x in batch.column("seq").to_pylist()]
    code = window_codes(b" ".join(texts), k)
    row = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in texts])[: len(code)]
    return code[code >= 0], row[code >= 0]


def _dealt(held: list[tuple[np.ndarray, pa.Array]], parts: int, k: int) -> Iterator[pa.RecordBatch]:
    """Codes and what belongs to them as one packed row for each part."""
    code, of = np.concatenate([c for c, _ in held]), pa.concat_arrays([x for _, x in held])
    to = code % parts
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(parts + 1))
    small = np.uint32 if 4**k <= parts << 32 else np.int64
    for p in range(parts):
        if (at := order[ends[p] : ends[p + 1]]).size:
            high = (code[at] // parts).astype(small)
            yield packed(pa.RecordBatch.from_arrays([pa.array(high), of.take(pa.array(at))], names=["code", "of"]), part=p)


def _probes(batch: pa.RecordBatch, k: int, often: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, row of the batch): of each way a read may lie, all seeds but the most frequent one of that end whose others are rarer."""
    texts = [x.encode() for x in batch.column("seq").to_pylist()]
    d = _DIGIT[np.frombuffer(b"".join(texts) + b"A" * k, dtype=np.uint8)] & 3
    size = np.array([len(x) for x in texts], dtype=np.int64)
    start, last = np.cumsum(size) - size, size - k
    offs = np.array(seed_offsets(k))
    near = offs[None, :] + np.zeros_like(last)[:, None]
    far = last[:, None] - offs[None, :]

    def codes(at: np.ndarray, back: bool) -> np.ndarray:
        good = (at >= 0) & (at <= last[:, None])
        where = np.where(good, start[:, None] + at, 0)
        code = np.zeros(where.shape, dtype=np.int64)
        for j in reversed(range(k)) if back else range(k):
            code = code * 4 + (d[where + j] ^ back)  # bases are numbered so that a complement differs in the last bit
        return np.where(good, code, -1)

    out_code, out_row = [], []
    for head, tail in ((codes(near, False), codes(far, False)), (codes(far, True), codes(near, True))):
        costs, kept = [], []
        for side in (head, tail):
            i = np.minimum(np.searchsorted(often, side), max(0, len(often) - 1))
            n = np.where(often[i] == side, times[i], 0) if len(often) else np.zeros(side.shape, dtype=np.int64)
            n = np.where(side < 0, -1, n)
            worst = n.argmax(axis=1)
            rest = side.copy()
            rest[np.arange(len(side)), worst] = -1
            n[np.arange(len(side)), worst] = 0
            costs.append(np.maximum(n, 0).sum(axis=1))
            kept.append(rest)
        use = np.where((costs[1] < costs[0])[:, None], kept[1], kept[0])
        row, _ = np.nonzero(use >= 0)
        out_code.append(use[use >= 0])
        out_row.append(row)
    return np.concatenate(out_code), np.concatenate(out_row)


def frequent_nodes(exons: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, times) of k-mers that some of the exons have in common, most frequent ones of all exons among them."""
    n = exons.count()
    some = exons.filter(F.pmod(F.xxhash64("seq"), F.lit(max(1, n // LOOKED_AT))) == 0).select("seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, times = np.unique(_nodes(b, k)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(times)], names=["code", "n"])

    rows = some.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT).toArrow()
    code, times = rows["code"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(code)
    return code[order], times[order]


def places_of_reads(reads: DataFrame, exons: DataFrame, k: int) -> DataFrame:
    """(rid, chrom): the chromosomes on which a read may have two head seeds on one exon and two tail seeds on one, and others.

    ``reads`` (rid bigint, seq of ACGT), ``exons`` (chrom, seq). A pair comes out if any of the looked up seeds of a read is on the
    chromosome: of the end whose seeds are rarer, all seeds but the most frequent one, so that two can't be met without one of these.
    Codes are dealt out by their remainder in packed stretches and met in arrays. Pairs may come out several times.
    """
    spark = exons.sparkSession
    parts = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    often, times = frequent_nodes(exons, k)
    kind = exons.schema["chrom"].dataType.simpleString()

    def dealt(of: str, cut) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for b in batches:
                code, row = cut(b)
                held.append((code, b.column(of).take(pa.array(row))))
                size += len(code)
                if size >= STRETCH:
                    yield from _dealt(held, parts, k)
                    held, size = [], 0
            if size:
                yield from _dealt(held, parts, k)

        return run

    nodes = exons.select("chrom", "seq").mapInArrow(dealt("chrom", lambda b: _nodes(b, k)), "part int, packed binary")
    probes = reads.select("rid", "seq").mapInArrow(dealt("rid", lambda b: _probes(b, k, often, times)), "part int, packed binary")

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["rid", "chrom"]
        if not len(left) or not len(right):
            return pa.table({"rid": pa.array([], pa.int64()), "chrom": pa.array([], chrom_type)})
        n, p = (pa.Table.from_batches([b for x in t["packed"].to_pylist() for b in unpacked(x)]) for t in (left, right))
        code = n["code"].to_numpy()
        order = np.argsort(code, kind="stable")
        code, probe = code[order], p["code"].to_numpy()
        low, high = np.searchsorted(code, probe, "left"), np.searchsorted(code, probe, "right")
        count = high - low
        row = np.repeat(np.arange(len(probe)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        out = pa.table([p["of"].take(pa.array(row)), n["of"].take(pa.array(order[at]))], names=names)
        return out.group_by(names).aggregate([]).select(names)

    from pyspark.sql.pandas.types import to_arrow_type

    chrom_type = to_arrow_type(exons.schema["chrom"].dataType)
    return nodes.groupBy("part").cogroup(probes.groupBy("part")).applyInArrow(met, f"rid bigint, chrom {kind}")
