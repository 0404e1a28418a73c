"""k-mers of long sequences and their counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import BASES, canonical, encode_kmer, neighbours

#: Bases per chunk before k-mers are cut, so that a cut never reaches far into a long text.
CHUNK = 256
#: Bases that are encoded at once.
STRETCH = 1 << 21


def kmers(seqs: DataFrame, seq: str, k: int, keep: tuple[str, ...] = (), positions: bool = False) -> DataFrame:
    """Every window of ``k`` bases as ``kmer`` (upper case), windows with other letters than ACGT left out.

    Sequences are first cut into chunks overlapping by k - 1. NULL and short sequences give none. With
    ``positions`` there is ``pos`` (BIGINT, from 0) too.
    """
    rows = seqs.select(*keep, F.upper(seq).alias("__s")).filter(F.length("__s") >= k)
    chunks = rows.select(*keep, "__s", F.explode(F.sequence(F.lit(0), F.length("__s") - k, F.lit(CHUNK))).alias("__at"))
    chunks = chunks.select(*keep, "__at", F.substr("__s", F.col("__at") + 1, F.lit(CHUNK + k - 1)).alias("__c"))
    cut = chunks.select(*keep, "__at", "__c", F.explode(F.sequence(F.lit(0), F.length("__c") - k)).alias("__i"))
    cut = cut.select(*keep, (F.col("__at") + F.col("__i")).cast("bigint").alias("pos"), F.substr("__c", F.col("__i") + 1, F.lit(k)).alias("kmer"))
    cut = cut.filter(~F.col("kmer").rlike("[^ACGT]"))
    return cut if positions else cut.drop("pos")


def _codes(text: bytes, k: int) -> np.ndarray:
    """Codes of all windows of ``k`` bases, two bits a base, first base highest; windows with other letters left out."""
    digit = np.full(256, 4, dtype=np.int64)
    for i, b in enumerate(BASES):
        digit[ord(b)] = digit[ord(b.lower())] = i
    d = digit[np.frombuffer(text, dtype=np.uint8)]
    n = len(d) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    code = np.zeros(n, dtype=np.int64)
    for j in range(k):
        code = code * 4 + (d[j : j + n] & 3)
    wrong = np.concatenate([[0], np.cumsum(d == 4)])
    return code[wrong[k:] == wrong[:-k]]


def sequence_kmer_counts(seqs: DataFrame, seq: str, k: int) -> DataFrame:
    """(code, n) per k-mer of all sequences, any case, k up to 31. NULL and short sequences give none.

    Sequences are encoded and counted in stretches inside tasks, so that sixteen bytes per distinct k-mer of a stretch
    are shuffled instead of its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(text: bytes) -> pa.RecordBatch:
            code, n = np.unique(_codes(text, k), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                text = text.encode()
                # a long text in stretches that overlap by k - 1
                for at in range(0, max(1, len(text) - k + 1), STRETCH):
                    held.append(text[at : at + STRETCH + k - 1])
                    size += len(held[-1])
                    if size >= STRETCH:
                        yield counted(b" ".join(held))
                        held, size = [], 0
        if held:
            yield counted(b" ".join(held))

    parts = seqs.select(seq).filter(F.length(seq) >= k).mapInArrow(run, "code bigint, n bigint")
    return parts.groupBy("code").agg(F.sum("n").alias("n"))


def kmer_counts(rows: DataFrame, kmer: str, weight: str | None = None) -> DataFrame:
    """(code, n) per k-mer: texts are counted first and encoded last."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = rows.groupBy(kmer).agg(n.cast("bigint").alias("n"))
    return counted.select(encode_kmer(F.col(kmer)).alias("code"), "n").filter("code is not null").groupBy("code").agg(F.sum("n").alias("n"))


def canonical_counts(rows: DataFrame, kmer: str, weight: str | None = None) -> DataFrame:
    """(code, n) per k-mer or its reverse complement, whichever code is less."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = rows.groupBy(kmer).agg(n.cast("bigint").alias("n"))
    return counted.select(canonical(F.col(kmer)).alias("code"), "n").filter("code is not null").groupBy("code").agg(F.sum("n").alias("n"))


def histogram(counts: DataFrame) -> DataFrame:
    """(n, kmers): how many k-mers occur n times."""
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("kmers"))


def solid(counts: DataFrame) -> DataFrame:
    """k-mers that occur more often than the average over the histogram without its first line."""
    h = histogram(counts)
    least = h.agg(F.min("n").alias("m")).scalar()
    rest = h.filter(F.col("n") > least)
    average = rest.agg((F.sum(F.col("n") * F.col("kmers")) / F.sum("kmers")).alias("a")).scalar()
    return counts.filter(F.col("n") > average)


def absorb_neighbours(counts: DataFrame, anchors: DataFrame, kmer: str, n: str) -> DataFrame:
    """Per anchor k-mer the summed count of all k-mers within Hamming distance 1: (anchor, members, total).

    A k-mer near several anchors counts for each; anchors without any member come out with zeros. The anchors'
    neighbourhoods are exploded (3k + 1 rows each) and meet the counts in an equi-join.
    """
    near = anchors.select(F.col(kmer).alias("anchor")).distinct().filter("anchor is not null")
    near = near.select("anchor", F.explode(neighbours(F.col("anchor"))).alias("kmer"))
    rows = counts.select(F.col(kmer).alias("kmer"), F.col(n).alias("n"))
    joined = near.join(rows, "kmer", "left")
    return joined.groupBy("anchor").agg(F.count("n").alias("members"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"))


def unabsorbed(counts: DataFrame, anchors: DataFrame, kmer: str) -> DataFrame:
    """k-mers that are near no anchor."""
    near = anchors.select(F.explode(neighbours(F.col(kmer))).alias(kmer)).distinct()
    return counts.join(near, kmer, "left_anti")
