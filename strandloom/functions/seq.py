"""Sequence functions as column expressions. NULL in gives NULL out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two-bit code of the bases.
BASES, DIGITS = "ATGC", "0123"


def encode_kmer(kmer: Column) -> Column:
    """Two bits per base, first base highest, as BIGINT (up to 31 bases); any case. NULL for other letters or length."""
    k = F.upper(kmer)
    code = F.conv(F.translate(k, BASES, DIGITS), 4, 10).cast("bigint")
    return F.when(k.rlike(r"\A[ATGC]{1,31}\z"), code)


def decode_kmer(code: Column, k: int | Column) -> Column:
    """The k bases of a code."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, F.lit("0")), DIGITS, BASES)


def reverse_complement(seq: Column) -> Column:
    """N stays N, any other letter becomes N."""
    return F.translate(F.reverse(F.regexp_replace(seq, "[^ATGCNatgcn]", "N")), "ATGCatgc", "TACGtacg")


def canonical(kmer: Column) -> Column:
    """The lesser code of a k-mer and its reverse complement."""
    return F.least(encode_kmer(kmer), encode_kmer(reverse_complement(kmer)))


def loose_match(a: Column, b: Column, k: int) -> Column:
    """Whether at least two of the three thirds (of k // 3 bases; what is left over doesn't count) agree."""
    third = k // 3
    same = [(F.substring(a, 1 + i * third, third) == F.substring(b, 1 + i * third, third)).cast("int") for i in range(3)]
    return (F.length(a) == k) & (F.length(b) == k) & (same[0] + same[1] + same[2] >= 2)


def neighbours(kmer: Column) -> Column:
    """Array of the distinct k-mers at Hamming distance 1 at most, itself included."""
    upper = F.upper(kmer)
    every = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length(upper)),
            lambda i: F.transform(F.array(*[F.lit(b) for b in BASES]), lambda b: F.concat(F.substr(upper, F.lit(1), i - 1), b, F.substr(upper, i + 1, F.length(upper)))),
        )
    )
    return F.when(F.length(kmer) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def next_unknown(seq: Column, start: int | Column = 1) -> Column:
    """Position (from 1) of the next N at or after ``start``, 0 if there is none."""
    return F.locate("N", F.upper(seq), start) if isinstance(start, int) else F.expr("0")


def has_unknown(seq: Column) -> Column:
    return F.contains(F.upper(seq), F.lit("N"))


def fill_quality(seq: Column, mark: str = "I") -> Column:
    """A constant quality per base."""
    return F.repeat(F.lit(mark), F.length(seq))


def wrap(seq: Column, width: int = 100) -> Column:
    """Line breaks after every ``width`` letters."""
    return F.regexp_replace(seq, f"(?s)(.{{{width}}})", "$1\n")


def fasta_record(name: Column, seq: Column, width: int = 100) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(wrap(seq, width), r"\n\z", ""))


def donor_acceptor_signal(head2: Column, tail2: Column, strand: Column) -> tuple[Column, Column]:
    """(head signal, tail signal) of an exon by the two bases on either side, read from the reference strand."""
    plus = strand == "+"
    head = F.when(plus, F.upper(head2) == "AG").otherwise(F.upper(head2) == "AC")
    tail = F.when(plus, F.upper(tail2) == "GT").otherwise(F.upper(tail2) == "CT")
    return head, tail


def is_reversed(start: Column, end: Column) -> Column:
    """Whether a stretch runs against its subject: its start lies beyond its end."""
    return start > end


def flanks(seq: Column, start: Column, end: Column, size: int = 50) -> tuple[Column, Column]:
    """(before, after): ``size`` bases on either side of the stretch from ``start`` to ``end`` (from 1, inclusive), fewer at the
    ends of ``seq``. Of a stretch that runs backwards the sides change places and are read backwards, not complemented."""
    low, high = F.least(start, end), F.greatest(start, end)
    left = F.substr(seq, F.greatest(low - size, F.lit(1)).cast("int"), F.least(low - 1, F.lit(size)).cast("int"))
    right = F.substr(seq, (high + 1).cast("int"), F.lit(size))
    back = is_reversed(start, end)
    return F.when(back, F.reverse(right)).otherwise(left), F.when(back, F.reverse(left)).otherwise(right)
