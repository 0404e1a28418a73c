"""Rows that fail to parse: one generated pattern per schema, then prefixes of it for the failures."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAB = "\t"
#: Stands for NULL in a row's text; no field pattern accepts it.
NULL_MARK = "\x00"


def integer_pattern(low: int, high: int) -> str:
    """A pattern of the decimal numbers from ``low`` to ``high``, leading zeros allowed (0 <= low <= high)."""

    def between(a: str, b: str) -> list[str]:
        """Patterns of the numbers from a to b, which have as many digits."""
        if not a:
            return [""]
        if a[0] == b[0]:
            return [a[0] + x for x in between(a[1:], b[1:])]
        n, out = len(a) - 1, []
        first, last = int(a[0]), int(b[0])
        if a[1:] != "0" * n:
            out += [a[0] + x for x in between(a[1:], "9" * n)]
            first += 1
        if b[1:] != "9" * n:
            out += [b[0] + x for x in between("0" * n, b[1:])]
            last -= 1
        if first <= last:
            out.append(f"[{first}-{last}]" + (f"[0-9]{{{n}}}" if n else ""))
        return out

    parts = []
    for digits in range(len(str(low)), len(str(high)) + 1):
        a = max(low, 10 ** (digits - 1) if digits > 1 else 0)
        b = min(high, 10**digits - 1)
        parts += between(str(a), str(b))
    return "0*(?:" + "|".join(parts) + ")"


@dataclass(frozen=True)
class FieldRule:
    """A field of a row: what it may look like (``pattern``, no anchors), and the reason given if it doesn't.

    Without a pattern the field is free text."""

    name: str
    pattern: str | None = None
    reason: str | None = None


class RowSchema:
    """Patterns generated from the fields of a row."""

    def __init__(self, fields: Sequence[FieldRule], separator: str = TAB):
        self.fields, self.separator = list(fields), separator
        self.sep = re.escape(separator)
        self.any = f"[^{self.sep}]*"

    def whole(self) -> str:
        """Anchored pattern of a valid row."""
        return r"\A" + self.sep.join(f.pattern or self.any for f in self.fields) + r"\z"

    def prefix(self, n: int) -> str:
        """Anchored pattern of a row whose first ``n`` fields are valid."""
        return r"\A" + self.sep.join(f.pattern or self.any for f in self.fields[:n]) + f"(?:{self.sep}|\\z)"

    def only(self, n: int) -> str:
        """As prefix(n), but what stands before field ``n`` is free: for rows with an earlier broken field."""
        return r"\A" + f"(?:{self.any}{self.sep}){{{n - 1}}}" + (self.fields[n - 1].pattern or self.any) + f"(?:{self.sep}|\\z)"

    def text(self, columns: Sequence[Column]) -> Column:
        """The row as one text. A separator inside a field is masked, NULL becomes a mark of its own."""
        return F.concat_ws(self.separator, *[F.coalesce(F.translate(c, self.separator, "\x01"), F.lit(NULL_MARK)) for c in columns])

    def reasons(self, row: Column) -> Column:
        """Array of reasons, in field order; empty for a valid row.

        Only rows that fail the whole pattern go on to the prefixes: the shortest prefix that fails names the
        first broken field; fields after it are tried with what precedes them left free.
        """
        checked = [k for k, f in enumerate(self.fields, 1) if f.pattern]
        first = F.coalesce(*[F.when(~row.rlike(self.prefix(k)), F.lit(k)) for k in checked])
        broken = [F.when((first == k) | ((first < k) & ~row.rlike(self.only(k))), F.lit(self.fields[k - 1].reason)) for k in checked]
        none = F.array().cast("array<string>")
        return F.when(row.rlike(self.whole()), none).otherwise(F.array_compact(F.array(*broken)))


def masked_quotes(field: Column) -> Column:
    """``field`` with every well-formed quoted text put as Q, so that any double quote left is a fault.

    A quote after a backslash is plain text. A quoted text begins at the start or after a blank and has
    nothing but blanks between its end and a semicolon or the end of the field. Quotes that match are
    consumed in pairs from the left, so a stray one always stays.
    """
    plain = F.regexp_replace(field, r'\\"', "xx")
    return F.regexp_replace(plain, r'(?:\A|(?<= ))"[^"]*"(?= *(?:;|\z))', "Q")


def digits_above(a: Column, b: Column) -> Column:
    """Whether the digits-only text ``a`` is a larger number than ``b``, of any length."""
    x, y = F.regexp_replace(a, r"^0+", ""), F.regexp_replace(b, r"^0+", "")
    return (F.length(x) > F.length(y)) | ((F.length(x) == F.length(y)) & (x > y))


#: Rules of annotation rows; blanks around a value don't count.
SEQNAME = FieldRule("seqname", " *[A-Za-z0-9._-]+ *", "seqname")
START = FieldRule("start", " *" + integer_pattern(1, 2147483647) + " *", "start")
FRAME = FieldRule("frame", " *[.012] *", "frame")
ANNOTATION = [SEQNAME, FieldRule("source"), FieldRule("feature"), START, FieldRule("end"), FieldRule("score"), FieldRule("strand"), FRAME]


def annotation_reasons(columns: Sequence[Column], attributes: Column | None = None) -> Column:
    """Array of the distinct reasons why an annotation row can't be loaded; empty if it can.

    ``columns`` are its eight fields in order; ``attributes`` is the ninth, checked for its quoting if given.
    That the start isn't above the end compares two fields and so follows as an exact check.
    """
    schema = RowSchema(ANNOTATION + ([FieldRule("attributes", '[^"\t]*', "quoting")] if attributes is not None else []))
    row = schema.text([*columns, *([masked_quotes(attributes)] if attributes is not None else [])])
    start, end = F.trim(columns[3]), F.trim(columns[4])
    reversed_ = end.rlike(r"\A[0-9]+\z") & start.rlike(r"\A[0-9]+\z") & digits_above(start, end)
    crossed = F.when(F.coalesce(reversed_, F.lit(False)), F.array(F.lit("start"))).otherwise(F.array().cast("array<string>"))
    return F.array_union(schema.reasons(row), crossed)


GFF_COLUMNS = ("seqname_", "source_", "feature_", "start_", "end_", "score_", "strand_", "frame_")


def check_elements(df: DataFrame) -> DataFrame:
    """gff_element rows with ``reasons`` (a column of that name is replaced). Any field may be NULL, which breaks the
    rule of a checked one; an empty table gives an empty result; repeated rows are each checked."""
    return df.withColumn("reasons", annotation_reasons([F.col(c) for c in GFF_COLUMNS]))


def check_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Raw annotation lines with their ``cells`` and ``reasons`` (columns of these names are replaced).

    Lines that are NULL, empty or begin with ``#`` are no rows and are left out. A line without nine columns
    has the sole reason column_count. An empty table gives an empty result.
    """
    rows = df.filter(F.col(line).isNotNull() & (F.col(line) != "") & ~F.startswith(F.col(line), F.lit("#")))
    rows = rows.withColumn("cells", F.split(F.col(line), TAB, -1))
    cell = [F.get(F.col("cells"), k) for k in range(9)]
    counted = F.size("cells") == 9
    return rows.withColumn("reasons", F.when(counted, annotation_reasons(cell[:8], cell[8])).otherwise(F.array(F.lit("column_count"))))


def sequence_key(name: Column) -> Column:
    """The trimmed sequence name without a leading ``chr`` in any case."""
    return F.regexp_replace(F.trim(name), r"\A[cC][hH][rR]", "")


def usable_sequence(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A" + SEQNAME.pattern + r"\z"), F.lit(False))


def whole_number(text: Column) -> Column:
    """Digits-only text (blanks around it don't count) as BIGINT; a number beyond it becomes the largest; else NULL."""
    t = F.trim(text)
    return F.when(t.rlike(r"\A[0-9]+\z"), F.coalesce(t.try_cast("bigint"), F.lit(9223372036854775800)))
