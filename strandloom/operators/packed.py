"""Several values packed in one field: a quote-aware tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class PackedFormat:
    """What separates values (``separators``), names from values (``marks``) and nests (``nesting``: pairs of
    an opening and a closing character, within which separators and blanks are plain text)."""

    separators: str = ";|,\t"
    marks: str = "=:"
    blanks: str = " "
    quotes: str = "\"'"
    escape: str = "\\"
    nesting: str = ""


class Tokenizer:
    """A finite-state tokenizer over one field: between, name, mark, plain, nested, quoted.

    Every state consumes the longest run that can't change it with one compiled pattern, so the cost is in
    proportion to the number of values and not of characters.
    """

    def __init__(self, form: PackedFormat):
        one = lambda s: "[" + re.escape(s) + "]" if s else "(?!)"
        blank = form.blanks + "".join(c for c in "\t\r\n" if c not in form.separators)
        opening, closing = form.nesting[::2], form.nesting[1::2]
        self.form = form
        self.between = re.compile(r"[^A-Za-z0-9_]*")
        self.name = re.compile(r"[A-Za-z0-9_]+")
        self.mark = re.compile(f"{one(blank)}*(?:{one(form.marks)}{one(blank)}*)?")
        stop = form.separators + blank + opening
        self.plain = re.compile("[^" + re.escape(stop) + "]*")
        self.nested = re.compile("[^" + re.escape(opening + closing) + "]*") if opening else None
        self.pairs = dict(zip(opening, closing))
        self.quoted = {q: re.compile(f"[^{re.escape(q + form.escape)}]*") for q in form.quotes}

    def _quoted(self, text: str, at: int) -> tuple[str, int]:
        quote, parts, at = text[at], [], at + 1
        run = self.quoted[quote]
        while True:
            m = run.match(text, at)
            parts.append(m[0])
            at = m.end()
            if at >= len(text):  # stays open: all of the rest is the value
                return "".join(parts), at
            following = text[at + 1 : at + 2]
            if text[at] == quote and following != quote:
                return "".join(parts), at + 1
            if following == quote:  # doubled or after the escape: the quote itself
                parts.append(quote)
                at += 2
            else:
                parts.append(text[at])
                at += 1

    def _plain(self, text: str, at: int) -> tuple[str, int]:
        begin = at
        while True:
            at = self.plain.match(text, at).end()
            if at >= len(text) or text[at] not in self.pairs:
                return text[begin:at], at
            depth, stack = 1, [self.pairs[text[at]]]
            at += 1
            while depth and at < len(text):
                at = self.nested.match(text, at).end()
                if at >= len(text):
                    break
                if text[at] in self.pairs:
                    stack.append(self.pairs[text[at]])
                    depth += 1
                elif text[at] == stack[-1]:
                    stack.pop()
                    depth -= 1
                at += 1

    def tokens(self, text: str) -> Iterator[tuple[str, str]]:
        at, n = 0, len(text)
        while True:
            at = self.between.match(text, at).end()
            if at >= n:
                return
            m = self.name.match(text, at)
            at = self.mark.match(text, m.end()).end()
            if at < n and text[at] in self.form.quotes and at > m.end():
                value, at = self._quoted(text, at)
            else:
                value, at = self._plain(text, at)
            yield m[0], value


def split_packed(df: DataFrame, row_id: str, field: str, form: PackedFormat = PackedFormat(), names: tuple[str, str, str] = ("pos", "attr_name", "attr_value")) -> DataFrame:
    """One row per value packed in ``field``: ``row_id``, position from 1, name and value.

    Separators count only outside quotes (and nesting, if the format has any); a quote opens only as first
    character of a value, and doubled or escaped inside it means itself. Empty values between separators take
    no position. A NULL, empty or blank field gives no rows; a name without a value gets an empty one; a quote
    that stays open takes the rest of the field. Rows stay in their partitions: no shuffle, no group. Rows of
    equal ``row_id`` are each split on their own.
    """
    kept = df.select(F.col(row_id).alias("id"), F.col(field).alias("field")).filter("field is not null and field <> ''")
    id_type = kept.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("pos", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = Tokenizer(form)
        for batch in batches:
            ids: list = []
            pos: list[int] = []
            keys: list[str] = []
            values: list[str] = []
            for i, text in zip(batch["id"], batch["field"]):
                for k, (name, value) in enumerate(tokenizer.tokens(text), 1):
                    ids.append(i)
                    pos.append(k)
                    keys.append(name)
                    values.append(value)
            yield pd.DataFrame({"id": pd.Series(ids, dtype=batch["id"].dtype), "pos": pd.Series(pos, dtype="int32"), "name": pd.Series(keys, dtype="object"), "value": pd.Series(values, dtype="object")})

    out = kept.mapInPandas(run, schema)
    return out.select(F.col("id").alias(row_id), F.col("pos").alias(names[0]), F.col("name").alias(names[1]), F.col("value").alias(names[2]))
