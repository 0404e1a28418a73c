"""Semi joins that broadcast only what has been counted and keep hot keys apart otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Keys that are broadcast at most; beyond it the join shuffles.
BROADCAST_KEYS = 500_000
SALTS = 16


def semi_join(rows: DataFrame, keys: DataFrame, on: str, broadcast_keys: int = BROADCAST_KEYS, anti: bool = False) -> DataFrame:
    """Rows of ``rows`` whose ``on`` is (or with ``anti``: isn't) among ``keys``.

    ``keys`` holds each key once and is counted first: up to ``broadcast_keys`` fixed-width keys are broadcast,
    which bounds the size; beyond it both sides are shuffled on (key, salt), so a key that holds a third of the
    rows is met by ``SALTS`` tasks. What makes the keys runs once: they are written before they are counted. A NULL
    key matches nothing.
    """
    keys = cut_lineage(keys.select(on))
    how = "left_anti" if anti else "left_semi"
    if keys.limit(broadcast_keys + 1).count() <= broadcast_keys:
        return rows.join(F.broadcast(keys), on, how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]), F.lit(SALTS)).cast("int"))
    copies = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [on, "__salt"], how).drop("__salt")


def lookup_join(rows: DataFrame, table: DataFrame, on: str, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``rows`` whose ``on`` is in ``table``, with that one's columns of fixed width.

    As in ``semi_join``: ``table`` holds each key once, is written and counted, and either broadcast or met by salted keys.
    """
    table = cut_lineage(table)
    if table.limit(broadcast_keys + 1).count() <= broadcast_keys:
        return rows.join(F.broadcast(table), on)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [on, "__salt"]).drop("__salt")
