import os

import duckdb
import pytest

from strandloom.llm.queries import QUERIES
from strandloom.llm.tokens import counter, token_count
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(QUERIES.queries))
def test_query(spark, small, name):
    df = QUERIES.queries[name](spark, small)
    rows = df.collect()
    if name in QUERIES.sql:
        c = duckdb.connect()
        for f in os.listdir(small):
            c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
        assert sorted(map(tuple, rows)) == sorted(c.execute(QUERIES.sql[name]).fetchall())


def test_token_counts(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("",), ("a" * 70000,), ("<|endoftext|>",)], "t string")
    got = [r["n"] for r in df.select(token_count(F.col("t")).alias("n")).collect()]
    assert got[0] == 2 and got[1] == got[2] == 0 and got[3] > 1000 and got[4] > 1
    for kind in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        assert counter(f"/opt/tokenizers/{kind}")("hello world") >= 2
