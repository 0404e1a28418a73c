"""Pairwise alignment reports as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "subject string, aln_len int, identity double, gap double, s_start int, s_end int, q_start int, q_end int"


def parse_report(text: str) -> list[tuple]:
    """Alignments of one report, positions from 0. A subject begins with >, an alignment with Score."""
    import re

    out, subject, now = [], None, None

    def close() -> None:
        if now and now["q"] and now["s"]:
            out.append((subject, now["len"], now["ident"], now["gap"], now["s"][0] - 1, now["s"][-1] - 1, now["q"][0] - 1, now["q"][-1] - 1))

    for line in text.splitlines():
        if line.startswith(">"):
            close()
            subject, now = line[1:].strip(), None
        elif line.lstrip().startswith("Score"):
            close()
            now = {"len": None, "ident": None, "gap": None, "q": [], "s": []}
        elif now is not None:
            if m := re.search(r"Identities\s*=\s*(\d+)/(\d+)", line):
                now["len"], now["ident"] = int(m[2]), int(m[1]) / int(m[2])
                g = re.search(r"Gaps\s*=\s*(\d+)/(\d+)", line)
                now["gap"] = int(g[1]) / int(g[2]) if g else 0.0
            elif m := re.match(r"(Query|Sbjct)[:\s]+(\d+)\s+\S+\s+(\d+)", line):
                now["q" if m[1] == "Query" else "s"] += [int(m[2]), int(m[3])]
    close()
    return out


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per alignment of each report file (a report is one small file)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [(f, *r) for f, t in zip(batch["file"], batch["value"]) for r in parse_report(t)]
            yield pd.DataFrame(rows, columns=["file", *names])

    reports = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return reports.mapInPandas(run, "file string, " + SCHEMA)
