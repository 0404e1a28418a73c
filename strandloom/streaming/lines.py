"""Annotation lines checked as they arrive: the rules keep no state, so the batch operator serves a stream too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rowcheck import check_lines


def load_lines(spark: SparkSession, source: str, good: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Files of lines that appear in ``source`` go to parquet in ``good`` (their nine cells) or ``rejected`` (with
    the reasons), each batch at once; ``checkpoint`` must be on shared storage. Call awaitTermination or
    processAllAvailable on the result."""

    def put(batch: DataFrame, number: int) -> None:
        checked = check_lines(batch, "value").withColumn("batch", F.lit(number))
        parts = ((good, F.size("reasons") == 0, "cells"), (rejected, F.size("reasons") > 0, "reasons"))
        for path, which, extra in parts:
            # a batch that is run again replaces what it had written
            checked.filter(which).select("value", extra).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return spark.readStream.text(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
