"""Session construction, table access and lineage cutting shared by all plans."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "12g", app: str = "strandloom") -> SparkSession:
    """A session for one machine; on a cluster the submitting job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` in ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where none is set and the session has
    but one machine, as in tests, a temporary one is made. A cluster without one raises ValueError.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandloom-"))
    return df.checkpoint(eager=True)


def packed(batch: pa.RecordBatch, **beside: int) -> pa.RecordBatch:
    """One row: ``beside`` and the whole batch, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    values = [pa.array([n], pa.int32()) for n in beside.values()] + [pa.array([sink.getvalue().to_pybytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(values, names=[*beside, "packed"])


def unpacked(data: bytes) -> Iterator[pa.RecordBatch]:
    """The batches of a packed row."""
    with pa.ipc.open_stream(data) as r:
        yield from r


def cut_packed(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for wide or long rows: checkpoints aren't compressed, so rows are packed by the batch for it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield packed(b)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                yield from unpacked(data)

    return cut_lineage(df.mapInArrow(pack, "packed binary")).mapInArrow(unpack, df.schema)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with work for every core: rows of too few input splits are dealt out, others stay where they are.

    For scans without a shuffle only, of which the number of splits is known without running anything.
    """
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() < wanted else scan
