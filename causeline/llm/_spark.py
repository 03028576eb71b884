"""Session helpers shared by the corpus operators: shared-folder checkpoints and Arrow slices."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: Rows in an Arrow batch at most: whole texts are in it, on both sides of the pipe.
BATCH_ROWS = 1000


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the session names.

    A lost executor never loses the rows.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a session on one machine gets a folder of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="causeline-ckpt-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reads; none if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there in full: its files appear when the job commits."""
    return any(n.startswith("part-") for n in children(spark, path))


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from here on the session makes Arrow batches of ``BATCH_ROWS`` rows at most."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))


def ids_repeat(df: DataFrame, column: str = "doc_id") -> bool:
    """Whether any id stands on several rows: reads that column alone."""
    ids = df.select(column).filter(F.col(column).isNotNull())
    return has_rows(ids.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column as a plain string array, nulls as empty texts."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return col.fill_null("") if col.null_count else col


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose texts hold at most ``limit`` bytes each, or one row: bounds working memory."""
    _, off = raw(text_column(batch, name))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copies; offsets are absolute."""
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int32)[col.offset : col.offset + len(col) + 1] if offsets is not None else np.zeros(len(col) + 1, np.int32)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), off.astype(np.int64)
