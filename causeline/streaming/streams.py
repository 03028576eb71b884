"""Streams: ingest, bins over event time, late rows, change points as keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalar import header
from ..functions.tokenise import words_and_separators
from ..plans.checkpoint import shared_folder


def text_stream(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """Lines of files as they come."""
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path).select(F.col("value").alias("line"))


def parsed(lines: DataFrame, default_year: int) -> DataFrame:
    """(dt, host, words, seps) of the lines that can be read. Works on streams and tables."""
    rows = lines.withColumn("h", header(F.col("line"), default_year)).filter("h is not null").select("h.*")
    return rows.withColumn("t", words_and_separators(F.col("message"))).select(F.col("dt").cast("timestamp").alias("dt"), "host", "t.words", "t.seps")


def binned(events: DataFrame, size: str, slide: str | None = None, late: str = "0 seconds", keys: tuple[str, ...] = ("gid", "host")) -> DataFrame:
    """Counts in tumbling or hopping windows; rows later than the watermark are dropped, closed bins are emitted once."""
    rows = events.withWatermark("dt", late)
    window = F.window("dt", size, slide) if slide else F.window("dt", size)
    return rows.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("cnt")).select(F.col("w.start").alias("bin_dt"), *keys, "cnt")


def sessions(events: DataFrame, gap: str, late: str = "0 seconds", keys: tuple[str, ...] = ("gid", "host")) -> DataFrame:
    rows = events.withWatermark("dt", late).groupBy(F.session_window("dt", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("cnt"))
    return rows.select(F.col("w.start").alias("first_dt"), F.col("w.end").alias("end_dt"), *keys, "cnt")


def append(rows: DataFrame, path: str, checkpoint: str):
    """Write a stream as Parquet by day; the checkpoint makes it exactly once."""
    out = rows.withColumn("day", F.to_date("dt"))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append")


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream of its files. (A stream takes a single file as a pattern only.)"""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_once(rows: DataFrame) -> DataFrame:
    """All that a stream gives for what there is now, written to the shared folder and read back (append mode: closed windows only)."""
    spark = rows.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    q = rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


CP_STATE = "blob binary"
CP_OUT = "gid int, host string, bin long, value double, score double"


def change_points(bins: DataFrame, rate: float, order: int, smooth: int) -> DataFrame:
    """Scores of closed bins from counts (gid, host, bin, cnt) as they come; the two models of each event and its open bin are kept as state.

    Counts of one bin add up, whichever batch they come in; a bin is closed and scored when a later one of the event comes, and what
    comes for a closed bin is late and dropped. Bins that never come are zeros between those that do.
    """
    import pickle

    from ..operators.changepoint import ChangeFinder

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        finder, open_, count = pickle.loads(state.get[0]) if state.exists else (ChangeFinder(rate, order, smooth), None, 0.0)
        rows = pd.concat(list(batches)).groupby("bin")["cnt"].sum().sort_index()
        out = []
        for at, value in rows.items():
            if open_ is not None and at < open_:
                continue
            if open_ is not None and at > open_:
                for b, x in [(open_, count), *((b, 0.0) for b in range(open_ + 1, at))]:
                    out.append((key[0], key[1], b, x, finder.update(x)))
                count = 0.0
            open_, count = int(at), count + float(value)
        state.update((pickle.dumps((finder, open_, count)),))
        yield pd.DataFrame(out, columns=["gid", "host", "bin", "value", "score"])

    return bins.groupBy("gid", "host").applyInPandasWithState(run, CP_OUT, CP_STATE, "append", GroupStateTimeout.NoTimeout)
