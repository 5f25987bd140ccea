"""Streams of documents: stages look at one document, so a stream of documents is a stream of segments."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stages import Stage, segment


def segment_stream(docs: DataFrame, stage: Stage, root: str | None = "doc") -> DataFrame:
    """Segments of a streaming table of documents, in append mode; no state is kept."""
    return segment(docs, stage, root)


def windowed_counts(events: DataFrame, width: str, late: str, time: str = "ts", *keys: str) -> DataFrame:
    """Counts by tumbling window and keys, of rows that are late by ``late`` at most."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, late: str, key: str, time: str = "ts") -> DataFrame:
    """Counts by key and session, which ends after ``gap`` without a row."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("session")).agg(F.count("*").alias("n"))


def segments_once(spark: SparkSession, path: str, stage: Stage) -> DataFrame:
    """The segments of the documents at ``path``, read as a stream, written to the shared folder and read back."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/treespan-streams"
    out = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder = path if not path.endswith(".parquet") else path.rpartition("/")[0]
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(path) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", path.rpartition("/")[2]).parquet(folder)
    query = segment_stream(rows.select("doc_id", "text"), stage).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
