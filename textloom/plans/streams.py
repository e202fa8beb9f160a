"""Streams over the base tables, drained: the same results as the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans import corpus, relational
from textloom.streaming import streams

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")  # a file or a folder


def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resumable scan without state."""
    rows = streams.drain(_stream(spark, sf_dir, "documents").select("lang", F.length("text").alias("chars")))
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"))


def stream_windows(spark, sf_dir):
    rows = streams.drain(streams.event_windows(_stream(spark, sf_dir, "events"), "1 day"), complete=True)
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark, sf_dir):
    rows = streams.drain(streams.sessions(_stream(spark, sf_dir, "events"), "30 minutes"), complete=True)
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def stream_pack(spark, sf_dir):
    """Placements that the stateful packer has made when the stream ends: all but the
    last ones, whose items still wait in its buffers of 50."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, _ROCKS)
    try:
        items = _stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.octet_length("text") + 1).alias("length"))
        return streams.drain(streams.pack_stream(items, 2049, 4, 50))
    finally:
        spark.conf.set(key, before)


_PACKED = corpus.best_fit("i AS (SELECT doc_id AS id, strlen(text) + 1 AS length FROM documents)", 2049, 50, 4, True)

QUERIES = {
    "stream_documents": (stream_documents, "SELECT lang, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang"),
    "stream_windows": (stream_windows, relational.QUERIES["event_windows"][1]),
    "stream_sessions": (stream_sessions, relational.QUERIES["event_sessions"][1]),
    "stream_pack": (
        stream_pack,
        f"""SELECT stripe, row, slot, start, id, taken, dropped FROM (SELECT * REPLACE (CASE WHEN row = -2 THEN last ELSE row END AS row), row_number() OVER (PARTITION BY stripe ORDER BY CASE WHEN row = -2 THEN last ELSE row END, slot) AS q, count(*) OVER (PARTITION BY stripe) AS n
FROM (SELECT *, max(row) OVER (PARTITION BY stripe) + 1 AS last FROM ({_PACKED}))) WHERE q <= n - 49""",
    ),
}
