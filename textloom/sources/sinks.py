"""Sinks: size-bounded shards, result tables, reports and append-only files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import report_value, slugify
from textloom.operators.runs import missing_runs
from textloom.operators.select import running_before
from textloom.session import cut


def shard_plan(docs: DataFrame, shard_chars: int = 250_000_000, group_rows: int = 1024, order: str = "doc_id", text: str = "text") -> DataFrame:
    """group, shard, full: the shard of each row group in order. A shard closes at the
    first group end with `shard_chars` characters or more; groups of fewer rows or after
    the last close are not written (full is false)."""
    position = running_before(docs, F.lit(1), order, "__pos")
    groups = position.groupBy(F.floor(F.col("__pos") / group_rows).alias("group")).agg(F.sum(F.length(text)).alias("chars"), F.count("*").alias("n"))

    def scan(batches):
        """Shards of the groups in order, a batch at a time; the last row tells how many closed."""
        shard, held = 0, 0
        for batch in batches:
            chars, n = batch.column("chars").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
            upto, of, at = np.cumsum(np.nan_to_num(chars).astype(np.int64)), np.empty(len(n), np.int64), 0
            while at < len(n):
                before = upto[at - 1] if at else 0
                end = at + int(np.searchsorted(upto[at:], before + shard_chars - held)) + 1  # past the group that closes
                of[at:end] = shard
                if end <= len(n) and n[end - 1] == group_rows:
                    shard, held = shard + 1, 0
                else:
                    held += int(upto[min(end, len(n)) - 1] - before)
                at = end
            yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array(of), pa.array(chars, pa.int64(), from_pandas=True), batch.column("n")], names=["group", "shard", "chars", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (-1, shard, 0, 0)], names=["group", "shard", "chars", "n"])

    # a shard's start depends on every earlier one, so one task scans the groups; it streams
    # over a row of two numbers a group of `group_rows` documents, not the documents
    rows = cut(groups.repartition(1).sortWithinPartitions("group").mapInArrow(scan, "group long, shard long, chars long, n long"))
    closed = rows.where("group < 0").select(F.col("shard").alias("closed"))
    return rows.where("group >= 0").crossJoin(F.broadcast(closed)).select("group", "shard", "chars", "n", (F.col("shard") < F.col("closed")).alias("full"))  # one row


def write_shards(docs: DataFrame, path: str, shard_chars: int = 250_000_000, group_rows: int = 1024, order: str = "doc_id", text: str = "text") -> None:
    """Write the full shards as zstd parquet, one folder a shard."""
    plan = shard_plan(docs, shard_chars, group_rows, order, text).where("full").select("group", "shard")
    rows = running_before(docs, F.lit(1), order, "__pos").withColumn("group", F.floor(F.col("__pos") / group_rows)).join(plan, "group")
    rows.select(text, "shard", "__pos").repartition("shard").sortWithinPartitions("shard", "__pos").select(text, "shard").write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(path)


def write_vocabulary(spark, merges: list[tuple[int, int]], path: str) -> None:
    """Tokenizer artifact: merges as parquet, never a pickle."""
    spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, a int, b int").write.mode("overwrite").parquet(path)


def write_byte_table(table: DataFrame, path: str) -> None:
    """Tokenizer artifact: bytes of each token id."""
    table.select("token_id", "n_bytes").coalesce(1).write.mode("overwrite").parquet(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Metrics of runs (run, step, key, value) into a table with a folder a run."""
    rows.select("run", F.col("step").cast("long").alias("step"), "key", F.col("value").cast("double").alias("value")).write.mode("append").partitionBy("run").parquet(path)


def core_lines(results: DataFrame) -> DataFrame:
    """line: padded result rows with a last CORE row."""
    body = results.select(F.col("task").alias("o"), F.format_string("%-35s, %-10.6f, %-10.6f", "task", "accuracy", "centered").alias("line"), F.lit(1).alias("k"))
    head = results.sparkSession.range(1).select(F.lit("").alias("o"), F.format_string("%-35s, %-10s, %-10s", F.lit("Task"), F.lit("Accuracy"), F.lit("Centered")).alias("line"), F.lit(0).alias("k"))
    last = results.agg(F.lit("").alias("o"), F.format_string("%-35s, %-10s, %-10.6f", F.lit("CORE"), F.lit(""), F.avg("centered")).alias("line"), F.lit(2).alias("k"))
    return head.unionByName(body).unionByName(last).select("k", "o", "line")


def append_missing(rows: DataFrame, done: DataFrame, path: str, *key: str) -> None:
    missing_runs(rows, done, *key).write.mode("append").option("header", True).csv(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def report_lines(metrics: DataFrame) -> DataFrame:
    """stage, slug, line: `- key: value` lines of report sections."""
    return metrics.select("stage", slugify(F.col("section")).alias("slug"), F.concat(F.lit("- "), "key", F.lit(": "), report_value(F.col("kind"), F.col("number"), F.col("text"))).alias("line"))


def summary_table(metrics: DataFrame, fixed: bool = False) -> DataFrame:
    """ord, line: one row a metric with a column a stage; CORE first, ChatCORE last. Longer
    names and values widen their cell, or with `fixed` end at its edge."""
    value = report_value(F.col("kind"), F.col("number"), F.col("text"))
    wide = metrics.groupBy("key").pivot("stage", ["base", "sft", "rl"]).agg(F.max(value)).fillna("-")
    order = W.orderBy(F.col("key") != "CORE", F.col("key") == "ChatCORE", "key")  # one row a metric
    cells = [F.rpad(c, n, " ") if fixed else F.format_string(f"%-{n}s", c) for c, n in (("key", 15), ("base", 8), ("sft", 8), ("rl", 8))]
    return wide.select(F.row_number().over(order).alias("ord"), F.format_string("| %s | %s | %s | %s |", *cells).alias("line"))
