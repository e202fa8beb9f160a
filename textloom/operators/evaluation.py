"""Aggregation of scores: bits per byte, accuracy, centred metrics, pass@k, argmax."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators.select import sent


def byte_table(n_bytes: int = 256, specials: int = 9) -> "callable":
    """token_id, n_bytes: bytes that `decode([id])` shows (an invalid byte alone shows
    U+FFFD, three bytes), 0 for specials."""

    def build(spark) -> DataFrame:
        ids = spark.range(n_bytes + specials).withColumnRenamed("id", "token_id")
        return ids.select("token_id", F.when(F.col("token_id") < 128, 1).when(F.col("token_id") < n_bytes, 3).otherwise(0).cast("int").alias("n_bytes"))

    return build


def byte_counts(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, target, n: occurrences of each byte value in the texts of each value of `by`,
    summed in every batch before the shuffle."""

    def run(batches):
        for batch in batches:
            keys = batch.column(by).dictionary_encode()
            sums: dict[int, np.ndarray] = {}
            for k, t in zip(keys.indices.to_pylist(), batch.column(text).to_pylist()):
                sums[k] = sums.get(k, 0) + np.bincount(np.frombuffer((t or "").encode(), np.uint8), minlength=256)
            for k, counts in sums.items():
                at = np.flatnonzero(counts)
                value = keys.dictionary[k] if k is not None else pa.scalar(None, keys.type.value_type)
                yield pa.RecordBatch.from_arrays([pa.array([value.as_py()] * len(at), keys.type.value_type), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=[by, "target", "n"])

    kind = docs.schema[by].dataType.simpleString()
    return docs.select(by, text).mapInArrow(run, f"{by} {kind}, target int, n long").groupBy(by, "target").agg(F.sum("n").alias("n"))


def bits_per_byte(losses: DataFrame, token_bytes: DataFrame, *by: str, target: str = "target", loss: str = "loss") -> DataFrame:
    """Sum of losses at targets with bytes over ln 2 times the bytes; infinite without bytes."""
    joined = losses.join(sent(token_bytes), F.col(target) == F.col("token_id"), "left")  # one row a vocabulary entry
    n = F.coalesce("n_bytes", F.lit(0))
    sums = joined.groupBy(*by).agg(F.sum(F.when(n > 0, F.col(loss)).otherwise(0.0)).alias("nats"), F.sum(n).cast("long").alias("bytes"))
    return sums.withColumn("bpb", F.when(F.col("bytes") > 0, F.col("nats") / (math.log(2) * F.col("bytes"))).otherwise(F.lit(float("inf"))))


def option_losses(scores: DataFrame) -> DataFrame:
    """Mean loss of each option over its span [start - 1, stop - 1), and whether all its
    predictions hit the token that follows."""
    last = W.partitionBy("task", "idx", "option").orderBy("pos")
    rows = scores.withColumn("next", F.lead("token").over(last)).where((F.col("pos") >= F.col("start") - 1) & (F.col("pos") < F.col("stop") - 1))
    return rows.groupBy("task", "kind", "idx", "option", "gold").agg(F.avg("loss").alias("mean_loss"), F.bool_and(F.col("pred") == F.col("next")).alias("exact"))


def example_outcomes(options: DataFrame) -> DataFrame:
    """Per example: least mean loss equals gold (first option on ties), or exact match."""
    best = F.min_by("option", F.struct("mean_loss", "option"))
    rows = options.groupBy("task", "kind", "idx").agg(best.alias("best"), F.first("gold").alias("gold"), F.bool_and("exact").alias("exact"))
    return rows.select("task", "idx", F.when(F.col("kind") == "language_modeling", F.col("exact")).otherwise(F.col("best") == F.col("gold")).alias("is_correct"))


def accuracy(outcomes: DataFrame, *by: str) -> DataFrame:
    return outcomes.groupBy(*by).agg(F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.count("*").alias("n"))


def centered(acc: Column, baseline: Column) -> Column:
    return (acc - baseline) / (1.0 - baseline)


def core_metric(tasks: DataFrame, baselines: DataFrame) -> DataFrame:
    """Unweighted mean of centred accuracies; baselines are percentages."""
    joined = tasks.join(sent(baselines), "task")  # a row a task
    return joined.select("task", "accuracy", centered(F.col("accuracy"), 0.01 * F.col("random_baseline")).alias("centered"))


def sampled_text(samples: DataFrame, terminal: list[int], ids: str = "ids", prompt: str = "prompt_len") -> DataFrame:
    """Generated ids of each sample: without the prompt and from the first terminal id on."""
    after = F.slice(ids, F.col(prompt) + 1, F.greatest(F.size(ids) - F.col(prompt), F.lit(0)))
    stop = F.array_min(F.array(*[F.nullif(F.array_position("__after", t), F.lit(0)) for t in terminal]))
    rows = samples.withColumn("__after", after)
    return rows.withColumn("sampled", F.when(stop.isNull(), F.col("__after")).otherwise(F.slice("__after", F.lit(1), (stop - 1).cast("int")))).drop("__after")


def generative_accuracy(items: DataFrame, completions: DataFrame, equal, by: str = "task") -> DataFrame:
    """by, accuracy, n: share of items (by, idx, reference) of which any completion (by,
    idx, sample_idx, text) is right; an item without completions counts as failed."""
    joined = items.join(completions, [by, "idx"], "left")
    right = F.coalesce(equal(F.col("text"), F.col("reference")) & F.col("sample_idx").isNotNull(), F.lit(False))
    return accuracy(joined.groupBy(by, "idx").agg(F.bool_or(right).alias("is_correct")), by)


def pass_at_k(outcomes: DataFrame, key: str = "idx") -> DataFrame:
    """k, share of problems with a success in the first k samples."""
    frame = W.partitionBy(key).orderBy("sample_idx").rowsBetween(W.unboundedPreceding, 0)
    prefix = outcomes.select((F.col("sample_idx") + 1).alias("k"), F.bool_or("is_correct").over(frame).alias("hit"))
    return prefix.groupBy("k").agg(F.avg(F.col("hit").cast("double")).alias("pass_at_k"))


def advantages(rollouts: DataFrame) -> DataFrame:
    return rollouts.withColumn("advantage", F.col("reward") - F.avg("reward").over(W.partitionBy("idx")))


def argmax(df: DataFrame, group: list[str], item: str, value: str) -> DataFrame:
    """The item of largest value of each group, the smallest item on ties."""
    return df.groupBy(*group).agg(F.min_by(item, F.struct(-F.col(value), F.col(item))).alias("best"))


def top_k_softmax(df: DataFrame, group: str, k: int, temperature: float = 1.0, keep_ties: bool = False) -> DataFrame:
    """Probabilities over the k largest logits; with keep_ties all equal to the k-th."""
    order = W.partitionBy(group).orderBy(F.desc("logit"), *([] if keep_ties else [F.asc("token")]))
    kept = df.withColumn("r", (F.rank() if keep_ties else F.row_number()).over(order)).where(F.col("r") <= k)
    e = kept.withColumn("e", F.exp((F.col("logit") - F.max("logit").over(W.partitionBy(group))) / temperature))
    return e.select(group, "token", (F.col("e") / F.sum("e").over(W.partitionBy(group))).alias("p"))


def policy_objective(tokens: DataFrame) -> DataFrame:
    """Sum of log-probability times advantage over valid tokens, per their count."""
    valid = F.col("target") != -1
    return tokens.agg((F.sum(F.when(valid, F.col("logp") * F.col("advantage")).otherwise(0.0)) / F.greatest(F.count(F.when(valid, 1)), F.lit(1))).alias("objective"))
