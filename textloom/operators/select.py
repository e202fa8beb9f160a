"""Projections, predicates and windows over rows with a stable order key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def crop(docs: DataFrame, cap: int, text: str = "text") -> DataFrame:
    """Keep the first `cap` code points of each text."""
    return docs.withColumn(text, F.substring(text, 1, cap))


#: Rows of an order block; fewest and most blocks.
BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 1_000_000, 64, 4096


def sent(df: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """`df` marked for broadcast if it has at most `bound` rows, else as it is."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def _order_block(order: str, bounds: list) -> Column:
    """The number of bounds below the order value, found in two steps."""
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b < F.col(order)))

    part = below(F.array(*[F.lit(x[-1]) for x in parts]))
    inside = F.get(F.array(*[F.array(*[F.lit(b) for b in x]) for x in parts]), part)
    return part * step + F.coalesce(below(inside), F.lit(0))


def running_before(df: DataFrame, value: Column, order: str, name: str, blocks: int | None = None, block: Column | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add `name`: the sum of `value` over all rows before this one in `order` (then `ties`).

    No global single-partition sort: rows are dealt into order ranges, each block is
    summed locally, and the block offsets are broadcast, one row a block. `block` must
    not decrease with the order and take few values; by default it cuts a numeric
    order at approximate quantiles, one block a BLOCK_ROWS rows.
    """
    if block is None:
        blocks = blocks or min(MOST_BLOCKS, max(LEAST_BLOCKS, df.count() // BLOCK_ROWS))
        quantiles = df.select(F.percentile_approx(order, [i / blocks for i in range(1, blocks)], 10_000).alias("q")).first()["q"] or []
        bounds = sorted(set(quantiles))
        block = _order_block(order, bounds) if bounds else F.lit(0)
    parts = df.withColumn("__v", F.coalesce(value.cast("long"), F.lit(0))).withColumn("__block", block)
    sums = parts.groupBy("__block").agg(F.sum("__v").alias("__s"))
    offsets = sums.select("__block", (F.sum("__s").over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, 0)) - F.col("__s")).alias("__offset"))
    inside = F.sum("__v").over(W.partitionBy("__block").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0)) - F.col("__v")
    return parts.withColumn("__in", inside).join(F.broadcast(offsets), "__block").withColumn(name, F.col("__offset") + F.col("__in")).drop("__v", "__block", "__in", "__offset")


def char_budget(docs: DataFrame, max_chars: int, order: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows until the running character count passes `max_chars`; the crossing row is kept."""
    return running_before(docs, F.length(text), order, "__before").where(F.col("__before") <= max_chars).drop("__before")


def slice_view(df: DataFrame, start: int, stop: int | None, step: int = 1, idx: str = "idx") -> DataFrame:
    """`start:stop:step` over a dense index; the stop is not clamped to the table."""
    keep = (F.col(idx) >= start) & ((F.col(idx) - start) % step == 0)
    return df.where(keep & (F.col(idx) < stop) if stop is not None else keep)


def stripe(df: DataFrame, rank: int, world: int, idx: str = "idx") -> DataFrame:
    return df.where(F.pmod(F.col(idx), F.lit(world)) == rank)


def shuffle_key(seed: int, *idx: str) -> Column:
    """Order key of a deterministic shuffle: md5 of seed and index, then the index."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in idx]))


def shuffled(df: DataFrame, seed: int, *idx: str, name: str = "k") -> DataFrame:
    """Add `name`: the place from 1 of each row in the shuffled order of the whole table."""
    keyed = df.withColumn("__key", shuffle_key(seed, *idx))
    return running_before(keyed, F.lit(1), "__key", name, block=F.substring("__key", 1, 2), ties=idx).withColumn(name, (F.col(name) + 1).cast("long")).drop("__key")


def first_k(df: DataFrame, k: int, *order: str | Column) -> DataFrame:
    """The first `k` rows of a total order."""
    return df.orderBy(*order).limit(k)
