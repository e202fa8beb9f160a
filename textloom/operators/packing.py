"""Packing of token sequences into rows of fixed capacity.

Order matters to greedy packing, so sequences are dealt into stripes by an order key and
each stripe is packed on its own: the result does not depend on Spark's partitions and
the number of stripes sets the parallelism.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACEMENT = "stripe long, row long, slot int, start int, id long, taken int, dropped int"


def place(items: list[tuple[int, int]], capacity: int, buffer_size: int, crop: bool) -> list[tuple[int, int, int, int, int, int]]:
    """(row, slot, start, id, taken, dropped) for items (id, length) in arrival order.

    The buffer is topped up before every placement; the largest item that fits goes
    first, the earlier of equals. If none fits, the shortest is cut to fill the row
    (crop) or the row stays short (pad). An item that can never fit is reported with
    row -1 in pad mode. The last, unfilled row has row -2: its items are the tail.
    """
    buffer: list[tuple[int, int, int]] = []  # (length, arrival, id), ascending
    feed = iter(enumerate(items))
    out, row, slot, pos = [], 0, 0, 0
    done = False
    while True:
        while len(buffer) < buffer_size and not done:
            nxt = next(feed, None)
            if nxt is None:
                done = True
                break
            arrival, (key, length) = nxt
            if length <= 0:
                continue
            if not crop and length > capacity:
                out.append((-1, 0, 0, key, 0, length))
                continue
            insort(buffer, (length, arrival, key))
        if not buffer:
            break
        left = capacity - pos
        k = bisect_left(buffer, (left + 1, -1, -1)) - 1
        if k >= 0:
            k = bisect_left(buffer, (buffer[k][0], -1, -1))
            length, _, key = buffer.pop(k)
            out.append((row, slot, pos, key, length, 0))
            pos, slot = pos + length, slot + 1
        elif crop:
            length, _, key = buffer.pop(0)
            out.append((row, slot, pos, key, left, length - left))
            pos = capacity
        else:
            pos = capacity
        if pos == capacity:
            row, slot, pos = row + 1, 0, 0
    if slot:
        out = [(-2, *x[1:]) if x[0] == row else x for x in out]
    return out


def first_fit_decreasing(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Longest first, each into the first row with room; longer items are cut to a row.
    The room of all rows is a tree of maxima, so a row is found in logarithmic time."""
    size = 1 << max(len(items) - 1, 0).bit_length()
    room = [capacity] * (2 * size)  # the leaves from `size` on are rows, empty at first
    slots = [0] * size
    out = []
    for key, length in sorted(items, key=lambda x: (-x[1], x[0])):
        taken, k = min(length, capacity), 1
        while k < size:
            k = 2 * k if room[2 * k] >= taken else 2 * k + 1
        row = k - size
        out.append((row, slots[row], capacity - room[k], key, taken, length - taken))
        slots[row] += 1
        room[k] -= taken
        while k > 1:
            k //= 2
            room[k] = max(room[2 * k], room[2 * k + 1])
    return out


def greedy(items: list[tuple[int, int]], capacity: int, crop: bool) -> list[tuple[int, int, int, int, int, int]]:
    """In arrival order; an item that overflows is cut (crop) or opens a new row (pad)."""
    out, row, slot, pos = [], 0, 0, 0
    for key, length in items:
        if not crop and pos and pos + length > capacity:
            row, slot, pos = row + 1, 0, 0
        taken = min(length, capacity - pos)
        out.append((row, slot, pos, key, taken, length - taken))
        pos, slot = pos + taken, slot + 1
        if pos == capacity:
            row, slot, pos = row + 1, 0, 0
    return out


STRATEGIES = {
    "bestfit_crop": lambda items, capacity, buffer: place(items, capacity, buffer, True),
    "bestfit_pad": lambda items, capacity, buffer: place(items, capacity, buffer, False),
    "greedy_crop": lambda items, capacity, buffer: greedy(items, capacity, True),
    "greedy_pad": lambda items, capacity, buffer: greedy(items, capacity, False),
    "ffd": lambda items, capacity, buffer: first_fit_decreasing(items, capacity),
}


#: Items of a stripe.
STRIPE_ITEMS = 250_000


def stripes_for(items: DataFrame, least: int = 1, each: int = STRIPE_ITEMS) -> int:
    """Stripes so that none has more than about `each` items."""
    return max(least, -(-items.count() // each))


def pack(items: DataFrame, capacity: int, stripes: int, strategy: str = "bestfit_crop", buffer_size: int = 1000, key: str = "id", length: str = "length") -> DataFrame:
    """Placements of items (key, length), packed per stripe of the key in key order. Only
    lengths are shuffled; `assemble` brings the tokens."""
    method = STRATEGIES[strategy]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        found = method(list(zip(pdf["id"].tolist(), pdf["length"].tolist())), capacity, buffer_size)
        out = pd.DataFrame(found, columns=["row", "slot", "start", "id", "taken", "dropped"])
        out.insert(0, "stripe", pdf["stripe"].iloc[0])
        return out

    rows = items.select(F.col(key).cast("long").alias("id"), F.col(length).cast("int").alias("length")).withColumn("stripe", F.pmod("id", F.lit(stripes)).cast("long"))
    return rows.groupBy("stripe").applyInPandas(run, PLACEMENT)


def assemble(placements: DataFrame, tokens: DataFrame, capacity: int, pad: int | None = None, key: str = "id") -> DataFrame:
    """stripe, row, tokens of each full row; short rows are padded when `pad` is given."""
    parts = placements.where("row >= 0").join(tokens.select(F.col(key).alias("id"), "ids"), "id").select("stripe", "row", F.struct("slot", F.slice("ids", F.lit(1), F.col("taken")).alias("ids")).alias("p"))
    rows = parts.groupBy("stripe", "row").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["ids"])).alias("tokens"))  # at most `capacity` tokens
    if pad is None:
        return rows
    full = F.concat("tokens", F.array_repeat(F.lit(pad), F.lit(capacity) - F.size("tokens")))
    return rows.select("stripe", "row", full.alias("tokens"), F.size("tokens").alias("content_len"))


def ignore_tail(rows: DataFrame, capacity: int) -> DataFrame:
    """Targets of padded rows: positions from content_len - 1 on become -1."""
    shifted = F.slice("tokens", 2, capacity - 1)
    return rows.withColumn("targets", F.transform(shifted, lambda t, i: F.when((i >= F.col("content_len") - 1) & (F.col("content_len") < capacity), -1).otherwise(t)))


def statistics(placements: DataFrame, capacity: int) -> DataFrame:
    """rows, utilisation, cropped and padded shares of full rows."""
    full = placements.where("row >= 0")
    rows = full.groupBy("stripe", "row").agg(F.sum("taken").alias("taken"), F.sum("dropped").alias("dropped"))
    return rows.agg(
        F.count("*").alias("rows"),
        (F.sum("taken") / (F.count("*") * capacity)).alias("utilisation"),
        (F.sum("dropped") / F.sum(F.col("taken") + F.col("dropped"))).alias("cropped"),
        (1 - F.sum("taken") / (F.count("*") * capacity)).alias("padded"),
    )


def pad_right(rows: DataFrame, pad: int, by: str | None = None) -> DataFrame:
    """Pad `ids` to the longest of the table, or of each value of `by`."""
    longest = rows.groupBy(*([by] if by else [])).agg(F.max(F.size("ids")).alias("__n"))
    joined = rows.join(longest, by) if by else rows.crossJoin(F.broadcast(longest))  # one row
    return joined.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad), F.col("__n") - F.size("ids")))).drop("__n")


def boundaries(rows: DataFrame, bos: int) -> DataFrame:
    """Positions of the BOS token in each row."""
    return rows.withColumn("starts", F.filter(F.transform("tokens", lambda t, i: F.when(t == bos, i)), lambda x: x.isNotNull()))
