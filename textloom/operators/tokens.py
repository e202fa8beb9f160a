"""Tokenizers: raw bytes with specials, and trained byte pairs; conversation rendering."""

from __future__ import annotations

import json
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import SPLIT_PATTERN, byte_ids
from textloom.operators.select import sent
from textloom.session import cut

#: Special tokens in id order (fixed values); their ids follow the mergeable ones.
SPECIALS = ["<|bos|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>", "<|python_start|>", "<|python_end|>", "<|output_start|>", "<|output_end|>"]
BASE = 256
#: Distinct chunks that are merged on the driver; distinct chunks a task holds.
DRIVER_CHUNKS, FLUSH = 500_000, 300_000
#: Vocabulary entries that may be broadcast; chunks whose ids a worker remembers.
BROADCAST, CACHE = 1_000_000, 200_000
#: Ids of a vocabulary that is written into the plan.
NAMES = 1 << 16


def special_ids(spark: SparkSession, n_mergeable: int = BASE) -> DataFrame:
    return spark.createDataFrame([(s, n_mergeable + i) for i, s in enumerate(SPECIALS)], "token string, token_id int")


def special(name: str, n_mergeable: int = BASE) -> int:
    return n_mergeable + SPECIALS.index(f"<|{name}|>")


# -- conversations --------------------------------------------------------------


def merge_system(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Join a leading system message to the user message after it; `i` numbers the rest."""
    w = W.partitionBy(conv).orderBy(turn)
    rows = turns.withColumn("__prev_role", F.lag("role").over(w)).withColumn("__prev", F.lag("text").over(w)).withColumn("__n", F.row_number().over(w))
    merged = F.when((F.col("__n") == 2) & (F.col("__prev_role") == "system"), F.concat("__prev", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    kept = rows.withColumn("text", merged).where(~((F.col("__n") == 1) & (F.col("role") == "system")))
    return kept.withColumn("i", F.row_number().over(w) - 1).drop("__prev_role", "__prev", "__n")


def violations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", least: int = 2) -> DataFrame:
    """conv, code: broken rules of each conversation (too short, wrong alternation, blank
    text, system not followed by user)."""
    rows = merge_system(turns, conv, turn)
    expected = F.when(F.col("i") % 2 == 0, "user").otherwise("assistant")
    codes = F.array_compact(F.array(F.when(F.col("role") != expected, "role"), F.when(F.coalesce(F.btrim("text", F.lit(" \t\r\n")), F.lit("")) == "", "blank")))
    each = rows.select(conv, F.explode(codes).alias("code")).distinct()
    short = rows.groupBy(conv).agg(F.count("*").alias("n")).where(F.col("n") < least).select(conv, F.lit("short").alias("code"))
    w = W.partitionBy(conv).orderBy(turn)
    heads = turns.select(conv, "role", F.lead("role").over(w).alias("next"), F.row_number().over(w).alias("n")).where("n = 1 and role = 'system' and (next is null or next <> 'user')")
    return each.unionByName(short).unionByName(heads.select(conv, F.lit("system").alias("code")))


def _wrapped(ids: Column, mask: int, start: str, end: str, edge: int | None = None) -> tuple[Column, Column]:
    edge = mask if edge is None else edge
    tokens = F.concat(F.array(F.lit(special(start))), ids, F.array(F.lit(special(end))))
    return tokens, F.concat(F.array(F.lit(edge)), F.array_repeat(F.lit(mask), F.size(ids)), F.array(F.lit(mask if edge == mask else 1)))


def render_parts(parts: Column) -> tuple[Column, Column]:
    """ids and mask of assistant parts: text is learned, tool calls with their marks too,
    tool outputs are not."""

    def ids(p: Column) -> Column:
        body = byte_ids(p["text"])
        call, out = F.array(F.lit(special("python_start"))), F.array(F.lit(special("output_start")))
        return F.when(p["type"] == "python", F.concat(call, body, F.array(F.lit(special("python_end"))))).when(p["type"] == "python_output", F.concat(out, body, F.array(F.lit(special("output_end"))))).otherwise(body)

    def mask(p: Column) -> Column:
        extra = F.when(p["type"] == "text", 0).otherwise(2)
        return F.array_repeat(F.when(p["type"] == "python_output", 0).otherwise(1), F.octet_length(p["text"]) + extra)

    return F.flatten(F.transform(parts, ids)), F.flatten(F.transform(parts, mask))


def render(turns: DataFrame, max_tokens: int = 2048, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, ids, mask of each conversation: BOS, wrapped messages, cut to `max_tokens`.
    Only text between assistant marks, and the end mark, is learned."""
    rows = merge_system(turns, conv, turn)
    body = byte_ids(F.coalesce(F.col("text"), F.lit("")))
    user = F.concat(F.array(F.lit(special("user_start"))), body, F.array(F.lit(special("user_end"))))
    agent = F.concat(F.array(F.lit(special("assistant_start"))), body, F.array(F.lit(special("assistant_end"))))
    is_user = F.col("role") == "user"
    each = rows.select(conv, "i", F.when(is_user, user).otherwise(agent).alias("ids"), is_user.alias("u"))
    mask = F.when(F.col("u"), F.array_repeat(F.lit(0), F.size("ids"))).otherwise(F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(1), F.size("ids") - 1)))
    groups = each.select(conv, F.struct("i", "ids", mask.alias("mask")).alias("m")).groupBy(conv).agg(F.array_sort(F.collect_list("m")).alias("m"))  # one conversation
    ids = F.concat(F.array(F.lit(special("bos"))), F.flatten(F.transform("m", lambda x: x["ids"])))
    masks = F.concat(F.array(F.lit(0)), F.flatten(F.transform("m", lambda x: x["mask"])))
    return groups.select(conv, F.slice(ids, 1, max_tokens).alias("ids"), F.slice(masks, 1, max_tokens).alias("mask"))


def render_for_completion(turns: DataFrame, max_tokens: int = 2048, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations that end with the assistant, without that message, primed with the
    assistant start mark (appended after the cut)."""
    w = W.partitionBy(conv).orderBy(F.desc(turn))
    ranked = turns.withColumn("__r", F.row_number().over(w)).withColumn("__last", F.first("role").over(w))
    rest = ranked.where("__last = 'assistant' and __r > 1").drop("__r", "__last")
    return render(rest, max_tokens, conv, turn).select(conv, F.array_append("ids", F.lit(special("assistant_start"))).alias("ids"))


def render_web(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Serving variant: no alternation check, system messages are left out, primed for
    the assistant."""
    body = byte_ids(F.coalesce(F.col("text"), F.lit("")))
    user = F.concat(F.array(F.lit(special("user_start"))), body, F.array(F.lit(special("user_end"))))
    agent = F.concat(F.array(F.lit(special("assistant_start"))), body, F.array(F.lit(special("assistant_end"))))
    rows = turns.where(F.col("role").isin("user", "assistant")).select(conv, F.struct(F.col(turn).alias("t"), F.when(F.col("role") == "user", user).otherwise(agent).alias("ids")).alias("m"))
    groups = rows.groupBy(conv).agg(F.array_sort(F.collect_list("m")).alias("m"))
    return groups.select(conv, F.concat(F.array(F.lit(special("bos"))), F.flatten(F.transform("m", lambda x: x["ids"])), F.array(F.lit(special("assistant_start")))).alias("ids"))


def with_targets(rows: DataFrame, capacity: int) -> DataFrame:
    """inputs and targets (shift by one); targets with mask 0 become -1."""
    t = rows.withColumn("inputs", F.slice("ids", 1, capacity)).withColumn("targets", F.slice("ids", 2, capacity))
    m = F.slice("mask", 2, capacity)
    return t.withColumn("targets", F.zip_with("targets", m, lambda x, y: F.when(y == 0, -1).otherwise(x)))


def visualize(tokens: Column, mask: Column, with_ids: Column | None = None) -> Column:
    """Tokens joined by bars, green where learned and red elsewhere."""
    green, red, gray, reset = (F.lit(f"\x1b[{c}m") for c in (92, 91, 90, 0))
    shown = F.zip_with(tokens, mask, lambda t, m: F.concat(F.when(m == 1, green).otherwise(red), t, reset))
    if with_ids is not None:
        shown = F.zip_with(shown, with_ids, lambda t, i: F.concat(t, F.lit("|"), gray, F.lit("("), i.cast("string"), F.lit(")"), reset))
    return F.array_join(shown, "|")


def lookup(rows: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, tokens: ids replaced by their vocabulary entries; ids without one are left
    out, and rows without any. A vocabulary of ids below NAMES is an array that each row
    reads in place; a larger one is joined on the id (sent to all tasks up to BROADCAST
    entries)."""
    named = vocab.select("token_id", "token").limit(NAMES + 1).collect()  # at most NAMES entries
    names: list[str | None] = [None] * (1 + max([0, *(r["token_id"] for r in named if r["token_id"] is not None and r["token_id"] < NAMES)]))
    for r in named:
        if r["token_id"] is not None and 0 <= r["token_id"] < NAMES and r["token"] is not None and names[r["token_id"]] is None:
            names[r["token_id"]] = r["token"]
    if sum(x is not None for x in names) == len(named):  # every entry has its own place
        table = F.from_json(F.lit(json.dumps(names)), "array<string>")
        found = F.array_compact(F.transform("ids", lambda i: F.get(table, i)))
        return rows.select(key, F.explode(F.filter(F.array(found), lambda x: F.size(x) > 0)).alias("tokens"))  # a filter would compute them twice
    flat = rows.select(key, F.posexplode("ids").alias("pos", "token_id")).join(sent(vocab, BROADCAST), "token_id")
    return flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))  # one text


# -- byte pairs -----------------------------------------------------------------


_pieces = regex.compile(SPLIT_PATTERN).findall


def chunk_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """chunk, n: split pieces of all texts with their counts; every task sums its own."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["chunk", "n"])

        for batch in batches:
            for t in batch.column(text).to_pylist():
                seen.update(_pieces(t or ""))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select(text).mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def _merged(ids: list[int], pair: tuple[int, int], new: int) -> list[int]:
    """The ids with every occurrence of a pair, from the left, replaced."""
    out, i, n = [], 0, len(ids)
    while i < n:
        if i + 1 < n and ids[i] == pair[0] and ids[i + 1] == pair[1]:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


class _Chunks:
    """All chunks in one linked list: ids with -1 between chunks and -2 where an id was
    merged away, the places before and after, and the count of the chunk at each place."""

    def __init__(self, counts: list[tuple[bytes, int]], kind: type = np.uint8) -> None:
        size = np.fromiter((len(c) // np.dtype(kind).itemsize + 1 for c, _ in counts), np.int64, len(counts))
        self.ids = np.full(int(size.sum()) + 1, -1, np.int32)
        inside = np.ones(len(self.ids), bool)
        inside[np.concatenate([[0], np.cumsum(size)])] = False
        self.ids[inside] = np.frombuffer(b"".join(c for c, _ in counts), kind)
        self.weight = np.concatenate([[0], np.repeat(np.fromiter((n for _, n in counts), np.int64, len(counts)), size)])
        self.after, self.before = np.arange(1, len(self.ids) + 1), np.arange(-1, len(self.ids) - 1)
        self.after[-1], self.before[0] = len(self.ids) - 1, 0

    def pairs(self, at: np.ndarray) -> dict[tuple[int, int], int]:
        """Summed counts of the pairs that start at some places."""
        a, b = self.ids[at], self.ids[self.after[at]]
        fine = (a >= 0) & (b >= 0)
        key, of = np.unique((a[fine].astype(np.int64) << 32) | b[fine], return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, of, self.weight[at[fine]])
        return dict(zip(zip((key >> 32).tolist(), (key & 0xFFFFFFFF).tolist()), total.tolist()))

    def merge(self, pair: tuple[int, int], new: int) -> tuple[dict, dict]:
        """Replace a pair, from the left; the counts of pairs that go and that come."""
        at = np.flatnonzero(self.ids == pair[0])
        at = at[self.ids[self.after[at]] == pair[1]]
        if pair[0] == pair[1] and len(at):  # of a run of equal ids every second one
            order = np.arange(len(at))
            starts = np.concatenate([[True], at[1:] != self.after[at[:-1]]])
            at = at[(order - np.maximum.accumulate(np.where(starts, order, 0))) % 2 == 0]
        second = self.after[at]
        gone = self.pairs(np.unique(np.concatenate([self.before[at], at, second])))
        follow = self.after[second]
        self.ids[at], self.ids[second] = new, -2
        self.after[at] = follow
        self.before[follow] = at
        return gone, self.pairs(np.unique(np.concatenate([self.before[at], at])))


def learn_merges(counts: list[tuple[bytes, int]], n_merges: int, kind: type = np.uint8, known: list[tuple[int, int]] = [], least: int = 1) -> list[tuple[int, int]]:
    """The most frequent pair first, the smallest pair on ties: a heap of counts, of which
    outdated ones are put right when they come up; a merge changes the counts of the
    pairs at its own places only. Goes on after the `known` merges if the chunks hold ids
    of `kind` after these, and ends before a pair of fewer than `least`."""
    chunks = _Chunks(counts, kind)
    pairs: Counter = Counter(chunks.pairs(np.arange(len(chunks.ids))))
    heap = [(-n, p) for p, n in pairs.items()]
    heapify(heap)
    merges = list(known)
    while len(merges) < n_merges and heap:
        n, best = heappop(heap)
        if pairs[best] != -n:
            if pairs[best] > 0:
                heappush(heap, (-pairs[best], best))
            continue
        if -n < least:
            break
        gone, come = chunks.merge(best, BASE + len(merges))
        merges.append(best)
        for p, m in gone.items():
            pairs[p] -= m
        for p, m in come.items():
            pairs[p] += m
            heappush(heap, (-pairs[p], p))
        del pairs[best]
    return merges


class _Segments:
    """The segments of an Arrow batch (ids packed in bytes, n) end to end: the id at each
    place, whether a segment ends there, and the count of its segment."""

    def __init__(self, batch: pa.RecordBatch, kind: type) -> None:
        packed = batch.column("ids").to_pylist()
        size = np.fromiter((len(x) for x in packed), np.int64, len(packed)) // np.dtype(kind).itemsize
        self.kind, self.ids = kind, np.frombuffer(b"".join(packed), kind).astype(np.int64)
        self.end = np.zeros(len(self.ids), bool)
        self.end[np.cumsum(size)[size > 0] - 1] = True
        self.n = np.repeat(batch.column("n").to_numpy(), size)

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys (first id times `width`, plus the second) and counts of the pairs."""
        inside = ~self.end[:-1]
        key, of = np.unique((self.ids[:-1] * width + self.ids[1:])[inside], return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, of, self.n[:-1][inside])
        return key, total

    def keep(self, at: np.ndarray) -> None:
        self.ids, self.end, self.n = self.ids[at], self.end[at], self.n[at]

    def merge(self, group: list[tuple[tuple[int, int], int]], width: int) -> None:
        """Replace pairs that share no id, from the left."""
        partner, code = np.full(width, -1), np.zeros(width, np.int64)
        for (a, b), new in group:
            partner[a], code[a] = b, new
        at = np.flatnonzero((partner[self.ids[:-1]] == self.ids[1:]) & ~self.end[:-1])
        if len(at):  # neighbours are in a run of equal ids, of which every second one counts
            order = np.arange(len(at))
            starts = np.concatenate([[True], at[1:] != at[:-1] + 1])
            at = at[(order - np.maximum.accumulate(np.where(starts, order, 0))) % 2 == 0]
        self.ids[at] = code[self.ids[at]]
        self.end[at] = self.end[at + 1]
        stay = np.ones(len(self.ids), bool)
        stay[at + 1] = False
        self.keep(stay)

    def part(self, alive: np.ndarray, below: int, width: int) -> None:
        """End segments between ids whose pair is not `alive`, unless an id is new (not
        `below`); segments of one id go."""
        a, b = self.ids[:-1], self.ids[1:]
        self.end[:-1] |= ~((a >= below) | (b >= below) | np.isin(a * width + b, alive))
        self.keep(~(self.end & np.concatenate([[True], self.end[:-1]])) if len(self.ids) else self.end)

    def batch(self) -> pa.RecordBatch:
        ends = np.flatnonzero(self.end) + 1
        offsets = np.concatenate([[0], ends * np.dtype(self.kind).itemsize]).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.ids.astype(self.kind).tobytes())])
        return pa.RecordBatch.from_arrays([packed, pa.array(self.n[ends - 1], pa.int64())], names=["ids", "n"])


def learn_merges_apart(counts: DataFrame, n_merges: int, batch: int = 1 << 16, driver_chunks: int = 0) -> list[tuple[int, int]]:
    """The same merges where the table of chunks (chunk, n) is too large for the driver.

    Pairs are counted in Spark, and each round takes all merges that are certain. The next
    pair in order is certain if it shares no id with those taken before it in the round
    and is more frequent than any pair that a new id could form, which is bounded by the
    pairs that follow or precede the merged ones.

    No pair becomes more frequent, nor do the pairs that its ids form with others later. So
    chunks are parted at pairs of fewer than `least`, equal segments become one, and
    what is left soon fits on the driver. `least` is half the count of the pair in place
    `n_merges`; only if merges of fewer are wanted in the end, it is lowered, and the work
    goes on from the whole chunks."""
    width, kind = BASE + n_merges, np.uint16 if BASE + n_merges <= 1 << 16 else np.int32

    def pack(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer((c or "").encode(), np.uint8).astype(kind).tobytes() for c in x.column("chunk").to_pylist()], pa.binary()), x.column("n")], names=["ids", "n"])

    def count(batches):
        seen: Counter = Counter()
        for x in batches:
            key, n = _Segments(x, kind).pairs(width)
            for k, m in zip(key.tolist(), n.tolist()):
                seen[k] += m
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["key", "n"])

    def merged(table: DataFrame, groups: list, alive: np.ndarray | None, below: int) -> DataFrame:
        def run(batches):
            for x in batches:
                segments = _Segments(x, kind)
                for group in groups:
                    segments.merge(group, width)
                if alive is not None:
                    segments.part(alive, below, width)
                yield segments.batch()

        return cut(table.mapInArrow(run, "ids binary, n long").groupBy("ids").agg(F.sum("n").alias("n")))

    whole = counts.where("chunk <> ''").select("chunk", "n").mapInArrow(pack, "ids binary, n long")
    table, merges, least = whole, [], 0
    while len(merges) < n_merges:
        pairs = table.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        top = [(divmod(r["key"], width), r["n"]) for r in pairs.where(F.col("n") >= max(least, 1)).orderBy(F.desc("n"), "key").limit(batch).collect()]
        if not least:
            least = max(1, top[n_merges - 1][1] // 2) if len(top) >= n_merges else 1
        full = len(top) < batch or top[-1][1] < least
        top = [(p, n) for p, n in top if n >= least]
        taken: list[tuple[int, int]] = []
        used: set[int] = set()
        bound = -1
        for p, n in top[: n_merges - len(merges)]:
            if used & set(p) or n <= bound:
                break
            taken.append(p)
            used |= set(p)
            near = [m for q, m in top if q[0] == p[1] or q[1] == p[0]]
            bound = max([bound, *near, least - 1 if full else top[-1][1]])
        if taken:
            below = BASE + len(merges)
            merges += taken
            alive = np.array([a * width + b for (a, b), _ in top]) if full else None
            table = merged(table, [[(p, below + i) for i, p in enumerate(taken)]], alive, below)
            if len(merges) < n_merges and table.count() <= driver_chunks:
                found = table.toArrow()
                merges = learn_merges(list(zip(found.column("ids").to_pylist(), found.column("n").to_pylist())), n_merges, kind, merges, least)
                taken = []
        if not taken and len(merges) < n_merges:
            if least == 1:
                break
            least = max(1, least // 8)
            table = merged(whole, [[(p, BASE + i)] for i, p in enumerate(merges)], None, 0)
    return merges


def train(docs: DataFrame, n_merges: int, text: str = "text", driver_chunks: int = DRIVER_CHUNKS) -> list[tuple[int, int]]:
    """Merges of a byte-pair tokenizer over all chunks. A table of at most `driver_chunks`
    distinct chunks is merged on the driver, a larger one in Spark until what can still be
    merged is as small, with the same result."""
    table = cut(chunk_counts(docs, text))
    if table.count() > driver_chunks:
        return learn_merges_apart(table, n_merges, driver_chunks=driver_chunks)
    found = table.toArrow()
    return learn_merges([(c.encode(), n) for c, n in zip(found.column("chunk").to_pylist(), found.column("n").to_pylist())], n_merges)


def vocabulary(merges: list[tuple[int, int]]) -> list[bytes]:
    tokens = [bytes([b]) for b in range(BASE)]
    for a, b in merges:
        tokens.append(tokens[a] + tokens[b])
    return tokens


def _merge_all(chunk: bytes, rank: dict[tuple[int, int], int]) -> list[int]:
    """The ids of a chunk after all merges, the earliest first."""
    ids = list(chunk)
    while len(ids) > 1:
        new, pair = min((rank.get(p, 1 << 60), p) for p in zip(ids, ids[1:]))
        if new == 1 << 60:
            break
        ids = _merged(ids, pair, new)
    return ids


def encode(docs: DataFrame, merges: list[tuple[int, int]], key: str = "doc_id", text: str = "text", bos: bool = False) -> DataFrame:
    """key, ids: the text's pieces merged in training order; never parses specials."""
    rank = {p: BASE + i for i, p in enumerate(merges)}
    head = [BASE + len(merges)] if bos else []

    def run(batches):
        cache: dict[str, list[int]] = {}
        for batch in batches:
            values, ends = [], [0]
            for t in batch.column(text).to_pylist():
                values += head
                for p in _pieces(t or ""):
                    ids = cache.get(p)
                    if ids is None:
                        if len(cache) > CACHE:
                            cache.clear()
                        ids = cache[p] = _merge_all(p.encode(), rank)
                    values += ids
                ends.append(len(values))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def side_by_side(docs: DataFrame, by: str, encoders: dict, text: str = "text") -> DataFrame:
    """by, encoder, bytes, tokens, ratio: how well several tokenizers compress the texts of
    each value of `by`. An encoder is a function without arguments that each worker calls
    once; it gives a function from a text to its number of tokens."""

    def run(batches):
        built = {name: make() for name, make in encoders.items()}
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for k, t in zip(batch.column(by).to_pylist(), batch.column(text).to_pylist()):
                for name, size in built.items():
                    total = sums.setdefault((k, name), [0, 0])
                    total[0] += len((t or "").encode())
                    total[1] += size(t or "")
            kind = batch.schema.field(by).type
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], kind), pa.array([n for _, n in sums], pa.string()), pa.array([x for x, _ in sums.values()], pa.int64()), pa.array([x for _, x in sums.values()], pa.int64())], names=[by, "encoder", "bytes", "tokens"])

    kind = docs.schema[by].dataType.simpleString()
    sums = docs.select(by, text).mapInArrow(run, f"{by} {kind}, encoder string, bytes long, tokens long").groupBy(by, "encoder").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"))
    return sums.withColumn("ratio", F.round(F.col("bytes") / F.col("tokens"), 6))


def piece_counter(merges: list[tuple[int, int]]):
    """An encoder for `side_by_side` from merges: pieces are merged and counted."""
    rank = {p: BASE + i for i, p in enumerate(merges)}

    def make():
        sizes: dict[str, int] = {}

        def size(text: str) -> int:
            total = 0
            for p in _pieces(text):
                n = sizes.get(p)
                if n is None:
                    if len(sizes) > CACHE:
                        sizes.clear()
                    n = sizes[p] = len(_merge_all(p.encode(), rank))
                total += n
            return total

        return size

    return make


def rank_counter(path: str, pattern: str):
    """An encoder for `side_by_side` from a public file of ranks, by its own library."""

    def make():
        import base64

        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        known = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(known.encode_ordinary(text))

    return make


def decode(rows: DataFrame, merges: list[tuple[int, int]], key: str = "doc_id") -> DataFrame:
    tokens = vocabulary(merges) + [s.encode() for s in SPECIALS]

    def run(batches):
        for batch in batches:
            texts = [b"".join(tokens[i] for i in ids or ()).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")
