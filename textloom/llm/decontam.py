"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units after a number, and names (capitalised
words inside a sentence) turn into typed placeholders, all else into lower-case words
without outer punctuation (case is folded fully). Windows of WINDOW template tokens of all benchmark items are
hash-joined with the windows of every whole document. Matching windows of one item on
one diagonal are a chain; a chain counts if the slot values of the item map to the
document's consistently (one value to one value, by type), which a re-parameterised
question does and an accidental template match does not.

Names depend on letter case, so windows with names are looked up a second time with their
names as folded words: a copy in capitals, lower or title case meets the item that way.

Windows of the benchmark are a table; its hashes set bits of a bitmap of fixed size, the
only thing sent to all executors. Windows of the documents that hit a bit are joined with
the table by hash, in one pass over the documents, whatever the benchmark's size. Items
of one template (equal template tokens, equal slot values in the same places) form a
class, of which the item with the smallest id is searched: results name that item and the
size of its class, `item_classes` lists the members.

Defined cases: null and empty texts, and items without a word, match nothing; an item
shorter than the window is one window of its whole length; windows with fewer literal
words than placeholders say nothing as templates: an item that has no other windows, or
fewer than MIN_WORDS words, is searched by exact windows of its folded words instead (one
of one or two words only where it fills a line); repeated rows are reported row by row;
rows without an id are reported with a null id; null item ids are ignored; extra columns
are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of a window and of the shortest item; share of the item's windows, or run of
#: windows, that contaminates; share of slots that must be consistent.
WINDOW, MIN_WORDS, COVERAGE, RUN, CONSISTENT = 8, 4, 0.4, 13, 0.75
#: Fewest words of an item that is searched inside lines.
INSIDE = 3
#: Bits of the bitmap of window hashes; candidate rows of a check; entries of a worker's word cache.
SLOTS, CHECKED, CACHE = 1 << 22, 50_000, 300_000

# Fixed words of the slot types.
UNITS = "m cm mm km kg g mg l ml lb lbs oz ft in mi mph s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years mile miles meter meters metre metres litre litres liter liters gram grams kilogram kilograms kilometer kilometers kilometre kilometres inch inches foot feet dollar dollars euro euros cent cents percent degrees".split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()

LITERAL, NUMBER, UNIT, NAME = range(4)
_MARK = np.array([0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_OUTER = b".,;:!?\"'()[]{}<>*#$%&|-_"
_NUMBER = re.compile(rb"[-+]?\d[\d.,:/]*(?:st|nd|rd|th)?\Z")
_QUANTITY = re.compile(rb"[-+]?\d[\d.,:/]*([a-z]+)\Z")
_units, _number_words = {u.encode() for u in UNITS}, {w.encode() for w in NUMBER_WORDS}


def _describe(word: bytes) -> tuple[int, int]:
    """(hash of the case-folded core, flags: 1 number, 2 unit word, 4 capitalised, 8 ends a sentence)."""
    core = word.strip(_OUTER)
    low = core.decode("utf-8", "replace").casefold().encode()
    flags = 8 if word.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?", b":") else 0
    quantity = _QUANTITY.match(low)
    if _NUMBER.match(low) or low in _number_words or quantity and quantity[1] in _units:
        flags |= 1
    if low in _units:
        flags |= 2
    head = core[:4].decode("utf-8", "ignore")[:1]
    if head.isupper() and (len(core) == 1 or core != core.upper()):
        flags |= 4
    return xxhash.xxh3_64_intdigest(low), flags


class Canonical:
    """Template tokens of texts, with a bounded word cache."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.hash, self.flags = np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def _lookup(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        new = list({w for w in words if w not in ids})
        if len(ids) + len(new) > CACHE:
            ids.clear()
            self.hash, self.flags = self.hash[:0], self.flags[:0]
            new = list(set(words))
        if new:
            found = [_describe(w) for w in new]
            ids.update(zip(new, range(len(self.hash), len(self.hash) + len(new))))
            self.hash = np.concatenate([self.hash, np.array([f[0] for f in found], np.uint64)])
            self.flags = np.concatenate([self.flags, np.array([f[1] for f in found], np.uint8)])
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(template token, slot type, value, words of a text) of all texts in a row."""
        split = [t.split() for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        at = self._lookup([w for ws in split for w in ws])
        value, flags = self.hash[at], self.flags[at]
        begins = np.zeros(len(at) + 1, bool)
        begins[(np.cumsum(size) - size)] = True
        begins = begins[: len(at)]
        number = flags & 1 > 0
        after = np.zeros(len(at), bool)
        after[1:] = number[:-1]
        opens = begins.copy()
        opens[1:] |= flags[:-1] & 8 > 0
        kind = np.full(len(at), LITERAL, np.uint8)
        kind[(flags & 4 > 0) & ~opens] = NAME
        kind[(flags & 2 > 0) & after & ~begins] = UNIT
        kind[number] = NUMBER
        return np.where(kind == LITERAL, value, _MARK[kind]), kind, value, size


def window_hashes(token: np.ndarray, kind: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, usable) of the window that starts at each token; windows stay inside their
    text and need at least as many literal words as placeholders."""
    n = len(token)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    mixed = common.mix64(token)
    h = np.full(n - width + 1, np.uint64(width))
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mixed[j : n - width + 1 + j]
    ends = np.repeat(np.cumsum(size), size)
    literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    return common.mix64(h), (np.arange(n - width + 1) + width <= ends[: n - width + 1]) & (2 * (literal[width:] - literal[:-width]) >= width)


def plain_hashes(kind: np.ndarray, value: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the usable windows that hold names, with names as words."""
    names = np.concatenate([[0], np.cumsum(kind == NAME)])
    slots = np.concatenate([[0], np.cumsum((kind != LITERAL) & (kind != NAME))])
    ends = np.repeat(np.cumsum(size), size)
    n = max(len(kind) - width + 1, 0)
    at = np.flatnonzero((names[width : n + width] > names[:n]) & (np.arange(n) + width <= ends[:n]) & (2 * (slots[width : n + width] - slots[:n]) <= width))
    mixed = common.mix64(np.where((kind == LITERAL) | (kind == NAME), value, _MARK[kind]))
    h = np.full(len(at), np.uint64(width))
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mixed[at + j]
    return at, common.mix64(h)


def exact_hashes(value: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of all windows inside their texts, by their folded words alone."""
    n = max(len(value) - width + 1, 0)
    at = np.flatnonzero(np.arange(n) + width <= np.repeat(np.cumsum(size), size)[:n])
    h = np.full(n, np.uint64(0xD6E8FEB86659FD93))
    mixed = common.mix64(value)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mixed[j : n + j]
    return at, common.mix64(h[at])


def _line_hash(value: np.ndarray) -> np.ndarray:
    """Hash of an item that has to fill a line."""
    return common.mix64(exact_hashes(value, np.array([len(value)]), len(value))[1] + np.uint64(1))


def item_windows(canon: Canonical, texts: list[bytes], window: int = WINDOW, min_words: int = MIN_WORDS) -> list[tuple[int, str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """(windows, kind of search, places, hashes, kinds, values, class) of each item."""
    token, kind, value, size = canon.tokens(texts)
    out = []
    for a, n in zip(np.cumsum(size) - size, size.tolist()):
        t, k, v, one = token[a : a + n], kind[a : a + n], value[a : a + n], np.array([n])
        width = min(n, window)
        _, first, pattern = np.unique(np.stack([k[k != LITERAL].astype(np.uint64), v[k != LITERAL]], 1), axis=0, return_index=True, return_inverse=True)
        group = xxhash.xxh3_128_digest(t.tobytes() + k.tobytes() + first[pattern.ravel()].astype("<i8").tobytes())
        if not n:
            out.append((0, "none", np.zeros(0, np.int64), np.zeros(0, np.uint64), k, v, group))
            continue
        h, ok = window_hashes(t, k, one, width)
        places = np.flatnonzero(ok)
        if n >= min_words and len(places):
            named, plain = plain_hashes(k, v, one, width)
            out.append((len(places), "template", np.concatenate([places, named[ok[named]]]), np.concatenate([h[places], plain[ok[named]]]), k, v, group))
        elif n >= INSIDE:
            places, h = exact_hashes(v, one, width)
            out.append((len(places), "exact", places, h, k, v, b"exact" + v.tobytes()))
        else:
            out.append((1, "line", np.zeros(1, np.int64), _line_hash(v), k, v, b"line" + v.tobytes()))
    return out


def _cells(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary cells."""
    n, wide = values.shape[0], values.shape[1] * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * wide).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _taken(values: np.ndarray, at: np.ndarray, width: int, window: int) -> np.ndarray:
    """(windows, `window`) values from each start on; zero beyond the width."""
    out = np.zeros((len(at), window), values.dtype)
    out[:, :width] = values[at[:, None] + np.arange(width)]
    return out


ITEMS = "item_id long, class binary, windows int, search string, width int, place int, h long, kinds binary, own binary"


def _item_rows(benchmark: DataFrame, window: int) -> DataFrame:
    """A row of each window of each item; one without a hash for items without a word."""

    def run(batches):
        canon = Canonical()
        for batch in batches:
            for part in common.slices(batch, size=1 << 20):
                for i, (n, search, places, h, kind, value, group) in zip(part.column("item_id").to_pylist(), item_windows(canon, common.texts_of(part), window)):
                    width, r = min(len(kind), window), max(len(places), 1)
                    cells = [pa.array(places, pa.int32()), pa.array(h.view(np.int64)), _cells(_taken(kind, places, width, window)), _cells(_taken(value, places, width, window))] if len(places) else [pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())]
                    head = [pa.array([i] * r, pa.int64()), pa.array([group] * r, pa.binary()), pa.array([n] * r, pa.int32()), pa.array([search] * r, pa.string()), pa.array([width] * r, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*head, *cells], names=[f.split()[0] for f in ITEMS.split(", ")])

    known = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    return known.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, ITEMS)


def item_classes(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, class_item_id: the item that stands for it in results (a repeated id may
    belong to several classes)."""
    items = _item_rows(benchmark, window).select("item_id", "class").distinct()
    least = items.groupBy("class").agg(F.min("item_id").alias("class_item_id"))
    return items.join(least, "class").select("item_id", "class_item_id").distinct()


def _lines(canon: Canonical, texts: list[bytes]):
    """(text, word, hash, values) of the lines that are shorter than INSIDE words."""
    for k, text in enumerate(texts):
        at = 0
        for line in text.split(b"\n"):
            words = line.split()
            if 0 < len(words) < INSIDE:
                value = canon.tokens([line])[2]
                yield k, at, _line_hash(value), value
            at += len(words)


CANDIDATES = "row long, doc_id long, key long, pos int, h long, there binary"


def _candidates(docs: DataFrame, shared, window: int) -> DataFrame:
    """A row of each window of the documents whose hash is in the bitmap."""
    names = [f.split()[0] for f in CANDIDATES.split(", ")]

    def run(batches):
        bits, searches = shared.value
        seen = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
        mask = np.uint64(len(seen) - 1)
        canon = Canonical()
        serial = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in common.slices(batch, size=1 << 20):
                texts = common.texts_of(part)
                token, kind, value, size = canon.tokens(texts)
                start, text_of = np.cumsum(size) - size, np.repeat(np.arange(len(texts)), size)
                found = []
                for search, width in searches:
                    if search == "template":
                        h, ok = window_hashes(token, kind, size, width)
                        at = np.flatnonzero(ok & seen[(h & mask).astype(np.int64)])
                        found.append((at, h[at], width))
                        at, h = plain_hashes(kind, value, size, width)
                    elif search == "exact":
                        at, h = exact_hashes(value, size, width)
                    else:
                        continue
                    hit = seen[(h & mask).astype(np.int64)]
                    found.append((at[hit], h[hit], width))
                cells = [(text_of[at], at - start[text_of[at]], h, _taken(value, at, width, window)) for at, h, width in found]
                if any(search == "line" for search, _ in searches):
                    for k, at, h, own in _lines(canon, texts):
                        cells.append((np.array([k]), np.array([at]), h, _taken(own, np.zeros(1, np.int64), len(own), window)))
                if cells:
                    of, pos, h, there = (np.concatenate(x) for x in zip(*cells))
                    own = part.select(["doc_id", "key"]).take(pa.array(of))
                    yield pa.RecordBatch.from_arrays([pa.array(serial + of), own.column("doc_id").cast(pa.int64()), own.column("key"), pa.array(pos.astype(np.int32)), pa.array(h.view(np.int64)), _cells(there)], names=names)
                serial += part.num_rows

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, CANDIDATES)


def chains(row: np.ndarray, item: np.ndarray, place: np.ndarray, pos: np.ndarray, width: np.ndarray, kinds: np.ndarray, own: np.ndarray, there: np.ndarray, consistent: float = CONSISTENT) -> list[tuple]:
    """(row, item, windows, run, slots, changed slots, first word, last word) of matching
    windows: those of one item on one diagonal of a document are a chain, which counts if
    its slots are consistent."""
    order = np.lexsort((place, pos - place, item, row))
    row, item, place, pos, width, kinds, own, there = (x[order] for x in (row, item, place, pos, width, kinds, own, there))
    key = np.stack([row, item, pos - place], 1)
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])) if len(key) else np.zeros(0, int)
    best: dict[tuple[int, int], list] = {}
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
        w = int(width[a])
        spots = np.unique(place[a:b])  # a window may match both ways
        words, at = np.unique(place[a:b, None] + np.arange(w), return_index=True)
        k, x, y = (z[a:b, :w].ravel()[at] for z in (kinds, own, there))
        slot = k != LITERAL
        pairs = np.stack([k[slot].astype(np.uint64), x[slot], y[slot]], 1)
        if len(pairs) and _consistent(pairs) < consistent * len(pairs):
            continue
        longest = int(np.diff(np.flatnonzero(np.concatenate([[True], np.diff(spots) != 1, [True]]))).max())
        shift = int(pos[a] - place[a])
        found = best.setdefault((int(row[a]), int(item[a])), [set(), 0, 0, 0, 1 << 60, 0])
        found[0].update(spots.tolist())
        found[1] = max(found[1], longest)
        found[2] += len(pairs)
        found[3] += int((pairs[:, 1] != pairs[:, 2]).sum())
        found[4] = min(found[4], shift + int(words[0]))
        found[5] = max(found[5], shift + int(words[-1]))
    return [(r, i, len(spots), *rest) for (r, i), (spots, *rest) in best.items()]


def _consistent(pairs: np.ndarray) -> int:
    """Slots whose item value maps to the commonest document value of that item value,
    with no other item value of the type mapping there."""
    to: dict[tuple[int, int], dict[int, int]] = {}
    for kind, a, b in pairs.tolist():
        to.setdefault((kind, a), {}).setdefault(b, 0)
        to[kind, a][b] += 1
    used: dict[tuple[int, int], int] = {}
    for (kind, _), values in sorted(to.items(), key=lambda x: -max(x[1].values())):
        b, n = max(values.items(), key=lambda x: (x[1], x[0]))
        used[kind, b] = max(used.get((kind, b), 0), n)
    return sum(used.values())


SCHEMA = "doc_id long, item_id long, n_windows long, item_windows long, longest_run long, n_slots long, changed_slots long, first_word long, last_word long"


def _packed(table: pa.Table, name: str, kind, window: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(-1, window)


def _found(docs: DataFrame, benchmark: DataFrame, window: int, coverage: float, run: int, consistent: float) -> DataFrame:
    """SCHEMA, key (of the text) and class_items: matches by row and class of items."""
    spark = docs.sparkSession
    rows = common.materialize(_item_rows(benchmark, window), "decontam-items")
    classes = rows.select("class", "item_id").distinct().groupBy("class").agg(F.min("item_id").alias("item_id"), F.count("*").alias("class_items"))
    items = rows.where("h is not null").join(classes, ["class", "item_id"]).distinct()
    slots = rows.where("h is not null").select(F.expr(f"cast(h & {SLOTS - 1} as int)").alias("slot")).distinct().toArrow()  # at most SLOTS integers
    bits = np.zeros(SLOTS, bool)
    bits[slots.column("slot").to_numpy()] = True
    searches = [(r["search"], r["width"]) for r in rows.where("h is not null").select("search", "width").distinct().collect()]  # at most 2 * WINDOW rows
    shared = spark.sparkContext.broadcast((np.packbits(bits).tobytes(), sorted(searches)))
    met = common.materialize(_candidates(docs, shared, window).join(items, "h"), "decontam-candidates")
    groups = max(1, met.count() // CHECKED)

    def check(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in ("row", "item", "place", "pos", "width")}
        found = chains(*(col[c].astype(np.int64) for c in ("row", "item", "place", "pos", "width")), _packed(table, "kinds", np.uint8, window), _packed(table, "own", np.uint64, window), _packed(table, "there", np.uint64, window), consistent)
        of = {r: k for k, r in enumerate(table.column("row").to_pylist())}
        info = {i: k for k, i in enumerate(table.column("item").to_pylist())}
        kept = []
        for r, i, n, longest, *rest in sorted(found):
            whole = table.column("windows")[info[i]].as_py()
            if n >= coverage * whole or longest >= run:
                kept.append((table.column("doc_id")[of[r]].as_py(), table.column("item_id")[info[i]].as_py(), n, whole, longest, *rest, table.column("key")[of[r]].as_py(), table.column("class_items")[info[i]].as_py()))
        names = [f.split()[0] for f in SCHEMA.split(", ")] + ["key", "class_items"]
        return pa.table([pa.array([x[k] for x in kept], pa.int64()) for k in range(len(names))], names=names)

    met = met.withColumn("item", F.xxhash64("class")).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return met.groupBy("group").applyInArrow(check, f"{SCHEMA}, key long, class_items long")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, run: int = RUN, consistent: float = CONSISTENT) -> DataFrame:
    """A row of each document and class of benchmark items that it holds: item_id is the
    smallest of the class, class_items its size; see `item_classes` for the members."""
    return _found(docs, benchmark, window, coverage, run, consistent).drop("key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns kept. Rows that share an id
    share its fate; rows without an id are known by their text."""
    found = _found(docs, benchmark, WINDOW, COVERAGE, RUN, CONSISTENT).select(F.col("doc_id").alias("__id"), F.when(F.col("doc_id").isNull(), F.col("key")).alias("__key")).distinct()
    found = common.materialize(common.merged(found, docs.count()), "decontam")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__id").isNotNull() | (F.xxhash64("text") == F.col("__key")))
    return docs.join(found, same, "left_anti")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents. Null and empty texts hold none; a row without an id
    is reported with a null id; repeated rows are reported row by row; an empty table gives
    an empty result; other columns are not read."""
    return contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
