"""Language-model scoring by context-tree weighting over bytes.

Counts of all byte strings of DEPTH + 1 bytes are gathered from the whole training
part. Bytes are decomposed into eight binary decisions; for each decision a context
tree over the preceding bytes mixes Krichevsky-Trofimov estimates of all depths, with
the weights that the training counts give. Every context of the training part is a
node, so the tree grows with the input. It is never in one place: contexts of more than
UPPER bytes are dealt into buckets by their nearest bytes, each with whole subtrees;
only the contexts of up to UPPER bytes (at most 65,793 at any size) are on the driver.
Texts are cut into chunks; the distinct strings of a chunk go to the buckets, packed, and
come back with their probabilities. The tree reads texts as they are, in their own letter
case; only the words below are folded. Besides the log-probability there is the code
length it stands for, in bits a byte (the end counts as a byte).

The word model that goes with it (a unigram with additive smoothing) needs the exact
count of every word: counts lie in buckets by the hash of the word, and the distinct
words of a chunk are looked up there the same way.

Defined cases: null and empty texts consist of the end symbol only; repeated rows and
repeated ids are scored row by row; a null id belongs to the training part; without
training rows every count is 0; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Depth of the tree in bytes; depth of the part on the driver.
DEPTH, UPPER = 5, 2
#: Bytes of training text a bucket of the tree, and of text a chunk of documents.
BUCKET, CHUNK = 4 << 20, 32 << 20
#: Bytes of text whose strings are taken together.
SLICE = 1 << 20
#: Marks the start and the end of a text; no byte of UTF-8.
END = b"\xff"
#: Strings or words a worker counts before it hands them on.
FLUSH = 1_000_000


# -- counting -----------------------------------------------------------------


def _codes(texts: list[bytes], depth: int) -> np.ndarray:
    """Each byte and each end with its `depth` preceding symbols, as one integer."""
    data = np.frombuffer(b"".join(END * depth + t + END for t in texts), np.uint8)
    size = np.fromiter((len(t) + 1 + depth for t in texts), np.int64, len(texts))
    starts = np.cumsum(size) - size
    n, code, done, word, width = len(data) - depth, None, 0, data.astype(np.uint64), 1
    for bit in range((depth + 1).bit_length()):  # depth + 1 bytes from each place on, by doubling
        if depth + 1 >> bit & 1:
            part = word[: n + depth + 1 - width]
            code = part if code is None else (code[:n] << np.uint64(8 * width)) | part[done : done + n]
            done += width
        if 2 * width <= depth + 1:
            word = (word[:-width] << np.uint64(8 * width)) | word[width:]
        width *= 2
    code = code[:n]
    inside = np.ones(len(data), bool)
    for k in range(depth):  # strings that end inside the padding
        inside[starts + k] = False
    return code[inside[depth:]]


def _distinct(code: np.ndarray) -> np.ndarray:
    code = np.sort(code)
    return code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code


def _strings(texts: list[bytes], depth: int) -> np.ndarray:
    """The distinct strings of texts, ascending."""
    found, held, size = [np.zeros(0, np.uint64)], [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= 4 * SLICE:
            found.append(_distinct(_codes(held, depth)))
            held, size = [], 0
    return _distinct(np.concatenate([*found, _codes(held, depth)] if held else found))


def _summed(code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        code = np.sort(code)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.array([], int)
        return code[first], np.diff(np.append(first, len(code)))
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.array([], int)
    return code[first], np.add.reduceat(n, first) if len(first) else n


def _dealt(code: np.ndarray, buckets: int, upper: int):
    """(bucket, places) of codes by their upper + 1 nearest context bytes."""
    nearest = (code >> np.uint64(8)) & np.uint64((1 << 8 * (upper + 1)) - 1)
    bucket = (common.mix64(nearest) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    for k in np.unique(bucket).tolist():
        yield k, order[ends[k - 1] if k else 0 : ends[k]]


def count_strings(docs: DataFrame, buckets: int, depth: int = DEPTH) -> DataFrame:
    """bucket, codes, counts: partial counts of all strings of depth + 1 symbols, packed."""
    upper = min(UPPER, depth - 1)

    def out(code, n):
        for k, at in _dealt(code, buckets, upper):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([code[at].tobytes()], pa.binary()), pa.array([n[at].tobytes()], pa.binary())], names=["bucket", "codes", "counts"])

    def run(batches):
        code, n = np.array([], np.uint64), np.array([], np.int64)
        for batch in batches:
            for part in common.slices(batch, size=4 * SLICE):
                more, m = _summed(_codes(common.texts_of(part), depth))
                code, n = _summed(np.concatenate([code, more]), np.concatenate([n, m]))
                if len(code) > FLUSH:
                    yield from out(code, n)
                    code, n = code[:0], n[:0]
        yield from out(code, n)

    return docs.select("text").mapInArrow(run, "bucket int, codes binary, counts binary")


def _words_dealt(words: list[bytes], buckets: int):
    """(bucket, words) of ascending words, by their hash."""
    held: dict[int, list[bytes]] = {}
    for w in words:
        held.setdefault(xxhash.xxh3_64_intdigest(w) % buckets, []).append(w)
    return sorted(held.items())


def count_words(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, words, counts, n, v: one row of each bucket's words (between spaces, as no
    word holds one), ascending, with their occurrences, the sum of these and the words' number."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            for k, words in _words_dealt(list(seen), buckets):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b" ".join(words)], pa.binary()), pa.array([np.fromiter(map(seen.__getitem__, words), np.int64, len(words)).tobytes()], pa.binary())], names=["bucket", "words", "counts"])

        for batch in batches:
            for part in common.slices(batch):
                for text in common.texts_of(part):
                    seen.update(text.lower().split())
                if len(seen) > FLUSH // 2:
                    yield from out()
                    seen.clear()
        yield from out()

    def merge(table: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for words, counts in zip(table.column("words"), table.column("counts")):
            for w, c in zip(words.as_py().split(b" "), np.frombuffer(counts.as_py(), np.int64).tolist()):
                total[w] += c
        words = sorted(total)
        counts = np.fromiter(map(total.__getitem__, words), np.int64, len(words))
        return pa.table([pa.array([table.column("bucket")[0].as_py()], pa.int32()), pa.array([b" ".join(words)], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([int(counts.sum())]), pa.array([len(words)])], names=["bucket", "words", "counts", "n", "v"])

    parts = docs.select("text").mapInArrow(run, "bucket int, words binary, counts binary")
    return parts.groupBy("bucket").applyInArrow(merge, "bucket int, words binary, counts binary, n long, v long")


# -- the tree -----------------------------------------------------------------


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0 by shifted Stirling series."""
    x = np.asarray(x, np.float64)
    shift = np.ones_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift * y, shift)
        y = np.where(low, y + 1, y)
    inv = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + inv * (1 / 12 - inv**2 * (1 / 360 - inv**2 / 1260)) - np.log(shift)


def _gamma_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return lgamma(a + 0.5) + lgamma(b + 0.5) - math.log(math.pi) - lgamma(a + b + 1)


#: The estimate at small counts, as a table.
SMALL = 128
_KT = _gamma_kt(*np.divmod(np.arange(SMALL * SMALL, dtype=np.float64), SMALL))


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    small = (a < SMALL) & (b < SMALL)
    out = _KT[np.where(small, a * SMALL + b, 0).astype(np.int64)]
    out[~small] = _gamma_kt(a[~small], b[~small])
    return out


class Levels:
    """The nodes of some depths by decision. A decision of a context is the string of
    the context and the leading bits of the symbol: at [depth, bits] these are integers,
    ascending."""

    def __init__(self, code: np.ndarray, n: np.ndarray, depths: range) -> None:
        """code: strings with depths[-1] context bytes, ascending, and their counts."""
        self.depths, self.code = depths, code
        self.key, self.zeros, self.ones, self.run = {}, {}, {}, {}
        for d in reversed(depths):
            if d < depths[-1]:
                code, n = _summed(code & np.uint64((1 << 8 * (d + 1)) - 1), n)
            for bits in range(8):
                key = code >> np.uint64(8 - bits)
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.array([], int)
                one = n * ((code >> np.uint64(7 - bits)) & np.uint64(1)).astype(np.int64)
                b = np.add.reduceat(one, first) if len(first) else one
                total = np.add.reduceat(n, first) if len(first) else n
                self.key[d, bits], self.zeros[d, bits], self.ones[d, bits] = key[first], (total - b).astype(np.float64), b.astype(np.float64)
                if d == depths[-1]:
                    self.run[bits] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        self.strings = code, n

    def parents(self, d: int, bits: int) -> np.ndarray:
        """The nodes one byte up, of the nodes at d."""
        return self.key[d, bits] & np.uint64((1 << 8 * (d - 1) + bits) - 1)

    def weigh(self, below: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
        """Bottom-up: the weight of each node's own estimate. `below`: by bits, sums over
        the children of the deepest nodes, else these are leaves. Gives the logarithms of
        the weighted probabilities at the top."""
        self.weight, top = {}, {}
        for bits in range(8):
            log_w = None
            for d in reversed(self.depths):
                own = _log_kt(self.zeros[d, bits], self.ones[d, bits])
                if log_w is None:
                    split = None if below is None else below[bits]
                else:
                    at = np.searchsorted(self.key[d, bits], self.parents(d + 1, bits))
                    split = np.bincount(at, log_w, len(own))
                log_w = own if split is None else np.logaddexp(own, split) - math.log(2)
                self.weight[d, bits] = np.ones(len(own)) if split is None else np.exp(own - math.log(2) - log_w)
            top[bits] = log_w
        return top

    def mix(self, above: Levels | None = None) -> None:
        """Top-down: probability of a one if a node is the last on the path, mass settled
        at the nodes passed, mass left over."""
        self.stop, self.acc, self.rem = {}, {}, {}
        for bits in range(8):
            for d in self.depths:
                source = self if d > self.depths[0] else above
                if source is None:
                    acc, rem = 0.0, 1.0
                else:
                    at = np.searchsorted(source.key[d - 1, bits], self.parents(d, bits))
                    acc, rem = source.acc[d - 1, bits][at], source.rem[d - 1, bits][at]
                a, b, w = self.zeros[d, bits], self.ones[d, bits], self.weight[d, bits]
                kt = (b + 0.5) / (a + b + 1)
                self.stop[d, bits], self.acc[d, bits], self.rem[d, bits] = acc + rem * kt, acc + rem * w * kt, rem * (1 - w)

    def look_up(self, code: np.ndarray, bits: int, one: np.ndarray) -> None:
        """Put the probability of a one at the deepest known node into `one`."""
        for d in self.depths:
            known = self.key[d, bits]
            if len(known):
                key = (code & np.uint64((1 << 8 * (d + 1)) - 1)) >> np.uint64(8 - bits)
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[at] == key
                one[hit] = self.stop[d, bits][at[hit]]


def _code_lengths(code: np.ndarray, one_of) -> np.ndarray:
    """Natural log-probability of the last symbol of strings; `one_of` gives the
    probability of a one at each of its bits."""
    total = np.zeros(len(code))
    for bits in range(8):
        one = np.clip(one_of(bits), 1e-12, 1 - 1e-12)
        total += np.where((code >> np.uint64(7 - bits)) & np.uint64(1) == 1, np.log(one), np.log1p(-one))
    return total


class Answers:
    """Log-probabilities by the mixed nodes of a bucket and the upper ones."""

    def __init__(self, upper: Levels, own: Levels) -> None:
        self.upper, self.own = upper, own
        self.logs = _code_lengths(own.code, lambda bits: own.stop[own.depths[-1], bits][own.run[bits]])

    def __call__(self, code: np.ndarray) -> np.ndarray:
        """Of strings (ascending): those of the training part by their own node, new ones
        by the deepest known node of each decision."""
        known = self.own.code
        at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
        seen = known[at] == code if len(known) else np.zeros(len(code), bool)
        out, new = np.zeros(len(code)), code[~seen]
        out[seen] = self.logs[at[seen]]

        def one_of(bits: int) -> np.ndarray:
            one = np.full(len(new), 0.5)
            self.upper.look_up(new, bits, one)
            self.own.look_up(new, bits, one)
            return one

        if len(new):
            out[~seen] = _code_lengths(new, one_of)
        return out


def _packed(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def fit_buckets(strings: DataFrame, depth: int = DEPTH) -> DataFrame:
    """bucket, codes, counts: one row of each bucket's counts; keys, values: what the upper
    part needs, counts of its strings and sums of weighted log-probabilities by decision."""
    upper = min(UPPER, depth - 1)

    def run(table: pa.Table) -> pa.Table:
        code, n = _summed(_packed(table, "codes", np.uint64), _packed(table, "counts", np.int64))
        own = Levels(code, n, range(upper + 1, depth + 1))
        top = own.weigh()
        short, m = _summed(own.strings[0] & np.uint64((1 << 8 * (upper + 1)) - 1), own.strings[1])
        keys, values = [short | np.uint64(8 << 56)], [m.astype(np.float64)]
        for bits in range(8):
            key, at = np.unique(own.parents(upper + 1, bits), return_inverse=True)
            keys.append(key | np.uint64(bits << 56))
            values.append(np.bincount(at, top[bits], len(key)))
        cells = [code.tobytes(), n.tobytes(), np.concatenate(keys).tobytes(), np.concatenate(values).tobytes()]
        return pa.table([pa.array([table.column("bucket")[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], names=["bucket", "codes", "counts", "keys", "values"])

    return strings.groupBy("bucket").applyInArrow(run, "bucket int, codes binary, counts binary, keys binary, values binary")


def fit_upper(buckets: DataFrame, depth: int = DEPTH) -> Levels:
    """The part of up to UPPER bytes."""

    def run(batches):
        for batch in batches:
            for keys, values in zip(batch.column("keys").to_pylist(), batch.column("values").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(values, np.float64))], names=["k", "x"])

    # at most 256 ** (UPPER + 1) * 2 keys
    found = buckets.select("keys", "values").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toPandas().sort_values("k")
    k, x = found["k"].to_numpy(np.uint64), found["x"].to_numpy(np.float64)
    kind, key = k >> np.uint64(56), k & np.uint64((1 << 56) - 1)
    upper = min(UPPER, depth - 1)
    tree = Levels(key[kind == 8], np.rint(x[kind == 8]).astype(np.int64), range(upper + 1))
    tree.weigh({bits: x[kind == bits] for bits in range(8)})
    tree.mix()
    return tree


def chunked(docs: DataFrame) -> DataFrame:
    """chunk, doc_id, text: rows dealt into chunks of about CHUNK bytes."""

    def run(batches):
        chunk, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for part in common.slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * part.num_rows, pa.int64()), part.column("doc_id").cast(pa.int64()), part.column("text")], names=["chunk", "doc_id", "text"])
                held += sum(map(len, common.texts_of(part)))
                if held >= CHUNK:
                    chunk, held = chunk + 1, 0

    return docs.select("doc_id", "text").mapInArrow(run, "chunk long, doc_id long, text string")


class Contents:
    """The distinct strings and words of a chunk."""

    def __init__(self) -> None:
        self.found: list[np.ndarray] = []
        self.words: set[bytes] = set()

    def add(self, texts: list[bytes], depth: int) -> None:
        self.found.append(_strings(texts, depth))
        if sum(map(len, self.found)) > 4 * FLUSH:
            self.found = [_distinct(np.concatenate(self.found))]
        for text in texts:
            self.words.update(text.lower().split())

    def strings(self) -> np.ndarray:
        return _distinct(np.concatenate(self.found)) if self.found else np.zeros(0, np.uint64)


ASK = "word boolean, bucket int, chunk long, asked binary"
ANSWER = "chunk long, word boolean, bucket int, found binary"


def ask(rows: DataFrame, buckets: int, depth: int = DEPTH) -> DataFrame:
    """ASK: the distinct strings (word is false) and words of each chunk by bucket, packed
    and ascending."""
    low = min(UPPER, depth - 1)
    names = [f.split()[0] for f in ASK.split(", ")]

    def run(batches):
        now, held = None, Contents()

        def out():
            code = held.strings()
            cells = [(False, k, now, code[at].tobytes()) for k, at in _dealt(code, buckets, low)]
            cells += [(True, k, now, b" ".join(words)) for k, words in _words_dealt(sorted(held.words), buckets)]
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], kind) for i, kind in enumerate((pa.bool_(), pa.int32(), pa.int64(), pa.binary()))], names=names)

        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if chunk[a] != now:
                    yield from out()
                    now, held = int(chunk[a]), Contents()
                for part in common.slices(batch.slice(a, b - a), size=4 * SLICE):
                    held.add(common.texts_of(part), depth)
        yield from out()

    return rows.select("chunk", "text").mapInArrow(run, ASK)


def look_up(asked: DataFrame, trees: DataFrame, words: DataFrame, upper: Levels, depth: int = DEPTH) -> DataFrame:
    """ANSWER: of each ASK row, in its order, the log-probabilities of the strings or the
    counts of the words."""
    low = min(UPPER, depth - 1)
    shared = asked.sparkSession.sparkContext.broadcast(upper)

    def told(table: pa.Table, cells: list[bytes]) -> pa.Table:
        return pa.table([table.column("chunk"), table.column("word"), table.column("bucket"), pa.array(cells, pa.binary())], names=["chunk", "word", "bucket", "found"])

    def probabilities(table: pa.Table, tree: pa.Table) -> pa.Table:
        own = Levels(_packed(tree, "known", np.uint64), _packed(tree, "counts", np.int64), range(low + 1, depth + 1))
        own.weigh()
        own.mix(shared.value)
        logs = Answers(shared.value, own)
        return told(table, [logs(np.frombuffer(x.as_py(), np.uint64)).astype(np.float32).tobytes() for x in table.column("asked")])

    def counts(table: pa.Table, known: pa.Table) -> pa.Table:
        count: dict[bytes, int] = {}
        for w, c in zip(known.column("known").to_pylist(), known.column("counts").to_pylist()):
            count.update(zip(w.split(b" "), np.frombuffer(c, np.int64).tolist()))
        return told(table, [np.array([count.get(w, 0) for w in x.as_py().split(b" ")], np.int64).tobytes() for x in table.column("asked")])

    def answer(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return told(table, [])
        return (counts if table.column("word")[0].as_py() else probabilities)(table, known)

    models = trees.select(F.lit(False).alias("word"), "bucket", F.col("codes").alias("known"), "counts")
    models = models.unionByName(words.select(F.lit(True).alias("word"), "bucket", F.col("words").alias("known"), "counts"))
    return asked.groupBy("word", "bucket").cogroup(models.groupBy("word", "bucket")).applyInArrow(answer, ANSWER)


class Table:
    """Values of known strings: two hashed tables of places, then a sorted rest."""

    def __init__(self, code: np.ndarray, value: np.ndarray) -> None:
        self.code, self.value = code, value
        self.shift = np.uint64(62 - max(len(code), 1).bit_length())  # four slots a string or more
        self.places, left = [], np.arange(len(code))
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            place = np.zeros(1 << int(64 - self.shift), np.int32)
            slot = self._slot(code[left], factor)
            place[slot] = left
            left = left[place[slot] != left]
            self.places.append((factor, place))
        self.rest = left

    def _slot(self, code: np.ndarray, factor: int) -> np.ndarray:
        return ((code * np.uint64(factor)) >> self.shift).astype(np.int64)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        """Values of strings that are all known."""
        (factor, place), (factor2, place2) = self.places
        at = place[self._slot(code, factor)]
        miss = np.flatnonzero(self.code[at] != code)
        if len(miss):
            at[miss] = place2[self._slot(code[miss], factor2)]
            miss = miss[self.code[at[miss]] != code[miss]]
            at[miss] = self.rest[np.searchsorted(self.code[self.rest], code[miss])]
        return self.value[at]


# -- scoring ------------------------------------------------------------------


RESULT = "doc_id long, n_bytes long, n_tokens long, n_known long, base_score double, score double"


def _score_rows(end: int, scale: float, depth: int, buckets: int, docs: pa.Table, answers: pa.Table) -> pa.Table:
    """RESULT of the texts of a chunk."""
    held, names = Contents(), [f.split()[0] for f in RESULT.split(", ")]
    for batch in docs.to_batches():
        for part in common.slices(batch, size=4 * SLICE):
            held.add(common.texts_of(part), depth)
    found = {(w, k): x for w, k, x in zip(answers.column("word").to_pylist(), answers.column("bucket").to_pylist(), answers.column("found"))}
    code = held.strings()
    value = np.zeros(len(code), np.float32)
    for k, at in _dealt(code, buckets, min(UPPER, depth - 1)):
        value[at] = np.frombuffer(found[False, k].as_py(), np.float32)
    strings = Table(code, value)
    ids: dict[bytes, int] = {}
    counts = []
    for k, words in _words_dealt(sorted(held.words), buckets):
        ids.update(zip(words, range(len(ids), len(ids) + len(words))))
        counts.append(np.frombuffer(found[True, k].as_py(), np.int64))
    counts = np.concatenate([*counts, [end]])  # the end symbol comes last
    logs = np.log10((counts + 0.1) / scale)
    out = []
    for batch in docs.to_batches():
        for part in common.slices(batch, size=SLICE):
            texts = common.texts_of(part)
            edges = np.concatenate([[0.0], np.cumsum(strings(_codes(texts, depth)).astype(np.float64))])
            scores = np.diff(edges[np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])]) / math.log(10)
            split = [t.lower().split() for t in texts]
            size = np.fromiter((len(w) + 1 for w in split), np.int64, len(split))
            at = np.full(int(size.sum()), len(counts) - 1)
            inside = np.ones(len(at), bool)
            inside[np.cumsum(size) - 1] = False
            at[inside] = [ids[w] for words in split for w in words]
            first = np.cumsum(size) - size
            out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(size), pa.array(np.add.reduceat((counts[at] > 0).astype(np.int64), first)), pa.array(np.add.reduceat(logs[at], first)), pa.array(scores)], names=names))
    return pa.Table.from_batches(out) if out else pa.table([pa.nulls(0, pa.int64())] * 4 + [pa.nulls(0, pa.float64())] * 2, names=names)


def score(docs: DataFrame, train: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every
    row of `docs`, learning from the texts of `train`."""
    held = train.agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n")).first()
    buckets = max(1, -(-(held["size"] or 0) // BUCKET))
    trees = common.materialize(fit_buckets(count_strings(train, buckets, depth), depth), "ctw-trees")
    words = common.materialize(count_words(train, buckets), "ctw-words")
    upper = fit_upper(trees, depth)
    stats, texts = words.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first(), held["n"]
    n, v = (stats["n"] or 0) + texts, (stats["v"] or 0) + (texts > 0)
    rows = common.materialize(chunked(docs), "ctw-rows")
    answers = look_up(ask(rows, buckets, depth), trees, words, upper, depth)
    scale = n + 0.1 * (v + 1)

    def scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
        return _score_rows(texts, scale, depth, buckets, docs, answers)

    found = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, RESULT)
    return found.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / F.lit(math.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document, learning from those whose remainder by 10 is not 0. Null
    texts score as empty ones; a null id is a training row; repeated rows are scored row
    by row; an empty table gives an empty result; other columns are not read."""
    docs = common.documents(spark, sf_dir)
    held = common.is_remainder("doc_id", 10, 0)
    return score(docs, docs.where(~held)).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
