"""Removal of long repeats with run-compressed Burrows-Wheeler indexes.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller
id, or same document and earlier start). Equal strings must meet, so every window of
LENGTH bytes is assigned to the least hash of its grams (its minimizer); neighbouring
windows with the same minimizer form a segment. Then

1. segments of one minimizer with the same bytes (a 128-bit cryptographic digest of
   them) are merged: all but the earliest are repeats as a whole. Each batch merges its
   own copies before the shuffle, so a common passage sends one row a batch;
2. where a minimizer has different segments, or occurs twice in a segment (periodic
   text), the texts of the segments are indexed together: a suffix order gives the
   Burrows-Wheeler transform, of which the runs and the suffixes at the ends of the runs
   are kept, nothing else. Between two such samples a text position and the suffix
   before it in suffix order move on together, so both that neighbour and the match with
   it (the matching statistic) are measured at the samples and streamed along the text.
   Neighbours that share LENGTH bytes chain up; all but the earliest place of a chain are
   marked;
3. a minimizer of more than BUCKET bytes, or one that a sample of documents shows to be
   common, is dealt by the digests of its single windows, the longest grams there are:
   strings of one such bucket are equal, so nothing is left to index, and the work is
   linear however many documents share a passage. The sample only chooses this route;
   the marks are the same on both.

Defined cases: null text is empty; texts shorter than LENGTH bytes keep everything;
null ids come after all others; rows that share an id count as one document and get
each other's spans, clipped to their length; extra columns are kept by
`remove_repeats`, whatever their names, and ignored elsewhere; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Bytes of a gram, text bytes of an index bucket, slots of the document filter.
GRAM, BUCKET, SLOTS = 32, 1 << 18, 1 << 20
#: Documents of the sample that looks for common minimizers, and the share of it that
#: makes one common. Both decide the route only, not the result.
SAMPLE, COMMON = 4096, 0.005
LAST = 2**63 - 1


# -- segments -----------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes at each position, by doubling."""
    p = 0x9E3779B97F4A7C15 | 1
    h, width, parts = data.astype(np.uint64) + np.uint64(1), 1, []
    out, done = None, 0
    for bit in range(gram.bit_length()):
        if gram >> bit & 1:
            parts.append((h, width))
        if 2 * width <= gram:
            h = h[: len(h) - width] * np.uint64(pow(p, width, 1 << 64)) + h[width:]
        width *= 2
    n = len(data) - gram + 1
    for h, width in reversed(parts):
        piece = h[done : done + n]
        out = piece.copy() if out is None else out * np.uint64(pow(p, width, 1 << 64)) + piece
        done += width
    return common.mix64(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by doubling."""
    n, step, target = len(x), 1, len(x) - width + 1
    while 2 * step <= width:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    return np.minimum(x[:target], x[width - step : width - step + target]) if n >= width else x[:0]


def segments(texts: list[bytes], length: int, gram: int = GRAM):
    """(text index, first window, windows, minimizer, whether the minimizer occurs more
    than once in it) of all segments."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    start = np.cumsum(size) - size
    grams = gram_hashes(data, gram)
    least = sliding_min(grams, length - gram + 1)
    valid = np.zeros(len(data) + 1, np.int32)
    long = size >= length
    np.add.at(valid, start[long], 1)
    np.add.at(valid, (start + size - length + 1)[long], -1)
    valid = np.cumsum(valid)[: len(least)] > 0
    new = np.concatenate([[True], least[1:] != least[:-1]])
    new[start[long]] = True
    new[1:] |= valid[1:] != valid[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(least)))
    keep = valid[first]
    first, count = first[keep], count[keep]
    of = np.searchsorted(start, first, side="right") - 1
    while len(of) and (bad := size[of] == 0).any():  # empty texts share a start with the next
        of[bad] -= 1
    # places of minimizers: grams that are the least of some window; close equal ones
    width = length - gram + 1
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = np.where(valid, least, np.uint64(0))
    place = np.flatnonzero(~sliding_min(~padded, width) == grams)
    value = grams[place]
    order = np.argsort(value, kind="stable")
    pair = np.flatnonzero(value[order][1:] == value[order][:-1])
    twice = np.zeros(len(first), bool)
    if len(pair) and len(first):
        distance, value = place[order][pair + 1] - place[order][pair], value[order][pair]
        known, at = np.unique(value, return_index=True)
        closest = np.minimum.reduceat(distance, at)
        at = np.minimum(np.searchsorted(known, least[first]), len(known) - 1)
        twice = (known[at] == least[first]) & (closest[at] < count + width - 1)
    return of, first - start[of], count, least[first], twice


def _digests(texts: list[bytes], of: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128-bit digests of the bytes first .. first + size of text `of`, (n, 2)."""
    views = [memoryview(t) for t in texts]
    spans = zip(of.tolist(), first.tolist(), (first + size).tolist())
    found = b"".join([hashlib.blake2b(views[t][a:b], digest_size=16).digest() for t, a, b in spans])
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def _windows(of, first, count):
    """The single windows of segments: (index of the segment, first byte)."""
    which = np.repeat(np.arange(len(of)), count)
    return which, np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


SEGMENT = "copy boolean, m long, g long, h long, id long, s int, n int, twice boolean"


def _packed(ids, s, n, m, g, t) -> pa.RecordBatch:
    """Rows of SEGMENT; all but the earliest of equal segments are copies, which are
    spread over all partitions; the same place of a repeated row counts once."""
    order = np.lexsort((s, ids, g[:, 1], g[:, 0], m))
    ids, s, n, m, g, t = (x[order] for x in (ids, s, n, m, g, t))
    again = np.zeros(len(m), bool)
    again[1:] = (m[1:] == m[:-1]) & (g[1:] == g[:-1]).all(1)
    same = np.zeros(len(m), bool)
    same[1:] = again[1:] & (ids[1:] == ids[:-1]) & (s[1:] == s[:-1])
    m = np.where(again, common.mix64(ids.astype(np.uint64) + common.mix64(s.astype(np.uint64))), m)
    k = ~same
    columns = [pa.array(again[k]), pa.array(m[k].view(np.int64)), pa.array(g[k, 0]), pa.array(g[k, 1]), pa.array(ids[k]), pa.array(s[k].astype(np.int32)), pa.array(n[k].astype(np.int32)), pa.array(t[k])]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SEGMENT.split(", ")])


def _segment_rows(docs: DataFrame, length: int, gram: int, hot: np.ndarray) -> DataFrame:
    """A row of each segment, or of each window of a segment with a `hot` minimizer;
    `copy` for all but the earliest of equal ones of a batch."""

    def run(batches):
        for batch in batches:
            held = []
            for part in common.slices(batch, size=2 << 20):
                own, texts = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64), common.texts_of(part)
                of, first, count, m, t = segments(texts, length, gram)
                g = np.zeros((len(of), 2), np.int64)
                apart = np.isin(m, hot)
                if apart.any():
                    which, s = _windows(of[apart], first[apart], count[apart])
                    w = _digests(texts, of[apart][which], s, np.full(len(s), length))
                    held.append((own[of[apart][which]], s, np.ones(len(s), np.int64), w[:, 0].view(np.uint64), w, np.zeros(len(s), bool)))
                    of, first, count, m, t, g = (x[~apart] for x in (of, first, count, m, t, g))
                if len(of):
                    g = _digests(texts, of, first, count + length - 1)
                    held.append((own[of], first, count, m, g, t))
            if held:
                yield _packed(*(np.concatenate(x) for x in zip(*held)))

    return docs.select(_id().alias("id"), "text").mapInArrow(run, SEGMENT)


def common_minimizers(docs: DataFrame, length: int, gram: int) -> np.ndarray:
    """Minimizers that at least COMMON of about SAMPLE documents hold (chosen by the hash
    of their id): at most the minimizers of SAMPLE documents. They are a choice of route."""
    n = docs.count()
    step = max(1, n // SAMPLE)
    chosen = docs.select(_id().alias("id"), "text").where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, size=2 << 20):
                of, _, _, m, _ = segments(common.texts_of(part), length, gram)
                pair = np.unique(np.stack([of.astype(np.uint64), m], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 1].view(np.int64))], names=["m"])

    held = chosen.mapInArrow(run, "m long").groupBy("m").agg(F.count("*").alias("n"))
    least = max(16, int(COMMON * n / step))
    return np.array([r["m"] for r in held.where(F.col("n") >= least).collect()], np.int64).view(np.uint64)


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


# -- the index of a bucket ----------------------------------------------------


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of several strings.

    heads and lengths are the runs; first and last are the suffixes at the run starts and
    run ends. A string end is a symbol of its own below all bytes. The suffix order is
    there while the runs are cut, and is not kept.
    """

    def __init__(self, strings: list[bytes]) -> None:
        size = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(ends) else 0
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        self.n = n
        self.left = np.repeat(ends - 1, size) - np.arange(n)  # bytes to the end of the string
        self.word = np.where(inside, text - 1, 0).astype(np.uint64)  # eight bytes from each place on
        for width in (1, 2, 4):
            self.word = (self.word << np.uint64(8 * width)) | np.append(self.word[width:], np.zeros(min(width, n), np.uint64))
        suffixes = self._sorted(text)
        before = np.zeros(n, np.int64)
        before[suffixes > 0] = text[suffixes[suffixes > 0] - 1]
        start = np.ones(n, bool)
        start[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        run_start = np.flatnonzero(start)
        self.heads = before[run_start]
        self.lengths = np.diff(np.append(run_start, n))
        self.first = suffixes[run_start]
        self.last = suffixes[run_start + self.lengths - 1]

    def _sorted(self, text: np.ndarray) -> np.ndarray:
        """The suffixes in order, by doubling; equal ones by place."""
        n = self.n
        longest = int(self.left.max()) if n else 0
        # as many symbols as 62 bits hold, renumbered in order; nothing beyond a string's end
        known = np.flatnonzero(np.bincount(text, minlength=257)) if n else np.zeros(1, int)
        bits = max(1, int(len(known)).bit_length())
        step = 62 // bits
        key, width, parts = np.searchsorted(known, text), 1, []
        for bit in range(step.bit_length()):
            if step >> bit & 1:
                parts.append((key, width))
            key, width = (key << width * bits) | self._ahead(key, width), 2 * width
        key, done = np.zeros(n, np.int64), 0
        for part, width in reversed(parts):
            key = (key << width * bits) | (self._ahead(part, done) if done else part)
            done += width
        rank = self._refine(np.zeros(n, np.int64), key, np.arange(n))
        while step <= longest:
            tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
            if not len(tied):
                break
            rank = self._refine(rank, self._ahead(rank + 1, step), tied)
            step *= 2
        return np.argsort(rank, kind="stable")

    def _ahead(self, values: np.ndarray, step: int) -> np.ndarray:
        """The value `step` positions later in the same string, else 0."""
        out = np.zeros(len(values), np.int64)
        out[: max(len(values) - step, 0)] = values[step:]
        out[self.left < step] = 0
        return out

    @staticmethod
    def _refine(rank: np.ndarray, key: np.ndarray, tied: np.ndarray) -> np.ndarray:
        """Split ties by a further key. A rank is the number of smaller suffixes, so only
        the tied suffixes move, inside the places of their group."""
        if len(tied) < len(rank) or rank.any():
            order = np.argsort(rank[tied] << 32 | key[tied])
        else:
            order = np.argsort(key)
        moved = tied[order]
        old, key = rank[moved], key[moved]
        at = np.arange(len(moved))
        group = np.ones(len(moved), bool)
        group[1:] = old[1:] != old[:-1]
        new = group.copy()
        new[1:] |= key[1:] != key[:-1]
        start = np.maximum.accumulate(np.where(group, at, 0))
        out = rank.copy()
        out[moved] = old + np.maximum.accumulate(np.where(new, at, 0)) - start
        return out

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, within their strings."""
        limit = np.minimum(self.left[a], self.left[b])
        length = np.zeros(len(a), np.int64)
        rows = np.flatnonzero(limit)
        while len(rows):
            apart = self.word[a[rows] + length[rows]] ^ self.word[b[rows] + length[rows]]
            length[rows] += sum((apart < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(8))
            rows = rows[(apart == 0) & (length[rows] < limit[rows])]
        return np.minimum(length, limit)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of the suffix before it in suffix order, match with it) of each place:
        measured at the run starts against the ends of the runs before, and streamed."""
        places, ends = self.first[1:], self.last[:-1]
        match = np.zeros(self.n, np.int64)
        match[places] = self.common_prefix(places, ends)
        other = np.arange(self.n)
        other[places] = ends
        sampled = np.zeros(self.n, bool)
        sampled[self.first] = True
        origin = np.maximum.accumulate(np.where(sampled, np.arange(self.n), 0))
        moved = np.arange(self.n) - origin
        return other[origin] + moved, np.maximum(match[origin] - moved, 0)

    def repeats(self, length: int) -> np.ndarray:
        """Places whose `length` bytes also start at a smaller place."""
        other, match = self.neighbours()
        at = np.arange(self.n)
        root = np.where(match >= length, other, at)
        while (root != root[root]).any():  # to the first of the chain in suffix order
            root = root[root]
        earliest = at.copy()
        earliest[root[::-1]] = at[::-1]
        return earliest[root] != at


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def index_bucket(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """id, a, b: byte spans of the repeats inside one bucket of segments."""
    pdf = pdf.sort_values(["id", "s"], kind="stable").drop_duplicates(["id", "s"])
    index = RunIndex(pdf["seg"].tolist())
    marks = index.repeats(length)
    size = pdf["seg"].map(len).to_numpy(np.int64) + 1
    start = np.cumsum(size) - size
    a, b = _spans(marks)
    of = np.searchsorted(start, a, side="right") - 1
    base = pdf["s"].to_numpy(np.int64)[of] - start[of]
    return pd.DataFrame({"id": pdf["id"].to_numpy(np.int64)[of], "a": a + base, "b": b + base + length - 1})


# -- operator -----------------------------------------------------------------


def _slot(col: str):
    return F.pmod(F.xxhash64(col), F.lit(SLOTS))


def repeat_spans(docs: DataFrame, length: int = 100, gram: int = GRAM) -> DataFrame:
    """id, a, b: byte spans (start, end) to remove; they may overlap."""
    rows = _segment_rows(docs, length, gram, common_minimizers(docs, length, gram)).repartition("m")
    own = W.partitionBy("copy", "m")
    rows = rows.withColumn("k", F.rank().over(W.partitionBy("copy", "m", "g", "h").orderBy("id", "s")))  # a repeated row ties with itself
    rows = rows.withColumn("mixed", (F.min("g").over(own) != F.max("g").over(own)) | (F.min("h").over(own) != F.max("h").over(own)) | F.col("twice"))
    settled = F.col("copy") | (F.col("k") > 1)
    marks = rows.where(settled | F.col("mixed")).select("m", "id", "s", "n", settled.alias("settled"))
    marks = common.materialize(common.merged(marks, docs=docs), "suffix-marks")
    whole = marks.where("settled").select("id", F.col("s").cast("long").alias("a"), (F.col("s") + F.col("n") + F.lit(length - 1)).cast("long").alias("b"))
    open_ = marks.where("not settled").select("m", "id", "s", "n")
    total = open_.agg(F.sum(F.col("n") + F.lit(length - 1)).alias("b")).first()["b"] or 0
    buckets = max(1, -(-total // BUCKET))
    large = open_.groupBy("m").agg(F.sum(F.col("n") + F.lit(length - 1)).alias("bytes")).where(F.col("bytes") > BUCKET).select("m", F.lit(True).alias("large"))
    marked = open_.join(large, "m", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    by_doc = marked.groupBy("id").agg(F.collect_list(F.struct("m", "s", "n", "large")).alias("segs"))  # bounded by the text
    slots = F.broadcast(by_doc.select(_slot("id").alias("slot")).distinct())  # at most SLOTS rows
    texts = docs.select(_id().alias("id"), "text").withColumn("slot", _slot("id")).join(slots, "slot", "left_semi").drop("slot")

    def cut(batches):
        for batch in batches:
            for part in common.slices(batch, size=2 << 20):
                m, ids, s, large, seg = [], [], [], [], []
                for i, text, segs in zip(part.column("id").to_pylist(), common.texts_of(part), part.column("segs").to_pylist()):
                    for x in segs:
                        m.append(x["m"])
                        ids.append(i)
                        s.append(x["s"])
                        large.append(x["large"])
                        seg.append(text[x["s"] : x["s"] + x["n"] + length - 1])
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(ids, pa.int64()), pa.array(s, pa.int32()), pa.array(large, pa.bool_()), pa.array(seg, pa.binary())], names=["m", "id", "s", "large", "seg"])

    pieces = texts.join(by_doc, "id").mapInArrow(cut, "m long, id long, s int, large boolean, seg binary")
    pieces = common.materialize(common.merged(pieces, docs=docs), "suffix-pieces")

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        return index_bucket(pdf, length)

    indexed = pieces.where("not large").select(F.pmod(F.xxhash64("m"), F.lit(buckets)).alias("bucket"), "id", "s", "seg").groupBy("bucket").applyInPandas(index, "id long, a long, b long")

    def windows(batches):
        """The windows of the segments of large minimizers."""
        for batch in batches:
            for part in common.slices(batch, "seg", size=1 << 20):
                texts, own = common.texts_of(part, "seg"), part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                at = part.column("s").to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.arange(len(texts))
                which, s = _windows(of, np.zeros(len(texts), np.int64), np.fromiter((max(len(t) - length + 1, 0) for t in texts), np.int64, len(texts)))
                g = _digests(texts, which, s, np.full(len(s), length))
                yield _packed(own[which], s + at[which], np.ones(len(s), np.int64), g[:, 0].view(np.uint64), g, np.zeros(len(s), bool))

    single = pieces.where("large").mapInArrow(windows, SEGMENT).repartition("m").withColumn("k", F.rank().over(W.partitionBy("copy", "m", "g", "h").orderBy("id", "s")))
    single = single.where("copy or k > 1").select("id", F.col("s").cast("long").alias("a"), (F.col("s") + F.lit(length)).cast("long").alias("b"))
    return whole.unionByName(indexed).unionByName(single)


def _merge(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal removed runs of a text of `size` bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], min(x["b"], size)) for x in spans or ()):
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def with_spans(docs: DataFrame, spans: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Documents that may have spans, joined with their `__spans` (array), and the others.
    Only the first part is shuffled; a bounded table of id slots tells them apart."""
    by_doc = spans.groupBy("id").agg(F.collect_set(F.struct("a", "b")).alias("__spans"))  # bounded by the text
    by_doc = common.materialize(common.merged(by_doc, docs=docs), "suffix-spans")
    slots = F.broadcast(by_doc.select(_slot("id").alias("slot")).distinct())  # at most SLOTS rows
    slots = slots.withColumnRenamed("slot", "__slot")
    keyed = docs.select(*columns, _id().alias("__id")).withColumn("__slot", _slot("__id"))
    touched = keyed.join(slots, "__slot", "left_semi").join(by_doc.withColumnRenamed("id", "__id"), "__id", "left").select(*columns, "__spans")
    return touched, keyed.join(slots, "__slot", "left_anti").select(*columns)


def dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                out = []
                spans = part.column("__spans").to_pylist() if "__spans" in part.schema.names else [None] * part.num_rows
                for text, own in zip(common.texts_of(part), spans):
                    runs = _merge(own, len(text))
                    out.append((len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(text, runs)).hexdigest()))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    touched, others = with_spans(docs, repeat_spans(docs, length), ["doc_id", "text"])
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return touched.mapInArrow(run, schema).unionByName(others.mapInArrow(run, schema))


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """The same documents without the repeats; parts of a character that a cut leaves
    behind are dropped. All columns stay; n_chars, if there, is counted anew."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                texts = [None if t is None else _kept(b := t.encode(), _merge(own, len(b))).decode("utf-8", "ignore") for t, own in zip(part.column("text").to_pylist(), part.column("__spans").to_pylist())]
                part = part.drop_columns(["__spans"])
                yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    touched, others = with_spans(docs, repeat_spans(docs, length), docs.columns)
    out = touched.mapInArrow(run, docs.schema).unionByName(others)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM f),
r AS (SELECT doc_id, n, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM g) GROUP BY doc_id, n),
e AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM r),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
