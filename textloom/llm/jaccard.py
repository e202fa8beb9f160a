"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles as 64-bit hashes; equal sets form one
class. Per size band every set gets a parity sketch: each shingle flips one bit of one
of G blocks. A shingle that only one of two sets holds changes one block at most, so the
number of unequal blocks, and the Hamming distance, are lower bounds of the symmetric
difference. A pair at the threshold differs in at most T shingles and G > T, so by the
pigeonhole it agrees on G - T blocks: sets are joined on block contents. The blocks are
wide and their few bits are kept as a list. Blocks of one bit meet wherever a common
shingle is alone, and blocks without a bit say nothing, so only blocks of two bits or more
are keys: a set with more than T of them meets every partner by one of those. A set with
fewer is sketched again with another hash, until it has enough (in the later LEVELS blocks
of one bit count too, at the very end those without); a pair has both its sets sketched in
every round up to the first in which one of them is well off, and meets there. So no pair
at the threshold is lost.

Two sets that share a passage share a key now and then, and the more documents hold a
passage, the more of them such keys chain together. So the sets that meet at a key are
compared there by folded sketches as wide as the sets are large, which tell apart what
only shares a passage, and only a spanning forest of the pairs that the sketches leave
possible counts. Families are the components of those; inside a family, pairs are compared
by folded sketch first and verified exactly by set, and only a spanning forest of the
verified links leaves a task. Large families are cut into blocks and compared block by
block. Nothing is capped and no pair list of a group is emitted.

Defined cases: null text, empty text or no words: an empty set of size 0, linked with
nothing (its own component; with a null id the component is null); fewer words than a
shingle: the whole sequence is the only shingle; equal texts and repeated rows are in
one component; ties do not matter, components carry the smallest id; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache, partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Least bits of a key block by round of sketches, and bits of the folded sketch of a check.
LEVELS, FOLD = (2,) * 8 + (1,) * 8, 1024
#: Least and most bits of the folded sketch by which sets that meet at a key are compared.
WIDTHS = 256, 1 << 16
#: Shingles in a block of a family that one task compares with another block.
FAMILY_BLOCK = 1 << 18
#: Classes that a task remembers as sent.
SENT = 200_000


def shingles(text: bytes, n: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for j in range(k):
        out = common.mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def set_class(s: np.ndarray) -> int:
    """64-bit fingerprint of a set, signed."""
    if not len(s):
        return 0
    mixed = common.mix64(s + np.uint64(0x632BE59BD9B4E019))
    parts = np.array([mixed.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed), len(s)], np.uint64)
    return int.from_bytes(xxhash.xxh3_64_digest(parts.tobytes()), "big", signed=True)


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    """Parity sketch of a power of two of bits, as 64-bit words; the exclusive or of its
    halves is the sketch of half the bits."""
    bit = np.bincount((common.mix64(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(bit.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(s: np.ndarray) -> bytes:
    """Parity sketch with a bit a shingle or more, within WIDTHS."""
    return parity(s, min(max(1 << (len(s) - 1).bit_length(), WIDTHS[0]), WIDTHS[1])).tobytes() if len(s) else b""


def members(docs: DataFrame, n: int = 4) -> DataFrame:
    """doc_id, own (for a null id), n_shingles, cls (fingerprint of the set), sketch (folded)
    of every row."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                sets = [shingles(t, n) for t in common.texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("own"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_class(s) for s in sets], pa.int64()), pa.array([folded(s) for s in sets], pa.binary())], names=["doc_id", "own", "n_shingles", "cls", "sketch"])

    return docs.select("doc_id", "text", _own().alias("own")).mapInArrow(run, "doc_id long, own long, n_shingles long, cls long, sketch binary")


#: Smallest sizes of the size cells: powers of the square root of two.
EDGES = np.unique(np.ceil(2 ** (np.arange(0, 80) / 2) - 1e-9).astype(np.int64))


def most(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Largest symmetric difference of linked sets of sizes a and b."""
    return (den - num) * (a + b) // (den + num)


@cache
def blocks(cell: int, num: int, den: int) -> int:
    """Blocks G of a size cell: the fewest with which nearly every set of the cell keeps
    more blocks of two bits than a linked set can change; else those that come closest."""
    ends = np.array([EDGES[cell], EDGES[cell + 1] - 1])
    limit = most(ends, ends * den // num, num, den)
    g = np.unique(np.round(np.geomspace(limit[1] + 1, 4 * limit[1] + 8, 400)).astype(np.int64))
    load = ends[None, :] / g[:, None]
    telling = 1 - np.exp(-load) * (1 + load)
    margin = g[:, None] * telling - 2 * np.sqrt(g[:, None] * telling * (1 - telling)) - limit[None, :] - 1
    margin = margin.min(1)
    return int(g[np.argmax(margin >= 0)] if (margin >= 0).any() else g[np.argmax(margin)])


def _sketch(sets: list[np.ndarray], entry: np.ndarray, cell: np.ndarray, g: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, block, content) of the blocks with enough bits, of the sketches of one round."""
    size = np.array([len(sets[i]) for i in entry], np.int64)
    flat = np.concatenate([sets[i] for i in entry])
    of = np.repeat(np.arange(len(entry)), size)
    h = common.mix64(flat ^ common.mix64(cell[of].astype(np.uint64) + np.uint64(77 + (turn << 20))))
    block = ((h >> np.uint64(32)) * g[of].astype(np.uint64)) >> np.uint64(32)
    # entry, block and bit in 64 bits: what entries and blocks leave is the width of a block
    low = min(32, 64 - int(len(entry)).bit_length() - int(g.max()).bit_length())
    high = np.uint64(low + int(g.max()).bit_length())
    code = (of.astype(np.uint64) << high) | (block << np.uint64(low)) | (h & np.uint64((1 << low) - 1))
    code.sort()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    odd = np.diff(np.append(first, len(code))) % 2 == 1
    code = code[first[odd]]  # the bits that are set
    where = code >> np.uint64(low)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])[: len(where)])
    bit = common.mix64((code & np.uint64((1 << low) - 1)) + np.uint64(1))
    content = np.bitwise_xor.reduceat(bit, first) if len(first) else code
    enough = np.diff(np.append(first, len(where))) >= LEVELS[turn]
    where, content = where[first][enough], content[enough]
    return (where >> (high - np.uint64(low))).astype(np.int64), where & ((np.uint64(1) << (high - np.uint64(low))) - np.uint64(1)), content


def sketch_keys(sets: list[np.ndarray], num: int = 85, den: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of each set: (index of the set, key)."""
    size = np.array([len(s) for s in sets], np.int64)
    top = np.searchsorted(EDGES, size, side="right") - 1
    entry, cell, limit = [], [], []
    for below in range(len(EDGES)):  # the own cell, and lower ones that a linked set may be in
        largest = size * den // num if not below else EDGES[np.maximum(top - below + 1, 0)] - 1
        limits = most(size, largest, num, den)
        at = np.flatnonzero((size > 0) & (top >= below) & (num * size <= den * largest) & (limits > 0))
        if below and not len(at):
            break
        entry.append(at)
        cell.append(top[at] - below)
        limit.append(limits[at])
    entry, cell, limit = (np.concatenate(x) for x in (entry, cell, limit))
    if not len(entry):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known, of_cell = np.unique(cell, return_inverse=True)
    g = np.array([blocks(c, num, den) for c in known.tolist()])[of_cell]
    owners, keys, todo = [], [], np.arange(len(entry))
    for turn in range(len(LEVELS)):
        at, block, content = _sketch(sets, entry[todo], cell[todo], g[todo], turn)
        place = (cell[todo][at].astype(np.uint64) << np.uint64(48)) + (np.uint64(turn) << np.uint64(40)) + block
        owners.append(entry[todo[at]])
        keys.append(common.mix64(content ^ common.mix64(place)))
        poor = np.bincount(at, minlength=len(todo)) <= limit[todo]
        if turn == len(LEVELS) - 1:  # poor in every round: the empty blocks of the last one, too
            for e in np.flatnonzero(poor).tolist():
                empty = np.setdiff1d(np.arange(g[todo[e]], dtype=np.uint64), block[at == e])
                owners.append(np.full(len(empty), entry[todo[e]]))
                keys.append(common.mix64(common.mix64((np.uint64(cell[todo[e]]) << np.uint64(48)) + (np.uint64(len(LEVELS)) << np.uint64(40)) + empty)))
        todo = todo[poor]
        if not len(todo):
            break
    return np.concatenate(owners), np.concatenate(keys)


def _keys(n, num, den, batches):
    """key, cls of every set; a task sends each class once as long as it remembers it."""
    sent: set[int] = set()
    for batch in batches:
        for part in common.slices(batch, rows=512, size=1 << 20):
            sets = {set_class(s): s for s in (shingles(t, n) for t in common.texts_of(part))}
            if len(sent) > SENT:
                sent.clear()
            fresh = [c for c in sets if c not in sent]
            sent.update(fresh)
            owner, key = sketch_keys([sets[c] for c in fresh], num, den)
            cls = np.array(fresh, np.int64)[owner] if len(owner) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cls)], names=["key", "cls"])


def _alike(sketches: list[bytes]) -> np.ndarray:
    """Folded sketches as rows of the width of the narrowest."""
    width = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), width), np.uint64)
    for i, x in enumerate(sketches):
        words = np.frombuffer(x, np.uint64)
        while len(words) > width:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        out[i] = words
    return out


def possible(size: np.ndarray, sketch: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that may be linked by their sizes and sketches."""
    root = np.arange(len(size))
    out = []
    for i in range(len(size) - 1):
        later = size[i + 1 :]
        todo = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (den * later >= num * size[i]) & (num * later <= den * size[i]))
        if not len(todo):
            continue
        apart = np.bitwise_count(sketch[todo] ^ sketch[i]).sum(1)
        todo = todo[apart * (den + num) <= (den - num) * (size[todo] + size[i])]
        roots, first = np.unique(root[todo], return_index=True)
        out += [(i, j) for j in todo[first].tolist()]
        root[np.isin(root, roots)] = root[i]
        if (root == root[i]).all():
            break
    return out


def _possible(num, den, batches):
    """a, b: possible links inside each group; rows come by group, which may go over batches."""
    held: list[pa.RecordBatch] = []  # of the group that has not ended
    for batch in chain(batches, [None]):
        if batch is None:
            whole = held
        elif not batch.num_rows:
            continue
        else:
            group = batch.column(0).to_numpy()
            begin = int(np.argmax(group == group[-1]))
            if not begin and held and held[0].column(0)[0].as_py() == group[0]:
                held.append(batch)
                continue
            whole, held = [*held, batch.slice(0, begin)], [batch.slice(begin)]
        a, b = [], []
        if whole:
            table = pa.Table.from_batches(whole)
            group, cls, size = (table.column(i).to_numpy() for i in range(3))
            sketches = table.column(3).to_pylist()
            ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)) if len(group) else []
            at = 0
            for to in map(int, ends):
                found = possible(size[at:to], _alike(sketches[at:to]), num, den)
                a += [cls[at + i] for i, _ in found]
                b += [cls[at + j] for _, j in found]
                at = to
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def meetings(docs: DataFrame, every: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """a, b: a spanning forest, for each key, of the classes that share it and may be linked
    by their folded sketches in `every` (members). The keys are shuffled once; distinct rows
    and groups follow inside that partitioning. Keys with the same classes are one group,
    known by a hash of its classes; if two groups had the same hash, more were compared."""
    rows = docs.select("text").mapInArrow(partial(_keys, n, num, den), "key long, cls long").repartition("key").distinct()
    at = W.partitionBy("key")
    rows = rows.select("cls", F.min("cls").over(at).alias("least"), F.max("cls").over(at).alias("most"), F.bit_xor(F.xxhash64("cls")).over(at).alias("all"))
    rows = rows.where("least < most").select(F.xxhash64("least", "most", "all").alias("group"), "cls").distinct()
    sets = every.where("n_shingles > 0").select("cls", "n_shingles", "sketch").dropDuplicates(["cls"])
    rows = rows.join(sets, "cls").select("group", "cls", "n_shingles", "sketch").repartition("group").sortWithinPartitions("group")
    return rows.mapInArrow(partial(_possible, num, den), "a long, b long").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root from edges a, b: the smallest node of each connected component, by
    alternating large-star and small-star steps; lineage is cut after every round. A root
    with very many nodes makes one large partition of the first join of a round, which
    adaptive execution splits (the result is shuffled anew anyway). Edges are
    counted first, so they are best a written table."""
    rows = edges.count()
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = common.materialize(common.merged(edges, rows), name)
    mark = None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (seen["n"], seen["h"])
        # every larger neighbour of a node goes to the least of that node and its neighbours
        down = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        large = edges.join(down, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # every smaller neighbour of a node, and the node, go to the least of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small_least.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        before, edges = edges, common.materialize(common.merged(small, seen["n"]), name)
        common.release(before)


def _fold(sets: list[np.ndarray]) -> np.ndarray:
    """Parity sketches of FOLD bits, as rows of 64-bit words."""
    out = np.zeros((len(sets), FOLD // 64), np.uint64)
    for i, s in enumerate(sets):
        out[i] = parity(s, FOLD)
    return out


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def spanning(ids: list[int], sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets. With two sides (0 and 1) links
    inside side 1 are left to another task."""
    n = len(ids)
    size = np.array([len(s) for s in sets], np.int64)
    sketch = _fold(sets)
    root = np.arange(n)
    out = []
    for i in np.argsort(size, kind="stable").tolist():
        todo = np.flatnonzero((root != root[i]) & ((side == 0) | (side[i] == 0)) & (den * size >= num * size[i]) & (num * size <= den * size[i]))
        if not len(todo):
            continue
        apart = np.bitwise_count(sketch[todo] ^ sketch[i]).sum(1)
        todo = todo[apart * (den + num) <= (den - num) * (size[todo] + size[i])]
        for j in todo.tolist():
            if root[i] != root[j] and _linked(sets[i], sets[j], num, den):
                out.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
    return out


def _family(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("cls")
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    found = spanning(pdf["cls"].tolist(), sets, pdf["side"].to_numpy(), num, den)
    return pd.DataFrame({"a": pd.Series([f[0] for f in found], dtype="int64"), "b": pd.Series([f[1] for f in found], dtype="int64")})


def _own() -> Column:
    """What a row without an id is known by."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text"))


def _components(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, own, n_shingles, comp, least (id of the component) of every row."""
    every = common.materialize(members(docs, n), "jaccard-members")
    rows = every.count()  # the forests have about as many edges
    met = common.materialize(common.merged(meetings(docs, every, n, num, den), rows), "jaccard-met")
    families = components(met, "jaccard-families")
    families = families.unionByName(families.select(F.col("root").alias("node"), "root")).distinct()
    # one document stands for each class
    picked = every.where(F.col("n_shingles") > 0).groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", "own").alias("id"))).alias("d"), F.max("n_shingles").alias("n"))
    picked = picked.join(families.withColumnRenamed("node", "cls"), "cls").select("cls", "root", "n", "d.none", "d.id")
    total = picked.groupBy("root").agg(F.expr(f"cast(ceil(sum(n) / {FAMILY_BLOCK}) as int)").alias("parts"))
    picked = picked.join(total, "root").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))

    def sets(batches):
        for batch in batches:
            for part in common.slices(batch):
                own = [shingles(t, n) for t in common.texts_of(part)]
                match = [set_class(s) == c for s, c in zip(own, part.column("cls").to_pylist())]
                kept = part.filter(pa.array(match)).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([s.tobytes() for s, ok in zip(own, match) if ok], pa.binary())], names=["cls", "root", "parts", "part", "shingles"])

    texts = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", _own()).alias("id"), "text").join(picked, ["none", "id"]).select("cls", "root", "parts", "part", "text")
    texts = texts.mapInArrow(sets, "cls long, root long, parts int, part int, shingles binary")
    # each block of a family meets itself and every other block once
    pairs = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "cls", "shingles", (F.col("part") > F.col("other")).cast("int").alias("side"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return _family(pdf, num, den)

    edges = pairs.groupBy("root", "i", "j").applyInPandas(compare, "a long, b long")
    edges = common.materialize(common.merged(edges.distinct(), rows), "jaccard-edges")
    linked = components(edges, "jaccard-links")
    joined = every.join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("root", "cls"))
    least = joined.where(F.col("n_shingles") > 0).groupBy("comp").agg(F.min("doc_id").alias("least"))
    return joined.join(least, "comp", "left").select("doc_id", "own", "n_shingles", "comp", "least")


def link(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link when their sets of
    n-word shingles have a Jaccard similarity of num / den or more."""
    return _components(docs, n, num, den).select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """The documents with the smallest id of their component, all columns kept. Of a
    component without ids one row stays; rows without an id and without words all stay."""
    rows = _components(docs, n, num, den)
    kept = rows.where((F.col("n_shingles") == 0) | (F.col("doc_id") == F.col("least"))).where("doc_id is not null").select("doc_id").distinct()
    none = rows.where("doc_id is null and n_shingles > 0 and least is null").groupBy("comp").agg(F.min("own").alias("__own")).select("__own")
    wordless = rows.where("doc_id is null and n_shingles = 0").select(F.col("own").alias("__own")).distinct()
    unnamed = docs.where("doc_id is null").withColumn("__own", _own())
    one = unnamed.join(none, "__own", "left_semi").dropDuplicates(["__own"])
    every = one.unionByName(unnamed.join(wordless, "__own", "left_semi")).select(*docs.columns)
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(every)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents. Null texts and texts without a word are linked with
    nothing; rows without an id are linked, and have the id of their component, null if no
    member has one; repeated rows share it; an empty table gives an empty result; other
    columns are not read."""
    return link(common.documents(spark, sf_dir))


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
c AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT c.x, e.y FROM c JOIN e ON e.x = c.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS m FROM c GROUP BY x) USING (doc_id)"""
