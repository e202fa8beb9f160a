"""Byte-level BPE encoding and decoding on padded matrices.

Distinct pieces of a slice of texts are dealt into length buckets; each bucket is
a padded matrix of token ids. In every round each row merges its leftmost pair of
minimum rank; pair ranks come from an open-addressing hash table, finished rows
leave the matrix (compaction) and the matrix loses one column a round. Pieces
already seen by the worker come from a bounded cache.

Defined cases: null and empty texts give no ids; lone surrogates cannot occur in
Spark strings; special-token strings are ordinary text; repeated rows and equal
ids are encoded independently; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

INF = np.int32(2**31 - 1)
#: Entries of the piece cache of one Python worker, about 60 MB.
CACHE = 250_000
#: Cells of one padded matrix.
CELLS = 1 << 20
#: Longer pieces are merged one by one.
LONG = 512


def read_ranks(raw: bytes) -> list[bytes]:
    """Tokens by rank from the lines `base64 rank` of a rank file."""
    pairs = [line.split() for line in raw.splitlines() if line.strip()]
    tokens: list[bytes] = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _ranges(cls: str, top: int) -> str:
    """The characters of a class up to `top`, as ranges for a character set."""
    every = "".join(chr(c) for c in range(top + 1) if not 0xD800 <= c < 0xE000)
    return "".join(f"\\U{ord(m[0]):08x}-\\U{ord(m[-1]):08x}" for m in regex.findall(cls + "+", every) for m in _runs(m))


def _runs(text: str) -> list[str]:
    """Cut between characters whose code points are not neighbours."""
    code = np.array([ord(c) for c in text])
    cuts = [0, *(np.flatnonzero(np.diff(code) != 1) + 1).tolist(), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def bmp_pattern(pattern: str) -> str:
    r"""The pattern with \p{L}, \p{N} and \s spelled out for texts without characters
    beyond U+FFFF, so that the faster standard engine runs it."""
    out, inside, at = [], False, 0
    sets = {r"\p{L}": _ranges(r"\p{L}", 0xFFFF), r"\p{N}": _ranges(r"\p{N}", 0xFFFF), r"\s": _ranges(r"\p{White_Space}", 0xFFFF)}
    while at < len(pattern):
        for name, chars in sets.items():
            if pattern.startswith(name, at):
                out.append(chars if inside else f"[{chars}]")
                at += len(name)
                break
        else:
            if pattern.startswith(r"\S", at) and not inside:
                out.append(f"[^{sets[chr(92) + 's']}]")
                at += 2
            elif pattern[at] == "\\":
                out.append(pattern[at : at + 2])
                at += 2
            else:
                inside = pattern[at] == "[" or inside and pattern[at] != "]"
                out.append(pattern[at])
                at += 1
    return "".join(out)


class PairTable:
    """Open addressing with linear probing over (left id, right id) -> rank."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(10, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1), np.uint64)
        self.values = np.full(1 << bits, INF, np.int32)
        todo, slot = np.arange(len(keys)), self.slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            at = todo[free]
            _, first = np.unique(slot[at], return_index=True)
            won = at[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + (self.keys[slot[todo]] != np.uint64(2**64 - 1))) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; INF for no pair or for padding (-1)."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self.slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], INF)
        todo = np.flatnonzero((held != keys) & (held != np.uint64(2**64 - 1)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held != np.uint64(2**64 - 1))]
        out[(left < 0) | (right < 0)] = INF
        return out.reshape(shape)


class Encoder:
    def __init__(self, raw: bytes, pattern: str) -> None:
        self.tokens = read_ranks(raw)
        self.whole = {t: i for i, t in enumerate(self.tokens) if t}
        wide = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        narrow = re.compile(bmp_pattern(pattern)).findall
        self.find = lambda t: narrow(t) if t.isascii() or len(t.encode("utf-16-le")) == 2 * len(t) else wide(t)
        self.byte_id = np.array([self.whole[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for rank, token in enumerate(self.tokens):
            for cut in range(1, len(token)):
                left, right = self.whole.get(token[:cut]), self.whole.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.uint64), np.array(values, np.int32))
        self.cache: dict[str, bytes] = {}

    # -- pieces ---------------------------------------------------------------

    def merge_matrix(self, ids: np.ndarray) -> list[bytes]:
        """Merge all rows of a padded id matrix (padding -1) to the end."""
        n = len(ids)
        out: list[bytes] = [b""] * n
        rows = np.arange(n)
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        while len(rows):
            width = ids.shape[1]
            best = rank.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), best] if width > 1 else np.full(len(rows), INF)
            live = least < INF
            if not live.all():
                done = ids[~live]
                full = done >= 0
                ends = (np.cumsum(full.sum(1)) * 4).tolist()
                data = done[full].astype("<u4").tobytes()
                for row, a, b in zip(rows[~live].tolist(), [0, *ends], ends):
                    out[row] = data[a:b]
                ids, rank, rows, best, least = ids[live], rank[live], rows[live], best[live], least[live]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            cols = np.arange(width - 1)[None, :]
            ids = np.take_along_axis(ids, cols + (cols > best[:, None]), 1)
            ids[at, best] = least
            if width == 2:
                rank = rank[:, :0]
                continue
            cols = np.arange(width - 2)[None, :]
            rank = np.take_along_axis(rank, cols + (cols >= best[:, None]), 1)
            has = best < width - 2
            rank[at[has], best[has]] = self.pairs.get(ids[at[has], best[has]], ids[at[has], best[has] + 1])
            has = best > 0
            rank[at[has], best[has] - 1] = self.pairs.get(ids[at[has], best[has] - 1], ids[at[has], best[has]])
        return out

    def merge_long(self, ids: np.ndarray) -> bytes:
        """One long piece. A round takes all places of the minimum rank from left to
        right where that gives what one leftmost merge after another gives, that is,
        where no pair that arises on the way has a lower rank; else only the first."""
        rank = self.pairs.get(ids[:-1], ids[1:])
        while len(rank):
            least = rank.min()
            if least == INF:
                break
            at = np.flatnonzero(rank == least)
            run = np.cumsum(np.diff(at, prepend=at[0] - 2) != 1)
            start = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])[run - 1]
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            merged = ids.copy()
            merged[at] = least
            new = merged[keep]
            where = at - np.arange(len(at))
            before = self.pairs.get(np.where(where > 0, new[where - 1], -1), np.full(len(at), least, np.int32))
            after = self.pairs.get(np.full(len(at), least, np.int32), np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1))
            if len(at) > 1 and min(before.min(), after.min()) < least:
                at, keep = at[:1], np.ones(len(ids), bool)
                keep[at + 1] = False
                merged = ids.copy()
                merged[at] = least
                new, where = merged[keep], at
            ids = new
            if len(ids) < 2:
                break
            rank = np.where(keep[:-1], rank, INF)[keep[:-1]][: len(ids) - 1]
            if len(rank) < len(ids) - 1:
                rank = np.append(rank, INF)
            for near in (where, where - 1):
                near = near[(near >= 0) & (near < len(ids) - 1)]
                rank[near] = self.pairs.get(ids[near], ids[near + 1])
        return ids.astype("<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        rest = []
        for i, whole in enumerate(map(self.whole.get, pieces)):
            if whole is None:
                rest.append(i)
            else:
                out[i] = whole.to_bytes(4, "little")
        sizes = np.fromiter((len(pieces[i]) for i in rest), np.int64, len(rest))
        order = np.argsort(sizes, kind="stable")
        bucket = np.maximum(sizes[order] + 1, 4) // 2 * 2  # pieces of two neighbouring lengths share a matrix
        bucket[sizes[order] > LONG] = -1
        for width in np.unique(bucket).tolist():
            members = order[bucket == width]
            step = max(1, CELLS // max(width, 1))
            for part in [members[a : a + step] for a in range(0, len(members), step)]:
                some = [pieces[rest[j]] for j in part.tolist()]
                if width < 0:
                    merged = [self.merge_long(self.byte_id[np.frombuffer(p, np.uint8)]) for p in some]
                elif not (lengths := sizes[part]).max():
                    continue
                else:
                    ids = np.full((len(some), int(lengths.max())), -1, np.int32)
                    ids[np.arange(ids.shape[1])[None, :] < lengths[:, None]] = self.byte_id[np.frombuffer(b"".join(some), np.uint8)]
                    merged = self.merge_matrix(ids)
                for j, data in zip(part.tolist(), merged):
                    out[rest[j]] = data
        return out

    # -- texts ----------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cache = self.cache
        split = [self.find(t) for t in texts]
        new = {p for pieces in split for p in pieces if p not in cache}
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = {p for pieces in split for p in pieces}
        order = list(new)
        cache.update(zip(order, self.encode_pieces([p.encode() for p in order])))
        return [b"".join(map(cache.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(raw: bytes, pattern: str) -> Encoder:
    key = (hashlib.sha256(raw).hexdigest(), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(raw, pattern)
    return _encoders[key]


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as file:  # a file of the installed tokenizer package, at the driver
        return spark.sparkContext.broadcast(file.read())


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), ids_sha256, decoded_sha256 of every text.

    `decoded_sha256` hashes the bytes that decoding the ids gives back. With
    `with_ids` false the ids themselves are left out. Null text: no ids.
    """
    raw = _vocabulary(docs.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches):
        codec = encoder(raw.value, pattern)
        for batch in batches:
            for part in common.slices(batch):
                data = codec.encode([t or "" for t in part.column("text").to_pylist()])
                columns = [part.column("doc_id"), pa.array([len(x) // 4 for x in data], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in data]), pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in data])]
                if with_ids:
                    sizes = np.fromiter((len(x) // 4 for x in data), np.int64, len(data))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(data), "<u4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    spark_schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, spark_schema)


def decode_ids(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text from doc_id, ids; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    raw = _vocabulary(rows.sparkSession, path)

    def run(batches):
        codec = encoder(raw.value, pattern)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document. Null and empty texts have no ids; a null id stays
    null; repeated rows are encoded row by row; an empty table gives an empty result; other
    columns are not read."""
    import public_tokenizers

    return encode_documents(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
