"""Context-tree weighting against the textbook recursion."""

import collections
import functools
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import ctw

SF = "/root/testdata/sf0.001"


def brute_tree(texts, depth):
    """Textbook context-tree weighting by recursion over strings of context bytes: a
    function that gives the natural log-probability of a text with its end."""

    @functools.cache
    def counts(context, symbol_bits):
        """Zeros and ones at a decision after a context (nearest byte last)."""
        found = [0, 0]
        for t in texts:
            padded = ctw.END * depth + t + ctw.END
            for i in range(depth, len(padded)):
                bits = f"{padded[i]:08b}"
                if padded[i - len(context) : i] == context and bits.startswith(symbol_bits):
                    found[int(bits[len(symbol_bits)])] += 1
        return tuple(found)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    @functools.cache
    def weighted(context, bits):
        """(own estimate, product of the children's weighted probabilities), as logarithms."""
        split = 0.0
        if len(context) < depth:
            children = [bytes([c]) + context for c in range(256)]
            split = sum(node(c, bits) for c in children if sum(counts(c, bits)))
        return kt(*counts(context, bits)), split

    def node(context, bits):
        own, split = weighted(context, bits)
        return own if len(context) == depth else np.logaddexp(own, split) - math.log(2)

    def one(context, bits, d=0):
        """Probability of a one: own estimate and the next deeper known node, by weight."""
        here = context[len(context) - d :]
        a, b = counts(here, bits)
        deeper = d < depth and sum(counts(context[len(context) - d - 1 :], bits))
        if not a + b:
            return 0.5
        if not deeper:
            return (b + 0.5) / (a + b + 1)
        own, split = weighted(here, bits)
        w = math.exp(own - np.logaddexp(own, split))
        return w * (b + 0.5) / (a + b + 1) + (1 - w) * one(context, bits, d + 1)

    def log_probability(text):
        padded, total = ctw.END * depth + text + ctw.END, 0.0
        for i in range(depth, len(padded)):
            bits = f"{padded[i]:08b}"
            for k in range(8):
                p = one(padded[i - depth : i], bits[:k])
                total += math.log(p if bits[k] == "1" else 1 - p)
        return total

    return log_probability


def test_score_is_context_tree_weighting(spark):
    """Depth 5, seen and unseen texts, against the textbook recursion."""
    texts = [b"abracadabra", b"abracadabra", b"barbara", b"", b"a cab", "äß".encode()]
    new = [b"abraxas", b"bar", b"\x00z", b"quite new"]
    want = [brute_tree(tuple(texts), 5)(t) / math.log(10) for t in texts + new]
    docs = spark.createDataFrame([(i, t.decode() if t else None) for i, t in enumerate(texts + new)], "doc_id long, text string")
    got = ctw.score(docs, docs.where(F.col("doc_id") < len(texts))).toPandas().sort_values("doc_id")
    assert np.allclose(got.score, want, rtol=1e-5, atol=1e-5)
    assert np.allclose(got.bits_per_byte, [-w / math.log10(2) / (len(t) + 1) for w, t in zip(want, texts + new)], rtol=1e-5)


def test_ctw_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    counts, ends = collections.Counter(), 0
    for i, t in zip(docs.doc_id, docs.text):
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(t.encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = ctw.op7(spark, SF).toPandas().set_index("doc_id")
    assert (got.train_tokens == n).all()
    for i, t in zip(docs.doc_id, docs.text):
        words = t.encode().lower().split()
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(counts[w] for w in words), ends])
        row = got.loc[i]
        assert abs(row.base_score - base) < 1e-6 * max(1, abs(base)) and row.n_tokens == len(words) + 1 and row.n_known == 1 + sum(counts[w] > 0 for w in words)
        assert row.held_out == (zlib.crc32(str(i).encode()) % 10 == 0) and row.score < 0


def test_buckets_and_chunks_do_not_matter(spark, monkeypatch):
    """Every context seen, however rare, in one bucket and chunk or in many."""
    texts = [("the same few words again " * 400)[:9000] + f" {i % 7}" for i in range(60)] + ["quixotic zephyr", "a quixotic zephyr", None, "", "Ünïcode"] + ["short"] * 1100  # more than one slice
    unseen = ["quixotic zebra \x00", "\t日本"]
    docs = spark.createDataFrame(list(enumerate(texts + unseen)), "doc_id long, text string").coalesce(1)

    def run():
        return ctw.score(docs, docs.where(F.col("doc_id") < len(texts))).toPandas().sort_values("doc_id").score.to_numpy()

    want = run()
    monkeypatch.setattr(ctw, "BUCKET", 1 << 14)
    monkeypatch.setattr(ctw, "CHUNK", 1 << 17)
    monkeypatch.setattr(ctw, "SLICE", 1 << 12)
    assert np.allclose(run(), want, rtol=1e-6, atol=1e-4)


def test_hashed_table_finds_every_string():
    code = np.unique(np.random.default_rng(0).integers(0, 1 << 47, 50_000).astype(np.uint64))
    assert (ctw.Table(code, np.arange(len(code)))(code[::-1]) == np.arange(len(code))[::-1]).all()
    assert (ctw._codes([b"abcdefg"], 5) == ctw._codes([b"xx", b"abcdefg"], 5)[3:]).all() and ctw._codes([b"abcdef"], 5)[5] == int.from_bytes(b"abcdef", "big")
