"""Removal of repeats against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.llm import suffix


def brute_marks(texts, length):
    seen, out = set(), []
    for t in texts:
        flags = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                flags[i : i + length] = True
            seen.add(w)
        out.append(flags)
    return out


def test_run_index():
    rng = random.Random(2)
    for _ in range(40):
        length, letters = rng.choice([6, 10]), rng.choice(["ab", "abc", "abcdefghij"])
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))).encode() for _ in range(rng.randrange(1, 8))]
        texts += [texts[0], b"a" * 30, texts[-1] + texts[0]]
        spans = suffix.index_bucket(pd.DataFrame({"id": range(len(texts)), "s": 0, "seg": texts}), length)
        got = [np.zeros(len(t), bool) for t in texts]
        for i, a, b in spans.itertuples(index=False):
            got[i][a:b] = True
        assert all((x == y).all() for x, y in zip(got, brute_marks(texts, length)))
        index = suffix.RunIndex(texts)
        assert index.lengths.sum() == index.n and len(index.heads) == len(index.first) == len(index.last) <= index.n
        of, first, count, m, twice = suffix.segments(texts, length, 4)
        windows = sorted((o, k) for o, a, c in zip(of, first, count) for k in range(a, a + c))
        assert windows == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - length + 1)]


def test_samples_of_runs_give_neighbours_and_statistics():
    """The streamed neighbours and matches against a plainly sorted suffix order."""
    rng = random.Random(3)
    for _ in range(60):
        letters = rng.choice([b"ab", b"abc", bytes(range(256))])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 6))]
        texts += [texts[0] * 3, b"ab" * 30]
        ends = np.cumsum([len(t) + 1 for t in texts])
        suffixes = sorted((t[i:], e - len(t) - 1 + i) for t, e in zip(texts, ends.tolist()) for i in range(len(t) + 1))
        index = suffix.RunIndex(texts)
        other, match = index.neighbours()
        assert not hasattr(index, "suffixes") and not match[suffixes[0][1]]
        for (a, x), (b, y) in zip(suffixes, suffixes[1:]):
            common_ = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert match[y] == common_ and (not common_ or other[y] == x)


def test_blocks_in_other_order_are_not_repeats(spark):
    """Texts of two kinds of blocks in the orders 0110 and 1001, and random periodic texts."""
    rng = random.Random(11)
    block = "rwemxxrjhmlmpqjnn dveeastuwqdwyu"
    tables = [[f"{block}0{block}1{block}1{block}0{block}", f"{block}1{block}0{block}0{block}1{block}"]]
    for _ in range(12):
        unit = "".join(rng.choice("abcdef ") for _ in range(rng.randrange(1, 40)))
        tables.append(["".join(unit + rng.choice("01") for _ in range(rng.randrange(2, 260 // len(unit) + 4))) for _ in range(8)])
    for texts in tables:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: r["n_removed"] for r in suffix.dedup(docs).collect()}
        assert got == {i: int(f.sum()) for i, f in enumerate(brute_marks([t.encode() for t in texts], 100))}
        assert texts is not tables[0] or got == {0: 0, 1: 0}


@pytest.mark.parametrize("route", ["index", "large", "common"])
def test_routes_of_minimizers_agree(spark, monkeypatch, route):
    """Periodic and shared texts by the index, by windows of large minimizers, and by
    windows of common ones."""
    if route == "large":
        monkeypatch.setattr(suffix, "BUCKET", 300)
    if route == "common":
        monkeypatch.setattr(suffix, "COMMON", 0.0)
    rng = random.Random(4)
    core = "".join(rng.choice("abcdefgh ") for _ in range(160))
    texts = ["".join(rng.choice("xyz") for _ in range(20)) + core[rng.randrange(30) :] + "".join(rng.choice("xyz") for _ in range(20)) for _ in range(40)]
    texts += ["ab" * 90, "ba" * 130 + "c" * 150, None, "", texts[3]]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_removed"] for r in suffix.dedup(docs).collect()}
    assert got == {i: int(f.sum()) for i, f in enumerate(brute_marks([(t or "").encode() for t in texts], 100))}


def test_remove_repeats_keeps_columns_and_characters(spark):
    shared = "Überall gleich: " + "".join(chr(0x4E00 + i) for i in range(80))
    docs = spark.createDataFrame([(1, f"eins {shared} ende", "de", 5), (2, f"zwei {shared} schluss", "de", None), (3, None, None, 0)], "doc_id long, text string, lang string, n_chars long")
    docs = docs.withColumn("spans", F.lit("clash")).withColumn("id", F.lit(7)).withColumn("slot", F.lit(8))
    assert suffix.remove_repeats(docs).columns == docs.columns
    got = {r["doc_id"]: r for r in suffix.remove_repeats(docs).collect()}
    assert got[1]["text"] == f"eins {shared} ende" and got[3]["text"] is None and got[3]["n_chars"] == 0
    assert len(got[2]["text"]) < 30 and got[2]["text"].startswith("zwei") and got[2]["text"].endswith("schluss") and got[2]["n_chars"] == len(got[2]["text"])
