"""N-gram Jaccard links against brute force."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import common, jaccard


@pytest.mark.parametrize("num", [85, 80])
def test_sketch_keys_lose_no_pair(num):
    rng = np.random.default_rng(1)
    for k in range(300):
        n = int(rng.integers(1, [12, 60, 400, 1500][k % 4]))
        base = rng.integers(0, 2**63, n + 400).astype(np.uint64)
        cut = int(rng.integers(0, n // 4 + 1))
        a, b = np.unique(base[:n]), np.unique(np.concatenate([base[cut:n], base[n : n + int(rng.integers(0, max(1, n // 5)))]]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= num * (len(a) + len(b) - both) and not len(a) == len(b) == both:
            owner, keys = jaccard.sketch_keys([a, b], num, 100)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def brute_components(texts, n=4, num=85):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(i, len(s), r) for i, (s, r) in enumerate(zip(sets, root))]


@pytest.mark.parametrize("block", [1 << 18, 300])
def test_near_copies_of_one_text(spark, monkeypatch, block):
    """One family with chains of edits; with small blocks it is compared block by block."""
    monkeypatch.setattr(jaccard, "FAMILY_BLOCK", block)
    rng = random.Random(6)
    words = [f"w{rng.randrange(5000)}" for _ in range(90)]
    texts = []
    for _ in range(60):
        copy = list(words)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(30)}"
        texts.append(" ".join(copy))
    texts += ["", None, "one two", "One TWO", "one two three four five", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.link(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(texts)


def test_small_sets_meet_without_empty_blocks():
    """Sets of a few shingles, which often leave blocks empty, meet by blocks with bits."""
    rng = np.random.default_rng(5)
    for n in [7, 8, 9, 12, 13] * 60:
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a[1:] if rng.integers(2) else np.unique(np.concatenate([a, rng.integers(0, 2**63, 1).astype(np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
            owner, keys = jaccard.sketch_keys([a, b])
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
    other = [np.unique(rng.integers(0, 2**63, 8).astype(np.uint64)) for _ in range(3000)]
    owner, keys = jaccard.sketch_keys(other)
    assert len(np.unique(keys)) == len(np.unique(np.stack([keys, owner.astype(np.uint64)], 1), axis=0))  # no chance meetings


def test_components_of_hubs_and_paths(spark):
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(25)] + [(7, 300), (300, 301), (5, 5)]
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {**dict.fromkeys([*range(1, 40), 300, 301], 0), **{101 + i: 100 for i in range(25)}}


def test_rows_without_an_id(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(1, a), (2, a + " end"), (None, a), (None, b), (None, b), (None, b + " end"), (3, c), (None, d), (None, None), (None, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = jaccard.keep_one(docs, 5, 80, 100)
    assert got.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sum((t or "").startswith("b0") for _, t in got) == 1
    assert sorted(map(str, [r for r in got if not (r[1] or "").startswith("b0")])) == sorted(map(str, [(1, a), (3, c), (None, d), (None, None), (None, ""), (4, None)]))


def test_a_shared_passage_makes_no_family(spark, monkeypatch):
    """Documents that only share a passage do not chain into a family, at any number; near
    copies among them still do."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for k in range(300):
        own = [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(120, 200))]
        at = rng.randrange(len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
    texts += [texts[7] + " end", texts[8] + " end"]
    largest = []
    plain = jaccard.components

    def seen(edges, name):
        found = plain(edges, name)
        if name == "jaccard-families":
            largest.append(max(r["count"] for r in found.groupBy("root").count().collect()) + 1)
        return found

    monkeypatch.setattr(jaccard, "components", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.link(docs, 5, 80, 100).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(texts, 5, 80)
    assert largest == [2]


@pytest.mark.parametrize("num", [85, 80])
def test_sketches_leave_every_linked_pair_possible(num):
    """Sets of all sizes, also with sketches of unlike widths; groups go over batches."""
    rng = np.random.default_rng(2)
    rows, linked = [], set()
    for group in range(60):
        n = int(rng.integers(1, [12, 300, 1100, 5000][group % 4]))
        base = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        sets = [np.unique(base[int(rng.integers(0, n // 5 + 1)) : n + int(rng.integers(0, n // 5 + 1))]) for _ in range(6)]
        sets = [s for s in sets if len(s)]
        rows += [(group, len(rows) + i, len(s), jaccard.folded(s)) for i, s in enumerate(sets)]
        first = len(rows) - len(sets)
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    linked.add((first + j, first + i))
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int64(), pa.binary()])]
    batches = pa.Table.from_arrays(columns, ["group", "cls", "n_shingles", "sketch"]).to_batches(max_chunksize=4)
    root = list(range(len(rows)))
    for batch in jaccard._possible(num, 100, iter(batches)):
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            assert rows[a][0] == rows[b][0]
            root = [root[a] if r == root[b] else r for r in root]
    assert len(linked) > 100 and all(root[a] == root[b] for a, b in linked)


def test_a_written_table_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}
    before, set_before = files(), spark.conf.get(common.CLEANUP, None)
    table = common.materialize(spark.range(100_000).repartition("id").groupBy("id").count(), "test")
    for _ in range(20):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and table.count() == 100_000
    assert spark.conf.get(common.CLEANUP, None) == set_before
    common.release(table)
