"""Benchmark decontamination against brute force and changed items."""

import collections
import re

import pytest

from textloom.llm import decontam

SF = "/root/testdata/sf0.001"


def test_reparameterised_questions(spark):
    item = "If a shop sells apples for 12 dollars and Tom buys 7 of them, how much money does Tom pay for the apples when Anna gets 3 kg back"
    docs = [
        item,
        "Intro words. " + item.replace("12", "99").replace("7", "41").replace("Tom", "Bob").replace("Anna", "Eve").replace("3 kg", "8 lb") + " and more",
        item.replace("Tom buys", "Bob buys").replace("12", "5").replace("does Tom", "does Jim").replace("Anna", "Jim").replace("7", "9").replace("3 kg", "9 kg"),
        "completely different words about the sea and the sky and many other things that nobody asks in any test at all",
        "short",
    ]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (6, "tiny one"), (7, "four words are enough")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(table, bench).collect()}
    assert set(got) >= {(0, 5), (1, 5)} and not {k for k in got if k[0] in (3, 4)}
    assert got[0, 5]["changed_slots"] == 0 and got[1, 5]["changed_slots"] >= 5 and got[1, 5]["first_word"] >= 2
    kept = {r["doc_id"] for r in decontam.drop_contaminated(table, bench).collect()}
    assert {3, 4} <= kept and not {0, 1} & kept


@pytest.mark.parametrize("case", [str.upper, str.lower, str.title, str])
def test_copies_in_other_case(spark, case):
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").select("item_id", "text")
    rows = bench.collect()
    docs = spark.createDataFrame([(r["item_id"], f"some words before {case(r['text'])} and after") for r in rows], "doc_id long, text string")
    of = {r["item_id"]: r["class_item_id"] for r in decontam.item_classes(bench).collect()}
    found = decontam.contaminated(docs, bench).collect()
    assert set(of) == {r["item_id"] for r in rows} and {(i, c) for i, c in of.items()} <= {(r["doc_id"], r["item_id"]) for r in found}
    assert all(r["n_windows"] <= r["item_windows"] for r in found)


def test_every_item_is_searched(spark):
    """Items that templates say nothing about, and short ones."""
    items = ["12 45 kg 7 88 Anna 3 lb", "what is seven", "Is it 5 or 6", "seven", "two words", "1 2 3 4 5 6 7 8 9 10 11 12 13 14", ". , ;", "", "   "]
    bench = spark.createDataFrame([*((i, t) for i, t in enumerate(items)), (77, None), (None, items[0])], "item_id long, text string")
    docs = [f"words first {t} words last" for t in items] + [f"a line\n {t} \nanother" for t in items] + ["13 46 kg 8 89 Anna 4 lb", "quite other words, seven of them, and two words here"]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table, bench).collect()}
    n = len(items)
    assert {(k, k) for k in (0, 1, 2, 5, 6)} | {(n + k, k) for k in range(7)} <= got
    assert not {k for k in got if k[0] in (3, 4, 7, 8, n + 7, n + 8, 2 * n, 2 * n + 1)}


def test_items_of_one_template_are_a_class(spark):
    ask = "A shop sells apples for {} dollars and Tom buys {} of them so how much does he pay"
    bench = spark.createDataFrame([(i, ask.format(i + 3, i + 50)) for i in range(300)] + [(400, ask.format(8, 8))], "item_id long, text string")
    docs = spark.createDataFrame([(i, ask.format(i + 7, i + 90)) for i in range(10)] + [(None, ask.format(1, 2))] * 2 + [(99, "nothing of that kind here, only some words about the sea")], "doc_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["class_items"]) for r in decontam.contaminated(docs, bench).collect()]
    assert sorted(x for x in got if x[0] is not None and x[1] == 0) == [(i, 0, 300) for i in range(10)] and sum(x == (None, 0, 300) for x in got) == 2
    classes = {r["item_id"]: r["class_item_id"] for r in decontam.item_classes(bench).collect()}
    assert set(classes.values()) == {0, 400} and classes[299] == 0
    assert [r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()] == [99]


def test_recall_of_reparameterised_items(spark):
    """Every number and name of the benchmark's items replaced by others."""
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").select("item_id", "text")
    rows = [(r["item_id"], re.sub(r"\d+", lambda m: str(int(m[0]) * 7 + 5), r["text"])) for r in bench.collect()]
    found = {r["doc_id"] for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert len(found) >= 0.95 * len(rows)


def test_planted_passages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    index = collections.defaultdict(set)
    for i, t in zip(bench.item_id, bench.text):
        w = t.lower().split()
        for k in range(len(w) - 7):
            index[tuple(w[k : k + 8])].add(i)
    want = set()
    for d, t in zip(docs.doc_id, docs.text):
        w, hits = t.lower().split(), collections.Counter()
        for k in range(len(w) - 7):
            hits.update(index.get(tuple(w[k : k + 8]), ()))
        want |= {(d, i) for i, n in hits.items() if n >= 5}
    of = {r["item_id"]: r["class_item_id"] for r in decontam.item_classes(spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op2(spark, SF).collect()}
    assert got == {(d, of[i]) for d, i in want} and got


def test_long_text_full_of_items(spark):
    """A very long document of nothing but items: its text is not copied by window."""
    item = "the ninth clerk of the tower counted every lantern on the quay before the bells rang twice"
    docs = spark.createDataFrame([(1, " ".join([item] * 6000)), (2, "other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(3, item)], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["n_windows"], r["last_word"]) for r in decontam.contaminated(docs, bench).collect()]
    n = len(item.split())
    assert got == [(1, 3, n - 7, 6000 * n - 1)]
