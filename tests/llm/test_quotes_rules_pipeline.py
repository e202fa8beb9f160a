"""Quotation links, rule policies and the pipeline."""

import base64
import collections
import itertools
import random

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from textloom.llm import common, decontam, quality, quotes, rules

SF = "/root/testdata/sf0.001"


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there, General.\nHow are you?"), (1, 1, "assistant", "> Hello there, general!\nFine."), (1, 2, "user", "Else"), (1, 3, "assistant", "On Monday Bob wrote:\n> How are you?\n>> hello THERE general\nAs said"), (1, 4, "user", None), (2, 0, "user", "> something\nyes"), (2, 1, "user", "a > b"), (2, 1, "user", "a > b"), (None, 3, "u", "x"), (3, None, "u", "> How are you?")]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash"))).toPandas()
    assert len(got) == len(rows)
    one = got[got.conv_id == 1].sort_values("turn")
    assert one.reply_to.tolist() == [-1, 0, 1, 0, 3] and one.position.tolist() == [1, 2, 4, 3, 5] and one.n_linked.tolist() == [0, 1, 0, 2, 0]
    assert one.text.tolist()[1:4] == ["Fine.", "Else", "As said"]
    assert quotes.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def as_sql(table, query):
    con = duckdb.connect()
    con.register("conversations", table)
    return con.sql(query).df()


def same(got, want):
    order = sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[order].astype(object).where(d[order].notna(), None).values.tolist()))
    return rows(got) == rows(want)


@pytest.mark.parametrize("hot", [1, 1000])
def test_quotes_of_parts_by_sql(spark, monkeypatch, hot):
    """Random conversations that quote whole messages, lines, sentences and rewrapped runs."""
    monkeypatch.setattr(quotes, "HOT", hot)
    monkeypatch.setattr(quotes, "BLOCK", 3)
    rng = random.Random(12)
    rows, said = [], []
    for conv in range(25):
        for turn in range(rng.randrange(1, 12)):
            lines = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(rng.randrange(1, 9))) + rng.choice([".", "", "!"]) for _ in range(rng.randrange(1, 4))]
            text = "\n".join(lines)
            if said and rng.random() < 0.7:
                words = rng.choice(said).split()
                a = rng.randrange(len(words))
                part = words[a : a + rng.randrange(1, 15)]
                cut = rng.randrange(len(part) + 1)
                text = "\n".join("> " + " ".join(x) for x in (part[:cut], part[cut:]) if x) + "\n" + text
            said.append("\n".join(lines))
            rows.append((conv, turn, rng.choice(["user", "assistant"]), text))
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    got = quotes.link(spark.createDataFrame(table)).toPandas()
    assert got.n_linked.sum() > 60 and same(got, as_sql(table, quotes.OP9_SQL))


def test_one_passage_that_many_quote(spark):
    """One turn that is quoted and answered by very many, one very long message, rows
    without ids."""
    opening = "the opening words that everybody here quotes again and again"
    n = 100_000
    many = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit(f"> {opening}\nanswer "), F.col("id")).alias("text"))
    rest = spark.createDataFrame([(1, 0, "user", f"before {opening} after"), (2, 0, "user", "> " + opening), (2, 1, "user", "word " * 20_000 + opening), (None, None, "u", "x"), (None, None, "u", "y"), (None, 1, "u", f"> {opening}")], "conv_id long, turn long, role string, text string")
    got = quotes.link(many.unionByName(rest))
    one = got.where("conv_id = 1").agg(F.count("*"), F.sum("n_linked"), F.max("reply_to"), F.countDistinct("position"), F.max("position")).first()
    assert tuple(one) == (n + 1, n, 0, n + 1, n + 1)
    assert got.where("conv_id = 1 and turn > 0 and position <> turn + 1").count() == 0
    other = {(r["conv_id"], r["turn"]): r for r in got.where("conv_id = 2 or conv_id is null").collect()}
    assert other[2, 0]["n_linked"] == 1 and other[None, 1]["n_linked"] == 0 and sorted(r["position"] for r in got.where("conv_id is null").collect()) == [1, 2, 3]


def test_policies_and_ablations(spark):
    rows = rules.ledger(spark.read.parquet(f"{SF}/documents.parquet"))
    kept = {v: rules.apply_policy(rows, v).where("kept").count() for v in rules.POLICIES}
    assert kept[1] >= kept[2] >= kept[3] > 0
    found = {r["rule"]: r for r in rules.ablations(rows, 3).collect()}
    for name, r in found.items():
        bit = 1 << rules.RULES.index(name)
        assert r["failing"] == rows.where(f"fail_bits & {bit} <> 0").count() and r["failing_alone"] == rows.where(f"fail_bits = {bit}").count()


def test_rules_use_no_python(spark):
    plan = rules.op5(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.materialize(stage(spark, before, SF), name)
        assert docs.columns == before.columns and docs.count() <= before.count()
    final = {r["doc_id"] for r in docs.select("doc_id").collect()}
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == final
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert not good & final and not {r["doc_id"] for r in decontam.op2(spark, SF).collect()} & final


def brute_pipeline(spark, sf_dir):
    """doc_id and token ids of what every stage keeps, stage by stage in plain Python;
    only the verdicts of the fitted classifier are taken as they are."""
    table = common.documents(spark, sf_dir)
    bad = {r["doc_id"] for r in quality.classify(table, common.labels(spark, sf_dir)).where("predicted = 0").collect()}
    docs = {r["doc_id"]: r["text"] for r in table.collect() if r["doc_id"] not in bad}
    # near duplicates
    sets = {}
    for i, t in docs.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in docs}
    for i, j in itertools.combinations(sorted(docs), 2):
        if sets[i] and sets[j] and root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    docs = {i: t for i, t in docs.items() if root[i] == i}
    # repeats of 100 bytes
    seen = set()
    for i in sorted(docs):
        text = docs[i].encode()
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - 99):
            window = text[k : k + 100]
            if window in seen:
                gone[k : k + 100] = True
            seen.add(window)
        docs[i] = bytes(b for b, x in zip(text, gone) if not x).decode("utf-8", "ignore")
    # benchmark
    index = collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = r["text"].lower().split()
        for k in range(len(w) - 7):
            index[tuple(w[k : k + 8])].add(r["item_id"])
    for i in list(docs):
        w, hits = docs[i].lower().split(), collections.Counter()
        for k in range(len(w) - 7):
            hits.update(index.get(tuple(w[k : k + 8]), ()))
        if max(hits.values(), default=0) >= 5:
            del docs[i]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {i: library.encode_ordinary(t) for i, t in docs.items()}


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline

    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == brute_pipeline(spark, SF)


def test_stages_take_all_kinds_of_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, rows without an id,
    and extra columns with names that the operators use."""
    import corpus_pipeline

    clash = ("id", "slot", "spans", "own", "cls", "key", "h", "t", "y", "stats", "root", "least", "comp", "row", "item_id", "score", "predicted", "ids", "n_tokens")
    good = "A quiet morning in the harbour began with fishermen who mended their nets, while {} gulls waited on the wall for whatever the tide would bring. Nobody hurried, and the bell of the small church counted hours that did not matter much to anyone there."
    texts = [good.format("seven"), None, "", " \n\t", " ".join(f"word{i % 9973}" for i in range(200_000)), "Ünïcode 日本語 " * 3, good.format("nine hundred and fifty noisy") + " Later the rain came over the hills and washed the boats."]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", None if i % 2 else 5) for i, t in enumerate(texts)]
    rows += [rows[0], rows[1], (None, "A row without an id tells of a garden behind the old school, where pears ripened late and children learned the names of birds from a patient teacher.", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(clash)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            got = stage(spark, table, SF)
            assert got.columns == docs.columns, name
            kept = got.collect()
            assert len(kept) <= table.count() and {r["doc_id"] for r in kept} <= {*range(len(texts)), None}
            if name in ("repeats", "benchmark"):
                assert len(kept) == table.count()
            if name == "near_duplicates" and kept:
                assert sorted(map(str, (r["doc_id"] for r in kept))) == sorted(map(str, [*range(len(texts)), 0, 1, None, None]))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(rows) and last.where("n_tokens = 0").count() == 4


def test_pipeline_takes_empty_tables(spark):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, common.documents(spark, SF).limit(0), SF).count() == 0


def test_stages_write_no_more_files_than_cores(spark, monkeypatch):
    """Small tables, also where the session keeps more shuffle partitions than they need."""
    import corpus_pipeline

    files, plain = {}, common.materialize

    def seen(df, name):
        table = plain(df, name)
        files[name] = max(files.get(name, 0), len(table.inputFiles()))
        return table

    monkeypatch.setattr(common, "materialize", seen)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400").coalesce(1)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = seen(stage(spark, docs, SF), name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("quality-fit", "decontam-candidates"):  # of op3 and op2, as they were
        files.pop(name)
    assert {"jaccard-met", "jaccard-families", "jaccard-links", "suffix-marks", "suffix-pieces", "suffix-spans", "decontam"} < set(files)
    assert max(files.values()) <= spark.sparkContext.defaultParallelism, files


def test_long_texts_keep_their_partitions(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = common.merged(docs.repartition(40), docs=docs).rdd.getNumPartitions()
    assert few == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(common, "BYTES", 1 << 10)
    assert common.merged(docs.repartition(40), docs=docs).rdd.getNumPartitions() == 40
    monkeypatch.undo()
    made = spark.createDataFrame([(1, "a")], "doc_id long, text string")  # its size is not known
    assert common.merged(made.repartition(9), docs=made.join(made, "doc_id")).rdd.getNumPartitions() == 9
