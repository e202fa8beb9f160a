"""Byte pairs, edge tables of all operators, and SQL oracles."""

import base64
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from textloom.llm import bpe, ctw, decontam, jaccard, langid, quality, queries, rules, suffix, toxicity


SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
TEXTS = ["A plain text of a few words. It has two sentences and 12 numbers.", None, "", "   \n\t ", "x", LONG, "same same same same same same same same same same", "dup text that occurs twice in the table, word for word, with enough bytes to be a repeat of one hundred bytes", "dup text that occurs twice in the table, word for word, with enough bytes to be a repeat of one hundred bytes", "Ünïcode 日本語 текст 🌍 <|endoftext|>", " non breaking", "a\x00b\x1c c"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, stats string, cls string"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    rows = [(i, t, "en" if i % 3 else None, None, None, 1.5, -1, "s", "c") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[0], (None, "a row without an id", "de", "s", 1, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 4)) for i in range(len(TEXTS))] + [(None, 1, 1), (3, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "bpe": lambda s, d, l: bpe.encode_documents(d, PATH, public_tokenizers.PATTERN),
    "decontam": lambda s, d, l: decontam.contaminated(d, s.createDataFrame([(0, TEXTS[0]), (1, None), (None, "x y z u v w"), (2, "")], "item_id long, text string")),
    "quality": lambda s, d, l: quality.classify(d, l),
    "suffix": lambda s, d, l: suffix.dedup(d),
    "rules": lambda s, d, l: rules.apply_policy(rules.ledger(d)),
    "jaccard": lambda s, d, l: jaccard.link(d),
    "ctw": lambda s, d, l: ctw.score(d, d),
    "langid": lambda s, d, l: langid.identify(d, langid.fit(d, F.lit(True))),
    "toxicity": lambda s, d, l: toxicity.score(d, toxicity.fit(d, l)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, edge, labels, name):
    run = OPERATORS[name]
    got = run(spark, edge, labels).toPandas()
    assert len(got) == (2 if name == "decontam" else edge.count())
    assert run(spark, edge.limit(0), labels.limit(0)).count() == 0
    for c in ("score", "base_score"):
        if c in got:
            assert got[c].notna().all()


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        raw = file.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe.Encoder(raw, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(codec):
    ours, theirs = codec
    rng = random.Random(5)
    texts = [t or "" for t in TEXTS] + ["a" * 3000, "ab" * 1500, "=-" * 700, "".join(rng.choice("etaoin") for _ in range(2000)), "\U0001d7d8 \U0001d400"]
    texts += ["".join(rng.choice([chr(rng.randrange(32, 127)), chr(rng.randrange(160, 700)), " ", "\n"]) for _ in range(rng.randrange(200))) for _ in range(150)]
    for text, ids in zip(texts, ours.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()


def test_bpe_query(spark, codec):
    got = bpe.op1(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    for i, text in zip(docs.doc_id, docs.text):
        ids = np.array(codec[1].encode_ordinary(text), "<u4")
        assert got.loc[i, "n_tokens"] == len(ids) and got.loc[i, "ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest() and got.loc[i, "decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_decode_ids(spark):
    docs = spark.createDataFrame([(0, "Hello wörld"), (1, None)], "doc_id long, text string")
    back = bpe.decode_ids(bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {0: "Hello wörld", 1: ""}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted(want.select(*[f'"{c}"' for c in cols]).fetchall(), key=repr)
