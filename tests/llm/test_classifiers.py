"""Quality, toxicity and language: parts by brute force, wholes by held-out labels."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import common, langid, quality, toxicity


def test_held_out_quality_and_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    for query, label, least in ((quality.op3, "quality", 0.97), (toxicity.op10, "toxic", 0.85)):
        rows = query(spark, sf).toPandas().merge(labels, on="doc_id")
        assert rows.score.between(0, 1).all()
        held = rows[rows.held_out]
        rank = held.score.rank()
        y = held[label] == 1
        assert (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()) > least


def test_isotonic():
    x, p = quality.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(p) >= 0).all() and p[0] == 0 and p[-1] == 1 and abs(np.interp(2.5, x, p) - 0.5) < 1e-9


def test_grammar():
    m = toxicity.Matcher(dict.fromkeys(["idiot", "lowei*"], 1.0))
    name = lambda t: [toxicity.READINGS[r] for r, _ in m.clause(t)]
    assert name("such an idiot here") == ["plain"] and name("you are an idiot") == ["targeted"] and name("he is not an idiot") == ["negated"]
    assert name("she said that an idiot came") == ["reported"] and name("i will kill them") == ["threat"] and name("ein loweischaft da") == ["plain"]
    assert name('the word "idiot" in a clause') == ["reported"] and name('an idiot "here" now') == ["plain"] and name('an " idiot') == ["plain"] and name("idiot as you are") == ["targeted"]
    assert name("he said i will kill you") == ["threat_reported"] and name("will not kill you") == ["threat_negated"]
    assert m.readings("Fine text. IDIOT!! idiotic")[0] == 1 and m.readings(None).sum() == 0 and m.readings("kill the process").sum() == 0
    assert m.readings("idiot " * 400)[0] == 400
    assert m.readings('"' + "very " * 300 + "idiot " + "very " * 300 + '"')[3] == 1


def brute_readings(symbols):
    """Readings by looking around each insult and threat."""
    T = toxicity

    def before(i, kind, span, through=()):
        for s in reversed(symbols[:i]):
            if s == kind:
                return True
            span -= s not in (*through, T.QUOTE)
            if not span:
                return False
        return False

    out = []
    for i, s in enumerate(symbols):
        ahead = T.TARGET in [x for x in symbols[i + 1 :] if x != T.QUOTE][:2]
        negated, target, modal = before(i, T.NEGATION, 3, (T.TARGET,)), before(i, T.TARGET, 4, (T.NEGATION,)), before(i, T.MODAL, 3, (T.NEGATION,))
        reported = before(i, T.REPORT, 12) or symbols[:i].count(T.QUOTE) % 2 == 1 and T.QUOTE in symbols[i + 1 :]
        name = ""
        if s == T.INSULT:
            name = "negated" if negated else "reported" if reported else "targeted" if target or ahead else "plain"
        if s == T.THREAT and (modal or ahead):
            name = "threat_negated" if negated else "threat_reported" if reported else "threat"
        out.append(T.READINGS.index(name) + 1 if name else 0)
    return out


def test_composed_machines_read_like_looking_around():
    rng = random.Random(8)
    for _ in range(4000):
        symbols = [rng.choices(range(8), [6, 3, 2, 1, 1, 1, 1, 1])[0] for _ in range(rng.randrange(40))]
        assert toxicity.read(symbols) == brute_readings(symbols)


def test_toxicity_does_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.unionByName(docs)  # repeated rows
    models = [toxicity.fit(docs.repartition(n, "text") if n > 1 else docs.coalesce(1), labels) for n in (1, 16)]
    assert models[0].entries == models[1].entries and np.allclose(models[0].weights, models[1].weights, atol=1e-9)
    once = toxicity.fit(docs.distinct(), labels)
    assert once.entries == models[0].entries and np.allclose(once.weights, models[0].weights, atol=1e-9)


def test_bound_of_labelled_rows(spark):
    """One id with many rows and labels does not pass the bound; equal rows count once."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "same")] * 50 + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (None, 1), (9, 1)], "doc_id long, toxic int")
    rows = common.labelled(docs, labels, "toxic", ["text"], None, 20)
    assert rows.count() == 20 and common.labelled(docs, labels, "toxic", ["text"], None, 10_000).count() == 1002
    assert common.labelled(docs, labels, "toxic", ["text"], F.col("doc_id") > 1, 10_000).count() == 2


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    for lengths in ([1], [5, 1, 70, 33], [32, 64, 2], [200]):
        emit, trans = rng.normal(size=(sum(lengths), 3)) * 2, rng.normal(size=(3, 3))
        got, at = langid.marginals(emit, trans, np.array(lengths)), 0
        for n in lengths:
            e = emit[at : at + n]
            a, b = np.zeros((n, 3)), np.zeros((n, 3))
            a[0] = e[0]
            for t in range(1, n):
                a[t] = e[t] + np.logaddexp.reduce(a[t - 1][:, None] + trans, 0)
            for t in range(n - 2, -1, -1):
                b[t] = np.logaddexp.reduce(trans + (e[t + 1] + b[t + 1])[None], 1)
            assert np.allclose(np.exp(a + b - np.logaddexp.reduce(a[-1])), got[at : at + n])
            at += n


def test_gradient_is_that_of_the_likelihood():
    """Against differences of the log-likelihood that sums over all labelings."""
    rng = np.random.default_rng(3)
    words, tags, k = "a b c a b d".split(), np.array([0, 1, 2, 2, 0, 1]), 3
    chain = langid.Chain(words, tags)
    slots = np.unique(chain.slots)
    weights, trans = np.zeros((langid.SLOTS, k)), rng.normal(size=(k, k))
    weights[slots] = rng.normal(size=(len(slots), k))

    def likelihood():
        slots_, has = langid.features(words)
        emit = np.stack([weights[s[h]].sum(0) / np.sqrt(h.sum()) for s, h in zip(slots_, has)])

        def total(path):
            return sum(emit[i, y] for i, y in enumerate(path)) + sum(trans[x, y] for x, y in zip(path, path[1:]))

        return total(tags) - np.logaddexp.reduce([total(p) for p in itertools.product(range(k), repeat=len(words))])

    grad, grad_t = chain.gradient(weights, trans)
    for table, found, places in ((trans, grad_t, list(np.ndindex(k, k))), (weights, grad, [(s, j) for s in slots[:10] for j in range(k)])):
        for at in places:
            old, step = table[at], 1e-5
            table[at] = old + step
            up = likelihood()
            table[at] = old - step
            down = likelihood()
            table[at] = old
            assert abs((up - down) / (2 * step) - found[at]) < 1e-6
    long = langid.Chain(words * 40, np.tile(tags, 40))  # over several blocks: pairs sum to the transitions
    pairs = np.zeros((k, k))
    langid.marginals(rng.normal(size=(240, k)), trans, np.array([100, 1, 139]), pairs=pairs)
    assert abs(pairs.sum() - 237) < 1e-6 and np.allclose(langid.Chain.unpack(long.pack()).gradient(weights, trans)[1], long.gradient(weights, trans)[1])


def test_language_fit_is_bounded_in_rows(spark):
    """One id with many rows; ties; one language; no language."""
    docs = spark.createDataFrame([(1, f"the words of row {i} and the others", "en") for i in range(400)] + [(2, "les mots de la ligne et les autres", "fr")] * 9 + [(3, None, "de"), (4, "x y", None)], "doc_id long, text string, lang string")
    assert langid.fit(docs.where("lang = 'en'"), F.lit(True)).langs == ["en"]
    assert langid.fit(docs.where("lang is null"), F.lit(True)).langs == []
    model = langid.fit(docs, F.lit(True), 300)
    assert set(model.langs) <= {"en", "fr"}
    flat = langid.Model(["de", "en"], np.zeros((langid.SLOTS, 2), np.float32), np.zeros((2, 2)))
    assert [r["lang_pred"] for r in langid.identify(docs.where("doc_id > 2").orderBy("doc_id"), flat).collect()] == ["und", "de"]


def test_language_query(spark):
    rows = langid.op8(spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_code_switched_words(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog are in the house with that thing " * 5, "en"), ("le chat et le chien sont dans la maison avec une chose " * 5, "fr")] * 20)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    mixed = spark.createDataFrame([(0, "the dog and the house le chien et la maison"), (1, "12 34")], "doc_id long, text string")
    tags = {r["doc_id"]: r["langs"] for r in langid.label_words(mixed, model).collect()}
    assert tags[0] == ["en"] * 5 + ["fr"] * 5 and tags[1] == []
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(mixed, model).collect()}[1] == "und"
