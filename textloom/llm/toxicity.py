"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses once. A clause is a string of symbols: classes of its words
(insult, threat, target, negation, reported speech, modal) and quotation marks. A
machine that reads from the right adds to each symbol whether a target or a closing
quotation mark lies ahead; machines for negation, reported speech, targets, modals and
quotations, composed into one, read its output from the left and pass each symbol on
with their marks; the last one turns marked insults and threats into readings: plain,
targeted, negated or reported. Learned weights of the readings and of the lexicon
entries score the matched clauses; words outside a reading have no weight.

The lexicon is a short seed list plus entries learned from labelled rows: words, and
stems that inflected words begin with (`stem*`), that are frequent in texts with label
1 and very rare in texts with label 0. An entry weighs as much as the labels tell it
apart (the logarithm of that lift, relative to the least lift of a learned entry); a
seed that too few labelled texts hold weighs 1. The reading weights are a logistic
fit. Equal texts with equal labels count once, wherever they lie. Fit bound: FIT_ROWS
such texts (smallest hash of the id, a documented parameter, counted after the labels
have met the texts); scoring covers every whole text.

Defined cases: null and empty texts match nothing and get the score of such texts;
without labels of both classes the score is the share of label 1 (0.5 without
labels); null ids and null labels are not learned from; words are compared in lower
case; a clause is read whole, however long; repeated rows get equal scores; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound of labelled rows; least texts of label 1 and least ratio for a learned entry.
FIT_ROWS, LEAST_TEXTS, LEAST_SHARE, LEAST_LIFT = 20_000, 5, 0.005, 40.0
#: Letters of a stem; largest weight of an entry.
STEMS, HEAVIEST = range(4, 9), 2.0
THRESHOLD = 0.7

# Fixed word classes of the grammar.
INSULTS = "idiot moron stupid loser trash scum clown pathetic worthless disgusting fool imbecile dumb jerk filth vermin idiota imbécil estúpido dummkopf trottel versager crétin abruti".split()
THREATS = "kill hurt destroy beat burn punch stab shoot töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours you're youre u he she they him her them his their these those du dich ihr euch sie tu te vous toi usted tú ustedes".split()
NEGATIONS = "not no never nobody isn't aren't wasn't don't doesn't didn't nicht kein keine nie pas jamais nunca".split()
REPORTS = "said says say called calls claimed wrote writes reported quoted quote sagte schrieb écrit dijo".split()
MODALS = "will gonna shall must should should've werde wirst vais voy".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, MODAL, QUOTE = range(8)
CLASSES = 8
#: Marks of a symbol, above its class.
TARGET_AHEAD, QUOTE_AHEAD, NEGATED, REPORTED, TARGETED, INTENDED, QUOTED = (CLASSES << k for k in range(7))
READINGS = ("plain", "targeted", "negated", "reported", "threat", "threat_negated", "threat_reported")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”„«»]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE_END = re.compile(r"[.!?;:\n|]+(?=\s|$)|\n")


class Transducer:
    """A deterministic letter-to-letter transducer: step[state, symbol] and out[state, symbol]."""

    def __init__(self, states: int, symbols: int, rule) -> None:
        """rule(state, symbol) = (next state, output symbol)."""
        found = np.array([[rule(s, x) for x in range(symbols)] for s in range(states)])
        self.step, self.out = found[:, :, 0], found[:, :, 1]

    def then(self, other: Transducer) -> Transducer:
        """Composition: `other` reads what this one writes."""
        wide = len(other.step)
        both = object.__new__(Transducer)
        states = np.arange(wide)[None, :, None]
        both.step = (self.step[:, None, :] * wide + other.step[states, self.out[:, None, :]]).reshape(-1, self.step.shape[1])
        both.out = other.out[states, self.out[:, None, :]].reshape(both.step.shape)
        return both

    def rows(self) -> list[list[tuple[int, int]]]:
        """(next state, output) by state and symbol, for reading."""
        return [list(zip(a, b)) for a, b in zip(self.step.tolist(), self.out.tolist())]


def _recent(symbols: int, trigger: int, span: int, mark: int, through: tuple[int, ...] = ()) -> Transducer:
    """Adds `mark` to a symbol that comes within `span` words of `trigger`; classes in
    `through`, and quotation marks, do not use up the span."""

    def rule(left: int, x: int) -> tuple[int, int]:
        kind = x % CLASSES
        after = span if kind == trigger else left if kind in (*through, QUOTE) else max(left - 1, 0)
        return after, x | mark if left else x

    return Transducer(span + 1, symbols, rule)


def _inside(opened: int, x: int) -> tuple[int, int]:
    """Between two quotation marks of a clause."""
    if x % CLASSES == QUOTE:
        return 1 - opened, x
    return opened, x | QUOTED if opened and x & QUOTE_AHEAD else x


def _ahead(state: int, x: int) -> tuple[int, int]:
    """Read from the right: state is twice the span of the last target, plus whether there was a quotation mark."""
    left, quote = divmod(state, 2)
    seen = x | (TARGET_AHEAD if left else 0) | (QUOTE_AHEAD if quote else 0)
    left = 2 if x == TARGET else left if x == QUOTE else max(left - 1, 0)
    return 2 * left + (quote or x == QUOTE), seen


def _reading(_: int, x: int) -> tuple[int, int]:
    """One more than the reading of an insult or a threat, else 0."""
    kind = x % CLASSES
    name = None
    if kind == INSULT:
        name = "negated" if x & NEGATED else "reported" if x & (REPORTED | QUOTED) else "targeted" if x & (TARGETED | TARGET_AHEAD) else "plain"
    if kind == THREAT and x & (INTENDED | TARGET_AHEAD):
        name = "threat_negated" if x & NEGATED else "threat_reported" if x & (REPORTED | QUOTED) else "threat"
    return 0, READINGS.index(name) + 1 if name else 0


_ALL = CLASSES << 7
AHEAD = Transducer(6, CLASSES, _ahead)
#: Reads the output of AHEAD (classes with two marks) from the left.
GRAMMAR = (
    _recent(CLASSES << 2, NEGATION, 3, NEGATED, (TARGET,))
    .then(_recent(_ALL, REPORT, 12, REPORTED))
    .then(_recent(_ALL, TARGET, 4, TARGETED, (NEGATION,)))
    .then(_recent(_ALL, MODAL, 3, INTENDED, (NEGATION,)))
    .then(Transducer(2, _ALL, _inside))
    .then(Transducer(1, _ALL, _reading))
)
_AHEAD, _GRAMMAR = AHEAD.rows(), GRAMMAR.rows()


def read(symbols: list[int]) -> list[int]:
    """0, or one more than its reading, of each symbol of a clause."""
    state, marked = 0, []
    for x in reversed(symbols):
        state, y = _AHEAD[state][x]
        marked.append(y)
    state, out = 0, []
    for x in reversed(marked):
        state, y = _GRAMMAR[state][x]
        out.append(y)
    return out


class Matcher:
    def __init__(self, entries: dict[str, float]) -> None:
        """entries: insult words and stems (`stem*`) with lexicon weights."""
        self.entries = entries
        self.classes = {w: c for c, group in ((MODAL, MODALS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in group}
        self.classes |= dict.fromkeys('"“”„«»', QUOTE)
        self.find = ahocorasick.Automaton()
        for w in [*entries, *THREATS]:
            self.find.add_word(w.rstrip("*"), (len(w.rstrip("*")), w[-1] == "*"))
        self.find.make_automaton()

    def entry(self, word: str) -> str | None:
        """The lexicon entry that reads a word, the whole word first."""
        if word in self.entries:
            return word
        return next((e for k in STEMS if len(word) > k and (e := word[:k] + "*") in self.entries), None)

    def clause(self, text: str) -> list[tuple[int, float]]:
        """(reading, lexicon weight) of each insult or threat of one clause."""
        words = _TOKEN.findall(text)
        entries = [self.entry(w) for w in words]
        found = read([INSULT if e else self.classes.get(w, OTHER) for w, e in zip(words, entries)])
        return [(r - 1, self.entries[e] if e else 1.0) for r, e in zip(found, entries) if r]

    def readings(self, text: str | None) -> np.ndarray:
        """Summed lexicon weights by reading, of the clauses of a text that hold an entry
        or a threat."""
        out = np.zeros(len(READINGS))
        if not text:
            return out
        low = text.lower()
        places = []
        for end, (size, stem) in self.find.iter(low):
            start = end + 1 - size
            if (start == 0 or not low[start - 1].isalpha()) and (stem or end + 1 == len(low) or not low[end + 1].isalpha()):
                places.append(start)
        if not places:
            return out
        edges = [0, *(m.end() for m in _CLAUSE_END.finditer(low)), len(low)]
        for k in sorted({bisect_right(edges, at, hi=len(edges) - 1) - 1 for at in places}):
            for reading, weight in self.clause(low[edges[k] : edges[k + 1]]):
                out[reading] += weight
        return out


def _features(readings: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(readings), 1)), np.minimum(readings, 1), np.log1p(readings)])


class Model:
    def __init__(self, entries: dict[str, float], weights: np.ndarray | None, share: float) -> None:
        self.entries, self.weights, self.share = entries, weights, share

    def scores(self, readings: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(readings), self.share)
        return 1 / (1 + np.exp(-np.clip(_features(readings) @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the first column is the constant."""
    w = np.zeros(x.shape[1])
    ridge = penalty * len(x) * np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)]) + 1e-9 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train=None, fit_rows: int = FIT_ROWS) -> Model:
    texts = common.materialize(common.labelled(docs, labels, label, ["text"], train, fit_rows).select("text", "y").distinct(), "toxic-fit")
    counts = texts.agg(F.count("*").alias("n"), F.sum("y").alias("s")).first()
    n, positive = counts["n"], counts["s"] or 0.0
    if n == 0 or positive in (0, n):
        return Model(dict.fromkeys(INSULTS, 1.0), None, positive / n if n else 0.5)

    def words(batches):
        """Texts of each label that hold a word or begin one with a stem."""
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                found = set(_WORD.findall((text or "").lower()))
                for w in found | {w[:k] + "*" for w in found for k in STEMS if len(w) > k}:
                    seen.setdefault(w, [0, 0])[int(y > 0.5)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], names=["w", "clean", "toxic"])

    by_word = texts.mapInArrow(words, "w string, clean long, toxic long").groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = (F.col("toxic") / positive) / ((F.col("clean") + 0.5) / (n - positive))
    by_word = by_word.withColumn("lift", lift)
    # words and stems in a fixed share of the texts with label 1 are bounded by the words of a few hundred texts
    telling = (F.col("toxic") >= max(LEAST_TEXTS, LEAST_SHARE * positive)) & (F.col("lift") >= LEAST_LIFT)
    seeds = F.col("w").isin(INSULTS) & (F.col("toxic") + F.col("clean") >= LEAST_TEXTS)
    lifts = {r["w"]: r["lift"] for r in by_word.where(telling | seeds).select("w", "lift").collect()}
    names = {w for w, x in lifts.items() if x >= LEAST_LIFT} - set(THREATS) - set(INSULTS)
    names = {w for w in names if not any(len(w.rstrip("*")) > k and w[:k] + "*" in names for k in STEMS)}  # the shortest stem says it all
    entries = {w: min(float(np.log1p(lifts[w]) / np.log1p(LEAST_LIFT)), HEAVIEST) if w in lifts else 1.0 for w in [*INSULTS, *sorted(names)]}
    reads = collect_readings(texts.select("y", "text"), Matcher(entries), "y")
    pdf = reads.toPandas().sort_values("y", kind="stable")  # at most fit_rows short rows
    x = np.stack(pdf["readings"].to_numpy()) if len(pdf) else np.zeros((0, len(READINGS)))
    order = np.lexsort((*x.T, pdf["y"].to_numpy(float)))  # sums do not depend on where the rows were
    return Model(entries, logistic(_features(x[order]), pdf["y"].to_numpy(float)[order]), positive / n)


def collect_readings(rows: DataFrame, matcher: Matcher, key: str) -> DataFrame:
    """`key` and the readings of each text."""
    entries = matcher.entries

    def run(batches):
        own = Matcher(entries)
        for batch in batches:
            found = [own.readings(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.list_(pa.float64()))], names=[key, "readings"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, readings array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the readings of every whole text."""

    def run(batches):
        own = Matcher(model.entries)
        for batch in batches:
            for part in common.slices(batch):
                found = np.array([own.readings(t) for t in part.column("text").to_pylist()]).reshape(-1, len(READINGS))
                offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(READINGS))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(model.scores(found)), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], names=["doc_id", "score", "readings"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, readings array<double>")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document, learning labels of those whose remainder by 3 is not 1. Null
    and empty texts get the score of texts without a match; rows without an id are scored,
    not learned from; an empty table gives an empty result; other columns are not read."""
    docs = common.documents(spark, sf_dir)
    held = common.is_remainder("doc_id", 3, 1)
    model = fit(docs, common.labels(spark, sf_dir), train=~held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
