"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Document statistics of the whole text are standardised and mapped to random Fourier
features that approximate a Gaussian kernel. Normal equations are summed inside each
partition and only those fixed-size sums meet; their solution is the ridge score.
Isotonic regression (pool adjacent violators) on scores of rows that the scoring
model did not see turns it into a probability.

The standardised statistics themselves stand beside the Fourier features, so the ridge
score has a linear part too.

Fit bound: at most FIT_ROWS labelled rows, those with the smallest hash of their id
(a documented parameter, counted after labels have met documents). Scoring covers
every row.

Defined cases: null or empty text: statistics are zero, the score is that of a text
without words; rows with equal id, statistics and label count once; labels of
unknown documents and null labels are ignored; without labels of both classes every
score is the share of label 1 (0.5 without labels); repeated rows get equal scores;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound of the rows used for fitting, random features, kernel width and penalty.
FIT_ROWS, FEATURES, WIDTH, RIDGE, SEED = 20_000, 256, 3.0, 1e-3, 7
THRESHOLD = 0.3

_CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "digit": "0123456789",
    "space": common.WS,
    "stop": ".?",
    "comma": ",;:",
    "bang": "!",
    "symbol": "#*$%&|<>",
    "quote": "\"'()[]{}",
    "slash": "/\\=@_~^+-",
}
_LONGEST = re.compile(rb"[^\x20\x09-\x0D]{25,}")


def statistics(text: bytes) -> list[float]:
    """Statistics of one UTF-8 text; all zero without words."""
    words = text.split()
    if not words:
        return [0.0] * N_STATISTICS
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = [counts[list(chars.encode())].sum() / n for chars in _CLASSES.values()]
    p = counts[counts > 0] / n
    distinct = len(set(words))
    grams = len(set(zip(words, words[1:], words[2:])))
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbol_words = sum(1 for w in words if w[-1] in b"#*$%&|<>!")
    return [
        *shares,
        counts[128:].sum() / n,
        float(-(p * np.log2(p)).sum()),
        np.log1p(len(words)),
        n / len(words),
        distinct / len(words),
        1 - grams / max(len(words) - 2, 1) if len(words) > 2 else 0.0,
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(len(words) / max(len(lines), 1)),
        symbol_words / len(words),
        sum(map(len, _LONGEST.findall(text))) / n,
        words.count(b"|") / len(words),
        sum(1 for w in words if w.isupper()) / len(words),
    ]


N_STATISTICS = len(_CLASSES) + 12


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and `stats` (array<double>) of every whole text."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                rows = np.array([statistics(t) for t in common.texts_of(part)], np.float64).reshape(-1, N_STATISTICS)
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * N_STATISTICS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, stats array<double>")


class Kernel:
    """Standardisation and random Fourier features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = draw.normal(0, 1 / width, (len(mean), features))
        self.b = draw.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(x), 1)), z, np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)])


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), increasing; equal scores
    are one knot."""
    order = np.argsort(score, kind="stable")
    values, first, counts = np.unique(score[order], return_index=True, return_counts=True)
    sums = np.add.reduceat(label[order].astype(float), first) if len(first) else np.array([])
    blocks: list[list[float]] = []
    for v, s, n in zip(values, sums, counts):
        blocks.append([s, n, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s1, n1, _, hi = blocks.pop()
            blocks[-1][0] += s1
            blocks[-1][1] += n1
            blocks[-1][3] = hi
    knots = [(x, s / n) for s, n, lo, hi in blocks for x in ((lo, hi) if hi > lo else (lo,))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def _matrix(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


class Model:
    """What scoring needs: kernel, ridge weights and calibration knots."""

    def __init__(self, kernel: Kernel | None, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray], share: float) -> None:
        self.kernel, self.weights, self.knots, self.share = kernel, weights, knots, share

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.kernel is None or not len(x):
            return np.full(len(x), self.share)
        raw = self.kernel(x) @ self.weights
        level = np.interp(raw, *self.knots)
        # a share of the raw score keeps the order inside the steps of the calibration
        return np.clip(0.99 * level + 0.01 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", train=None, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled rows for which `train` (a column over doc_id) holds."""
    data = common.materialize(common.labelled(stats, labels, label, ["stats"], train, fit_rows).select("stats", "y", F.pmod("h", F.lit(4)).cast("int").alias("fold")), "quality-fit")
    k = N_STATISTICS
    moments = data.agg(F.count("*").alias("n"), F.sum("y").alias("s"), *[F.avg(F.get("stats", F.lit(i))).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(F.get("stats", F.lit(i))).alias(f"d{i}") for i in range(k)]).first()
    n, positive = moments["n"], moments["s"] or 0.0
    if n == 0 or positive in (0, n):
        return Model(None, np.array([]), (np.array([]), np.array([])), positive / n if n else 0.5)
    kernel = Kernel(np.array([moments[f"m{i}"] for i in range(k)]), np.array([moments[f"d{i}"] or 1.0 for i in range(k)]) + 1e-9)

    def sums(batches):
        """Normal equations of one partition, by fold; one row a fold."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            y, fold = batch.column("y").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)
            z = np.hstack([kernel(_matrix(batch)), y[:, None]])
            for f in np.unique(fold).tolist():
                total[f] = total.get(f, 0) + z[fold == f].T @ z[fold == f]
        for f, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([m.astype("<f8").tobytes()], pa.binary())], names=["fold", "m"])

    # the fit rows are bounded, so a fixed number of partial sums reaches the driver
    parts = data.coalesce(4).mapInArrow(sums, "fold int, m binary").collect()
    size = 2 + k + FEATURES
    folds = {f: sum((np.frombuffer(r["m"], "<f8").reshape(size, size) for r in parts if r["fold"] == f), np.zeros((size, size))) for f in range(4)}

    def solve(total: np.ndarray) -> np.ndarray:
        a, b = total[:-1, :-1], total[:-1, -1]
        return np.linalg.solve(a + RIDGE * max(total[0, 0], 1) * np.diag([1e-9, *[1.0] * (len(b) - 1)]), b)

    whole = sum(folds.values())
    out_of_fold = {f: solve(whole - folds[f]) for f in folds}

    def held(batches):
        for batch in batches:
            fold, z = batch.column("fold").to_numpy(zero_copy_only=False), kernel(_matrix(batch))
            raw = np.einsum("ij,ij->i", z, np.array([out_of_fold[f] for f in range(4)])[fold])
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("y")], names=["raw", "y"])

    pairs = data.mapInArrow(held, "raw double, y double").toPandas()  # at most fit_rows rows
    return Model(kernel, solve(whole), isotonic(pairs["raw"].to_numpy(), pairs["y"].to_numpy()), positive / n)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model(_matrix(batch)), pa.float64())], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`."""
    stats = common.materialize(describe(docs), "quality-stats")
    model = fit(stats, labels, train=~common.is_remainder("doc_id", modulus, held))
    return score(stats, model).select("doc_id", common.is_remainder("doc_id", modulus, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document, learning labels of those whose remainder by 5 is not 0. Null
    and empty texts have zero statistics; rows without an id are scored, not learned from;
    an empty table gives an empty result; other columns are not read."""
    return classify(common.documents(spark, sf_dir), common.labels(spark, sf_dir))
