"""Analytics of training runs: fits, moving averages, log scraping, comparison tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators.select import sent


def valid_runs(runs: DataFrame) -> DataFrame:
    """Runs with a usable loss, effective parameters and their ratio to tokens."""
    ok = F.col("val_bpb").isNotNull() & ~F.isnan("val_bpb") & (F.col("val_bpb") > 0)
    rows = runs.where(ok).withColumn("effective_params", F.col("params_transformer") + F.col("params_lm_head"))
    return rows.withColumn("ratio", F.col("tokens_trained") / F.col("effective_params"))


def ranked(runs: DataFrame, *by: Column) -> DataFrame:
    """Runs (a row each, so few) in the given order, numbered from 1."""
    return runs.withColumn("place", F.row_number().over(W.orderBy(*by)))


def quadratic_fit(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """a, b, c of the least-squares parabola of each group: power sums of x around its
    mean, a 3 x 3 system by Cramer's rule."""
    mean = df.groupBy(group).agg(F.avg(x).alias("mx"))
    c = df.join(sent(mean), group).withColumn("u", F.col(x) - F.col("mx")).withColumn("v", F.col(y))
    s = c.groupBy(group).agg(F.first("mx").alias("mx"), F.count("*").cast("double").alias("n"), *[F.sum(F.pow("u", F.lit(k))).alias(f"s{k}") for k in range(1, 5)], *[F.sum(F.pow("u", F.lit(k)) * F.col("v")).alias(f"t{k}") for k in range(3)])
    det = F.expr("n*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2)")
    c0 = F.expr("t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)") / det
    c1 = F.expr("n*(t1*s4-s3*t2) - t0*(s1*s4-s2*s3) + s2*(s1*t2-s2*t1)") / det
    c2 = F.expr("n*(s2*t2-s3*t1) - s1*(s1*t2-s2*t1) + t0*(s1*s3-s2*s2)") / det
    out = s.select(group, "mx", c0.alias("c0"), c1.alias("c1"), c2.alias("a"))
    return out.select(group, "a", (F.col("c1") - 2 * F.col("a") * F.col("mx")).alias("b"), (F.col("c0") - F.col("c1") * F.col("mx") + F.col("a") * F.col("mx") * F.col("mx")).alias("c"))


def interpolate(points: DataFrame, at: DataFrame, group: str, x: str, value: str, want: str) -> DataFrame:
    """`value` at `want` by linear interpolation between neighbours, clamped at the ends."""
    w = W.partitionBy(group).orderBy(x)
    pairs = points.select(group, F.col(x).alias("x0"), F.col(value).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(value).over(w).alias("y1"), F.row_number().over(w).alias("k"))
    joined = pairs.join(at.select(group, want), group)
    inside = ((F.col(want) >= F.col("x0")) | (F.col("k") == 1)) & (F.col("x1").isNull() | (F.col(want) < F.col("x1")))
    t = (F.greatest(F.col(want), F.col("x0")) - F.col("x0")) / (F.col("x1") - F.col("x0"))
    return joined.where(inside).select(group, F.when(F.col("x1").isNull(), F.col("y0")).otherwise(F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias(value))


def isoflop_optima(runs: DataFrame) -> DataFrame:
    """Optimal size of each compute budget: vertex of the parabola in log size, else the
    best run."""
    rows = valid_runs(runs).withColumn("x", F.log10("effective_params"))
    fit = quadratic_fit(rows, "flops_budget", "x", "val_bpb").withColumn("opt", -F.col("b") / (2 * F.col("a")))
    at = fit.where("a > 0")
    tokens = interpolate(rows.withColumn("tokens", F.col("tokens_trained").cast("double")), at, "flops_budget", "x", "tokens", "opt")
    ratio = interpolate(rows, at, "flops_budget", "x", "ratio", "opt")
    vertex = at.join(tokens, "flops_budget").join(ratio, "flops_budget").select("flops_budget", F.pow(F.lit(10.0), "opt").alias("params"), "tokens", "ratio", (F.col("a") * F.col("opt") * F.col("opt") + F.col("b") * F.col("opt") + F.col("c")).alias("bpb"))
    best = rows.join(fit.where("a <= 0").select("flops_budget"), "flops_budget").groupBy("flops_budget").agg(F.min_by(F.struct(F.col("effective_params").cast("double").alias("params"), F.col("tokens_trained").cast("double").alias("tokens"), "ratio", F.col("val_bpb").alias("bpb")), F.struct("val_bpb", "depth")).alias("s"))
    return vertex.unionByName(best.select("flops_budget", "s.*"))


def power_law(points: DataFrame, x: str, y: str) -> DataFrame:
    """Exponent, log10 factor and fit quality of y against x in log-log space."""
    lx, ly = F.log10(x), F.log10(y)
    return points.agg(F.regr_slope(ly, lx).alias("exponent"), F.regr_intercept(ly, lx).alias("log_factor"), F.regr_r2(ly, lx).alias("r2"))


#: Most steps of a block of a moving average; the weight that its last step may have.
EMA_BLOCK, EMA_WEIGHT = 4096, 1e100
#: Blocks whose ends may be broadcast.
EMA_ENDS = 1_000_000


def averaged(log: DataFrame, value: str, beta: float, order: str = "step", by: tuple[str, ...] = ()) -> DataFrame:
    """Add `__n`, the place from 0 of a row in its run, and `__e`, its moving average that
    starts at 0, exact over all steps. Inside a block it is a running sum of values
    weighted by beta ** -i, divided by the weight of the last; what a block hands to the
    next is folded over the blocks and added."""
    keys = list(by)
    span = max(1, min(EMA_BLOCK, int(math.log(EMA_WEIGHT) / -math.log(beta)))) if 0 < beta < 1 else 1 if beta == 0 else EMA_BLOCK
    rows = log.withColumn("__n", (F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1).cast("long"))
    rows = rows.withColumn("__b", F.floor(F.col("__n") / span)).withColumn("__i", F.col("__n") % span)
    weight = F.pow(F.lit(float(beta)), F.col("__i"))
    inside = F.sum((1 - beta) * F.col(value).cast("double") / weight).over(W.partitionBy(*keys, "__b").orderBy("__i").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("__l", inside * weight)
    ends = rows.where(F.col("__i") == span - 1).select(*keys, "__b", "__l")
    before = F.collect_list("__l").over(W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, 0))
    carry = ends.select(*keys, (F.col("__b") + 1).alias("__b"), F.aggregate(before, F.lit(0.0), lambda acc, x: acc * float(beta) ** span + x).alias("__c"))
    carry = F.broadcast(carry) if log.count() // span <= EMA_ENDS else carry  # a row a block
    handed = F.coalesce(F.pow(F.lit(float(beta)), F.col("__i") + 1) * F.col("__c"), F.lit(0.0))
    return rows.join(carry, [*keys, "__b"], "left").withColumn("__e", F.col("__l") + handed).drop("__b", "__i", "__l", "__c")


def debiased(beta: float, after_increment: bool = False) -> Column:
    """The debiased average of a row of `averaged`; with `after_increment` the power is one
    larger."""
    return F.col("__e") / (1 - F.pow(F.lit(beta), F.col("__n") + (2 if after_increment else 1)))


def ema(log: DataFrame, value: str, beta: float, order: str = "step", by: tuple[str, ...] = (), after_increment: bool = False, name: str = "ema") -> DataFrame:
    """Debiased exponential moving average of each run."""
    return averaged(log, value, beta, order, by).withColumn(name, debiased(beta, after_increment)).drop("__n", "__e")


def scrape(lines: DataFrame, patterns: dict[str, str], run: str = "run") -> DataFrame:
    """Last match of each pattern in the log of each run, commas dropped; null without one."""
    found = lines.select(run, "line_no", *[F.nullif(F.regexp_extract("line", p, 1), F.lit("")).alias(k) for k, p in patterns.items()])
    return found.groupBy(run).agg(*[F.replace(F.max_by(k, F.when(F.col(k).isNotNull(), F.col("line_no"))), F.lit(","), F.lit("")).alias(k) for k in patterns])


def first_match(rows: DataFrame, table: DataFrame, matches: Column, key: list[str], value: str, default: Column) -> DataFrame:
    """The value of the first table row (by ord) that matches, else the default. The
    table is a small constant, so it is broadcast."""
    joined = rows.join(sent(table, 10_000), matches, "left")
    return joined.groupBy(*key).agg(F.coalesce(F.min_by(value, "ord"), default).alias(value))


def missing_runs(wanted: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    return wanted.join(done.select(*key).distinct(), list(key), "left_anti")


def ridge(df: DataFrame, features: list[str], y: str, alpha: float) -> list[float]:
    """Intercept (not penalised) and weights, from sums of products: what reaches the
    driver is one row whatever the input."""
    import numpy as np

    cols = [F.lit(1.0), *[F.col(f) for f in features], F.col(y)]
    k = len(cols)
    row = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    m = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    return np.linalg.solve(m[:-1, :-1] + alpha * np.diag([0.0] + [1.0] * len(features)), m[:-1, -1]).tolist()
