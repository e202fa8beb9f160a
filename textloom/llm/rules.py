"""Quality rules as a bitmask ledger, in DataFrame functions only.

`ledger` evaluates every rule once and stores the measurements and one failure bit
a rule. Policies are versioned masks over those bits: a verdict is one bitwise AND,
so a new policy or an ablation never reads the texts again.

Defined cases: a null text has no words, so all counts are 0 and the base rule on
short texts fails; an empty text likewise; repeated rows are judged independently;
a null doc_id stays null; clashing extra columns are ignored because only doc_id
and text are taken; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rule names by bit; the first two are the base rules.
RULES = ("few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "shouting", "table_cells")
#: Versioned policies: the rules that each one enforces.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "duplicate_lines"),
    3: RULES,
}
CURRENT = 3


def _let(value: Column, body) -> Column:
    """Bind an expression once for use inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, n: int = 5) -> Column:
    """Words covered by n-word windows that occur twice or more in the text.

    Windows are hashed, sorted with their position and compared with their
    neighbours, so the cost is n log n in the words of one text.
    """

    def windows(w: Column) -> Column:
        return F.array_sort(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.struct(F.xxhash64(F.slice(w, i, n)).alias("h"), i.alias("i"))))

    def covered(sorted_windows: Column) -> Column:
        def same(k: Column) -> Column:
            return F.get(sorted_windows, k)["h"]

        flagged = F.filter(sorted_windows, lambda p, k: (F.coalesce(same(k - 1) == p["h"], F.lit(False))) | (F.coalesce(same(k + 1) == p["h"], F.lit(False))))
        places = F.array_sort(F.transform(flagged, lambda p: p["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(n), i + n - 1 - acc["end"])).alias("n"), (i + n - 1).alias("end")))["n"]

    return F.when(F.size(words) > n, _let(words, lambda w: _let(windows(w), covered))).otherwise(0)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(common.WS))
    split = docs.select("doc_id", text.alias("t"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, common.WORD_SPLIT)).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(common.WS)) != "")
    joined = F.array_join("w", "")

    def left(keep: str) -> Column:
        return F.length(F.regexp_replace(joined, keep, ""))

    return split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        left(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("d"), F.size(x).alias("n"))).alias("lines"),
        _repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        left(r"\P{Lu}+").cast("long").alias("n_upper"),
        left(r"\P{L}+").cast("long").alias("n_letters"),
        left(r"[^|]+").cast("long").alias("n_bars"),
    ).select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.d").cast("long").alias("n_dup_lines"), "n_repeat_words", F.col("lines.n").cast("long").alias("n_lines"), "n_upper", "n_letters", "n_bars")


def _failures() -> dict[str, Column]:
    c = F.col
    return {
        "few_words": c("n_words") < 10,
        "repeated_words": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 8 * c("word_chars"),
        "duplicate_lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
        "long_words": c("word_chars") > 20 * c("n_words"),
        "shouting": 100 * c("n_upper") > 40 * c("n_letters"),
        "table_cells": 100 * c("n_bars") > 25 * c("n_words"),
    }


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `fail_bits` (bit k: rule k of RULES fails)."""
    bits = F.lit(0).cast("long")
    for k, name in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(_failures()[name], F.lit(1 << k)).otherwise(0).cast("long"))
    return measure(docs).withColumn("fail_bits", bits)


def mask(policy: int) -> int:
    return sum(1 << RULES.index(name) for name in POLICIES[policy])


def apply_policy(rows: DataFrame, policy: int = CURRENT) -> DataFrame:
    """Add base_failed and kept under a policy version."""
    bits = F.col("fail_bits")
    base = bits.bitwiseAND(F.lit(mask(1))) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & (bits.bitwiseAND(F.lit(mask(policy))) == 0)).withColumn("policy", F.lit(policy))


def ablations(rows: DataFrame, policy: int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and that fail it alone,
    that is, that the policy without the rule would keep."""
    enforced = mask(policy)
    patterns = rows.select(F.col("fail_bits").bitwiseAND(F.lit(enforced)).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    names = [F.struct(F.lit(k).alias("bit"), F.lit(name).alias("rule")) for k, name in enumerate(RULES) if enforced >> k & 1]
    each = patterns.select("bits", "n", F.explode(F.array(*names)).alias("r")).select("bits", "n", "r.*", F.expr("shiftleft(1L, r.bit)").alias("own"))
    return each.groupBy("bit", "rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("own")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("own"), F.col("n")).otherwise(0)).alias("failing_alone"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdicts of every document. Null and empty texts have no words and
    fail the base rule; a null id stays null; repeated rows are judged row by row; an empty
    table gives an empty result; other columns are not read."""
    rows = apply_policy(ledger(common.documents(spark, sf_dir)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM f, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_WS}) <> '') AS x FROM d),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
      (len(x) - len(list_distinct(x)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(x) AS n_lines,
      length(regexp_replace(array_to_string(w, ''), '\P{{Lu}}+', '', 'g')) AS n_upper, length(regexp_replace(array_to_string(w, ''), '\P{{L}}+', '', 'g')) AS n_letters,
      length(regexp_replace(t, '[^|]+', '', 'g')) AS n_bars
      FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 100 * n_symbols > 8 * word_chars THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
      + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_upper > 40 * n_letters THEN 32 ELSE 0 END
      + CASE WHEN 100 * n_bars > 25 * n_words THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b"""
