"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, ctw, decontam, jaccard, langid, quality, quotes, rules, suffix, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": bpe.op1,
        "op2_template_join": decontam.op2,
        "op3_quality_rff": quality.op3,
        "op4_run_index": suffix.op4,
        "op5_rule_ledger": rules.op5,
        "op6_parity_sketch": jaccard.op6,
        "op7_context_tree": ctw.op7,
        "op8_language_crf": langid.op8,
        "op9_quotation_links": quotes.op9,
        "op10_toxicity_grammar": toxicity.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_run_index": suffix.OP4_SQL, "op5_rule_ledger": rules.OP5_SQL, "op6_parity_sketch": jaccard.OP6_SQL, "op9_quotation_links": quotes.OP9_SQL}
