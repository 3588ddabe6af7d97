"""What this subpackage registers: one query an operator, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import ann, cws, langid, mixing, ngram_lm, packing, pii, simhash, substring, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring.op1_substring_dedup,
        "op2_lm_score": ngram_lm.op2_lm_score,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_ann": ann.op4_ann,
        "op5_mix": mixing.op5_mix,
        "op6_pack": packing.op6_pack,
        "op7_langid": langid.op7_langid,
        "op8_simhash": simhash.op8_simhash,
        "op9_pii": pii.op9_pii,
        "op10_cws": cws.op10_cws,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring.DEDUP_SQL,
        "op5_mix": mixing.MIX_SQL,
    }
