"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, line_dedup, mixing, ngram_join, pii, quality, secrets, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_collapse": chat.op1_chat_collapse,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_mixing": mixing.op4_mixing,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_url_filter": urls.op7_url_filter,
        "op8_ngram_join": ngram_join.op8_ngram_join,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_personal_data": pii.op10_personal_data,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_collapse": chat.OP1_SQL,
        "op2_quality_rules": quality.OP2_SQL,
        "op4_mixing": mixing.OP4_SQL,
        "op5_line_dedup": line_dedup.OP5_SQL,
        "op7_url_filter": urls.OP7_SQL,
        "op8_ngram_join": ngram_join.OP8_SQL,
        "op9_decontaminate": decontaminate.OP9_SQL,
    }
