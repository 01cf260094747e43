"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kestrelq.llm import bpe, chat, decontaminate, langid, multiset, quality, repair, simhash, substring, wrapper


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.query,
        "op2_bpe": bpe.query,
        "op3_wrapper": wrapper.query,
        "op4_langid": langid.query,
        "op5_simhash": simhash.query,
        "op6_chat": chat.query,
        "op7_repair": repair.query,
        "op8_multiset": multiset.query,
        "op9_substring": substring.query,
        "op10_decontaminate": decontaminate.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_chat": chat.ORACLE_SQL, "op9_substring": substring.ORACLE_SQL, "op10_decontaminate": decontaminate.ORACLE_SQL}
