"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, embeddings, langid, licenses, line_dedup, minhash, mixing, pii, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": mixing.query,
        "op2_decontaminate": decontaminate.query,
        "op3_pii": pii.query,
        "op4_minhash": minhash.query,
        "op5_line_dedup": line_dedup.query,
        "op6_chat": chat.query,
        "op7_embeddings": embeddings.query,
        "op8_licenses": licenses.query,
        "op9_toxicity": toxicity.query,
        "op10_langid": langid.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.SQL,
        "op4_minhash": minhash.SQL,
        "op5_line_dedup": line_dedup.SQL,
        "op6_chat": chat.SQL,
        "op7_embeddings": embeddings.SQL,
    }
