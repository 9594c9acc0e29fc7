"""Training-data operators.  Nothing outside this subpackage imports it; __spark_entry__.py asks it for its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, language, licenses, matroska, packing, secrets, similarity, suffixes, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        language.op1_language_id,
        secrets.op2_secret_scan,
        licenses.op3_license_scan,
        decontaminate.op4_decontaminate,
        suffixes.op5_suffix_dedup,
        similarity.op6_jaccard_join,
        matroska.op7_matroska,
        chat.op8_chat_format,
        urls.op9_url_filter,
        packing.op10_best_fit_packing,
    ]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it; the other queries are held against brute force in tests/llm."""
    return {"op4_decontaminate": decontaminate.ORACLE, "op8_chat_format": chat.ORACLE, "op9_url_filter": urls.ORACLE}
