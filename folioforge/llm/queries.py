"""Queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import decontam, html_text, langid, packing, pii, quality_rules, simhash, token_store, url_graph, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        quality_rules.op1_quality_rules,
        html_text.op2_html_text,
        packing.op3_packing,
        decontam.op4_decontamination,
        warc.op5_warc,
        langid.op6_language_id,
        token_store.op7_token_store,
        pii.op8_pii,
        url_graph.op9_url_graph,
        simhash.op10_simhash,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.oracle(), "op4_decontamination": decontam.oracle(), "op5_warc": warc.oracle(), "op9_url_graph": url_graph.oracle()}
