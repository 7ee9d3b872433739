"""Queries of the corpus operators and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riftscan.llm import centroids, decontamination, html, jaccard, language, packing, pii, quality, repeats, sharding, spelling, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": language.op1_language,
    "op2_packing": packing.op2_packing,
    "op3_pii": pii.op3_pii,
    "op4_sharding": sharding.op4_sharding,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality.op6_quality,
    "op7_repeats": repeats.op7_repeats,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_html": html.op10_html,
    "op11_urls": urls.op11_urls,
    "op12_spelling": spelling.op12_spelling,
    "op13_centroids": centroids.op13_centroids,
}

ORACLE_SQL: dict[str, str] = {
    "op8_decontamination": decontamination.OP8_SQL,
    "op9_ngram_jaccard": jaccard.OP9_SQL,
    "op12_spelling": spelling.OP12_SQL,
    "op13_centroids": centroids.OP13_SQL,
}
