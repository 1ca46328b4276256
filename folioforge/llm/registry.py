"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query -> module; a module's ORACLE is the query's SQL, where it has one.
MODULES = {
    "op1_substring_dedup": "substring_dedup",
    "op2_toxicity": "toxicity",
    "op3_benchmark_decontamination": "decontaminate",
    "op4_url_filters": "url_filters",
    "op5_best_fit_packing": "packing",
    "op6_media_columns": "media",
    "op7_pii": "pii",
    "op8_html_extraction": "html_extract",
    "op9_token_counts": "token_counts",
    "op10_ngram_jaccard_join": "ngram_join",
    "op11_embedding_near_dedup": "metric_join",
    "op12_importance_resampling": "resample",
    "op13_ranked_search": "ranked_search",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}
    return found


def oracle_sql() -> dict[str, str]:
    sql = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: text for name, text in sql.items() if text}
