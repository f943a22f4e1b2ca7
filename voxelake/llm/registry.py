"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_WHERE = {
    "op1_html": "html_crf",
    "op2_quality": "quality",
    "op3_bpe": "bpe",
    "op4_near_dedup": "near_dedup",
    "op5_decontamination": "decontamination",
    "op6_url_filter": "url_filter",
    "op7_token_shards": "token_shards",
    "op8_sharding": "sharding",
    "op9_neighbours": "neighbours",
    "op10_toxicity": "toxicity",
    "op11_quality_rules": "quality_rules",
    "op12_conversations": "conversations",
    "op13_merkle": "merkle",
}

_WITH_SQL = ("op4_near_dedup", "op6_url_filter", "op8_sharding", "op9_neighbours", "op11_quality_rules", "op12_conversations", "op13_merkle")


def _lazy(module: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _lazy(module, name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    """The others train models or hash and encode as SQL engines don't; tests hold them to plain versions."""
    return {name: import_module(f"{__package__}.{_WHERE[name]}").ORACLE_SQL for name in _WITH_SQL}
