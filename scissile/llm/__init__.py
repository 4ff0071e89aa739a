"""Operators of a training-data pipeline; nothing else in the library imports them."""

from __future__ import annotations

from importlib import import_module

#: In the order of their numbers.
MODULES = ("mixing", "warc", "language_id", "quality_rules", "lm_scoring", "simhash", "sharding", "exact_dedup", "segmentation", "token_counts", "secrets", "divergence", "merkle")


def load() -> tuple[dict, dict]:
    """Queries and SQL of all operators."""
    queries, oracle = {}, {}
    for m in MODULES:
        module = import_module(f"{__name__}.{m}")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    pipeline = import_module("corpus_pipeline")  # at the top of the repository
    queries["pipeline"] = pipeline.run
    if pipeline.ORACLE_SQL:
        oracle["pipeline"] = pipeline.ORACLE_SQL
    return queries, oracle
