"""Queries and oracle SQL of the training-data operators, and the pipeline."""

from __future__ import annotations

import importlib

import corpus_pipeline

MODULES = ("token_records", "exact_dedup", "packing", "near_dedup", "mixing", "toxicity", "winnowing", "hmm_score", "language_id", "token_counts")


def _modules():
    return [importlib.import_module(f"ledgerlake.llm.{x}") for x in MODULES]


def queries() -> dict:
    out = {}
    for module in _modules():
        out |= module.QUERIES
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    out = {}
    for module in _modules():
        out |= getattr(module, "ORACLES", {})
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
