"""Queries and SQL of the text operators, for the entry module."""

from __future__ import annotations

import importlib
import importlib.util

#: Query name -> module of this package; a module has query(spark, sf_dir) and, where SQL can express it, SQL.
MODULES = {
    "op1_ngram_jaccard_join": "op1_jaccard",
    "op2_substring_dedup": "op2_substring",
    "op3_lm_scoring": "op3_brown",
    "op4_sentencepiece": "op4_sentencepiece",
    "op5_exact_dedup": "op5_exact",
    "op6_suffix_array_dedup": "op6_suffix",
    "op7_pii": "op7_pii",
    "op8_decontamination": "op8_decontam",
    "op9_quality_classifier": "op9_quality",
    "op10_chat_formatting": "op10_chat",
    "op11_collocations": "op11_collocations",
    "op12_embedding_dedup": "op12_embeddings",
    "op13_fill_in_middle": "op13_fim",
}


def _modules():
    return {name: importlib.import_module(f"{__package__}.{m}") for name, m in MODULES.items() if importlib.util.find_spec(f"{__package__}.{m}")}


def queries():
    return {name: m.query for name, m in _modules().items()}


def oracle_sql():
    return {name: m.SQL for name, m in _modules().items() if getattr(m, "SQL", None)}
