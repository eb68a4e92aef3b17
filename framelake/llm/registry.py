"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

import importlib

#: query -> (module, function)
OPERATORS = {
    "op1_crf_language": ("crf", "op1"),
    "op2_decontamination": ("decontaminate", "op2"),
    "op3_suffix_dedup": ("suffixdedup", "op3"),
    "op4_minhash_neardup": ("neardup", "op4"),
    "op5_quality": ("quality", "op5"),
    "op6_chat_formatting": ("chat", "op6"),
    "op7_toxicity": ("toxicity", "op7"),
    "op8_hilbert_sharding": ("sharding", "op8"),
    "op9_media_columns": ("media", "op9"),
    "op10_sentencepiece": ("sentencepieces", "op10"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"framelake.llm.{module}"), function) for name, (module, function) in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    from framelake.llm import chat

    return {"op6_chat_formatting": chat.SQL}
