"""Queries of this package, one per operator, with reference SQL where SQL can express them."""

from __future__ import annotations

from . import (
    conversations,
    hard_negatives,
    licenses,
    lines,
    mixing,
    neighbours,
    packing,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    substrings,
    toxicity,
)


def queries() -> dict:
    return {
        "op1_neighbours": neighbours.op1_neighbours,
        "op2_lines": lines.op2_lines,
        "op3_licenses": licenses.op3_licenses,
        "op4_packing": packing.op4_packing,
        "op5_quality": quality_model.op5_quality,
        "op6_simhash": simhash.op6_simhash,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_mixing": mixing.op8_mixing,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_substrings": substrings.op10_substrings,
        "op11_conversations": conversations.op11_conversations,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_sharding": sharding.op13_sharding,
    }


def oracle_sql() -> dict:
    return {
        "op1_neighbours": neighbours.OP1_SQL,
        "op3_licenses": licenses.OP3_SQL,
        "op8_mixing": mixing.OP8_SQL,
        "op11_conversations": conversations.OP11_SQL,
        "op12_hard_negatives": hard_negatives.OP12_SQL,
        "op13_sharding": sharding.OP13_SQL,
    }
