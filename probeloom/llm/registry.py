"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from probeloom.llm import (
    bpe, chat_paths, exact_dedup, near_dedup, neighbours, packing, periodic_runs, quality, resampling, substring_dedup, suffix_dedup, toxicity,
    warc,
)


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_packing": packing.op2_packing,
        "op3_bpe": bpe.op3_bpe,
        "op4_quality": quality.op4_quality,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_neighbours": neighbours.op8_neighbours,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_warc": warc.op10_warc,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_chat_paths": chat_paths.op12_chat_paths,
        "op13_resampling": resampling.op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {**exact_dedup.SQL, **warc.SQL, **chat_paths.SQL}
