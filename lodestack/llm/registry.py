"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable


def queries() -> dict[str, Callable]:
    """op1 to op10 and the corpus pipeline, each over its whole table."""
    import corpus_pipeline
    from lodestack.llm import chat, decontaminate, language, licenses, pieces, quality, repeats, shards, simhash, token_counts

    return {
        "op4_suffix_array_dedup": repeats.op4_suffix_array_dedup,
        "op1_license_scans": licenses.op1_license_scans,
        "op2_sentencepiece": pieces.op2_sentencepiece,
        "op3_sharding": shards.op3_sharding,
        "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
        "op7_language_id": language.op7_language_id,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict[str, str]:
    from lodestack.llm import decontaminate, repeats

    return {"op4_suffix_array_dedup": repeats.ORACLE_SQL, "op6_benchmark_decontamination": decontaminate.ORACLE_SQL}
