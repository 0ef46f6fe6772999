"""The package's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontamination, embedding_dedup, language_id, masked_lm, mixing, near_duplicates, secrets, sharding, token_counts, token_tables, toxicity, whitening


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of the package."""
    return {
        "pipeline": pipeline,
        "op1_embedding_dedup": embedding_dedup.query,
        "op2_token_counts": token_counts.query,
        "op3_decontamination": decontamination.query,
        "op4_language_id": language_id.query,
        "op5_masked_lm": masked_lm.query,
        "op6_toxicity": toxicity.query,
        "op7_near_duplicates": near_duplicates.query,
        "op8_sharding": sharding.query,
        "op8b_shard_places": sharding.query_nocrc,
        "op9_mixing": mixing.query,
        "op10_token_tables": token_tables.query,
        "op11_embedding_whitening": whitening.query,
        "op12_conversation_repair": conversations.query,
        "op13_secret_scans": secrets.query,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that have it."""
    return {"op8b_shard_places": sharding.oracle(), "op9_mixing": mixing.oracle()}
