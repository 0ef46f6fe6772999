"""A training corpus from raw documents: five stages, each written and read again by the next.

Toxic documents go; of each group of near duplicates one document stays; documents that hold a benchmark passage go;
sources are mixed to their target weights; the rest is encoded into table files of token ids.

Defined cases, the same in all stages: a null or empty text is not toxic, duplicates and holds nothing, and gives the end id alone; rows with
one identifier count as one document where duplicates and benchmark passages are judged, and each by its own text for toxicity; rows with a null identifier are never duplicates,
and are judged together against the benchmark; a null source is a source of its own; very long texts are worked on whole; equal rows share their fate, but for the
number of their copies; an empty table gives an empty result; columns other than those of ``documents`` are left out by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm import decontamination, mixing, near_duplicates, token_tables, toxicity
from tidebook.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on all labels, scores under 0.5."""
    return toxicity.accepted(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def drop_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.deduplicated(docs).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their draws, so that sources reach their target shares, in shuffled order."""
    return mixing.poisson_mix(docs).select(COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in table files; places, counts and checksums as read back from them."""
    return token_tables.token_tables(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_tables", write_tokens),
]

#: The classifier and the signatures are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
