"""A training corpus from raw documents: language, near-duplicates, secrets, mix, packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import language, mixing, packing, secrets, similar
from tilewright.llm.common import documents, stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language: null, empty, without a letter, or of windows that fit none.

    Learns as the query does. Texts of any length are judged whole; repeated rows fare alike; equal counts go to the first
    language; an empty table, or one without a training row, gives no rows; other columns stay, whatever their names.
    """
    return language.with_language(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component: the smallest doc_id (null last), one row of it.

    Linked are fingerprints within op3's radius and texts whose five-word shingles have similarity 0.8 or more. Texts
    without words (null, empty) are one component. Texts of any length are compared whole; of repeated rows one stays;
    ties go to one row; an empty table gives no rows; other columns stay, whatever their names.
    """
    return similar.one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; no document is dropped.

    Null and empty texts stay as they are; texts of any length are scanned whole; overlapping secrets get one mark;
    repeated rows fare alike; an empty table gives no rows; n_chars follows a changed text, other columns stay.
    """
    return secrets.redacted(docs, secrets.log_ratios(secrets.corpus_counts(docs)))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents taken more than once are repeated, the last time perhaps in part.

    Null and empty texts have nothing to take and go; null sources are one source; repeated rows are taken each on
    their own; equal quotients go to the first source; an empty table gives no rows; other columns go along.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece.

    A null or empty text is one piece of length 1; longer texts than a sequence are cut, nothing else is; repeated rows
    and null ids have their own pieces; an empty table gives no rows; other columns are left out.
    """
    return packing.pack_documents(docs, cached_words=150_000)  # workers carry other stages' memory too


STAGES = [
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("secrets", secret_stage),
    ("mix", mix_stage),
    ("packing", packing_stage),
]
#: SQL can express neither the trained stages nor packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
