"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Toxic documents go, exact copies go, of near copies one stays, personal data get surrogates, and
what is left is packed into training sequences. Every stage works on all rows its predecessor kept;
all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, neardup, packing, pii, toxicity
from tessera.llm.common import materialise, release, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the scorer is fitted on labels.toxic.

    Null and empty texts are scored as empty ones; equal texts have equal scores, so copies go or stay
    together; without labels of both kinds all stay. An empty table stays empty; other columns, whatever their names, are carried.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for the case of A-Z the one with the largest doc_id.

    Null counts as empty, a null doc_id is the smallest, and of rows that share even that one stays. An
    empty table stays empty; other columns, whatever their names, are carried.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (0.8 of five-word shingles, directly or through others).

    Texts too short for a shingle, null or empty ones have no near copies and stay. Rows of equal or null
    doc_id are told apart. An empty table stays empty; other columns, whatever their names, are carried.
    """
    return neardup.drop_near_copies(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text with surrogates and n_chars renewed where it is not null.

    Null and empty texts stay as they are, and equal texts stay equal. An empty table stays empty; other
    columns, whatever their names, are carried.
    """
    return pii.anonymise(docs, pii.key_of(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its bytes and its place in a training sequence.

    A document longer than the largest sequence has several pieces, a null or empty one a single piece of
    length 0 in no sequence. Repeated rows are packed each for itself; of other columns only doc_id
    is kept. An empty table gives no rows.
    """
    return packing.best_fit_pack(docs, content=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores, signatures, keyed surrogates and packing have no SQL; tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote for itself goes once its result is written, and that
    once the next stage's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scope(spark) as made:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
            made.remove(docs.work_path)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
