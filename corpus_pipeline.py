"""A training corpus from ``documents``: toxic texts out, exact and near copies out, sources mixed to weights, packed into sequences.

Every stage takes the session, the rows its predecessor kept and the tables' folder; all but the last return the columns of
``documents``. Between stages the rows are written as Parquet to the shared folder and read again, and what a stage wrote on
its way is removed. Near copies are those of the SimHash operator's two passes. Mixing and packing count the same vocabulary's tokens; the last stage gives each document's pieces with
their token ids, bin and place.

Defined cases: bytes that are no UTF-8 pass through as they stand, and count as replacement characters where words or tokens
are read; a null or empty text is scored as an empty one, is a copy of other empty texts, and is packed into no bin; a
null id is smaller than any other in exact dedup and always stays in near-dedup; rows that repeat in id and text leave one;
null languages and sources are leaves of their own; an empty table gives an empty result; other columns pass through all
stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import exact_dedup, mixing, packing, simhash, toxicity
from pagewright.llm.shared import only_last, remove, written

#: Tokens that the mix draws of those there are; a row is drawn once at most, so that no copies come back.
SHARE = (9, 10)
SEED = 7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    count = mixing.vocabulary_tokens(spark)
    return mixing.mixed(docs, SHARE, max_epochs=1, seed=SEED, count=count, length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Boosted trees and best-fit packing have no SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus. A stage's table is removed once the next one's is written, or if a stage fails; the last one stays, as packing reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        try:
            with only_last(spark) as named:
                docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        finally:
            if before is not None:
                remove(spark, before)
        before = named[-1]
    return STAGES[-1][1](spark, docs, sf_dir)
