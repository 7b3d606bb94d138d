"""Corpus pipeline: language ID, near-dedup, decontamination, mixing and token output over ``documents``.

Each stage reads all that the stage before it kept; its result is written as Parquet to the shared
folder and read again. All stages but the last return the columns of ``documents``, whatever their names.
Every stage takes null, empty and very long texts, repeated rows and null ids as its operator's docstring says; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustframe.llm.common import held_out, packed, stored
from gustframe.llm.decontaminate import contamination
from gustframe.llm.language import UNKNOWN, identify, train
from gustframe.llm.mixing import mixed
from gustframe.llm.near_dedup import near_duplicates
from gustframe.llm.tokens import token_output

#: A document whose best language has a lower mean probability has no language.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the network knows; ``und`` and scores below LEAST_SCORE go."""
    model = train(docs.where(~held_out(5, 0)))
    found = identify(packed(docs, "text"), model, keep=("__row",))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id. Rows without a doc_id stay, and
    rows that repeat a doc_id are one document."""
    dropped = near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    found = contamination(packed(docs, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("__row",))
    return found.where("not contaminated").select("__row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks for (0 to 3 times)."""
    return mixed(docs, F.array("source"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, read back: doc_id, start, n_tokens and ids_crc32 of each taken copy."""
    return token_output(docs)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("token-ID output", tokens),
]

#: The network of the first stage cannot be expressed in SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
