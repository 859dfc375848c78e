"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; ``run`` writes and rereads the documents between stages. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import decontaminate, langid, linededup, pieces, simhash
from runledger.llm.common import table
from runledger.session import through_parquet

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, fitted on their own labels, does not reject."""
    return langid.accepted(docs, langid.fit_on(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that match an earlier one; n_chars follows the text."""
    out = linededup.deduplicate(docs)
    return out.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in out.columns])


def keep_one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.one_per_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text that they decode to."""
    return pieces.encode_decode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES: list[tuple[str, Stage]] = [
    ("language", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", keep_one_per_group),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

# models and connected components are beyond SQL; tests/llm holds every stage against a plain version on small fixtures
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = through_parquet(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
