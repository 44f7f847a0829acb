"""The corpus pipeline: documents in, packed training sequences out.

STAGES run in order, each on all that its predecessor kept: toxic documents
go; one document of each group of near-duplicates stays; secrets in texts are
replaced; sources are mixed to target weights, so a document can occur twice;
and texts are packed into sequences. Every stage takes the columns of
`documents`, and all but the last return them. Empty input gives empty output;
rows with null doc_id, text, lang or source pass through every stage (null
and empty texts count as copies of one another, and have no words to mix or
to pack); columns beyond those of `documents` are kept by all but the last.
Texts of any length are taken whole. Rows repeated to the letter count as
copies, of which one stays; among equally good choices the smallest doc_id, or
a hash of the row, decides, so reruns agree.

The module is part of the subpackage quern.llm and goes with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import mixing, packing, secret_scan, simhash_dedup, toxicity
from quern.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labelled ones, doesn't reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return simhash_dedup.without_near_duplicates(docs, simhash_dedup.near_duplicates(docs))


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    found = written(secret_scan.secret_findings(docs, secret_scan.train(spark)).where("is_secret").drop("value"), "secrets")
    return secret_scan.without_secrets(docs, found)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training sequence."""
    return packing.best_fit_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", replace_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: Learned models and drawn samples: SQL can't express the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
