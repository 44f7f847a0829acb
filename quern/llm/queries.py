"""The thin queries over the driver tables, by name, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, curve_packing, divergence, fingerprints, language_id, mixing, packing, quality_rules, secret_scan, simhash_dedup, substring_dedup, toxicity, url_filters
from .common import in_share


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_share(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), rows=~held_out)
    scored = toxicity.toxicity_scores(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filters.train(url_filters.labelled_urls(spark))
    return url_filters.url_verdicts(_table(spark, sf_dir, "pages"), URL_RULES, model)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash_dedup.fingerprint_classes(_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_findings(_table(spark, sf_dir, "documents"), secret_scan.train(spark))
    masked = F.concat(F.substring("value", 1, 4), F.lit("..."), F.length("value").cast("string"))
    return found.select("doc_id", "start", "end", masked.alias("masked"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = in_share(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs, rows=~held_out)
    told = language_id.predicted_languages(docs, model)
    return told.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op13_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return curve_packing.curve_pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_fingerprints": op5_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_url_filters": op7_url_filters,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_source_divergence": op12_source_divergence,
    "op13_curve_packing": op13_curve_packing,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
ORACLE: dict[str, str] = {"op11_collocations": collocations.SQL, "op12_source_divergence": divergence.SQL}
