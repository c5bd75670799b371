"""The registered query of each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, langid, licences, mixing, pii, ppm, quality, suffix, warc
from .common import documents, remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir).select("doc_id", "text"), _table(spark, sf_dir, "benchmark")).drop("text")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(documents(spark, sf_dir), passage=suffix.PASSAGE)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audit_pages(_table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir).select("doc_id", "text"), _table(spark, sf_dir, "labels")).drop("text")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), remainder("doc_id", 5) == 0
    return langid.predict(docs, langid.train(docs.where(~held_out)), held_out)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op10_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir), remainder("doc_id", 7) == 2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_pii": op3_pii,
    "op4_warc_fixity": op4_warc_fixity,
    "op5_quality": op5_quality,
    "op6_mix": op6_mix,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_language": op8_language,
    "op9_licences": op9_licences,
    "op10_ppm_score": op10_ppm_score,
}

SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.find_sql(),
    "op4_warc_fixity": warc.audit_sql(),
    "op6_mix": mixing.mix_sql(),
    "op7_jaccard_join": jaccard.join_sql(),
    "op9_licences": licences.scan_sql(licences.known_rows()),
}
