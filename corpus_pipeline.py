"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, personal data, mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import decontaminate, jaccard, mixing, pii, quality
from latticework.llm.common import documents, stored


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: fewer than ten words (null and empty texts too), too many repeated ones, or a ratio
    below the threshold. Repeated rows and null ids are judged like others; a column named like a result of the rules stays as it is."""
    names = {f"own_{i}": c for i, c in enumerate(docs.columns) if c.lower() not in ("doc_id", "text")}
    own = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for n, c in names.items()])
    kept = quality.assess(own, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept")
    back = {c: n for n, c in names.items()}
    return kept.select(*[F.col(back.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that with the smallest id; texts without words are linked with nothing and
    stay, repeated rows once. Any columns do."""
    return jaccard.distinct(docs).select(_columns(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts, and all texts where the benchmark is empty, stay. A column
    named like a result of the search stays as it is."""
    clash = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c.lower() in ("contaminated", "n_items", "items", "best_match")}
    own = docs.select(*[F.col(f"`{c}`").alias(clash.get(c, c)) for c in docs.columns])
    found = decontaminate.find(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated")
    return found.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by marks; n_chars, where there is one, counts the new text. A null text stays null;
    no row goes."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, until all sources (a null one is one, too) have equal shares; all are shuffled. Adds copy,
    n_copies and mix_key, in place of columns of these names; an empty table gives an empty one."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("mix", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
