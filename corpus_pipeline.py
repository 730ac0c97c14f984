"""A corpus from raw documents to a training mix: each stage is written as Parquet and read by the next.

A stage removes the intermediate tables of the one before it, whose rows are written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctpulse.llm import decontamination, mixing, near_duplicates, quality_rules, secret_scan
from acctpulse.session import discard, materialize, remove, written
from acctpulse.sources.tables import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Tables that the last stage wrote for itself, by application.
_left: dict[str, list[str]] = {}


def tidy(stage: Stage) -> Stage:
    """The stage, after the tables that the stage before wrote for itself are removed."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        remove(spark, _left.pop(app, []))
        before = set(written(spark))
        out = stage(spark, docs, sf_dir)
        _left[app] = [p for p in written(spark) if p not in before]
        return out

    return run_stage


@tidy
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge(docs).where("qr_kept").drop("qr_m", "qr_kept")


@tidy
def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_duplicates.keep_one(docs)


@tidy
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


@tidy
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets redacted."""
    return secret_scan.redact_rows(docs).withColumn("n_chars", F.length("text").cast("long"))


@tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per occurrence in training, with the time at which it is due, in that order."""
    sized = docs.withColumn("mx_size", mixing.size_of())
    ordered = mixing.training_order(mixing.mix(sized, "mx_size"))
    return ordered.select(*docs.columns, F.col("mx_epoch").alias("epoch"), F.col("mx_at").alias("due"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", rules),
    ("near duplicates", near_duplicate),
    ("decontamination", decontaminate),
    ("secret scans", secrets),
    ("mixing", mix),
]

#: Near-duplicate search and secret scans have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        discard(before)
    return docs
