"""Fact documents and the fact tables on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import KEYS, SCAN_FACTS

COLLECTIONS = [
    "design_system_components", "local_components", "usage_sites",
    "design_system_tokens", "token_sites", "hardcoded_style_sites", "diagnostics",
]


def parse_facts(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Typed facts struct from (repo_id, doc)."""
    return docs.withColumn("f", F.from_json(doc, SCAN_FACTS)).select(
        "repo_id", F.col("f.snapshot_id").alias("snapshot_id"), F.col("f.language.id").alias("language"), "f")


def _flatten(item: str, field) -> list[Column]:
    """Columns of one fact row; location and parent become flat columns."""
    if field.name == "location":
        return [F.col(f"{item}.location.file").alias("file"), F.col(f"{item}.location.line").alias("line"),
                F.col(f"{item}.location.column").alias("col")]
    if field.name == "parent":
        names = [f.name for f in field.dataType.fields if f.name != "location"]
        return [F.col(f"{item}.parent.{n}").alias(n if n == "parent_id" else f"parent_{n}") for n in names]
    return [F.col(f"{item}.{field.name}").alias(field.name)]


def fact_table(facts: DataFrame, name: str) -> DataFrame:
    """One collection of the documents as a table with an ``ordinal``."""
    element = SCAN_FACTS[name].dataType.elementType
    rows = facts.select(*KEYS, F.posexplode(f"f.{name}").alias("ordinal", "r"))
    return rows.select(*KEYS, "ordinal", *[c for fld in element.fields for c in _flatten("r", fld)])


def scan_runs(facts: DataFrame) -> DataFrame:
    return facts.select(
        *KEYS, F.col("f.status").alias("status"), F.col("f.scanned_at").alias("scanned_at"),
        F.col("f.language.parser_name").alias("parser_name"),
        F.col("f.metrics.files_scanned").alias("files_scanned"),
        F.col("f.metrics.parse_extract_ms").alias("parse_extract_ms"),
    )


def read_scan_facts(spark: SparkSession, path: str, repo_id: str) -> dict[str, DataFrame]:
    """Every fact table of the JSON documents below ``path``."""
    docs = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    facts = parse_facts(docs.select(F.lit(repo_id).alias("repo_id"), F.col("value").alias("doc")))
    return {**{c: fact_table(facts, c) for c in COLLECTIONS}, "scan_runs": scan_runs(facts)}


def write_outputs(tables: dict[str, DataFrame], path: str) -> None:
    """One directory per table, partitioned by repository and language.

    A full run replaces every partition, so artifacts of languages that are no
    longer scanned disappear with the overwrite.
    """
    for name, df in tables.items():
        parts = [c for c in ("repo_id", "language") if c in df.columns]
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*parts).parquet(f"{path}/{name}")


def write_repository(tables: dict[str, DataFrame], path: str) -> None:
    """S10 for one repository: replace only the partitions in the new tables."""
    for name, df in tables.items():
        parts = [c for c in ("repo_id", "language") if c in df.columns]
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{path}/{name}")


def stale_partitions(stored: DataFrame, current: DataFrame, by=("repo_id", "language")) -> DataFrame:
    """Stored (repository, language) pairs that the new run no longer has."""
    return stored.select(*by).distinct().join(current.select(*by).distinct(), list(by), "left_anti")
