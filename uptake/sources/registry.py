"""Registry documents: components, aliases and design tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.quality import blank
from ..schemas import CATEGORIES, REGISTRY

REGISTRY_KEY = ["repo_id", "language"]


def read_registries(spark: SparkSession, path: str) -> DataFrame:
    """One raw JSON document per file, with the file it came from."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("doc"))


def parse_registries(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Typed registry struct from a JSON text column."""
    return docs.withColumn("registry", F.from_json(doc, REGISTRY)).drop(doc)


def components(registries: DataFrame, by=REGISTRY_KEY) -> DataFrame:
    """One row per component, in document order."""
    rows = registries.select(*by, F.posexplode("registry.components").alias("ordinal", "c"))
    symbol = F.col("c.symbol")
    return rows.select(
        *by, "ordinal", F.concat(F.lit("ds."), symbol).alias("id"), symbol.alias("symbol"),
        symbol.alias("registry_symbol"), F.col("c.package").alias("package"),
        F.coalesce("c.aliases", F.array().cast("array<string>")).alias("aliases"),
    )


def invalid_components(component_rows: DataFrame) -> DataFrame:
    """Components without a symbol, or with an empty package."""
    return component_rows.filter(blank("symbol") | F.coalesce(F.col("package") == "", F.lit(False)))


def registry_aliases(component_rows: DataFrame, by=REGISTRY_KEY) -> DataFrame:
    """Call symbol -> registry symbol; the last writer in the document wins."""
    names = F.concat(F.array("symbol"), F.col("aliases"))
    entries = component_rows.select(*by, "ordinal", "symbol", "package", F.posexplode(names).alias("slot", "call_symbol"))
    last = F.max_by(F.struct("symbol", "package"), F.struct("ordinal", "slot"))
    return entries.groupBy(*by, "call_symbol").agg(last.alias("_l")).select(
        *by, "call_symbol", F.col("_l.symbol").alias("registry_symbol"), F.col("_l.package").alias("registry_package"))


def tokens(registries: DataFrame, by=REGISTRY_KEY) -> DataFrame:
    """One row per design token; a registry without tokens gives none."""
    return registries.select(*by, F.explode("registry.tokens").alias("t")).select(
        *by, F.col("t.id").alias("id"), F.col("t.key").alias("key"), F.col("t.category").alias("category"),
        F.coalesce("t.aliases", F.array().cast("array<string>")).alias("aliases"), F.col("t.value").alias("value"),
    )


def invalid_tokens(token_rows: DataFrame) -> DataFrame:
    """Tokens with a missing field, unknown category, or empty alias/value."""
    return token_rows.filter(
        blank("id") | blank("key") | ~F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False))
        | F.coalesce(F.col("value") == "", F.lit(False)) | F.exists("aliases", lambda a: a == "")
    )


def token_keys(token_rows: DataFrame, by=REGISTRY_KEY) -> DataFrame:
    """Every key and alias that refers to a token."""
    return token_rows.select(
        *by, F.explode(F.concat(F.array("key"), F.col("aliases"))).alias("match_key"),
        F.col("id").alias("token_id"), "category",
    )
