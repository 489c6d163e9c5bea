"""Registry maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import kebab_id

DISCOVER_KEY = ["repo_id", "language"]


def package_conflicts(discovered: DataFrame, by=DISCOVER_KEY) -> DataFrame:
    """One row per symbol with its package, first file first.

    The package of the first file decides.  If it is present and a later file
    names another one, the package is dropped and ``package_conflict`` is set.
    """
    first = F.min_by(F.struct("package"), F.struct("path", "ordinal"))["package"]
    rows = discovered.groupBy(*by, "symbol").agg(
        first.alias("_first"), F.min("package").alias("_min"), F.max("package").alias("_max"),
        F.min(F.struct("path", "ordinal")).alias("_at"),
    )
    conflict = F.col("_first").isNotNull() & (F.col("_min") != F.col("_max"))
    return rows.select(
        *by, "symbol",
        F.when(~conflict, F.col("_first")).alias("package"),
        conflict.alias("package_conflict"),
    )


def build_registry(symbols: DataFrame, by=DISCOVER_KEY) -> DataFrame:
    """Registry rows ``ds.<kebab>`` for symbols that are unique already."""
    return symbols.select(*by, F.concat(F.lit("ds."), kebab_id(F.col("symbol"))).alias("id"), "symbol", "package")


def id_collisions(registry: DataFrame, by=DISCOVER_KEY) -> DataFrame:
    """Two symbols that would share one id."""
    return (
        registry.groupBy(*by, "id")
        .agg(F.count(F.lit(1)).alias("symbol_count"), F.min("symbol").alias("first_symbol"),
             F.max("symbol").alias("last_symbol"))
        .filter("symbol_count > 1")
    )


def registry_drift(resolved: DataFrame, locks: DataFrame, by=DISCOVER_KEY) -> DataFrame:
    """Missing lock, changed source, changed digest - the first that holds."""
    locked = locks.select(
        *by, F.col("source").alias("locked_source"), F.col("sha256").alias("locked_sha256"), F.lit(True).alias("_l"))
    drift = (
        F.when(F.col("_l").isNull(), "missing")
        .when(F.col("source") != F.col("locked_source"), "source_drift")
        .when(F.col("sha256") != F.col("locked_sha256"), "digest_drift")
    )
    return resolved.join(locked, list(by), "left").withColumn("drift", drift).filter(
        F.col("drift").isNotNull()).drop("_l")


def with_digest(registries: DataFrame, content: str = "content") -> DataFrame:
    return registries.withColumn("sha256", F.sha2(F.col(content), 256)).drop(content)


LOCK_FIELDS = ["source", "sha256", "git", "tag", "commit"]


def lock_refresh(refreshed: DataFrame, locks: DataFrame, by=DISCOVER_KEY) -> DataFrame:
    """Refreshed lock rows that are new or differ from the stored ones."""
    same = locks.select(*by, F.struct(*LOCK_FIELDS).alias("_old"))
    joined = refreshed.join(same, list(by), "left")
    change = F.when(F.col("_old").isNull(), "insert").when(
        ~F.struct(*LOCK_FIELDS).eqNullSafe(F.col("_old")), "update")
    return joined.withColumn("change", change).filter(F.col("change").isNotNull()).drop("_old")


def git_lock_rules(locks: DataFrame, config: DataFrame, by=DISCOVER_KEY) -> DataFrame:
    """The first rule a Git lock breaks against its configuration."""
    want = config.select(*by, F.col("git").alias("config_git"), F.col("tag").alias("config_tag"))
    source = F.concat(F.lit("git:"), F.btrim("config_git"), F.lit("#"), F.btrim("config_tag"))
    violation = (
        F.when(F.col("git").isNull(), "git is required")
        .when(F.col("git") != F.col("config_git"), "git must match config")
        .when(F.col("tag").isNull(), "tag is required")
        .when(F.col("tag") != F.col("config_tag"), "tag must match config")
        .when(F.col("source") != source, "source must be canonical")
        .when(F.col("commit").isNull(), "commit is required")
        .when(~F.col("commit").rlike(r"\A(?:[0-9a-f]{40}|[0-9a-f]{64})\z"), "commit must be lowercase hex")
        .when(~F.col("sha256").rlike(r"\A[0-9a-f]{64}\z"), "sha256 must be lowercase hex")
    )
    return locks.join(want, list(by)).withColumn("violation", violation).filter(F.col("violation").isNotNull())
