"""Data-quality checks Q01-Q14: each returns the violating rows, empty = pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import KEYS, REGISTRY_SCHEMA_VERSION, U32_MAX

RATIO_TOLERANCE = 1e-12


def blank(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col, F.lit("")) == ""


def linkage(usage: DataFrame) -> DataFrame:
    """Q01: which of registry symbol and local id a status needs and forbids."""
    s, registry, local = F.col("match_status"), F.col("registry_symbol"), F.col("local_definition_id")
    bad = (
        F.when(s.isin("resolved", "candidate"), blank(registry) | local.isNotNull())
        .when(s == "local", blank(local) | registry.isNotNull())
        .otherwise(registry.isNotNull() | local.isNotNull())
    )
    return usage.filter(bad)


def location(sites: DataFrame) -> DataFrame:
    """Q02: a file, a 1-based line, and a 1-based column when there is one."""
    return sites.filter(
        blank("file") | F.coalesce(F.col("line") < 1, F.lit(True)) | F.coalesce(F.col("col") < 1, F.lit(False))
    )


def required(df: DataFrame, columns: list[str], when_present: list[str] = ()) -> DataFrame:
    """Q03: non-empty columns; ``when_present`` may be null but not empty."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | blank(c)
    for c in when_present:
        bad = bad | F.coalesce(F.col(c) == "", F.lit(False))
    return df.filter(bad)


def token_fk(token_sites: DataFrame, tokens: DataFrame, by=KEYS) -> DataFrame:
    """Q04: site -> token exists, key is its key or alias, category agrees."""
    known = tokens.select(
        *by, F.col("id").alias("token_id"),
        F.col("key").alias("_key"), F.col("category").alias("_category"), F.col("aliases").alias("_aliases"),
    ).dropDuplicates([*by, "token_id"])
    alias_ok = F.coalesce(F.array_contains("_aliases", F.col("key")), F.lit(False))
    violation = (
        F.when(F.col("_key").isNull(), "unknown_token")
        .when((F.col("key") != F.col("_key")) & ~alias_ok, "key_mismatch")
        .when(F.col("category") != F.col("_category"), "category_mismatch")
    )
    return (
        token_sites.join(known, [*by, "token_id"], "left")
        .withColumn("violation", violation).filter(F.col("violation").isNotNull())
        .drop("_key", "_category", "_aliases")
    )


def duplicate_ids(df: DataFrame, key: list[str]) -> DataFrame:
    """Q04/Q07: keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def ratio_valid(metrics: DataFrame, reported: str, numerator: str, denominator: str) -> DataFrame:
    """Q05: finite, within [0, 1], null iff the denominator is 0, as derived."""
    r, n, d = F.col(reported), F.col(numerator), F.col(denominator)
    return metrics.filter(
        (r.isNull() != (d == 0))
        | F.coalesce(F.isnan(r) | (r < 0) | (r > 1), F.lit(False))
        | F.coalesce((d != 0) & (F.abs(r - n.cast("double") / d) > RATIO_TOLERANCE), F.lit(False))
    )


def summary_rules(symbols: DataFrame, emitted: str = "emitted_parent_count") -> DataFrame:
    """Q06: kind/status agreement, linkage, limit and truncation rules."""
    kind, registry, local = F.col("symbol_kind"), F.col("registry_symbol"), F.col("local_definition_id")
    expected = F.when(kind == "registry", F.lit("resolved")).otherwise(kind)
    link = (
        F.when(kind.isin("registry", "candidate"), blank(registry) | local.isNotNull())
        .when(kind == "local", blank(local) | registry.isNotNull())
        .otherwise(registry.isNotNull() | local.isNotNull())
    )
    n, total, limit, cut = F.col(emitted), F.col("parent_scope_count"), F.col("parent_scope_limit"), F.col("parent_scopes_truncated")
    violation = (
        F.when(blank("symbol_id") | blank("symbol") | blank("identity_basis"), "required")
        .when(F.col("match_status") != expected, "status")
        .when(link, "linkage")
        .when((limit == 0) & (n > 0), "limit_zero")
        .when(cut & (n >= total), "truncated")
        .when(~cut & (limit != 0) & (n != total) & (n != F.least(limit, total)), "length")
    )
    return symbols.withColumn("violation", violation).filter(F.col("violation").isNotNull())


def inference_1to1(style_sites: DataFrame, inference: DataFrame, by=KEYS) -> DataFrame:
    """Q07: every raw site has one inference row, no duplicates, no orphans."""
    key = [*by, "site_id"]
    raw = style_sites.groupBy(*by, F.col("id").alias("site_id")).agg(F.count(F.lit(1)).alias("raw_count"))
    inferred = inference.groupBy(*key).agg(F.count(F.lit(1)).alias("inference_count"))
    both = raw.join(inferred, key, "full_outer").fillna(0, ["raw_count", "inference_count"])
    return both.filter((F.col("raw_count") != 1) | (F.col("inference_count") != 1))


def suggestion_rules(inference: DataFrame, suggestions: DataFrame, tokens: DataFrame, by=KEYS) -> DataFrame:
    """Q08: suggestions present iff exact/near and each one agrees with its token."""
    key = [*by, "site_id"]
    per_site = suggestions.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("classification").isin("exact", "near")
    n = F.coalesce("n", F.lit(0))
    presence = inference.join(per_site, key, "left").filter(
        (hit & ((n == 0) | F.col("confidence").isNull())) | (~hit & ((n > 0) | F.col("confidence").isNotNull()))
    ).select(*key, F.lit("presence").alias("violation"))

    sites = inference.select(*key, "classification", F.col("category").alias("site_category"))
    known = tokens.select(
        *by, F.col("id").alias("token_id"), F.col("key").alias("_key"),
        F.col("value").alias("_value"), F.col("category").alias("_category"), F.lit(True).alias("_known"),
    )
    # sorted, as Spark takes the size of tokens from their compressed table and would send them through the driver
    known = known.hint("merge")
    d, kind = F.col("distance"), F.col("match_kind")
    violation = (
        F.when(F.col("classification").isNull(), "no_inference_row")
        .when(kind != F.col("classification"), "match_kind")
        .when((kind == "exact") & F.coalesce(d != 0.0, F.lit(False)), "distance")
        .when((kind == "near") & ~F.coalesce((d > 0) & (d < float("inf")), F.lit(False)), "distance")
        .when(F.col("_known").isNull(), "unknown_token")
        .when(F.col("_key") != F.col("token_key"), "token_key")
        .when(F.col("_value").isNull() | (F.col("_value") != F.col("canonical_value")), "canonical_value")
        .when(F.col("_category") != F.col("site_category"), "category")
    )
    agreement = (
        suggestions.select(*key, "token_id", "token_key", "canonical_value", "match_kind", "distance")
        .join(sites, key, "left").join(known, [*by, "token_id"], "left")
        .withColumn("violation", violation).filter(F.col("violation").isNotNull()).select(*key, "violation")
    )
    return presence.unionByName(agreement)


def counts_match(reported: DataFrame, derived: DataFrame, key: list[str]) -> DataFrame:
    """Q09/Q10: reported counters that differ from the recount or leave u32.

    One row per (key, counter) that disagrees; a missing side reads as null.
    """
    counters = [c for c in reported.columns if c not in key and c in derived.columns]

    def tall(df: DataFrame, value: str) -> DataFrame:
        return df.select(*key, *[F.col(c).cast("decimal(20,0)").alias(c) for c in counters]).unpivot(
            key, counters, "counter", value)

    both = tall(reported, "reported").join(tall(derived, "derived"), [*key, "counter"], "full_outer")
    return both.filter(~F.col("reported").eqNullSafe(F.col("derived")) | (F.col("reported") > U32_MAX))


def registry_shape(registries: DataFrame, doc: str = "doc") -> DataFrame:
    """Q11: object, schema version 1, components array; empty -> warning.

    ``doc`` holds the raw JSON text of a registry.
    """
    v = F.try_parse_json(doc)
    version = F.try_variant_get(v, "$.schema_version", "bigint")
    kind = F.schema_of_variant(v)
    components = F.schema_of_variant(F.try_variant_get(v, "$.components", "variant"))
    violation = (
        F.when(v.isNull(), "malformed_json")
        .when(~F.startswith(kind, F.lit("OBJECT")), "not_an_object")
        .when(version.isNull(), "missing_schema_version")
        .when(version != REGISTRY_SCHEMA_VERSION, "unsupported_schema_version")
        .when(components.isNull(), "empty_components")
        .when(~F.startswith(components, F.lit("ARRAY")), "components_not_an_array")
        .when(F.try_variant_get(v, "$.components[0]", "variant").isNull(), "empty_components")
    )
    severity = F.when(F.col("violation") == "empty_components", "warning").otherwise("error")
    return registries.withColumn("violation", violation).filter(F.col("violation").isNotNull()).withColumn(
        "severity", severity)


def token_key_unique(token_keys: DataFrame, by=KEYS) -> DataFrame:
    """Q12: a key or alias that occurs more than once over all tokens."""
    return duplicate_ids(token_keys, [*by, "match_key"])


# The optional fields a facts document must leave out, not null.
NON_NULL_PATHS = {
    "usage_sites": ["qualified_symbol", "registry_symbol", "local_definition_id", "parent", "location.column"],
    "local_components": ["qualified_symbol", "identity_basis", "identity_stability", "location.column"],
    "design_system_components": ["package"],
    "design_system_tokens": ["value", "aliases"],
    "token_sites": ["parent", "location.column"],
    "hardcoded_style_sites": ["parent", "location.column"],
    "diagnostics": ["location"],
}


def null_policy(facts: DataFrame, doc: str = "doc") -> DataFrame:
    """Q13: explicit JSON nulls outside the allowed paths, one row per null."""
    v = F.try_parse_json(doc)
    sections = F.array(*[
        F.struct(
            F.lit(name).alias("section"),
            F.try_variant_get(F.col("_v"), f"$.{name}", "array<variant>").alias("items"),
        )
        for name in NON_NULL_PATHS
    ])
    keep = [c for c in facts.columns if c != doc]
    items = (
        facts.select(*keep, v.alias("_v")).select(*keep, F.explode(sections).alias("_s"))
        .select(*keep, F.col("_s.section").alias("section"), F.posexplode("_s.items").alias("item_index", "_item"))
    )
    paths = F.array(*[
        F.when((F.col("section") == section) & F.is_variant_null(F.try_variant_get("_item", f"$.{p}", "variant")), F.lit(p))
        for section, fields in NON_NULL_PATHS.items() for p in fields
    ])
    return items.select(
        *keep, "section", "item_index", F.explode(F.array_compact(paths)).alias("path")
    )


def enum_domain(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Q14: values outside a closed domain, null included."""
    return df.filter(~F.coalesce(F.col(column).isin(domain), F.lit(False)))
