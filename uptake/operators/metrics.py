"""Counters, ratios and per-symbol summaries.

Distinct counts are two grouped steps: the first groups on the scope *and* the
counted value, with map-side combining, so a repository that holds a large part
of the rows is spread over many tasks; the second adds up one row per value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.identity import identity_basis, identity_stability, symbol_id, symbol_kind
from ..schemas import CATEGORIES, KEYS, MATCH_STATUSES, RUN, SYMBOL_KINDS, rank_of


def _bigint(c: Column) -> Column:
    return c.cast("bigint")


def _count_if(cond: Column) -> Column:
    return _bigint(F.count_if(cond))


def raw_invocations(usage: DataFrame, by=KEYS) -> DataFrame:
    """Invocations in total and per match status."""
    return usage.groupBy(*by).agg(
        F.count(F.lit(1)).alias("raw_total"),
        *[_count_if(F.col("match_status") == s).alias(f"raw_{s}") for s in MATCH_STATUSES],
    )


def adoption(counts: DataFrame, candidate_policy: str = "report_separately") -> DataFrame:
    """Eligible, adopted and non-adopted invocations.

    Candidates stay out by default; ``count_as_adopted`` and
    ``count_as_non_adopted`` move them into the eligible total.
    """
    cand, zero = F.col("raw_candidate"), F.lit(0)
    extra, gain = {
        "report_separately": (zero, zero),
        "count_as_non_adopted": (cand, zero),
        "count_as_adopted": (cand, cand),
    }[candidate_policy]
    eligible = F.col("raw_resolved") + F.col("raw_local") + F.col("raw_unresolved") + extra
    return counts.withColumns({
        "eligible_invocation_count": _bigint(eligible),
        "adopted_invocation_count": _bigint(F.col("raw_resolved") + gain),
        "non_adopted_invocation_count": _bigint(eligible - F.col("raw_resolved") - gain),
    })


def ratio(numerator, denominator) -> Column:
    num = F.col(numerator) if isinstance(numerator, str) else numerator
    den = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def with_ratios(counts: DataFrame) -> DataFrame:
    """Adoption and registry resolution, null on an empty denominator."""
    return counts.withColumns({
        "invocation_adoption_ratio": ratio("adopted_invocation_count", "eligible_invocation_count"),
        "registry_resolution_ratio": ratio("raw_resolved", "raw_total"),
    })


def _distinct_per_key(df: DataFrame, value: str, alias: str, by=KEYS) -> DataFrame:
    return (
        df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.lit(1).alias("_one"))
        .groupBy(*by).agg(F.count(F.lit(1)).alias(alias))
    )


def _combine(parts: list[DataFrame], by) -> DataFrame:
    """Full-outer join of one-row-per-key tables; missing counters are 0."""
    joined = reduce(lambda a, b: a.join(b, list(by), "full_outer"), parts)
    return joined.fillna(0, [c for c in joined.columns if c not in by])


def registry_counts(usage: DataFrame, components: DataFrame, by=KEYS) -> DataFrame:
    """Registry size, distinct used symbols, resolved and candidate calls."""
    inventory = components.groupBy(*by).agg(F.count(F.lit(1)).alias("registry_component_count"))
    used = (
        usage.groupBy(*by, "registry_symbol")
        .agg(
            _count_if(F.col("match_status") == "resolved").alias("_resolved"),
            _count_if(F.col("match_status") == "candidate").alias("_candidate"),
        )
        .groupBy(*by)
        .agg(
            _count_if((F.col("_resolved") > 0) & F.col("registry_symbol").isNotNull()).alias(
                "registry_used_component_count"),
            F.sum("_resolved").alias("registry_resolved_raw_invocation_count"),
            F.sum("_candidate").alias("registry_candidate_raw_invocation_count"),
        )
    )
    return _combine([inventory, used], by)


def definition_counts(usage: DataFrame, local_components: DataFrame, by=KEYS) -> DataFrame:
    """Local definitions, invoked ids, and the unused rest (never below 0)."""
    inventory = local_components.groupBy(*by).agg(F.count(F.lit(1)).alias("local_definition_count"))
    invoked = _distinct_per_key(
        usage.filter(F.col("match_status") == "local"), "local_definition_id", "invoked_local_definition_count", by
    )
    return _combine([inventory, invoked], by).withColumn(
        "unused_local_definition_count",
        F.greatest(F.lit(0), F.col("local_definition_count") - F.col("invoked_local_definition_count")).cast("bigint"),
    )


def parent_scope_counts(usage: DataFrame, by=KEYS) -> DataFrame:
    """Distinct parents, and those with resolved/local/unresolved calls."""
    statuses = ["resolved", "local", "unresolved"]
    parents = (
        usage.filter(F.col("parent_id").isNotNull())
        .groupBy(*by, "parent_id")
        .agg(*[F.bool_or(F.col("match_status") == s).alias(f"_{s}") for s in statuses])
    )
    return parents.groupBy(*by).agg(
        F.count(F.lit(1)).alias("parent_scope_total"),
        *[_count_if(F.col(f"_{s}")).alias(f"parent_with_{s}_invocations") for s in statuses],
    )


def token_counts(tokens: DataFrame, token_sites: DataFrame, style_sites: DataFrame, by=KEYS) -> DataFrame:
    """Configured and used tokens, references and hard-coded sites by category."""
    configured = tokens.groupBy(*by).agg(F.count(F.lit(1)).alias("configured_token_count"))
    used = _distinct_per_key(token_sites, "token_id", "used_token_count", by)

    def sites(df: DataFrame, total: str, prefix: str) -> DataFrame:
        return df.groupBy(*by).agg(
            F.count(F.lit(1)).alias(total),
            *[_count_if(F.col("category") == c).alias(f"{prefix}_{c}") for c in CATEGORIES],
        )

    return _combine(
        [
            configured, used,
            sites(token_sites, "token_reference_site_count", "token_references"),
            sites(style_sites, "hardcoded_style_candidate_count", "hardcoded"),
            _distinct_per_key(token_sites, "parent_id", "parents_with_token_references", by),
            _distinct_per_key(style_sites, "parent_id", "parents_with_hardcoded_styles", by),
        ],
        by,
    )


def adoption_counts(usage: DataFrame, components: DataFrame, local_components: DataFrame, by=KEYS) -> DataFrame:
    """The whole usage counter block with its ratios, one row per language."""
    parts = [
        raw_invocations(usage, by), registry_counts(usage, components, by),
        definition_counts(usage, local_components, by), parent_scope_counts(usage, by),
    ]
    return with_ratios(adoption(_combine(parts, by)))


def merge_languages(counts: DataFrame, by=RUN) -> DataFrame:
    """Add every counter over languages, then recompute the ratios.

    Distinct counters are added as well; equal ids in two languages count twice.
    """
    skip = set(by) | {"language", "invocation_adoption_ratio", "registry_resolution_ratio"}
    counters = [c for c in counts.columns if c not in skip]
    return with_ratios(counts.groupBy(*by).agg(*[_bigint(F.sum(c)).alias(c) for c in counters]))


def run_metrics(scan_runs: DataFrame, by=RUN) -> DataFrame:
    """Files scanned and extraction time over all languages of a run."""
    return scan_runs.groupBy(*by).agg(
        _bigint(F.sum("files_scanned")).alias("files_scanned"),
        _bigint(F.sum("parse_extract_ms")).alias("parse_extract_ms"),
    )


SYMBOL_KEY = ["match_status", "registry_symbol", "local_definition_id", "qualified_symbol", "symbol"]


def symbol_usage(usage: DataFrame, by=KEYS) -> DataFrame:
    """Invocations, files and parents per used symbol; nulls are values.

    Files and parents are counted from separately pre-grouped pairs; the three
    results meet again in a last grouping, which needs no null-safe join.
    """
    key = [*by, *SYMBOL_KEY]
    none = F.lit(0).cast("bigint")
    calls = usage.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    files = usage.select(*key, "file").distinct().groupBy(*key).agg(F.count("file").alias("n"))
    parents = usage.select(*key, "parent_id").distinct().groupBy(*key).agg(F.count("parent_id").alias("n"))

    def slot(df: DataFrame, i: int) -> DataFrame:
        names = ["raw_invocation_count", "file_count", "parent_scope_count"]
        return df.select(*key, *[(F.col("n") if j == i else none).alias(n) for j, n in enumerate(names)])

    merged = slot(calls, 0).unionByName(slot(files, 1)).unionByName(slot(parents, 2))
    linkage = [F.col("registry_symbol"), F.col("local_definition_id"), F.col("qualified_symbol")]
    language = F.col("language") if "language" in by else F.lit("")
    return (
        merged.groupBy(*key)
        .agg(*[_bigint(F.sum(c)).alias(c) for c in ("raw_invocation_count", "file_count", "parent_scope_count")])
        .withColumns({
            "symbol_id": symbol_id(language, F.col("match_status"), *linkage, F.col("symbol")),
            "symbol_kind": symbol_kind(F.col("match_status")),
            "identity_basis": identity_basis(*linkage),
            "identity_stability": identity_stability(*linkage),
        })
    )


def parent_rows(usage: DataFrame, limit: int | None = None, by=KEYS) -> DataFrame:
    """A10: parents per symbol, most invocations first, as a child table.

    Without a limit no ranking is needed and rows stay spread over all tasks.
    The descriptive columns come from the first site (file, line, column, id)
    of the parent.
    """
    key = [*by, *SYMBOL_KEY]
    described = [c for c in usage.columns if c.startswith("parent_") and c != "parent_id"]
    order = F.struct("file", "line", F.coalesce("col", F.lit(0)), "id")
    rows = (
        usage.filter(F.col("parent_id").isNotNull())
        .groupBy(*key, "parent_id")
        .agg(F.count(F.lit(1)).alias("invocation_count"),
             *[F.min_by(c, order).alias(c) for c in described])
    )
    if limit is None:
        return rows
    if limit == 0:
        return rows.limit(0)
    w = Window.partitionBy(*key).orderBy(F.desc("invocation_count"), "parent_id")
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def with_truncation(symbols: DataFrame, limit: int | None) -> DataFrame:
    """Limit and truncation columns of the symbol summary."""
    cut = F.lit(False) if limit is None else F.col("parent_scope_count") > limit
    return symbols.withColumns({
        "parent_scope_limit": F.lit(limit).cast("bigint"),
        "parent_scopes_truncated": cut,
    })


def token_usage(tokens: DataFrame, token_sites: DataFrame, by=KEYS) -> DataFrame:
    """References, files and parents per token with at least one reference."""
    key = [*by, "token_id"]
    refs = token_sites.groupBy(*key).agg(F.count(F.lit(1)).alias("reference_count"))
    files = token_sites.select(*key, "file").distinct().groupBy(*key).agg(F.count("file").alias("file_count"))
    parents = (
        token_sites.select(*key, "parent_id").distinct().groupBy(*key)
        .agg(F.count("parent_id").alias("parent_scope_count"))
    )
    names = tokens.select(*by, F.col("id").alias("token_id"), "key", "category")
    return names.join(refs, key).join(files, key).join(parents, key)


def merge_symbol_rows(per_language: list[DataFrame]) -> DataFrame:
    """Concatenate language summaries; equal ids are not collapsed."""
    return reduce(lambda a, b: a.unionByName(b), per_language)


def order_symbol_summary(symbols: DataFrame) -> DataFrame:
    """Invocations descending, kind order, symbol id."""
    return symbols.orderBy(
        F.desc("raw_invocation_count"), rank_of(F.col("symbol_kind"), SYMBOL_KINDS), "symbol_id"
    )


def order_token_summary(rows: DataFrame) -> DataFrame:
    """Language, token id, key."""
    return rows.orderBy("language", "token_id", "key")
