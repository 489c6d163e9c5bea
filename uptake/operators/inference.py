"""Token replacement inference.

A site's result depends only on its scope, category, context and value, so the
work runs over *distinct values* and is joined back to the sites at the end.  A
value that a third of all sites share is therefore assessed once.

What is read from tokens meets the values by shuffle: Spark takes its size from the
compressed table, before tokens are spread over the context classes, and would send
all of them through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import CONTEXT_CLASSES, confidence, context_class, near_allowed, with_normal_form
from ..schemas import CATEGORIES, CLEAR_CONTEXTS, CONFIDENCES, CONTEXTS, DEFAULT_NUMERIC_TOLERANCE, KEYS, RUN

VALUE_KEY = ["category", "context", "value"]
_MATCH = ["kind", "unit", "scalar", "text"]


def _shuffled(tokens: DataFrame) -> DataFrame:
    """The next join of rows that grow with the tokens sorts them, whatever their size is guessed to be."""
    return tokens.hint("merge")


def normalized_tokens(tokens: DataFrame, by=KEYS) -> DataFrame:
    """Every token under each of the five context classes.

    Token values are read with the context of the site, so unitless ``8`` is a
    length for padding and a bare number for typography.
    """
    classes = F.array(*[F.lit(c) for c in CONTEXT_CLASSES])
    spread = tokens.select(
        *by, "category", F.col("id").alias("token_id"), F.col("key").alias("token_key"),
        F.col("value").alias("canonical_value"), F.explode(classes).alias("context_class"),
    )
    return with_normal_form(spread, "category", "context_class", "canonical_value")


def observed_values(sites: DataFrame, by=KEYS) -> DataFrame:
    """Distinct (scope, category, context, value) with its normal form."""
    distinct = sites.select(*by, *VALUE_KEY).distinct()
    classed = distinct.withColumn("context_class", context_class(F.col("context")))
    return with_normal_form(classed, "category", "context", "value")


def nearest_scalars(observed: DataFrame, tokens: DataFrame, tolerance: float, group: list[str]) -> DataFrame:
    """The closest token scalars below and above each observed scalar.

    Both sides are distinct scalars, cut into bins of twice the tolerance.  The
    next lower bin matters only through its maximum, the next upper one through
    its minimum, and inside a bin a sorted window finds the neighbours, so no
    pairs are formed.
    """
    width = F.lit(2.0 * tolerance)
    bin_key = [*group, "bin"]
    obs = observed.select(*group, "scalar").distinct().withColumn("bin", F.floor(F.col("scalar") / width).cast("double"))
    tok = tokens.select(*group, "scalar").distinct().withColumn("bin", F.floor(F.col("scalar") / width).cast("double"))

    both = obs.withColumn("t", F.lit(None).cast("double")).unionByName(tok.withColumn("t", F.col("scalar")))
    w = Window.partitionBy(*bin_key).orderBy("scalar")
    inside = both.withColumns({
        "lo_in": F.last("t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "hi_in": F.first("t", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    }).filter(F.col("t").isNull())

    edges = tok.groupBy(*bin_key).agg(F.min("scalar").alias("mn"), F.max("scalar").alias("mx"))
    below = edges.select(*group, (F.col("bin") + 1.0).alias("bin"), F.col("mx").alias("lo_out"))
    above = edges.select(*group, (F.col("bin") - 1.0).alias("bin"), F.col("mn").alias("hi_out"))
    near = inside.join(_shuffled(below), bin_key, "left").join(_shuffled(above), bin_key, "left")
    lo, hi = F.coalesce("lo_in", "lo_out"), F.coalesce("hi_in", "hi_out")
    gap = F.least(F.abs(F.col("scalar") - lo), F.abs(hi - F.col("scalar")))
    return (
        near.select(*group, "scalar", lo.alias("lo"), hi.alias("hi"), gap.alias("distance"))
        .filter((F.col("distance") > 0) & (F.col("distance") <= tolerance))
    )


def _near_matches(obs: DataFrame, tok: DataFrame, tolerance: float, group: list[str]) -> DataFrame:
    """Every token scalar at the minimum distance of an observed scalar.

    Rounding can make two adjacent scalars equally far away, so candidates are
    looked up in the tiny cells around both neighbours and kept by distance.
    Cells are whole doubles; for scalars so large that these have gaps, the
    differences are exact and only equal scalars share a distance.
    """
    nearest = nearest_scalars(obs, tok, tolerance, group)
    cell = F.lit(tolerance * 2.0 ** -48)

    def cell_of(c: Column) -> Column:
        return F.rint(c / cell)

    sides = F.filter(
        F.array("lo", "hi"), lambda t: t.isNotNull() & (F.abs(F.col("scalar") - t) == F.col("distance"))
    )
    cells = F.array_distinct(F.flatten(F.transform(
        sides, lambda t: F.array(cell_of(t) - 1.0, cell_of(t), cell_of(t) + 1.0))))
    probes = nearest.select(*group, F.col("scalar").alias("obs_scalar"), "distance", F.explode(cells).alias("cell"))
    return (
        _shuffled(tok.withColumn("cell", cell_of(F.col("scalar"))))
        .join(probes, [*group, "cell"])
        .filter(F.abs(F.col("scalar") - F.col("obs_scalar")) == F.col("distance"))
        .drop("cell")
    )


def value_suggestions(observed: DataFrame, tokens: DataFrame, tolerance: float, by=KEYS) -> DataFrame:
    """A20 on distinct values: one row per suggested token (J14 exact, J15 near)."""
    scope = [*by, "category", "context_class"]
    usable = tokens.filter(F.col("canonical_value").isNotNull() & (F.col("kind") != "unsupported"))
    described = ["token_id", "token_key", "canonical_value"]
    numeric = F.col("kind") == "numeric"

    exact_key = [*scope, *_MATCH]
    assessed = observed.filter(F.col("kind") != "unsupported")
    exact = assessed.join(_shuffled(usable.select(*exact_key, *described)), exact_key).select(
        *by, *VALUE_KEY, *described,
        F.lit("exact").alias("match_kind"),
        F.when(numeric, F.lit(0.0)).alias("distance"),
        F.when(numeric & (F.col("unit") != ""), F.col("unit")).alias("normalized_unit"),
    )
    if tolerance <= 0:
        return exact

    group = [*scope, "unit"]
    matched = usable.select(*exact_key).distinct()
    obs = assessed.filter(numeric & near_allowed(F.col("category"), F.col("context_class"))).join(
        _shuffled(matched), exact_key, "left_anti"
    )
    tok = usable.filter(numeric)
    scalars = _near_matches(
        obs, tok.filter(near_allowed(F.col("category"), F.col("context_class"))).select(*group, "scalar", *described),
        tolerance, group,
    )
    near = obs.withColumnRenamed("scalar", "obs_scalar").join(
        _shuffled(scalars.drop("scalar")), [*group, "obs_scalar"]
    ).select(
        *by, *VALUE_KEY, *described,
        F.lit("near").alias("match_kind"), "distance",
        F.when(F.col("unit") != "", F.col("unit")).alias("normalized_unit"),
    )
    return exact.unionByName(near)


def _evidence(**flags: Column) -> Column:
    """Array of the flagged evidence names, in declaration order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in flags.items()]))


def assess_values(observed: DataFrame, tokens: DataFrame, tolerance: float, by=KEYS) -> DataFrame:
    """A19 on distinct values: classification, confidence and ordered evidence."""
    scope = [*by, "category", "context_class"]
    numeric = F.col("kind") == "numeric"
    missing = F.col("canonical_value").isNull()
    stats = tokens.groupBy(*scope).agg(
        F.bool_or(missing).alias("any_missing"),
        F.bool_or(~missing & (F.col("kind") == "unsupported")).alias("any_unsupported"),
        F.bool_or(~missing & (F.col("kind") != "unsupported")).alias("any_usable"),
        F.min(F.when(numeric, F.col("unit"))).alias("min_unit"),
        F.max(F.when(numeric, F.col("unit"))).alias("max_unit"),
    )
    hits = value_suggestions(observed, tokens, tolerance, by).groupBy(*by, *VALUE_KEY).agg(
        F.first("match_kind").alias("match_kind"), F.count(F.lit(1)).alias("suggestion_count")
    )
    rows = observed.join(_shuffled(stats), scope, "left").join(_shuffled(hits), [*by, *VALUE_KEY], "left")

    unsupported = F.col("kind") == "unsupported"
    classification = (
        F.when(F.col("any_usable").isNull() | unsupported, "unassessed")
        .when(F.col("match_kind").isNotNull(), F.col("match_kind"))
        .when(~F.col("any_usable"), "unassessed")
        .otherwise("unmatched")
    )
    multiple = F.coalesce(F.col("suggestion_count") > 1, F.lit(False))
    clear = F.col("context").isin(CLEAR_CONTEXTS)
    c = F.col("classification")
    hit = c.isin("exact", "near")
    no_tokens = F.col("any_usable").isNull()
    uncovered = ~no_tokens & ~unsupported & (c == "unassessed")
    can_be_near = numeric & near_allowed(F.col("category"), F.col("context"))
    other_unit = (F.col("min_unit") != F.col("unit")) | (F.col("max_unit") != F.col("unit"))
    return rows.withColumn("classification", classification).select(
        *by, *VALUE_KEY, "classification",
        F.when(hit, confidence(c, F.col("context"), multiple)).alias("confidence"),
        F.coalesce("suggestion_count", F.lit(0)).cast("bigint").alias("suggestion_count"),
        _evidence(
            exact_value=c == "exact",
            within_numeric_tolerance=c == "near",
            clear_usage_context=hit & clear,
            generic_dimension_context=hit & ~clear,
            multiple_equal_matches=hit & multiple,
            missing_canonical_values=no_tokens | (uncovered & F.col("any_missing")),
            incomplete_canonical_coverage=uncovered,
            unsupported_canonical_format=(~no_tokens & unsupported) | (uncovered & F.col("any_unsupported")),
            incompatible_units=(c == "unmatched") & can_be_near & other_unit,
            outside_numeric_tolerance=c == "unmatched",
        ).alias("evidence"),
    )


def infer_tokens(sites: DataFrame, tokens: DataFrame, tolerance: float = DEFAULT_NUMERIC_TOLERANCE, by=KEYS) -> DataFrame:
    """One inference row per hard-coded style site."""
    assessed = assess_values(observed_values(sites, by), normalized_tokens(tokens, by), tolerance, by)
    return sites.join(assessed, [*by, *VALUE_KEY]).withColumnRenamed("id", "site_id")


def suggestions(sites: DataFrame, tokens: DataFrame, tolerance: float = DEFAULT_NUMERIC_TOLERANCE, by=KEYS) -> DataFrame:
    """The suggested tokens of every site, as a child table."""
    rows = value_suggestions(observed_values(sites, by), normalized_tokens(tokens, by), tolerance, by)
    return sites.select(*by, F.col("id").alias("site_id"), *VALUE_KEY).join(rows, [*by, *VALUE_KEY])


def inference_counts(inference: DataFrame, by=RUN) -> DataFrame:
    """Totals by class, and candidates by confidence, category, context."""
    c = F.col("classification")
    candidate = c.isin("exact", "near")

    def n(cond: Column, alias: str) -> Column:
        return F.count_if(cond).cast("bigint").alias(alias)

    return inference.groupBy(*by).agg(
        F.count(F.lit(1)).alias("hardcoded_observation_count"),
        n(c != "unassessed", "assessed_observation_count"),
        n(c == "exact", "exact_replacement_candidate_count"),
        n(c == "near", "near_replacement_candidate_count"),
        n(c == "unmatched", "unmatched_observation_count"),
        n(c == "unassessed", "unassessed_observation_count"),
        *[n(candidate & (F.col("confidence") == x), f"confidence_{x}") for x in CONFIDENCES],
        *[n(candidate & (F.col("category") == x), f"category_{x}") for x in CATEGORIES],
        *[n(candidate & (F.col("context") == x), f"context_{x}") for x in CONTEXTS],
    )


def value_coverage(tokens: DataFrame, by=KEYS) -> DataFrame:
    """Tokens with a usable, missing or unsupported value per category.

    A token's own category decides how its value is read here.
    """
    own = F.when(F.col("category").isin("spacing", "radius"), F.lit("layout")).otherwise(F.col("category"))
    read = normalized_tokens(tokens, by).filter(F.col("context_class") == own)
    missing = F.col("canonical_value").isNull()
    unsupported = ~missing & (F.col("kind") == "unsupported")
    return read.groupBy(*by, "category").agg(
        F.count(F.lit(1)).alias("token_count"),
        F.count_if(~missing & ~unsupported).cast("bigint").alias("usable_value_count"),
        F.count_if(missing).cast("bigint").alias("missing_value_count"),
        F.count_if(unsupported).cast("bigint").alias("unsupported_value_count"),
    )


def blocked_observations(inference: DataFrame, by=KEYS) -> DataFrame:
    """Unassessed sites per category and blocking reason."""
    return (
        inference.filter(F.col("classification") == "unassessed")
        .select(*by, "category", F.explode("evidence").alias("reason"))
        .groupBy(*by, "category", "reason")
        .agg(F.count(F.lit(1)).alias("blocked_observation_count"))
    )
