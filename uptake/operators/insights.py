"""Reports over finished facts: rollups, hotspots, unused, deltas, gates.

Covers A15-A18, A21, J16-J19, O01-O08, U02-U06 and S11.  Top-k reports rank
pre-aggregated rows, so Spark prunes each partition to k rows before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import CLASSIFICATIONS, CONFIDENCES, KEYS, MATCH_STATUSES, RUN, SYMBOL_KINDS, rank_of
from .metrics import ratio


def _count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def top_k(df: DataFrame, k: int, order: list, by=RUN) -> DataFrame:
    """The first ``k`` rows per ``by`` group; ``order`` must be total."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# --- rollups -----------------------------------------------------------------

def symbol_rollups(usage: DataFrame, by=RUN) -> DataFrame:
    """Calls per symbol and status; registry name for resolved/candidate."""
    registry_backed = F.col("match_status").isin("resolved", "candidate")
    label = F.when(registry_backed, F.coalesce("registry_symbol", "symbol")).otherwise(F.col("symbol"))
    return usage.groupBy(*by, "match_status", label.alias("rollup_symbol")).agg(
        F.count(F.lit(1)).alias("invocation_count")
    )


def hotspots(usage: DataFrame, k: int = 5, by=RUN) -> DataFrame:
    """The busiest parent scopes of a run with per-status counts."""
    order = F.struct("language", "file", "line", "id")
    parents = (
        usage.filter(F.col("parent_id").isNotNull())
        .groupBy(*by, "parent_id")
        .agg(
            F.min_by("parent_symbol", order).alias("parent_symbol"),
            F.min_by("parent_scope_kind", order).alias("parent_scope_kind"),
            F.count(F.lit(1)).alias("raw_total"),
            *[_count_if(F.col("match_status") == s).alias(f"raw_{s}") for s in MATCH_STATUSES],
        )
    )
    return top_k(parents, k, [F.desc("raw_total"), "parent_symbol", "parent_id"], by)


def ds_vs_local(counts: DataFrame) -> DataFrame:
    """Resolved / (resolved + local), null when both are 0."""
    return counts.withColumn(
        "ds_vs_local_ratio", ratio(F.col("raw_resolved"), F.col("raw_resolved") + F.col("raw_local"))
    )


def fragmentation(local_components: DataFrame, by=RUN) -> DataFrame:
    """Families of local symbols ending in Button or Modal, two or more.

    One row per family member keeps a large family distributed; the member
    count of the family is repeated on each row.
    """
    family = F.regexp_extract("symbol", r"(Button|Modal)\z", 1)
    members = (
        local_components.select(*by, F.concat(F.lit("*"), family).alias("pattern"), "symbol")
        .filter(F.col("pattern") != "*").distinct()
    )
    sizes = members.groupBy(*by, "pattern").agg(F.count(F.lit(1)).alias("family_size")).filter("family_size >= 2")
    return members.join(sizes, [*by, "pattern"])


def exact_name_duplicates(local_components: DataFrame, by=RUN) -> DataFrame:
    """Local symbols defined in more than one file."""
    files = local_components.select(*by, "symbol", "file").distinct()
    return (
        files.groupBy(*by, "symbol").agg(F.count(F.lit(1)).alias("file_count")).filter("file_count > 1")
    )


def unused_components(components: DataFrame, usage: DataFrame, by=RUN) -> DataFrame:
    """Registry symbols never resolved in any language of the run.

    Both sides are reduced to distinct symbols before the anti join.
    """
    registry = F.coalesce("registry_symbol", "symbol")
    order = F.struct("language", "id")
    inventory = (
        components.groupBy(*by, registry.alias("registry_symbol"))
        .agg(F.min_by(F.coalesce("symbol", "registry_symbol"), order).alias("symbol"),
             F.min_by(F.struct("package"), order)["package"].alias("package"))
    )
    resolved = (
        usage.filter(F.col("match_status") == "resolved")
        .select(*by, F.coalesce("registry_symbol", "symbol").alias("registry_symbol")).distinct()
    )
    return inventory.join(resolved, [*by, "registry_symbol"], "left_anti")


# --- token inference reports -------------------------------------------------

def style_enrich(inference: DataFrame, style_sites: DataFrame, by=KEYS) -> DataFrame:
    """Put location, context and value of the raw site on each inference row."""
    raw = style_sites.select(*by, F.col("id").alias("site_id"), "file", "line", "col", "context", "value")
    keep = [c for c in inference.columns if c not in ("file", "line", "col", "context", "value")]
    return inference.select(*keep).join(raw, [*by, "site_id"])


def confidence_rank(c: Column) -> Column:
    """very_high first; anything unknown last."""
    return F.coalesce(len(CONFIDENCES) - 1 - rank_of(c, CONFIDENCES), F.lit(len(CONFIDENCES)))


def ranked_findings(inference: DataFrame, k: int = 5, by=RUN) -> DataFrame:
    """The top exact/near findings by confidence, file, line, column."""
    rows = inference.filter(F.col("classification").isin("exact", "near"))
    order = [confidence_rank(F.col("confidence")), "file", "line", F.coalesce("col", F.lit(0)), "language", "site_id"]
    return top_k(rows, k, order, by)


def candidate_lists(inference: DataFrame) -> DataFrame:
    """Confirmed, possible, unmatched and unassessed lists in one table."""
    names = ["confirmed_candidates", "possible_candidates", "unmatched_observations", "unassessed_observations"]
    mapping = F.create_map(*[F.lit(x) for pair in zip(CLASSIFICATIONS, names) for x in pair])
    listed = inference.withColumn("list_name", F.try_element_at(mapping, F.col("classification")))
    ranked = F.when(F.col("classification").isin("exact", "near"), confidence_rank(F.col("confidence"))).otherwise(0)
    return listed.orderBy("list_name", ranked, "language", "file", "line", "site_id")


def order_inference(inference: DataFrame) -> DataFrame:
    """Language, file, line, column (null = 0), site id."""
    return inference.orderBy("language", "file", "line", F.coalesce("col", F.lit(0)), "site_id")


def order_usage(usage: DataFrame) -> DataFrame:
    """File, line, symbol."""
    return usage.orderBy("file", "line", "symbol", "id")


def order_tokens(token_sites: DataFrame) -> DataFrame:
    """File, line, column, token id."""
    return token_sites.orderBy("file", "line", "col", "token_id")


def order_styles(style_sites: DataFrame) -> DataFrame:
    """File, line, column, value."""
    return style_sites.orderBy("file", "line", "col", "value")


# --- top symbols -------------------------------------------------------------

def synthesized_symbols(usage: DataFrame, by=RUN) -> DataFrame:
    """Summary rows rebuilt from local and unresolved sites of a run."""
    local = F.col("match_status") == "local"
    sites = usage.filter(F.col("match_status").isin("local", "unresolved")).withColumn(
        "_key", F.when(local, F.coalesce("local_definition_id", "symbol")).otherwise(F.col("symbol"))
    )
    key = [*by, "_key"]
    order = F.struct("language", "file", "line", F.coalesce("col", F.lit(0)), "id")
    first = F.min_by(
        F.struct("symbol", "match_status", "registry_symbol", "local_definition_id"), order
    )
    base = sites.groupBy(*key).agg(first.alias("_f"), F.count(F.lit(1)).alias("raw_invocation_count"))
    return base.select(
        *by,
        F.concat_ws(":", F.col("_f.match_status"), F.col("_key")).alias("symbol_id"),
        F.col("_f.symbol").alias("symbol"),
        F.col("_f.match_status").alias("symbol_kind"),
        F.col("_f.registry_symbol").alias("registry_symbol"),
        F.col("_f.local_definition_id").alias("local_definition_id"),
        "raw_invocation_count",
    )


def top_symbols(reported: DataFrame, usage: DataFrame, kind: str, k: int = 5, by=RUN) -> DataFrame:
    """Top symbols of a kind; reported rows beat synthesised ones."""
    cols = [*by, "symbol_id", "symbol", "symbol_kind", "registry_symbol", "local_definition_id", "raw_invocation_count"]
    rows = (
        reported.select(*cols, F.lit(0).alias("_src"))
        .unionByName(synthesized_symbols(usage, by).select(*cols, F.lit(1).alias("_src")))
        .filter(F.col("symbol_kind") == kind)
        .withColumns({
            "_local": F.coalesce("local_definition_id", F.lit("")),
            "_registry": F.coalesce("registry_symbol", F.lit("")),
        })
    )
    # Reported rows arrive in summary order: count descending, then symbol id.
    first = F.struct("_src", F.negative("raw_invocation_count"), "symbol_id")
    unique = rows.groupBy(*by, "symbol_kind", "_local", "symbol", "_registry").agg(
        F.min_by(F.struct("symbol_id", "raw_invocation_count"), first).alias("_f")
    ).select(*by, "symbol_kind", "symbol", F.col("_f.symbol_id").alias("symbol_id"),
             F.col("_f.raw_invocation_count").alias("raw_invocation_count"))
    return top_k(unique, k, [F.desc("raw_invocation_count"), "symbol", "symbol_id"], by)


# --- deltas ------------------------------------------------------------------

def symbol_delta(current: DataFrame, baseline: DataFrame, by=("repo_id",)) -> DataFrame:
    """Current minus baseline per symbol id, missing = 0.

    A symbol id may appear in several summary rows; the last one in summary
    order stands for it, rows are not added up.
    """
    counters = ["raw_invocation_count", "file_count", "parent_scope_count"]
    labels = ["symbol", "symbol_kind", "match_status"]
    key = [*by, "symbol_id"]
    # Total order inside one symbol id: fewest calls last, then kind, language and the grouping key.
    last = F.struct(
        F.negative("raw_invocation_count"), rank_of(F.col("symbol_kind"), SYMBOL_KINDS),
        "language", "symbol", F.coalesce("qualified_symbol", F.lit("")),
    )

    def side(df: DataFrame, prefix: str) -> DataFrame:
        row = F.max_by(F.struct(*labels, *counters), last)
        return df.groupBy(*key).agg(row.alias(prefix))

    both = side(current, "c").join(side(baseline, "b"), key, "full_outer")
    return both.select(
        *key,
        *[F.coalesce(f"c.{x}", f"b.{x}").alias(x) for x in labels],
        *[(F.coalesce(f"c.{x}", F.lit(0)) - F.coalesce(f"b.{x}", F.lit(0))).cast("bigint").alias(x) for x in counters],
    )


RAW = ["raw_total", *[f"raw_{s}" for s in MATCH_STATUSES]]
RATIOS = ["ds_vs_local_ratio", "invocation_adoption_ratio", "registry_resolution_ratio"]


def _delta(current: DataFrame, baseline: DataFrame, key: list[str], ratios: list[str], counters: list[str]) -> DataFrame:
    c, b = current.alias("c"), baseline.alias("b")
    return c.join(b, key).select(
        *key,
        *[(F.col(f"c.{x}") - F.col(f"b.{x}")).alias(f"{x}_delta") for x in ratios],
        *[(F.col(f"c.{x}") - F.col(f"b.{x}")).cast("bigint").alias(f"{x}_delta") for x in counters],
    )


def language_delta(current: DataFrame, baseline: DataFrame, by=("repo_id", "language")) -> DataFrame:
    """Only languages in both scans; a null ratio on either side stays null."""
    return _delta(current, baseline, list(by), RATIOS[1:], RAW)


def repo_delta(current: DataFrame, baseline: DataFrame, by=("repo_id",)) -> DataFrame:
    """Current minus baseline of the merged run."""
    return _delta(current, baseline, list(by), RATIOS, [*RAW, "parent_scope_total"])


def language_sets(current: DataFrame, baseline: DataFrame, by=("repo_id",)) -> DataFrame:
    """Each language as shared, only_current or only_baseline."""
    def langs(df: DataFrame, flag: str) -> DataFrame:
        return df.select(*by, "language").distinct().withColumn(flag, F.lit(True))

    both = langs(current, "_c").join(langs(baseline, "_b"), [*by, "language"], "full_outer")
    return both.select(
        *by, "language",
        F.when(F.col("_b").isNull(), "only_current").when(F.col("_c").isNull(), "only_baseline")
        .otherwise("shared").alias("presence"),
    )


def snapshot_trend(merged: DataFrame) -> DataFrame:
    """Every run of a repository against its previous snapshot."""
    w = Window.partitionBy("repo_id").orderBy("snapshot_id")
    return merged.select(
        "repo_id", "snapshot_id",
        F.lag("snapshot_id").over(w).alias("previous_snapshot_id"),
        *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}_delta") for c in [*RATIOS, *RAW, "parent_scope_total"]],
    )


def replay_diff(current_ids: DataFrame, baseline_ids: DataFrame, expected: DataFrame, by=("repo_id",)) -> DataFrame:
    """Ids lost or added against a baseline, minus the expected changes.

    ``expected`` holds (repo, id, change) with change ``lost`` or ``added``.
    """
    key = [*by, "id"]
    have = current_ids.select(*key).distinct().withColumn("_h", F.lit(True))
    want = baseline_ids.select(*key).distinct().withColumn("_w", F.lit(True))
    changed = (
        have.join(want, key, "full_outer")
        .filter(F.col("_h").isNull() | F.col("_w").isNull())
        .select(*key, F.when(F.col("_h").isNull(), "lost").otherwise("added").alias("change"))
    )
    return changed.join(expected.select(*key, "change").distinct(), [*key, "change"], "left_anti")


def replay_gate(diff: DataFrame, current_runs: DataFrame, baseline_runs: DataFrame,
                max_slowdown_percent: float = 10.0, by=("repo_id",)) -> DataFrame:
    """Pass or fail per repository, with the slowdown in percent."""
    key = list(by)
    lost = diff.groupBy(*key).agg(
        _count_if(F.col("change") == "lost").alias("lost_count"),
        _count_if(F.col("change") == "added").alias("added_count"),
    )
    now = current_runs.groupBy(*key).agg(
        F.sum("parse_extract_ms").alias("ms"), F.bool_or(F.col("status") == "failed").alias("failed"))
    base = baseline_runs.groupBy(*key).agg(F.sum("parse_extract_ms").alias("base_ms"))
    rows = now.join(base, key, "left").join(lost, key, "left").fillna(0, ["lost_count", "added_count", "base_ms"])
    slowdown = F.when(F.col("base_ms") == 0, F.lit(0.0)).otherwise(
        (F.col("ms") - F.col("base_ms")).cast("double") * 100.0 / F.col("base_ms"))
    return rows.select(
        *key, "lost_count", "added_count", slowdown.alias("slowdown_percent"),
        (~F.col("failed") & (F.col("lost_count") == 0) & (F.col("added_count") == 0)
         & (slowdown <= max_slowdown_percent)).alias("passed"),
    )


# --- run status --------------------------------------------------------------

def is_failure(severity: Column, code: Column) -> Column:
    return (severity == "error") | (code == "parse_failed")


def failure_diagnostics(diagnostics: DataFrame, k: int = 5, by=RUN) -> DataFrame:
    """The first failures of a run, with the total and the omitted number."""
    rows = diagnostics.filter(is_failure(F.col("severity"), F.col("code")))
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total_count"))
    shown = top_k(rows, k, ["language", "ordinal"], by)
    return shown.join(totals, list(by)).withColumn(
        "omitted_count", F.greatest(F.lit(0), F.col("total_count") - k).cast("bigint")
    )


def strict_gate(scan_runs: DataFrame, diagnostics: DataFrame, by=RUN) -> DataFrame:
    """Partial and failed languages of a run and its failure count."""
    def names(status: str) -> Column:
        # At most one entry per language of the run.
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == status, F.col("language")))), ",")

    status = scan_runs.groupBy(*by).agg(
        names("partial").alias("partial_languages"), names("failed").alias("failed_languages"))
    failures = diagnostics.filter(is_failure(F.col("severity"), F.col("code"))).groupBy(*by).agg(
        F.count(F.lit(1)).alias("failure_diagnostic_count"))
    return status.join(failures, list(by), "left").fillna(0, ["failure_diagnostic_count"])


def scan_summary(scan_runs: DataFrame, counts: DataFrame, merged: DataFrame) -> DataFrame:
    """One report table with a line per language and one for the whole run."""
    def percent(c: str) -> Column:
        return F.bround(F.col(c) * 100.0, 1).alias(c.replace("_ratio", "_percent"))

    cols = ["raw_resolved", "raw_candidate", "raw_local", "raw_unresolved"]
    lines = [percent("invocation_adoption_ratio"), percent("registry_resolution_ratio"), *cols]
    per_language = scan_runs.select(*KEYS, "status").join(counts, KEYS).select(*KEYS, "status", *lines)
    whole = merged.select(*RUN, F.lit("all").alias("language"), F.lit(None).cast("string").alias("status"), *lines)
    return per_language.unionByName(whole)
