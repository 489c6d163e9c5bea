"""A01-A13, X29, X30, O03, O09, U01."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.identity import identity_basis, identity_stability, symbol_id
from ...operators import metrics as m
from ...schemas import CATEGORIES, KEYS, MATCH_STATUSES
from . import query

K = "repo_id, snapshot_id, language"
RAW_SQL = (
    "CAST(count(*) AS BIGINT) AS raw_total, "
    + ", ".join(f"CAST(sum(CASE WHEN match_status = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS raw_{s}" for s in MATCH_STATUSES)
)
RAW_COLS = "raw_total, raw_resolved, raw_candidate, raw_local, raw_unresolved"
PARENT_SQL = (
    "count(DISTINCT parent_id) AS parent_scope_total, "
    + ", ".join(
        f"count(DISTINCT CASE WHEN match_status = '{s}' THEN parent_id END) AS parent_with_{s}_invocations"
        for s in ("resolved", "local", "unresolved")
    )
)
RATIO_SQL = (
    "CASE WHEN eligible_invocation_count <> 0 THEN CAST(adopted_invocation_count AS DOUBLE) / eligible_invocation_count END AS invocation_adoption_ratio, "
    "CASE WHEN raw_total <> 0 THEN CAST(raw_resolved AS DOUBLE) / raw_total END AS registry_resolution_ratio"
)


@query("a01_raw_invocations", f"SELECT {K}, {RAW_SQL} FROM {{v_usage_sites}} GROUP BY {K}")
def _a01(t):
    return m.raw_invocations(t["v_usage_sites"])


@query("a02_adoption", f"""
SELECT *, raw_resolved + raw_local + raw_unresolved AS eligible_invocation_count, raw_resolved AS adopted_invocation_count,
 raw_local + raw_unresolved AS non_adopted_invocation_count
FROM (SELECT {K}, {RAW_SQL} FROM {{v_usage_sites}} GROUP BY {K}) c""")
def _a02(t):
    return m.adoption(m.raw_invocations(t["v_usage_sites"]))


@query("a03_candidate_policy", f"""
WITH c AS (SELECT {K}, {RAW_SQL} FROM {{v_usage_sites}} GROUP BY {K})
SELECT {K}, 'report_separately' AS policy, raw_resolved + raw_local + raw_unresolved AS eligible_invocation_count,
 raw_resolved AS adopted_invocation_count, raw_local + raw_unresolved AS non_adopted_invocation_count FROM c
UNION ALL SELECT {K}, 'count_as_non_adopted', raw_total, raw_resolved, raw_total - raw_resolved FROM c
UNION ALL SELECT {K}, 'count_as_adopted', raw_total, raw_resolved + raw_candidate, raw_local + raw_unresolved FROM c""")
def _a03(t):
    raw = m.raw_invocations(t["v_usage_sites"])
    cols = [*KEYS, "policy", "eligible_invocation_count", "adopted_invocation_count", "non_adopted_invocation_count"]
    policies = ["report_separately", "count_as_non_adopted", "count_as_adopted"]
    return m.merge_symbol_rows([m.adoption(raw, p).withColumn("policy", F.lit(p)).select(*cols) for p in policies])


@query("a04_ratios", f"""
SELECT {K}, {RATIO_SQL} FROM (
 SELECT *, raw_resolved + raw_local + raw_unresolved AS eligible_invocation_count, raw_resolved AS adopted_invocation_count
 FROM (SELECT {K}, {RAW_SQL} FROM {{v_usage_sites}} GROUP BY {K}) c) d""")
def _a04(t):
    counts = m.with_ratios(m.adoption(m.raw_invocations(t["v_usage_sites"])))
    return counts.select(*KEYS, "invocation_adoption_ratio", "registry_resolution_ratio")


A05_SQL = f"""
SELECT c.repo_id, c.snapshot_id, c.language, registry_component_count, registry_used_component_count,
 registry_resolved_raw_invocation_count, registry_candidate_raw_invocation_count
FROM (SELECT {K}, count(*) AS registry_component_count FROM {{v_components}} GROUP BY {K}) c
JOIN (SELECT {K}, count(DISTINCT CASE WHEN match_status = 'resolved' THEN registry_symbol END) AS registry_used_component_count,
 CAST(sum(CASE WHEN match_status = 'resolved' THEN 1 ELSE 0 END) AS BIGINT) AS registry_resolved_raw_invocation_count,
 CAST(sum(CASE WHEN match_status = 'candidate' THEN 1 ELSE 0 END) AS BIGINT) AS registry_candidate_raw_invocation_count
 FROM {{v_usage_sites}} GROUP BY {K}) u ON c.language = u.language"""


@query("a05_registry_counts", A05_SQL)
def _a05(t):
    return m.registry_counts(t["v_usage_sites"], t["v_components"])


A06_SQL = f"""
SELECT l.repo_id, l.snapshot_id, l.language, local_definition_count, invoked_local_definition_count,
 greatest(0, local_definition_count - invoked_local_definition_count) AS unused_local_definition_count
FROM (SELECT {K}, count(*) AS local_definition_count FROM {{v_local_components}} GROUP BY {K}) l
JOIN (SELECT {K}, count(DISTINCT CASE WHEN match_status = 'local' THEN local_definition_id END) AS invoked_local_definition_count
 FROM {{v_usage_sites}} GROUP BY {K}) u ON l.language = u.language"""


@query("a06_definition_counts", A06_SQL)
def _a06(t):
    return m.definition_counts(t["v_usage_sites"], t["v_local_components"])


A07_SQL = f"SELECT {K}, {PARENT_SQL} FROM {{v_usage_sites}} GROUP BY {K}"


@query("a07_parent_scope_counts", A07_SQL)
def _a07(t):
    return m.parent_scope_counts(t["v_usage_sites"])


def _by_category(prefix: str) -> str:
    return ", ".join(
        f"CAST(sum(CASE WHEN category = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS {prefix}_{c}" for c in CATEGORIES)


@query("a08_token_counts", f"""
SELECT * FROM (SELECT {K}, count(*) AS configured_token_count FROM {{v_tokens}} GROUP BY {K}) a
JOIN (SELECT {K}, count(DISTINCT token_id) AS used_token_count, count(*) AS token_reference_site_count, {_by_category('token_references')},
 count(DISTINCT parent_id) AS parents_with_token_references FROM {{v_token_sites}} GROUP BY {K}) b USING ({K})
JOIN (SELECT {K}, count(*) AS hardcoded_style_candidate_count, {_by_category('hardcoded')},
 count(DISTINCT parent_id) AS parents_with_hardcoded_styles FROM {{v_style_sites}} GROUP BY {K}) c USING ({K})""")
def _a08(t):
    return m.token_counts(t["v_tokens"], t["v_token_sites"], t["v_style_sites"])


SYMBOL_ID_SQL = (
    "concat(language, CASE WHEN registry_symbol IS NOT NULL THEN CASE match_status WHEN 'candidate' THEN concat(':candidate:', registry_symbol) ELSE concat(':registry:', registry_symbol) END "
    "WHEN local_definition_id IS NOT NULL THEN concat(':local:', coalesce(qualified_symbol, local_definition_id)) "
    "ELSE concat(':symbol:', coalesce(qualified_symbol, symbol)) END)"
)
S = "match_status, registry_symbol, local_definition_id, qualified_symbol, symbol"
SYMBOLS_SQL = f"""
SELECT {K}, {S}, count(*) AS raw_invocation_count, count(DISTINCT file) AS file_count, count(DISTINCT parent_id) AS parent_scope_count,
 {SYMBOL_ID_SQL} AS symbol_id, CASE match_status WHEN 'resolved' THEN 'registry' ELSE match_status END AS symbol_kind,
 CASE WHEN registry_symbol IS NOT NULL THEN 'registry_id' WHEN local_definition_id IS NOT NULL THEN 'local_definition_id'
  WHEN qualified_symbol IS NOT NULL THEN 'qualified_symbol' ELSE 'source_symbol' END AS identity_basis,
 CASE WHEN coalesce(registry_symbol, local_definition_id, qualified_symbol) IS NOT NULL THEN 'semantic' ELSE 'scan_local' END AS identity_stability
FROM {{usage}} GROUP BY {K}, {S}"""


def symbols_sql(view: str) -> str:
    return SYMBOLS_SQL.replace("{usage}", "{" + view + "}")


@query("a09_symbol_usage", symbols_sql("v_usage_sites"))
def _a09(t):
    return m.symbol_usage(t["v_usage_sites"])


PARENT_ROWS_SQL = f"""
SELECT {K}, {S}, parent_id, parent_symbol, parent_scope_kind, count(*) AS invocation_count
FROM {{v_usage_sites}} WHERE parent_id IS NOT NULL GROUP BY {K}, {S}, parent_id, parent_symbol, parent_scope_kind"""


@query("a10_parent_rows", PARENT_ROWS_SQL)
def _a10(t):
    return m.parent_rows(t["v_usage_sites"])


@query("a10_parent_rows_top3", f"""
SELECT {K}, {S}, parent_id, parent_symbol, parent_scope_kind, invocation_count FROM (
 SELECT *, row_number() OVER (PARTITION BY {K}, {S} ORDER BY invocation_count DESC, parent_id) AS rn FROM ({PARENT_ROWS_SQL}) p) q WHERE rn <= 3""")
def _a10_top(t):
    return m.parent_rows(t["v_usage_sites"], limit=3)


@query("a11_token_usage", f"""
SELECT {K}, token_id, k.key, k.category, reference_count, file_count, parent_scope_count FROM (
 SELECT {K}, token_id, count(*) AS reference_count, count(DISTINCT file) AS file_count, count(DISTINCT parent_id) AS parent_scope_count
 FROM {{v_token_sites}} GROUP BY {K}, token_id) s
JOIN (SELECT {K}, id AS token_id, key, category FROM {{v_tokens}}) k USING ({K}, token_id)""")
def _a11(t):
    return m.token_usage(t["v_tokens"], t["v_token_sites"])


def merged_sql(view: str = "v_usage_sites") -> str:
    return f"""
SELECT *, {RATIO_SQL} FROM (
 SELECT repo_id, snapshot_id, CAST(sum(raw_total) AS BIGINT) AS raw_total, CAST(sum(raw_resolved) AS BIGINT) AS raw_resolved,
  CAST(sum(raw_candidate) AS BIGINT) AS raw_candidate, CAST(sum(raw_local) AS BIGINT) AS raw_local, CAST(sum(raw_unresolved) AS BIGINT) AS raw_unresolved,
  CAST(sum(registry_component_count) AS BIGINT) AS registry_component_count, CAST(sum(registry_used_component_count) AS BIGINT) AS registry_used_component_count,
  CAST(sum(registry_resolved_raw_invocation_count) AS BIGINT) AS registry_resolved_raw_invocation_count,
  CAST(sum(registry_candidate_raw_invocation_count) AS BIGINT) AS registry_candidate_raw_invocation_count,
  CAST(sum(local_definition_count) AS BIGINT) AS local_definition_count, CAST(sum(invoked_local_definition_count) AS BIGINT) AS invoked_local_definition_count,
  CAST(sum(unused_local_definition_count) AS BIGINT) AS unused_local_definition_count,
  CAST(sum(parent_scope_total) AS BIGINT) AS parent_scope_total, CAST(sum(parent_with_resolved_invocations) AS BIGINT) AS parent_with_resolved_invocations,
  CAST(sum(parent_with_local_invocations) AS BIGINT) AS parent_with_local_invocations,
  CAST(sum(parent_with_unresolved_invocations) AS BIGINT) AS parent_with_unresolved_invocations,
  CAST(sum(raw_resolved + raw_local + raw_unresolved) AS BIGINT) AS eligible_invocation_count, CAST(sum(raw_resolved) AS BIGINT) AS adopted_invocation_count,
  CAST(sum(raw_local + raw_unresolved) AS BIGINT) AS non_adopted_invocation_count
 FROM (SELECT {K}, {RAW_SQL} FROM {{v_usage_sites}} GROUP BY {K}) a
 JOIN ({A05_SQL}) b USING ({K}) JOIN ({A06_SQL}) d USING ({K}) JOIN ({A07_SQL}) e USING ({K})
 GROUP BY repo_id, snapshot_id) x"""


@query("a12_merge_languages", merged_sql())
def _a12(t):
    counts = m.adoption_counts(t["v_usage_sites"], t["v_components"], t["v_local_components"])
    return m.merge_languages(counts)


@query("a13_run_metrics", """
SELECT repo_id, snapshot_id, CAST(sum(files_scanned) AS BIGINT) AS files_scanned, CAST(sum(parse_extract_ms) AS BIGINT) AS parse_extract_ms
FROM {v_scan_runs} GROUP BY repo_id, snapshot_id""")
def _a13(t):
    return m.run_metrics(t["v_scan_runs"])


@query("o03_order_symbol_summary", f"SELECT {K}, symbol_id, symbol, symbol_kind, raw_invocation_count FROM ({symbols_sql('v_usage_sites')}) s ORDER BY raw_invocation_count DESC, symbol_id")
def _o03(t):
    return m.order_symbol_summary(m.symbol_usage(t["v_usage_sites"])).select(
        *KEYS, "symbol_id", "symbol", "symbol_kind", "raw_invocation_count")


@query("o09_order_token_summary", f"SELECT {K}, token_id, k.key, count(*) AS reference_count FROM {{v_token_sites}} JOIN (SELECT {K}, id AS token_id, key FROM {{v_tokens}}) k USING ({K}, token_id) GROUP BY {K}, token_id, k.key ORDER BY language, token_id")
def _o09(t):
    return m.order_token_summary(m.token_usage(t["v_tokens"], t["v_token_sites"])).select(
        *KEYS, "token_id", "key", "reference_count")


@query("u01_merge_symbol_rows", f"SELECT {K}, symbol_id, symbol_kind, symbol, raw_invocation_count FROM ({symbols_sql('v_usage_sites')}) s")
def _u01(t):
    usage = t["v_usage_sites"]
    parts = [m.symbol_usage(usage.filter(F.col("language") == x)) for x in ("compose", "react", "swift")]
    return m.merge_symbol_rows(parts).select(*KEYS, "symbol_id", "symbol_kind", "symbol", "raw_invocation_count")


@query("x29_symbol_id", f"SELECT DISTINCT {K}, {S}, {SYMBOL_ID_SQL} AS symbol_id FROM {{v_usage_sites}}")
def _x29(t):
    u = t["v_usage_sites"]
    names = ["registry_symbol", "local_definition_id", "qualified_symbol", "symbol"]
    return u.withColumn("symbol_id", symbol_id("language", "match_status", *names)).select(
        *KEYS, *m.SYMBOL_KEY, "symbol_id").distinct()


@query("x30_identity_basis", f"""
SELECT {K}, identity_basis, identity_stability, count(*) AS site_count FROM (SELECT {K},
 CASE WHEN registry_symbol IS NOT NULL THEN 'registry_id' WHEN local_definition_id IS NOT NULL THEN 'local_definition_id' WHEN qualified_symbol IS NOT NULL THEN 'qualified_symbol' ELSE 'source_symbol' END AS identity_basis,
 CASE WHEN coalesce(registry_symbol, local_definition_id, qualified_symbol) IS NOT NULL THEN 'semantic' ELSE 'scan_local' END AS identity_stability FROM {{v_usage_sites}}) b
GROUP BY {K}, identity_basis, identity_stability""")
def _x30(t):
    link = [F.col(c) for c in ("registry_symbol", "local_definition_id", "qualified_symbol")]
    return t["v_usage_sites"].groupBy(
        *KEYS, identity_basis(*link).alias("identity_basis"), identity_stability(*link).alias("identity_stability")
    ).agg(F.count(F.lit(1)).alias("site_count"))
