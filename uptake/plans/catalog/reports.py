"""A15-A18, A21, J17-J19, O01, O02, O05, O08, U02-U06, S11."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import insights as ins, metrics as m
from ...schemas import KEYS, RUN
from . import query
from .metrics import A05_SQL, A06_SQL, K, RAW_SQL, RATIO_SQL, merged_sql, symbols_sql

R = "repo_id, snapshot_id"


@query("a15_symbol_rollups", f"""
SELECT {R}, match_status, CASE WHEN match_status IN ('resolved', 'candidate') THEN coalesce(registry_symbol, symbol) ELSE symbol END AS rollup_symbol, count(*) AS invocation_count
FROM {{v_usage_sites}} GROUP BY 1, 2, 3, 4""")
def _a15(t):
    return ins.symbol_rollups(t["v_usage_sites"])


@query("a16_hotspots", f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {R} ORDER BY raw_total DESC, parent_symbol, parent_id) AS INT) AS rank FROM (
 SELECT {R}, parent_id, min(parent_symbol) AS parent_symbol, min(parent_scope_kind) AS parent_scope_kind, {RAW_SQL}
 FROM {{v_usage_sites}} WHERE parent_id IS NOT NULL GROUP BY {R}, parent_id) p) q WHERE rank <= 5""")
def _a16(t):
    return ins.hotspots(t["v_usage_sites"])


@query("a17_ds_vs_local", f"""
SELECT {K}, CASE WHEN raw_resolved + raw_local <> 0 THEN CAST(raw_resolved AS DOUBLE) / (raw_resolved + raw_local) END AS ds_vs_local_ratio
FROM (SELECT {K}, {RAW_SQL} FROM {{v_usage_sites}} GROUP BY {K}) c""")
def _a17(t):
    return ins.ds_vs_local(m.raw_invocations(t["v_usage_sites"])).select(*KEYS, "ds_vs_local_ratio")


@query("a18_fragmentation", f"""
WITH members AS (SELECT DISTINCT {R}, concat('*', regexp_extract(symbol, '(Button|Modal)$', 1)) AS pattern, symbol FROM {{v_local_components}} WHERE regexp_matches(symbol, '(Button|Modal)$'))
SELECT * FROM members JOIN (SELECT {R}, pattern, count(*) AS family_size FROM members GROUP BY {R}, pattern HAVING count(*) >= 2) f USING ({R}, pattern)""")
def _a18(t):
    return ins.fragmentation(t["v_local_components"])


@query("a21_exact_name_duplicates", f"""
SELECT {R}, symbol, count(DISTINCT file) AS file_count FROM {{v_local_components}} GROUP BY {R}, symbol HAVING count(DISTINCT file) > 1""")
def _a21(t):
    return ins.exact_name_duplicates(t["v_local_components"])


@query("j17_unused_components", f"""
SELECT DISTINCT {R}, registry_symbol, symbol, package FROM {{v_components}} c
WHERE NOT EXISTS (SELECT 1 FROM {{v_usage_sites}} u WHERE u.match_status = 'resolved' AND u.registry_symbol = c.registry_symbol)""")
def _j17(t):
    return ins.unused_components(t["v_components"], t["v_usage_sites"])


_DELTA_COLS = ["raw_invocation_count", "file_count", "parent_scope_count"]


@query("j18_symbol_delta", f"""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, symbol_id ORDER BY raw_invocation_count, CASE symbol_kind WHEN 'registry' THEN 0 WHEN 'local' THEN 1 WHEN 'candidate' THEN 2 ELSE 3 END DESC, symbol DESC) AS rn
  FROM ({symbols_sql('v_usage_sites')} UNION ALL {symbols_sql('v_usage_baseline')}) s),
c AS (SELECT * FROM ranked WHERE rn = 1 AND snapshot_id = 's1'), b AS (SELECT * FROM ranked WHERE rn = 1 AND snapshot_id = 's0')
SELECT coalesce(c.repo_id, b.repo_id) AS repo_id, coalesce(c.symbol_id, b.symbol_id) AS symbol_id, coalesce(c.symbol, b.symbol) AS symbol,
 coalesce(c.symbol_kind, b.symbol_kind) AS symbol_kind, coalesce(c.match_status, b.match_status) AS match_status,
 {", ".join(f"CAST(coalesce(c.{x}, 0) - coalesce(b.{x}, 0) AS BIGINT) AS {x}" for x in _DELTA_COLS)}
FROM c FULL OUTER JOIN b ON c.symbol_id = b.symbol_id""")
def _j18(t):
    return ins.symbol_delta(m.symbol_usage(t["v_usage_sites"]), m.symbol_usage(t["v_usage_baseline"]))


def _language_sql(view: str) -> str:
    return f"""SELECT *, {RATIO_SQL} FROM (SELECT *, raw_resolved + raw_local + raw_unresolved AS eligible_invocation_count, raw_resolved AS adopted_invocation_count
 FROM (SELECT {K}, {RAW_SQL} FROM {{{view}}} GROUP BY {K}) x) y"""


def _diff(cols: list[str], cast: bool = False) -> str:
    return ", ".join(f"c.{x} - b.{x} AS {x}_delta" for x in cols)


def _per_language(usage):
    return m.with_ratios(m.adoption(m.raw_invocations(usage)))


def _whole(usage):
    counts = m.adoption(m.raw_invocations(usage)).join(m.parent_scope_counts(usage), KEYS)
    return ins.ds_vs_local(m.merge_languages(counts))


@query("j19_language_delta", f"""
SELECT repo_id, language, {_diff(ins.RATIOS[1:])}, {_diff(ins.RAW)}
FROM ({_language_sql('v_usage_sites')}) c JOIN ({_language_sql('v_usage_baseline')}) b USING (repo_id, language)""")
def _j19(t):
    return ins.language_delta(_per_language(t["v_usage_sites"]), _per_language(t["v_usage_baseline"]))


@query("u02_language_sets", """
SELECT repo_id, language, CASE WHEN b.l IS NULL THEN 'only_current' WHEN c.l IS NULL THEN 'only_baseline' ELSE 'shared' END AS presence
FROM (SELECT DISTINCT repo_id, language, 1 AS l FROM {v_usage_sites}) c FULL OUTER JOIN (SELECT DISTINCT repo_id, language, 1 AS l FROM {v_usage_baseline}) b USING (repo_id, language)""")
def _u02(t):
    return ins.language_sets(t["v_usage_sites"], t["v_usage_baseline"])


def _whole_sql(view: str) -> str:
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in [*ins.RAW, "parent_scope_total"])
    return f"""SELECT *, {RATIO_SQL}, CASE WHEN raw_resolved + raw_local <> 0 THEN CAST(raw_resolved AS DOUBLE) / (raw_resolved + raw_local) END AS ds_vs_local_ratio
 FROM (SELECT *, raw_resolved + raw_local + raw_unresolved AS eligible_invocation_count, raw_resolved AS adopted_invocation_count FROM (
  SELECT {R}, {sums} FROM (SELECT {K}, {RAW_SQL}, count(DISTINCT parent_id) AS parent_scope_total FROM {{{view}}} GROUP BY {K}) x GROUP BY {R}) y) z"""


@query("u03_repo_delta", f"""
SELECT repo_id, {_diff(ins.RATIOS)}, {_diff([*ins.RAW, 'parent_scope_total'])}
FROM ({_whole_sql('v_usage_sites')}) c JOIN ({_whole_sql('v_usage_baseline')}) b USING (repo_id)""")
def _u03(t):
    return ins.repo_delta(_whole(t["v_usage_sites"]), _whole(t["v_usage_baseline"]))


_TREND = [*ins.RATIOS, *ins.RAW, "parent_scope_total"]


@query("u05_snapshot_trend", f"""
WITH runs AS ({_whole_sql('v_usage_sites')} UNION ALL {_whole_sql('v_usage_baseline')})
SELECT repo_id, snapshot_id, lag(snapshot_id) OVER w AS previous_snapshot_id, {", ".join(f"{x} - lag({x}) OVER w AS {x}_delta" for x in _TREND)}
FROM runs WINDOW w AS (PARTITION BY repo_id ORDER BY snapshot_id)""")
def _u05(t):
    return ins.snapshot_trend(_whole(t["v_usage_sites"]).unionByName(_whole(t["v_usage_baseline"])))


@query("u04_replay_diff", """
SELECT repo_id, id, CASE WHEN h IS NULL THEN 'lost' ELSE 'added' END AS change FROM (
 SELECT repo_id, id, h, w FROM (SELECT DISTINCT repo_id, id, 1 AS h FROM {v_usage_sites} WHERE col <> 7) a
 FULL OUTER JOIN (SELECT DISTINCT repo_id, id, 1 AS w FROM {v_usage_baseline}) b USING (repo_id, id)) d
WHERE (h IS NULL OR w IS NULL) AND NOT (w IS NULL AND id IN (SELECT id FROM {v_usage_sites} WHERE language = 'swift'))""")
def _u04(t):
    usage = t["v_usage_sites"]
    expected = usage.filter("language = 'swift'").select("repo_id", "id", F.lit("added").alias("change"))
    return ins.replay_diff(usage.filter("col <> 7"), t["v_usage_baseline"], expected)


@query("u04_replay_gate", """
WITH n AS (SELECT repo_id, sum(parse_extract_ms) AS ms, bool_or(status = 'failed') AS failed FROM {v_scan_runs} WHERE snapshot_id = 's5' GROUP BY repo_id),
b AS (SELECT repo_id, sum(parse_extract_ms) AS base_ms FROM {v_scan_runs} WHERE snapshot_id = 's4' GROUP BY repo_id),
i AS (SELECT DISTINCT repo_id, concat(code, ':', message) AS id FROM {v_diagnostics} WHERE snapshot_id = 's5'),
j AS (SELECT DISTINCT repo_id, concat(code, ':', message) AS id FROM {v_diagnostics} WHERE snapshot_id = 's4'),
l AS (SELECT repo_id, count(*) AS lost_count FROM j WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.repo_id = j.repo_id AND i.id = j.id) GROUP BY repo_id),
a AS (SELECT repo_id, count(*) AS added_count FROM i WHERE NOT EXISTS (SELECT 1 FROM j WHERE i.repo_id = j.repo_id AND i.id = j.id) GROUP BY repo_id),
r AS (SELECT repo_id, coalesce(lost_count, 0) AS lost_count, coalesce(added_count, 0) AS added_count, failed,
 CASE WHEN coalesce(base_ms, 0) = 0 THEN 0.0 ELSE CAST(ms - base_ms AS DOUBLE) * 100.0 / base_ms END AS slowdown_percent
 FROM n LEFT JOIN b USING (repo_id) LEFT JOIN l USING (repo_id) LEFT JOIN a USING (repo_id))
SELECT repo_id, lost_count, added_count, slowdown_percent, NOT failed AND lost_count = 0 AND added_count = 0 AND slowdown_percent <= 10.0 AS passed FROM r""")
def _u04_gate(t):
    ids = t["v_diagnostics"].select("repo_id", "snapshot_id", F.concat_ws(":", "code", "message").alias("id"))
    now, base = ids.filter("snapshot_id = 's5'"), ids.filter("snapshot_id = 's4'")
    none = now.select("repo_id", "id", F.lit("lost").alias("change")).filter("false")
    runs = t["v_scan_runs"]
    return ins.replay_gate(
        ins.replay_diff(now, base, none), runs.filter("snapshot_id = 's5'"), runs.filter("snapshot_id = 's4'"))


_FAIL = "(severity = 'error' OR code = 'parse_failed')"


@query("u06_strict_gate", f"""
SELECT {R}, coalesce(string_agg(DISTINCT CASE WHEN status = 'partial' THEN language END, ',' ORDER BY CASE WHEN status = 'partial' THEN language END), '') AS partial_languages,
 coalesce(string_agg(DISTINCT CASE WHEN status = 'failed' THEN language END, ',' ORDER BY CASE WHEN status = 'failed' THEN language END), '') AS failed_languages,
 coalesce(max(n), 0) AS failure_diagnostic_count
FROM {{v_scan_runs}} LEFT JOIN (SELECT {R}, count(*) AS n FROM {{v_diagnostics}} WHERE {_FAIL} GROUP BY {R}) d USING ({R}) GROUP BY {R}""")
def _u06(t):
    return ins.strict_gate(t["v_scan_runs"], t["v_diagnostics"])


@query("o08_failure_diagnostics", f"""
SELECT {K}, ordinal, severity, code, message, rank, total_count, CAST(greatest(0, total_count - 5) AS BIGINT) AS omitted_count FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY {R} ORDER BY language, ordinal) AS INT) AS rank, count(*) OVER (PARTITION BY {R}) AS total_count
 FROM {{v_diagnostics}} WHERE {_FAIL}) d WHERE rank <= 5""")
def _o08(t):
    return ins.failure_diagnostics(t["v_diagnostics"]).select(
        *KEYS, "ordinal", "severity", "code", "message", "rank", "total_count", "omitted_count")


@query("o01_order_usage", "SELECT id, file, line, symbol FROM {v_usage_sites} ORDER BY file, line, symbol, id")
def _o01(t):
    return ins.order_usage(t["v_usage_sites"]).select("id", "file", "line", "symbol")


@query("o02_order_tokens", "SELECT id, file, line, col, token_id FROM {v_token_sites} ORDER BY file, line, col, token_id")
def _o02(t):
    return ins.order_tokens(t["v_token_sites"]).select("id", "file", "line", "col", "token_id")


@query("o02_order_styles", "SELECT id, file, line, col, value FROM {v_style_sites} ORDER BY file, line, col, value")
def _o02_styles(t):
    return ins.order_styles(t["v_style_sites"]).select("id", "file", "line", "col", "value")


def _top_sql(kind: str) -> str:
    return f"""
WITH reported AS (SELECT {R}, symbol_id, symbol, symbol_kind, coalesce(local_definition_id, '') AS lid, coalesce(registry_symbol, '') AS rid, raw_invocation_count, 0 AS src
 FROM ({symbols_sql('v_usage_sites')}) s WHERE symbol_kind = '{kind}' AND language <> 'react'),
synth AS (SELECT {R}, concat('{kind}:', k) AS symbol_id, min(symbol) AS symbol, '{kind}' AS symbol_kind, coalesce(min(local_definition_id), '') AS lid, '' AS rid, count(*) AS raw_invocation_count, 1 AS src
 FROM (SELECT *, CASE match_status WHEN 'local' THEN coalesce(local_definition_id, symbol) ELSE symbol END AS k FROM {{v_usage_sites}} WHERE match_status = '{kind}') x GROUP BY {R}, k),
uniq AS (SELECT *, row_number() OVER (PARTITION BY {R}, lid, symbol, rid ORDER BY src, raw_invocation_count DESC, symbol_id) AS rn FROM (SELECT * FROM reported UNION ALL SELECT * FROM synth) u)
SELECT {R}, symbol_kind, symbol, symbol_id, raw_invocation_count, rank FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY {R} ORDER BY raw_invocation_count DESC, symbol, symbol_id) AS INT) AS rank FROM uniq WHERE rn = 1) r WHERE rank <= 5"""


def _top(kind: str):
    def run(t):
        reported = m.symbol_usage(t["v_usage_sites"]).filter("language <> 'react'")
        return ins.top_symbols(reported, t["v_usage_sites"], kind).select(
            *RUN, "symbol_kind", "symbol", "symbol_id", "raw_invocation_count", "rank")
    return run


query("o05_top_local_symbols", _top_sql("local"))(_top("local"))
query("o05_top_unresolved_symbols", _top_sql("unresolved"))(_top("unresolved"))


@query("s11_scan_summary", f"""
WITH l AS ({_language_sql('v_usage_sites')}), w AS ({_whole_sql('v_usage_sites')})
SELECT {K}, CAST('complete' AS VARCHAR) AS status, round_even(invocation_adoption_ratio * 100.0, 1) AS invocation_adoption_percent, round_even(registry_resolution_ratio * 100.0, 1) AS registry_resolution_percent,
 raw_resolved, raw_candidate, raw_local, raw_unresolved FROM l
UNION ALL SELECT {R}, 'all', NULL, round_even(invocation_adoption_ratio * 100.0, 1), round_even(registry_resolution_ratio * 100.0, 1), raw_resolved, raw_candidate, raw_local, raw_unresolved FROM w""")
def _s11(t):
    counts = _per_language(t["v_usage_sites"])
    runs = t["v_usage_sites"].select(*KEYS).distinct().withColumn("status", F.lit("complete"))
    return ins.scan_summary(runs, counts, _whole(t["v_usage_sites"]))
