"""N01-N10, J14-J16, A14, A19, A20, O04, O06, O07, R06."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import values as v
from ...operators import inference as inf, insights as ins
from ...schemas import CATEGORIES, CONFIDENCES, CONTEXTS, KEYS
from . import query

K = "repo_id, snapshot_id, language"
LAYOUT = "('padding', 'margin', 'gap', 'width', 'height', 'size', 'radius')"
NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def _norm_sql(src: str) -> str:
    """(kind, scalar, unit, txt) of (language, category, context, value) rows."""
    return f"""
SELECT *, CASE WHEN color IS NOT NULL THEN 'color'
  WHEN regexp_matches(num, {NUM}) THEN 'numeric'
  WHEN language <> 'swift' AND regexp_matches(clean, '^[+-]?\\.?[0-9]') AND NOT (category IN ('color', 'typography', 'elevation') OR context IN ('color', 'typography', 'elevation')) THEN 'unsupported'
  ELSE 'text' END AS kind,
 CASE WHEN color IS NULL AND regexp_matches(num, {NUM}) THEN CAST(num AS DOUBLE) ELSE 0.0 END AS scalar,
 CASE WHEN color IS NULL AND regexp_matches(num, {NUM}) THEN
  CASE WHEN suffix <> '' THEN suffix WHEN language = 'react' AND context IN {LAYOUT} THEN 'px' ELSE '' END ELSE '' END AS unit,
 CASE WHEN color IS NOT NULL THEN color WHEN regexp_matches(num, {NUM}) THEN ''
  WHEN language <> 'swift' AND regexp_matches(clean, '^[+-]?\\.?[0-9]') AND NOT (category IN ('color', 'typography', 'elevation') OR context IN ('color', 'typography', 'elevation')) THEN ''
  ELSE clean END AS txt
FROM (SELECT *, CASE
   WHEN regexp_matches(clean, '^#[0-9A-Fa-f]{{{{3}}}}$') THEN lower(concat(regexp_replace(substr(clean, 2), '(.)', '\\1\\1', 'g'), 'ff')) END AS color,
  CASE language WHEN 'compose' THEN lower(regexp_extract(clean, '(dp|sp)$', 1)) WHEN 'react' THEN lower(regexp_extract(clean, '(vmin|vmax|rem|px|em|vh|vw|%)$', 1)) ELSE '' END AS suffix,
  CASE language WHEN 'compose' THEN regexp_replace(clean, '\\.?(dp|sp)$', '') WHEN 'react' THEN regexp_replace(clean, '(vmin|vmax|rem|px|em|vh|vw|%)$', '') ELSE clean END AS num
 FROM (SELECT *, trim(value) AS clean FROM ({src}) s0) s1) s2"""


_OBS = _norm_sql(f"SELECT DISTINCT {K}, category, context, value FROM {{v_style_sites}}")
_TOK = _norm_sql(
    f"SELECT t.*, c.context FROM (SELECT {K}, id AS token_id, key AS token_key, category, value FROM {{v_tokens}}) t "
    "CROSS JOIN (SELECT DISTINCT context FROM {v_style_sites}) c")
_NEVER = "(category IN ('color', 'elevation') OR context IN ('color', 'elevation'))"

BASE = f"""
obs AS ({_OBS}), tok AS ({_TOK}),
pairs AS (SELECT o.repo_id, o.snapshot_id, o.language, o.category, o.context, o.value, t.token_id, t.token_key, t.value AS canonical_value, t.unit,
  CASE WHEN o.kind <> 'unsupported' AND t.value IS NOT NULL AND t.kind = o.kind AND t.unit = o.unit AND t.scalar = o.scalar AND t.txt = o.txt THEN 'exact'
   WHEN o.kind = 'numeric' AND t.kind = 'numeric' AND t.value IS NOT NULL AND t.unit = o.unit AND NOT (o.category IN ('color', 'elevation') OR o.context IN ('color', 'elevation'))
    AND abs(o.scalar - t.scalar) <= {{tol}} THEN 'near' END AS match_kind,
  CASE WHEN t.kind = 'numeric' THEN abs(o.scalar - t.scalar) END AS distance,
  o.kind = 'unsupported' AS bad, t.value IS NULL AS missing, t.value IS NOT NULL AND t.kind = 'unsupported' AS tok_bad,
  t.value IS NOT NULL AND t.kind = 'numeric' AND o.kind = 'numeric' AND t.unit <> o.unit AND NOT (o.category IN ('color', 'elevation') OR o.context IN ('color', 'elevation')) AS other_unit
 FROM obs o JOIN tok t ON o.repo_id = t.repo_id AND o.snapshot_id = t.snapshot_id AND o.language = t.language AND o.category = t.category AND o.context = t.context),
best AS (SELECT {K}, category, context, value, max(CASE WHEN match_kind = 'exact' THEN 1 ELSE 0 END) AS has_exact,
  min(CASE WHEN match_kind = 'near' THEN distance END) AS min_near, bool_or(bad) AS bad, bool_or(missing) AS any_missing, bool_or(tok_bad) AS any_bad,
  bool_or(NOT missing AND NOT tok_bad) AS any_usable, bool_or(other_unit) AS other_unit FROM pairs GROUP BY {K}, category, context, value),
sug AS (SELECT p.repo_id, p.snapshot_id, p.language, p.category, p.context, p.value, p.token_id, p.token_key, p.canonical_value, p.match_kind,
  CASE WHEN p.match_kind = 'near' THEN p.distance WHEN p.distance IS NOT NULL THEN 0.0 END AS distance, CASE WHEN p.unit <> '' THEN p.unit END AS normalized_unit
 FROM pairs p JOIN best b USING ({K}, category, context, value)
 WHERE (p.match_kind = 'exact') OR (p.match_kind = 'near' AND b.has_exact = 0 AND p.distance = b.min_near AND p.distance > 0)),
hits AS (SELECT {K}, category, context, value, min(match_kind) AS match_kind, count(*) AS n FROM sug GROUP BY {K}, category, context, value),
cls AS (SELECT o.repo_id, o.snapshot_id, o.language, o.category, o.context, o.value, coalesce(h.n, 0) AS suggestion_count, coalesce(h.n, 0) > 1 AS multi,
  o.context IN ('padding', 'margin', 'gap', 'radius', 'color', 'typography', 'elevation') AS clear, b.any_usable IS NULL AS none, b.bad, b.any_missing, b.any_bad, b.other_unit,
  CASE WHEN b.any_usable IS NULL OR b.bad THEN 'unassessed' WHEN h.match_kind IS NOT NULL THEN h.match_kind WHEN NOT b.any_usable THEN 'unassessed' ELSE 'unmatched' END AS classification
 FROM obs o LEFT JOIN best b USING ({K}, category, context, value) LEFT JOIN hits h USING ({K}, category, context, value)),
lvl AS (SELECT *, CASE classification WHEN 'exact' THEN 3 WHEN 'near' THEN 1 END - CASE WHEN clear THEN 0 ELSE 1 END - CASE WHEN multi THEN 1 ELSE 0 END AS lv FROM cls),
assessed AS (SELECT {K}, category, context, value, classification, suggestion_count,
  CASE WHEN lv >= 3 THEN 'very_high' WHEN lv = 2 THEN 'high' WHEN lv = 1 THEN 'medium' WHEN lv IS NOT NULL THEN 'low' END AS confidence,
  concat_ws(',', CASE WHEN classification = 'exact' THEN 'exact_value' END, CASE WHEN classification = 'near' THEN 'within_numeric_tolerance' END,
   CASE WHEN classification IN ('exact', 'near') AND clear THEN 'clear_usage_context' END, CASE WHEN classification IN ('exact', 'near') AND NOT clear THEN 'generic_dimension_context' END,
   CASE WHEN classification IN ('exact', 'near') AND multi THEN 'multiple_equal_matches' END,
   CASE WHEN none OR (classification = 'unassessed' AND NOT bad AND any_missing) THEN 'missing_canonical_values' END,
   CASE WHEN classification = 'unassessed' AND NOT none AND NOT bad THEN 'incomplete_canonical_coverage' END,
   CASE WHEN NOT none AND (bad OR (classification = 'unassessed' AND any_bad)) THEN 'unsupported_canonical_format' END,
   CASE WHEN classification = 'unmatched' AND other_unit THEN 'incompatible_units' END,
   CASE WHEN classification = 'unmatched' THEN 'outside_numeric_tolerance' END) AS evidence
 FROM lvl),
inferred AS (SELECT s.repo_id, s.snapshot_id, s.language, s.id AS site_id, s.file, s.line, s.col, s.category, s.context, s.value, a.classification, a.confidence, a.evidence, a.suggestion_count
 FROM {{v_style_sites}} s JOIN assessed a USING ({K}, category, context, value))"""


def sql(select: str, tolerance: str = "2.0") -> str:
    return "WITH " + BASE.replace("{tol}", tolerance) + " " + select


def infer(t, tolerance: float = 2.0):
    return inf.infer_tokens(t["v_style_sites"], t["v_tokens"], tolerance)


def _flat(df):
    return df.withColumn("evidence", F.array_join("evidence", ","))


SITE_COLS = [*KEYS, "site_id", "classification", "confidence", "evidence", "suggestion_count"]


def _observed(t):
    return inf.observed_values(t["v_style_sites"])


NORM = f"SELECT {K}, category, context, value, kind, scalar, unit, txt AS norm_text FROM obs"


def _normal_form(where: str):
    def run(t):
        return _observed(t).filter(where).select(
            *KEYS, "category", "context", "value", "kind", "scalar", "unit", F.col("text").alias("norm_text"))
    return run


query("n01_clean_value", f"SELECT DISTINCT {K}, concat(' \"', value, '\" ') AS raw, value AS clean FROM {{v_style_sites}}")(
    lambda t: t["v_style_sites"].select(
        *KEYS, F.concat(F.lit(' "'), "value", F.lit('" ')).alias("raw"),
        v.clean_value(F.concat(F.lit(' "'), "value", F.lit('" '))).alias("clean")).distinct())
query("n02_hash_color", f"SELECT DISTINCT {K}, value, lower(concat(regexp_replace(substr(value, 2), '(.)', '\\1\\1', 'g'), 'ff')) AS rgba FROM {{v_style_sites}} WHERE value LIKE '#%'")(
    lambda t: t["v_style_sites"].select(*KEYS, "value", v.hash_color(F.col("value")).alias("rgba")).filter("rgba IS NOT NULL").distinct())
query("n03_argb_color", """
SELECT DISTINCT p_partkey, concat('0x', CASE WHEN p_partkey % 2 = 0 THEN '80' ELSE '' END, lpad(CAST(p_size AS STRING), 6, 'A')) AS value,
 concat(lower(lpad(CAST(p_size AS STRING), 6, 'A')), CASE WHEN p_partkey % 2 = 0 THEN '80' ELSE 'ff' END) AS rgba FROM {part}""")(
    lambda t: t["part"].select("p_partkey", F.concat(
        F.lit("0x"), F.when(F.col("p_partkey") % 2 == 0, "80").otherwise(""),
        F.lpad(F.col("p_size").cast("string"), 6, "A")).alias("value")).withColumn("rgba", v.argb_color(F.col("value"))))
query("n04_css_length", sql(NORM + " WHERE language = 'react'"))(_normal_form("language = 'react'"))
query("n05_compose_length", sql(NORM + " WHERE language = 'compose'"))(_normal_form("language = 'compose'"))
query("n06_swift_scalar", sql(NORM + " WHERE language = 'swift'"))(_normal_form("language = 'swift'"))
query("n07_unknown_suffix", sql(NORM + " WHERE value LIKE '%xyz'"))(_normal_form("value LIKE '%xyz'"))
query("n08_exact_text", sql(NORM + " WHERE kind = 'text'"))(_normal_form("kind = 'text'"))
query("n09_near_allowed", f"SELECT DISTINCT {K}, category, context, NOT (category IN ('color', 'elevation') OR context IN ('color', 'elevation')) AS near_allowed FROM {{v_style_sites}}")(
    lambda t: t["v_style_sites"].select(
        *KEYS, "category", "context", v.near_allowed(F.col("category"), F.col("context")).alias("near_allowed")).distinct())
query("n10_confidence", sql(f"SELECT {K}, site_id, classification, confidence FROM inferred WHERE confidence IS NOT NULL"))(
    lambda t: infer(t).filter("confidence IS NOT NULL").select(*KEYS, "site_id", "classification", "confidence"))

SUG = f"SELECT s.repo_id, s.snapshot_id, s.language, s.id AS site_id, token_id, token_key, canonical_value, match_kind, distance, normalized_unit FROM {{v_style_sites}} s JOIN sug USING ({K}, category, context, value)"
SUG_COLS = [*KEYS, "site_id", "token_id", "token_key", "canonical_value", "match_kind", "distance", "normalized_unit"]


def _suggestions(kind: str | None, tolerance: float = 2.0):
    def run(t):
        rows = inf.suggestions(t["v_style_sites"], t["v_tokens"], tolerance)
        return (rows if kind is None else rows.filter(F.col("match_kind") == kind)).select(*SUG_COLS)
    return run


query("j14_token_exact", sql(SUG + " WHERE match_kind = 'exact'"))(_suggestions("exact"))
query("j15_token_near", sql(SUG + " WHERE match_kind = 'near'"))(_suggestions("near"))
query("j15_token_near_wide", sql(SUG + " WHERE match_kind = 'near'", "7.5"))(_suggestions("near", 7.5))
query("a20_suggestions", sql(SUG))(_suggestions(None))
query("a19_evidence_and_class", sql("SELECT " + ", ".join(SITE_COLS) + " FROM inferred"))(
    lambda t: _flat(infer(t)).select(*SITE_COLS))


@query("j16_style_enrich", sql(f"""
SELECT i.repo_id, i.snapshot_id, i.language, i.site_id, i.classification, s.file, s.line, s.col, s.context, s.value
FROM inferred i JOIN {{v_style_sites}} s ON s.language = i.language AND s.id = i.site_id"""))
def _j16(t):
    rows = ins.style_enrich(infer(t), t["v_style_sites"])
    return rows.select(*KEYS, "site_id", "classification", "file", "line", "col", "context", "value")


def _n(cond: str, alias: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS {alias}"


_HIT = "classification IN ('exact', 'near')"
COUNTS_SQL = ", ".join([
    "count(*) AS hardcoded_observation_count",
    _n("classification <> 'unassessed'", "assessed_observation_count"),
    _n("classification = 'exact'", "exact_replacement_candidate_count"),
    _n("classification = 'near'", "near_replacement_candidate_count"),
    _n("classification = 'unmatched'", "unmatched_observation_count"),
    _n("classification = 'unassessed'", "unassessed_observation_count"),
    *[_n(f"{_HIT} AND confidence = '{x}'", f"confidence_{x}") for x in CONFIDENCES],
    *[_n(f"{_HIT} AND category = '{x}'", f"category_{x}") for x in CATEGORIES],
    *[_n(f"{_HIT} AND context = '{x}'", f"context_{x}") for x in CONTEXTS],
])
query("a14_inference_counts", sql(f"SELECT repo_id, snapshot_id, {COUNTS_SQL} FROM inferred GROUP BY repo_id, snapshot_id"))(
    lambda t: inf.inference_counts(infer(t)))
query("o04_order_inference", sql(f"SELECT {K}, site_id, file, line, col, classification FROM inferred ORDER BY language, file, line, col, site_id"))(
    lambda t: ins.order_inference(infer(t)).select(*KEYS, "site_id", "file", "line", "col", "classification"))

_RANK = "CASE confidence WHEN 'very_high' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
query("o06_ranked_findings", sql(f"""
SELECT {K}, site_id, classification, confidence, file, line, col, rank FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY repo_id, snapshot_id ORDER BY {_RANK}, file, line, col, language, site_id) AS INT) AS rank
 FROM inferred WHERE {_HIT}) r WHERE rank <= 5"""))(
    lambda t: ins.ranked_findings(infer(t)).select(
        *KEYS, "site_id", "classification", "confidence", "file", "line", "col", "rank"))
query("o07_candidate_lists", sql(f"""
SELECT CASE classification WHEN 'exact' THEN 'confirmed_candidates' WHEN 'near' THEN 'possible_candidates' WHEN 'unmatched' THEN 'unmatched_observations' ELSE 'unassessed_observations' END AS list_name,
 {K}, site_id, confidence, file, line FROM inferred"""))(
    lambda t: ins.candidate_lists(infer(t)).select("list_name", *KEYS, "site_id", "confidence", "file", "line"))

query("r06_value_coverage", f"""
WITH n AS ({_norm_sql(f"SELECT {K}, id, category, CASE WHEN category IN ('spacing', 'radius') THEN 'padding' ELSE category END AS context, value FROM {{v_tokens}}")})
SELECT {K}, category, count(*) AS token_count, {_n("value IS NOT NULL AND kind <> 'unsupported'", 'usable_value_count')},
 {_n('value IS NULL', 'missing_value_count')}, {_n("value IS NOT NULL AND kind = 'unsupported'", 'unsupported_value_count')}
FROM n GROUP BY {K}, category""")(lambda t: inf.value_coverage(t["v_tokens"]))
query("r06_blocked_observations", sql(f"""
SELECT {K}, category, reason, count(*) AS blocked_observation_count FROM (
 SELECT {K}, category, unnest(string_split(evidence, ',')) AS reason FROM inferred WHERE classification = 'unassessed') b GROUP BY {K}, category, reason"""))(
    lambda t: inf.blocked_observations(infer(t)))
