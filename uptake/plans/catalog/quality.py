"""Q01-Q14.  Violations are derived from the tables by changing some rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import inference as inf, metrics as m, quality as q
from ...schemas import CATEGORIES, CLASSIFICATIONS, KEYS, MATCH_STATUSES, RUN
from . import query
from .inference import COUNTS_SQL, infer, sql as inference_sql
from .metrics import K, RAW_SQL


def _broken_usage(t):
    """Usage sites with seeded faults, spread over the whole table."""
    u = t["v_usage_sites"]
    return u.withColumns({
        "registry_symbol": F.when((F.col("match_status") == "resolved") & (F.col("line") == 1) & (F.col("col") % 10 == 0), None).otherwise(F.col("registry_symbol")),
        "local_definition_id": F.when((F.col("match_status") == "candidate") & (F.col("col") % 8 == 0), F.lit("local.x")).otherwise(F.col("local_definition_id")),
        "line": F.when(F.col("col") == 17, F.lit(0).cast("bigint")).otherwise(F.col("line")),
        "symbol": F.when(F.col("col") == 33, F.lit("")).otherwise(F.col("symbol")),
    })


BROKEN = """
SELECT * REPLACE (CASE WHEN match_status = 'resolved' AND line = 1 AND col % 10 = 0 THEN NULL ELSE registry_symbol END AS registry_symbol,
 CASE WHEN match_status = 'candidate' AND col % 8 = 0 THEN 'local.x' ELSE local_definition_id END AS local_definition_id,
 CASE WHEN col = 17 THEN 0 ELSE line END AS line, CASE WHEN col = 33 THEN '' ELSE symbol END AS symbol) FROM {v_usage_sites}"""
IDS = ["id", "match_status"]

query("q01_linkage", f"""SELECT id, match_status FROM ({BROKEN}) b WHERE CASE WHEN match_status IN ('resolved', 'candidate') THEN coalesce(registry_symbol, '') = '' OR local_definition_id IS NOT NULL
 WHEN match_status = 'local' THEN coalesce(local_definition_id, '') = '' OR registry_symbol IS NOT NULL ELSE registry_symbol IS NOT NULL OR local_definition_id IS NOT NULL END""")(
    lambda t: q.linkage(_broken_usage(t)).select(*IDS))
query("q02_location", f"SELECT id, file, line, col FROM ({BROKEN}) b WHERE file = '' OR line < 1 OR col < 1")(
    lambda t: q.location(_broken_usage(t)).select("id", "file", "line", "col"))
query("q03_required", f"SELECT id, symbol FROM ({BROKEN}) b WHERE id = '' OR symbol = '' OR parent_id = ''")(
    lambda t: q.required(_broken_usage(t), ["id", "symbol"], ["parent_id"]).select("id", "symbol"))


def _with_aliases(t):
    return t["v_tokens"].withColumn("aliases", F.array("alias"))


query("q04_token_fk", f"""
SELECT s.id, s.token_id, CASE WHEN k.id IS NULL THEN 'unknown_token' WHEN s.key <> k.key AND s.key <> k.alias THEN 'key_mismatch' WHEN s.category <> k.category THEN 'category_mismatch' END AS violation
FROM {{v_token_sites}} s LEFT JOIN {{v_tokens}} k ON s.language = k.language AND s.token_id = k.id
WHERE k.id IS NULL OR (s.key <> k.key AND s.key <> k.alias) OR s.category <> k.category""")(
    lambda t: q.token_fk(t["v_token_sites"], _with_aliases(t)).select("id", "token_id", "violation"))
query("q04_duplicate_token_ids", f"""
SELECT {K}, id, count(*) AS row_count FROM (SELECT {K}, id FROM {{v_tokens}} UNION ALL SELECT {K}, concat('tok.', CAST(l AS STRING)) FROM (SELECT {K}, CAST(substr(id, 5) AS BIGINT) / 1 AS l0, CAST(substr(id, 5) AS BIGINT) AS l FROM {{v_tokens}}) z WHERE l % 9 = 0) y
GROUP BY {K}, id HAVING count(*) > 1""")(
    lambda t: q.duplicate_ids(
        t["v_tokens"].unionByName(t["v_tokens"].filter(F.substring("id", 5, 9).cast("bigint") % 9 == 0)), [*KEYS, "id"]))


def _reported(t):
    counts = m.with_ratios(m.adoption(m.raw_invocations(t["v_usage_sites"], [*KEYS, "file"])))
    odd = F.col("raw_total") % 5 == 0
    return counts.withColumn(
        "invocation_adoption_ratio", F.when(odd, F.lit(0.5)).otherwise(F.col("invocation_adoption_ratio")))


query("q05_ratio_valid", f"""
SELECT {K}, file, 0.5 AS invocation_adoption_ratio FROM (SELECT {K}, file, {RAW_SQL} FROM {{v_usage_sites}} GROUP BY {K}, file) c
WHERE raw_total % 5 = 0 AND (raw_resolved + raw_local + raw_unresolved = 0 OR abs(0.5 - CAST(raw_resolved AS DOUBLE) / (raw_resolved + raw_local + raw_unresolved)) > 1e-12)""")(
    lambda t: q.ratio_valid(
        _reported(t), "invocation_adoption_ratio", "adopted_invocation_count", "eligible_invocation_count"
    ).select(*KEYS, "file", "invocation_adoption_ratio"))


def _summaries(t):
    """Symbol summaries with limit 3; some emit too many or too few rows."""
    base = m.with_truncation(m.symbol_usage(t["v_usage_sites"]), 3)
    kept = F.least(F.lit(3), F.col("parent_scope_count"))
    return base.withColumn("emitted_parent_count", F.when(
        F.col("raw_invocation_count") % 2 == 0, F.col("parent_scope_count") + F.col("file_count") % 3 - 1).otherwise(kept))


query("q06_summary_rules", f"""
WITH s AS (SELECT language, symbol, match_status, count(*) AS n, count(DISTINCT file) AS f, count(DISTINCT parent_id) AS p FROM {{v_usage_sites}} GROUP BY language, symbol, match_status),
e AS (SELECT *, CASE WHEN n % 2 = 0 THEN p + f % 3 - 1 ELSE least(3, p) END AS emitted FROM s)
SELECT language, symbol, CASE WHEN p > 3 THEN 'truncated' ELSE 'length' END AS violation FROM e
WHERE (p > 3 AND emitted >= p) OR (p <= 3 AND emitted <> p AND emitted <> least(3, p))""")(
    lambda t: q.summary_rules(_summaries(t)).select("language", "symbol", "violation"))


def _damaged_inference(t):
    # one pass: each row gets the endings of the ids under which it is to appear
    col = F.col("col")
    endings = F.array_compact(F.array(F.when(col != 5, ""), F.when(col == 9, ""), F.when(col == 21, ":x")))
    return infer(t).withColumn("ending", F.explode(endings)).withColumn("site_id", F.concat("site_id", "ending")).drop("ending")


query("q07_inference_1to1", f"""
WITH r AS (SELECT {K}, id AS site_id, count(*) AS raw_count FROM {{v_style_sites}} GROUP BY {K}, id),
i AS (SELECT {K}, site_id, count(*) AS inference_count FROM (
 SELECT {K}, id AS site_id FROM {{v_style_sites}} WHERE col <> 5 UNION ALL SELECT {K}, id FROM {{v_style_sites}} WHERE col = 9
 UNION ALL SELECT {K}, concat(id, ':x') FROM {{v_style_sites}} WHERE col = 21) u GROUP BY {K}, site_id)
SELECT {K}, site_id, coalesce(raw_count, 0) AS raw_count, coalesce(inference_count, 0) AS inference_count FROM r FULL OUTER JOIN i USING ({K}, site_id)
WHERE coalesce(raw_count, 0) <> 1 OR coalesce(inference_count, 0) <> 1""")(
    lambda t: q.inference_1to1(t["v_style_sites"], _damaged_inference(t)))


def _damaged_suggestions(t):
    s = inf.suggestions(t["v_style_sites"], t["v_tokens"])
    n = F.substring("token_id", 5, 9).cast("bigint")
    return s.withColumns({
        "distance": F.when((F.col("match_kind") == "exact") & (n % 11 == 0), F.lit(1.0)).otherwise(F.col("distance")),
        "token_key": F.when(n % 13 == 0, F.lit("wrong")).otherwise(F.col("token_key")),
    })


query("q08_suggestion_rules", inference_sql(f"""
SELECT s.repo_id, s.snapshot_id, s.language, s.id AS site_id, CASE WHEN match_kind = 'exact' AND CAST(substr(token_id, 5) AS BIGINT) % 11 = 0 THEN 'distance' ELSE 'token_key' END AS violation
FROM {{v_style_sites}} s JOIN sug USING ({K}, category, context, value)
WHERE (match_kind = 'exact' AND CAST(substr(token_id, 5) AS BIGINT) % 11 = 0) OR CAST(substr(token_id, 5) AS BIGINT) % 13 = 0"""))(
    lambda t: q.suggestion_rules(infer(t), _damaged_suggestions(t), t["v_tokens"]))
query("q08_suggestion_rules_own_output", "SELECT repo_id, snapshot_id, language, id AS site_id, value AS violation FROM {v_style_sites} WHERE false")(
    lambda t: q.suggestion_rules(infer(t), inf.suggestions(t["v_style_sites"], t["v_tokens"]), t["v_tokens"]))


def _off_by_one(t):
    return inf.inference_counts(infer(t)).withColumn(
        "exact_replacement_candidate_count", F.col("exact_replacement_candidate_count") + 1)


query("q09_inference_counts_match", inference_sql(f"""
SELECT repo_id, snapshot_id, 'exact_replacement_candidate_count' AS counter, CAST(exact_replacement_candidate_count + 1 AS DECIMAL(20,0)) AS reported, CAST(exact_replacement_candidate_count AS DECIMAL(20,0)) AS derived
FROM (SELECT repo_id, snapshot_id, {COUNTS_SQL} FROM inferred GROUP BY repo_id, snapshot_id) c"""))(
    lambda t: q.counts_match(_off_by_one(t), inf.inference_counts(infer(t)), RUN))


def _claimed(t):
    return m.raw_invocations(t["v_usage_sites"]).withColumn(
        "raw_local", F.when(F.col("language") == "swift", F.lit(4294967296)).otherwise(F.col("raw_local")))


query("q10_counts_match", f"""
SELECT {K}, 'raw_local' AS counter, CAST(4294967296 AS DECIMAL(20,0)) AS reported, CAST(sum(CASE WHEN match_status = 'local' THEN 1 ELSE 0 END) AS DECIMAL(20,0)) AS derived
FROM {{v_usage_sites}} WHERE language = 'swift' GROUP BY {K}""")(
    lambda t: q.counts_match(_claimed(t), m.raw_invocations(t["v_usage_sites"]), KEYS))


REGISTRY_DOCS = """
SELECT concat('repo', CAST(p_partkey AS STRING)) AS repo_id, CASE p_partkey % 8
 WHEN 0 THEN concat('[', CAST(p_size AS STRING), ']') WHEN 1 THEN concat('{{"components":[{{"symbol":"C', CAST(p_size AS STRING), '"}}]}}')
 WHEN 2 THEN '{{"schema_version":2,"components":[]}}' WHEN 3 THEN '{{"schema_version":1,"components":{{}}}}' WHEN 4 THEN '{{"schema_version":1}}'
 WHEN 5 THEN '{{"schema_version":1,"components":[]}}' WHEN 6 THEN concat('{{"schema_version":1,"components":[{{"symbol":"', p_type, '"}}]}}')
 ELSE concat('{{"schema_version":1,', p_brand) END AS doc FROM {part}"""
query("q11_registry_shape", """
SELECT concat('repo', CAST(p_partkey AS STRING)) AS repo_id, CASE p_partkey % 8 WHEN 0 THEN 'not_an_object' WHEN 1 THEN 'missing_schema_version' WHEN 2 THEN 'unsupported_schema_version'
 WHEN 3 THEN 'components_not_an_array' WHEN 7 THEN 'malformed_json' ELSE 'empty_components' END AS violation,
 CASE WHEN p_partkey % 8 IN (4, 5) THEN 'warning' ELSE 'error' END AS severity FROM {part} WHERE p_partkey % 8 <> 6""")(
    lambda t: q.registry_shape(t.spark.sql(REGISTRY_DOCS, part=t["part"])).select("repo_id", "violation", "severity"))


query("q12_token_key_unique", f"""
SELECT {K}, match_key, count(*) AS row_count FROM (
 SELECT {K}, key AS match_key FROM {{v_token_sites}} GROUP BY {K}, key, token_id) u GROUP BY {K}, match_key HAVING count(*) > 1""")(
    lambda t: q.token_key_unique(
        t["v_token_sites"].select(*KEYS, "token_id", F.col("key").alias("match_key")).distinct()))

FACT_DOCS = """
SELECT concat('repo', CAST(o_orderkey AS STRING)) AS repo_id, concat('{{"snapshot_id":"s1","usage_sites":[{{"id":"a"',
 CASE WHEN o_orderkey % 4 = 0 THEN ',"qualified_symbol":null' ELSE '' END, ',"location":{{"file":"f","line":1',
 CASE WHEN o_orderkey % 6 = 0 THEN ',"column":null' ELSE '' END, '}}}},{{"id":"b","parent":', CASE WHEN o_orderkey % 10 = 0 THEN 'null' ELSE '{{"parent_id":"p"}}' END,
 '}}],"metrics":{{"invocation_adoption_ratio":null}},"diagnostics":[{{"code":"', o_orderstatus, '"}}]}}') AS doc FROM {orders}"""
query("q13_null_policy", """
SELECT concat('repo', CAST(o_orderkey AS STRING)) AS repo_id, 'usage_sites' AS section, 0 AS item_index, 'qualified_symbol' AS path FROM {orders} WHERE o_orderkey % 4 = 0
UNION ALL SELECT concat('repo', CAST(o_orderkey AS STRING)), 'usage_sites', 0, 'location.column' FROM {orders} WHERE o_orderkey % 6 = 0
UNION ALL SELECT concat('repo', CAST(o_orderkey AS STRING)), 'usage_sites', 1, 'parent' FROM {orders} WHERE o_orderkey % 10 = 0""")(
    lambda t: q.null_policy(t.spark.sql(FACT_DOCS, orders=t["orders"])))

query("q14_enum_domain", "SELECT id, category FROM {v_token_sites} WHERE category = 'unknown'")(
    lambda t: q.enum_domain(t["v_token_sites"], "category", CATEGORIES[:-1]).select("id", "category"))
query("q14_enum_domain_own_output", "SELECT id, match_status FROM {v_usage_sites} WHERE match_status NOT IN ('resolved', 'candidate', 'local', 'unresolved')")(
    lambda t: q.enum_domain(t["v_usage_sites"], "match_status", MATCH_STATUSES).select("id", "match_status"))
query("q14_classification_domain", f"SELECT {K}, id AS site_id, value AS classification FROM {{v_style_sites}} WHERE false")(
    lambda t: q.enum_domain(infer(t), "classification", CLASSIFICATIONS).select(*KEYS, "site_id", "classification"))
