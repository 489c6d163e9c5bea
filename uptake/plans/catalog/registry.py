"""S07-S10, R01-R05, X25, X26 over documents derived from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.text import kebab_id, npm_package_root
from ...operators import registry as r
from ...sources import facts as sf, registry as sr
from . import query

# One registry document per brand and hundred parts, so that none grows with the table:
# components with two aliases and a token.
REGISTRY_DOCS = """
SELECT repo_id, 'react' AS language, concat('{{"schema_version":1,"components":[', string_agg(component, ',' ORDER BY pk), '],"tokens":[', string_agg(token, ',' ORDER BY pk), ']}}') AS doc FROM (
 SELECT concat(p_brand, '/', CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS STRING)) AS repo_id, p_partkey AS pk,
  concat('{{"id":"x","symbol":"C', CAST(p_partkey % 30 AS STRING), '"', CASE WHEN p_partkey % 3 = 0 THEN ',"package":"@acme/ds"' ELSE '' END,
   CASE WHEN p_partkey % 2 = 0 THEN concat(',"aliases":["A', CAST(p_partkey AS STRING), '","C', CAST(p_size AS STRING), '"]') ELSE '' END, '}}') AS component,
  concat('{{"id":"t', CAST(p_partkey AS STRING), '","key":"k.', CAST(p_partkey % 40 AS STRING), '","category":"', CASE WHEN p_partkey % 5 = 0 THEN 'shadow' ELSE 'spacing' END, '"',
   CASE WHEN p_partkey % 4 = 0 THEN ',"value":"4px"' WHEN p_partkey % 4 = 1 THEN ',"value":""' ELSE '' END, '}}') AS token
 FROM {part}) p GROUP BY repo_id"""


def _registries(t):
    # listagg is the Spark spelling of the ordered string_agg above.
    sql = REGISTRY_DOCS
    for col in ("component", "token"):
        sql = sql.replace(f"string_agg({col}, ',' ORDER BY pk)", f"listagg({col}, ',') WITHIN GROUP (ORDER BY pk)")
    return sr.parse_registries(t.spark.sql(sql, part=t["part"]))


query("s07_components", """
SELECT concat(p_brand, '/', CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS STRING)) AS repo_id, CAST(row_number() OVER (PARTITION BY concat(p_brand, '/', CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS STRING)) ORDER BY p_partkey) - 1 AS INT) AS ordinal, concat('C', CAST(p_partkey % 30 AS STRING)) AS symbol,
 CASE WHEN p_partkey % 3 = 0 THEN '@acme/ds' END AS package, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS alias_count FROM {part}""")(
    lambda t: sr.components(_registries(t)).select("repo_id", "ordinal", "symbol", "package", F.size("aliases").alias("alias_count")))
query("s07_registry_aliases", """
SELECT repo_id, call_symbol, registry_symbol FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, call_symbol ORDER BY pk DESC, slot DESC) AS rn FROM (
 SELECT concat(p_brand, '/', CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS STRING)) AS repo_id, p_partkey AS pk, 0 AS slot, concat('C', CAST(p_partkey % 30 AS STRING)) AS call_symbol, concat('C', CAST(p_partkey % 30 AS STRING)) AS registry_symbol FROM {part}
 UNION ALL SELECT concat(p_brand, '/', CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS STRING)), p_partkey, 1, concat('A', CAST(p_partkey AS STRING)), concat('C', CAST(p_partkey % 30 AS STRING)) FROM {part} WHERE p_partkey % 2 = 0
 UNION ALL SELECT concat(p_brand, '/', CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS STRING)), p_partkey, 2, concat('C', CAST(p_size AS STRING)), concat('C', CAST(p_partkey % 30 AS STRING)) FROM {part} WHERE p_partkey % 2 = 0) a) b WHERE rn = 1""")(
    lambda t: sr.registry_aliases(sr.components(_registries(t))).select("repo_id", "call_symbol", "registry_symbol"))
query("s08_tokens", """
SELECT concat(p_brand, '/', CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS STRING)) AS repo_id, concat('t', CAST(p_partkey AS STRING)) AS id, concat('k.', CAST(p_partkey % 40 AS STRING)) AS key,
 CASE WHEN p_partkey % 5 = 0 THEN 'shadow' ELSE 'spacing' END AS category, CASE WHEN p_partkey % 4 = 0 THEN '4px' WHEN p_partkey % 4 = 1 THEN '' END AS value FROM {part}""")(
    lambda t: sr.tokens(_registries(t)).select("repo_id", "id", "key", "category", "value"))
query("s08_invalid_tokens", """
SELECT concat(p_brand, '/', CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS STRING)) AS repo_id, concat('t', CAST(p_partkey AS STRING)) AS id FROM {part} WHERE p_partkey % 5 = 0 OR p_partkey % 4 = 1""")(
    lambda t: sr.invalid_tokens(sr.tokens(_registries(t))).select("repo_id", "id"))
query("q12_registry_key_unique", """
SELECT concat(p_brand, '/', CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS STRING)) AS repo_id, concat('k.', CAST(p_partkey % 40 AS STRING)) AS match_key, count(*) AS row_count FROM {part} GROUP BY 1, 2 HAVING count(*) > 1""")(
    lambda t: sr.token_keys(sr.tokens(_registries(t))).groupBy("repo_id", "match_key").agg(
        F.count(F.lit(1)).alias("row_count")).filter("row_count > 1"))

# One facts document per order, with one usage site per line item.
FACT_DOCS = """
SELECT concat('repo', CAST(l_orderkey % 7 AS STRING)) AS repo_id, concat('{{"schema_version":3,"language":{{"id":"react","parser_name":"p"}},"snapshot_id":"s', CAST(l_orderkey AS STRING),
 '","status":"complete","metrics":{{"files_scanned":', CAST(count(*) AS STRING), ',"parse_extract_ms":', CAST(l_orderkey AS STRING), '}},"usage_sites":[', listagg(site, ',') WITHIN GROUP (ORDER BY site), ']}}') AS doc
FROM (SELECT l_orderkey, concat('{{"id":"u', CAST(l_partkey AS STRING), '","symbol":"C', CAST(l_suppkey AS STRING), '","match_status":"', CASE WHEN l_suppkey % 2 = 0 THEN 'resolved","registry_symbol":"C' ELSE 'unresolved' END,
  '","location":{{"file":"f', CAST(l_suppkey AS STRING), '","line":', CAST(l_linenumber AS STRING), '}}', CASE WHEN l_linenumber > 3 THEN ',"parent":{{"parent_id":"p1","symbol":"P"}}' ELSE '' END, '}}') AS site FROM {lineitem}) s
GROUP BY l_orderkey"""


def _facts(t):
    return sf.parse_facts(t.spark.sql(FACT_DOCS, lineitem=t["lineitem"]))


query("s09_read_scan_facts", """
SELECT concat('repo', CAST(l_orderkey % 7 AS STRING)) AS repo_id, concat('s', CAST(l_orderkey AS STRING)) AS snapshot_id, concat('u', CAST(l_partkey AS STRING)) AS id, concat('C', CAST(l_suppkey AS STRING)) AS symbol,
 CASE WHEN l_suppkey % 2 = 0 THEN 'resolved' ELSE 'unresolved' END AS match_status, concat('f', CAST(l_suppkey AS STRING)) AS file, CAST(l_linenumber AS BIGINT) AS line,
 CASE WHEN l_linenumber > 3 THEN 'p1' END AS parent_id FROM {lineitem}""")(
    lambda t: sf.fact_table(_facts(t), "usage_sites").select(
        "repo_id", "snapshot_id", "id", "symbol", "match_status", "file", "line", "parent_id"))
query("s09_scan_runs", """
SELECT concat('repo', CAST(l_orderkey % 7 AS STRING)) AS repo_id, concat('s', CAST(l_orderkey AS STRING)) AS snapshot_id, 'complete' AS status, count(*) AS files_scanned, l_orderkey AS parse_extract_ms
FROM {lineitem} GROUP BY l_orderkey""")(
    lambda t: sf.scan_runs(_facts(t)).select("repo_id", "snapshot_id", "status", "files_scanned", "parse_extract_ms"))
query("s10_stale_partitions", """
SELECT DISTINCT repo_id, language FROM {v_usage_sites} u WHERE NOT EXISTS (SELECT 1 FROM {v_usage_baseline} b WHERE b.language = u.language AND b.repo_id = u.repo_id)""")(
    lambda t: sf.stale_partitions(t["v_usage_sites"], t["v_usage_baseline"]))

# Discovered symbols: names of parts, spelled with acronyms and digits.
DISCOVERED = """
SELECT concat('repo', CAST(p_partkey % 5 AS STRING)) AS repo_id, 'react' AS language,
 concat('HTTP', upper(substring(p_name, 1, 1)), substring(p_name, 2, 4), CAST(p_size AS STRING), 'View', CASE WHEN p_partkey % 6 = 0 THEN '_x' ELSE '' END) AS symbol,
 concat('src/f', CAST(p_partkey + 100000 AS STRING), '.tsx') AS path, CAST(0 AS BIGINT) AS ordinal,
 CASE WHEN p_partkey % 4 <> 0 THEN concat('@acme/p', CAST(p_partkey % 3 AS STRING)) END AS package FROM {part}"""
KEBAB = (
    "lower(trim(regexp_replace(regexp_replace(regexp_replace(symbol, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), "
    "'([A-Z])([A-Z][a-z])', '\\1-\\2', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '-'))")
CONFLICTS = f"""
WITH d AS ({DISCOVERED}), f AS (SELECT repo_id, language, symbol, arg_min(coalesce(package, ''), path) AS first, min(package) AS mn, max(package) AS mx FROM d GROUP BY repo_id, language, symbol),
c AS (SELECT repo_id, language, symbol, CASE WHEN first = '' OR mn <> mx THEN NULL ELSE first END AS package, first <> '' AND mn <> mx AS package_conflict FROM f)"""


def _discovered(t):
    return t.spark.sql(DISCOVERED, part=t["part"])


query("x26_kebab_id", f"SELECT DISTINCT symbol, {KEBAB} AS kebab FROM ({DISCOVERED}) d")(
    lambda t: _discovered(t).select("symbol", kebab_id(F.col("symbol")).alias("kebab")).distinct())
query("r02_package_conflict", f"{CONFLICTS} SELECT repo_id, language, symbol, package, package_conflict FROM c")(
    lambda t: r.package_conflicts(_discovered(t)))
query("r01_build_registry", f"{CONFLICTS} SELECT repo_id, language, concat('ds.', {KEBAB}) AS id, symbol, package FROM c")(
    lambda t: r.build_registry(r.package_conflicts(_discovered(t))))
query("r01_id_collisions", f"""
SELECT repo_id, language, id, count(*) AS symbol_count, min(symbol) AS first_symbol, max(symbol) AS last_symbol FROM (
 SELECT DISTINCT repo_id, language, concat('ds.', {KEBAB}) AS id, symbol FROM (
  SELECT 'r' AS repo_id, 'react' AS language, concat(CASE WHEN p_partkey % 2 = 0 THEN 'Part' ELSE 'part' END, CASE WHEN p_partkey % 3 = 0 THEN 'View' ELSE '-view' END, CAST(p_size AS STRING)) AS symbol FROM {{part}}) s) u
GROUP BY repo_id, language, id HAVING count(*) > 1""")(
    lambda t: r.id_collisions(r.build_registry(t["part"].select(
        F.lit("r").alias("repo_id"), F.lit("react").alias("language"),
        F.concat(F.when(F.col("p_partkey") % 2 == 0, "Part").otherwise("part"),
                 F.when(F.col("p_partkey") % 3 == 0, "View").otherwise("-view"), F.col("p_size").cast("string")).alias("symbol"),
        F.lit(None).cast("string").alias("package")).distinct())))

query("x25_npm_package_root", """
SELECT DISTINCT spec, CASE WHEN spec LIKE '@%/%' AND split_part(substr(spec, 2), '/', 1) <> '' AND split_part(spec, '/', 2) <> '' THEN concat(split_part(spec, '/', 1), '/', split_part(spec, '/', 2))
 WHEN spec LIKE '@%' THEN spec ELSE split_part(spec, '/', 1) END AS package_root
FROM (SELECT concat(CASE p_partkey % 4 WHEN 0 THEN '@acme/' WHEN 1 THEN '@' ELSE '' END, replace(p_name, ' ', '/'), '/x', CAST(p_size AS STRING)) AS spec FROM {part}) s""")(
    lambda t: t["part"].select(F.concat(
        F.when(F.col("p_partkey") % 4 == 0, "@acme/").when(F.col("p_partkey") % 4 == 1, "@").otherwise(""),
        F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/x"), F.col("p_size").cast("string")).alias("spec")).distinct()
    .withColumn("package_root", npm_package_root(F.col("spec"))))

# Registry content per page, with locks that miss, move or change some of them.
RESOLVED = "SELECT concat('repo', CAST(page_id AS STRING)) AS repo_id, 'basic' AS language, url AS source, html AS content FROM {pages}"
DRIFT = """CASE WHEN page_id % 7 = 0 THEN 'missing' WHEN page_id % 5 = 0 THEN 'source_drift' WHEN page_id % 3 = 0 THEN 'digest_drift' END"""


def _resolved(t):
    return r.with_digest(t.spark.sql(RESOLVED, pages=t["pages"]))


def _locks(t):
    n = F.col("page_id")
    return t["pages"].filter(n % 7 != 0).select(
        F.concat(F.lit("repo"), n.cast("string")).alias("repo_id"), F.lit("basic").alias("language"),
        F.when(n % 5 == 0, F.concat("url", F.lit("?old"))).otherwise(F.col("url")).alias("source"),
        F.sha2(F.when(n % 3 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")), 256).alias("sha256"))


query("r03_registry_drift", f"""
SELECT concat('repo', CAST(page_id AS STRING)) AS repo_id, 'basic' AS language, sha256(html) AS sha256, {DRIFT} AS drift FROM {{pages}} WHERE {DRIFT} IS NOT NULL""")(
    lambda t: r.registry_drift(_resolved(t), _locks(t)).select("repo_id", "language", "sha256", "drift"))


def _full(df):
    return df.withColumns({c: F.lit(None).cast("string") for c in ("git", "tag", "commit")})


query("r04_lock_refresh", f"""
SELECT concat('repo', CAST(page_id AS STRING)) AS repo_id, 'basic' AS language, url AS source, sha256(html) AS sha256, CASE WHEN page_id % 7 = 0 THEN 'insert' ELSE 'update' END AS change
FROM {{pages}} WHERE {DRIFT} IS NOT NULL""")(
    lambda t: r.lock_refresh(_full(_resolved(t)), _full(_locks(t))).select("repo_id", "language", "source", "sha256", "change"))

GIT = """
SELECT concat('repo', CAST(c_custkey AS STRING)) AS repo_id, 'react' AS language, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat('https://git/', c_mktsegment) END AS git,
 CASE WHEN c_custkey % 9 = 1 THEN 'v0' ELSE concat('v', CAST(c_nationkey AS STRING)) END AS tag,
 concat('git:https://git/', c_mktsegment, '#v', CAST(c_nationkey AS STRING), CASE WHEN c_custkey % 9 = 2 THEN 'x' ELSE '' END) AS source,
 CASE c_custkey % 9 WHEN 3 THEN NULL WHEN 4 THEN 'ABC' WHEN 5 THEN repeat('g', 40) ELSE repeat('a', 40) END AS commit,
 repeat(CASE WHEN c_custkey % 9 = 6 THEN 'F' ELSE 'f' END, 64) AS sha256 FROM {customer}"""
query("r05_git_lock_rules", f"""
SELECT repo_id, violation FROM (SELECT repo_id, CASE WHEN n = 0 THEN 'git is required' WHEN n = 1 AND k <> 0 THEN 'tag must match config' WHEN n = 2 THEN 'source must be canonical' WHEN n = 3 THEN 'commit is required'
 WHEN n IN (4, 5) THEN 'commit must be lowercase hex' WHEN n = 6 THEN 'sha256 must be lowercase hex' END AS violation
 FROM (SELECT concat('repo', CAST(c_custkey AS STRING)) AS repo_id, c_custkey % 9 AS n, c_nationkey AS k FROM {{customer}}) c) v WHERE violation IS NOT NULL""")(
    lambda t: r.git_lock_rules(
        t.spark.sql(GIT, customer=t["customer"]),
        t["customer"].select(
            F.concat(F.lit("repo"), F.col("c_custkey").cast("string")).alias("repo_id"), F.lit("react").alias("language"),
            F.concat(F.lit("https://git/"), "c_mktsegment").alias("git"),
            F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("tag"))).select("repo_id", "violation"))
