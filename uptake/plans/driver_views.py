"""Projections of the generic driver tables into fact tables.

Each view is plain SQL that runs unchanged on Spark and on the SQL engine that
checks the results, so both sides start from the same facts.  ``{name}`` stands
for a driver table or an earlier view; doubled braces are literal braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import spread

TEXTS = ("documents", "pages")

LANGUAGE = "CASE {k} % 3 WHEN 0 THEN 'compose' WHEN 1 THEN 'react' ELSE 'swift' END"
CATEGORY = (
    "CASE {k} % 5 WHEN 0 THEN 'color' WHEN 1 THEN 'spacing' WHEN 2 THEN 'typography' "
    "WHEN 3 THEN 'radius' ELSE 'elevation' END"
)
_SITE = (
    "CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), ':', "
    "CAST(l_partkey AS STRING), ':', CAST(l_suppkey AS STRING)"
)


def _lang(k: str) -> str:
    return LANGUAGE.replace("{k}", k)


def _cat(k: str) -> str:
    return CATEGORY.replace("{k}", k)


VIEWS: dict[str, str] = {
    "v_usage_sites": f"""
SELECT 'repo0' AS repo_id, 's1' AS snapshot_id, {_lang('l_suppkey')} AS language,
 concat('u:', {_SITE}) AS id,
 concat('src/m', CAST(l_orderkey % 97 AS STRING), '.x') AS file,
 CAST(l_linenumber AS BIGINT) AS line, CAST(l_partkey % 80 + 1 AS BIGINT) AS col,
 concat('Sym', CAST(l_partkey % 50 AS STRING)) AS symbol,
 CASE WHEN l_partkey % 50 >= 38 AND l_partkey % 2 = 0 THEN concat('com.acme.Sym', CAST(l_partkey % 50 AS STRING)) END AS qualified_symbol,
 CASE WHEN l_partkey % 50 < 20 THEN 'resolved' WHEN l_partkey % 50 < 23 THEN 'candidate' WHEN l_partkey % 50 < 38 THEN 'local' ELSE 'unresolved' END AS match_status,
 CASE WHEN l_partkey % 50 < 23 THEN concat('ds.', CAST(l_partkey % 50 AS STRING)) END AS registry_symbol,
 CASE WHEN l_partkey % 50 BETWEEN 23 AND 37 THEN concat('local.', CAST(l_partkey % 50 AS STRING)) END AS local_definition_id,
 CASE WHEN l_orderkey % 7 <> 0 THEN concat('parent', CAST(l_orderkey % 61 AS STRING)) END AS parent_id,
 CASE WHEN l_orderkey % 7 <> 0 THEN concat('Screen', CAST(l_orderkey % 61 AS STRING)) END AS parent_symbol,
 CASE WHEN l_orderkey % 7 <> 0 THEN 'component' END AS parent_scope_kind
FROM {{lineitem}}""",
    "v_usage_baseline": """
SELECT 'repo0' AS repo_id, 's0' AS snapshot_id, language, id, file, line, col, symbol, qualified_symbol, match_status,
 registry_symbol, local_definition_id, parent_id, parent_symbol, parent_scope_kind
FROM {v_usage_sites} WHERE line <> 3 AND language <> 'swift'""",
    "v_components": f"""
SELECT DISTINCT 'repo0' AS repo_id, 's1' AS snapshot_id, {_lang('p_partkey')} AS language,
 concat('ds.', CAST(p_partkey % 25 AS STRING)) AS id, concat('Sym', CAST(p_partkey % 25 AS STRING)) AS symbol,
 concat('ds.', CAST(p_partkey % 25 AS STRING)) AS registry_symbol,
 CASE WHEN p_partkey % 25 % 4 <> 0 THEN '@acme/ds' END AS package
FROM {{part}}""",
    "v_local_components": f"""
SELECT DISTINCT 'repo0' AS repo_id, 's1' AS snapshot_id, {_lang('p_partkey')} AS language,
 concat('local.', CAST(23 + p_partkey % 20 AS STRING)) AS id,
 concat('Local', CAST(23 + p_partkey % 20 AS STRING), CASE p_partkey % 20 % 3 WHEN 0 THEN 'Button' WHEN 1 THEN 'Modal' ELSE 'Card' END) AS symbol,
 concat('src/d', CAST(p_partkey % 40 AS STRING), '.x') AS file
FROM {{part}}""",
    "v_tokens": f"""
SELECT 'repo0' AS repo_id, 's1' AS snapshot_id, {_lang('p_partkey')} AS language,
 concat('tok.', CAST(p_partkey AS STRING)) AS id, concat('theme.t', CAST(p_partkey AS STRING)) AS key,
 concat('old.t', CAST(p_partkey AS STRING)) AS alias,
 {_cat('p_partkey')} AS category,
 CASE WHEN p_partkey % 7 = 6 THEN NULL
      WHEN p_partkey >= 60 AND p_partkey % 5 = 0 THEN concat('#12', lpad(lower(hex(p_partkey % 65536)), 4, '0'))
      WHEN p_partkey >= 60 THEN concat(CAST(100 + p_partkey AS STRING), CASE p_partkey % 3 WHEN 0 THEN '.dp' WHEN 1 THEN 'px' ELSE '' END)
      WHEN p_partkey % 5 = 0 THEN concat('#', substring('0123456789abcdef', CAST(p_size % 16 + 1 AS INT), 1), '0f')
      WHEN p_partkey % 3 = 0 THEN concat(CAST(p_size * 3 AS STRING), '.dp')
      WHEN p_partkey % 3 = 1 THEN concat(CAST(p_size * 3 AS STRING), 'px')
      ELSE CAST(p_size * 3 AS STRING) END AS value
FROM {{part}}""",
    "v_style_sites": f"""
SELECT 'repo0' AS repo_id, 's1' AS snapshot_id, {_lang('l_suppkey')} AS language,
 concat('h:', {_SITE}) AS id,
 concat('src/m', CAST(l_orderkey % 97 AS STRING), '.x') AS file,
 CAST(l_linenumber AS BIGINT) AS line, CAST(l_partkey % 80 + 1 AS BIGINT) AS col,
 {_cat('l_partkey')} AS category,
 CASE l_partkey % 5 WHEN 0 THEN 'color' WHEN 1 THEN CASE l_orderkey % 3 WHEN 0 THEN 'padding' WHEN 1 THEN 'gap' ELSE 'width' END WHEN 2 THEN 'typography' WHEN 3 THEN 'radius' ELSE 'elevation' END AS context,
 CASE WHEN l_partkey % 5 = 0 THEN concat('#', substring('0123456789abcdef', CAST(l_partkey % 16 + 1 AS INT), 1), '0f')
      WHEN l_suppkey % 3 = 0 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), CASE WHEN l_orderkey % 11 = 0 THEN '.sp' ELSE '.dp' END)
      WHEN l_suppkey % 3 = 1 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), CASE WHEN l_orderkey % 11 = 0 THEN 'rem' WHEN l_orderkey % 11 = 1 THEN '' WHEN l_orderkey % 11 = 2 THEN 'xyz' ELSE 'px' END)
      ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS value,
 CASE WHEN l_orderkey % 7 <> 0 THEN concat('parent', CAST(l_orderkey % 61 AS STRING)) END AS parent_id
FROM {{lineitem}}""",
    "v_token_sites": f"""
SELECT 'repo0' AS repo_id, 's1' AS snapshot_id, {_lang('l_partkey')} AS language,
 concat('t:', {_SITE}) AS id,
 concat('src/m', CAST(l_orderkey % 97 AS STRING), '.x') AS file,
 CAST(l_linenumber AS BIGINT) AS line, CAST(l_partkey % 80 + 1 AS BIGINT) AS col,
 concat('tok.', CAST(l_partkey + CASE WHEN l_suppkey % 50 = 49 THEN 90000000 ELSE 0 END AS STRING)) AS token_id,
 concat(CASE l_linenumber % 4 WHEN 0 THEN 'old.t' WHEN 1 THEN CASE WHEN l_suppkey % 50 = 7 THEN 'bad.t' ELSE 'theme.t' END ELSE 'theme.t' END, CAST(l_partkey AS STRING)) AS key,
 CASE WHEN l_suppkey % 50 = 11 THEN 'unknown' ELSE {_cat('l_partkey')} END AS category,
 CASE WHEN l_orderkey % 7 <> 0 THEN concat('parent', CAST(l_orderkey % 61 AS STRING)) END AS parent_id
FROM {{lineitem}}""",
    "v_source_files": """
SELECT concat('repo', CAST(doc_id % 5 AS STRING)) AS repo_id, 's1' AS snapshot_id, 'basic' AS language,
 concat('docs/', source, '/d', CAST(doc_id AS STRING), '.', lang) AS path, text AS content FROM {documents}
UNION ALL
SELECT concat('repo', CAST(page_id % 5 AS STRING)), 's1', 'basic', concat('site/p', CAST(page_id AS STRING), '.html'), html FROM {pages}""",
    "v_scopes": """
SELECT DISTINCT concat('src/m', CAST(o_orderkey % 97 AS STRING), '.x') AS file, concat('S', CAST(o_orderkey AS STRING)) AS scope_id,
 CAST(o_orderkey % 5 + 1 AS BIGINT) AS start_pos, CAST(o_orderkey % 5 + 1 + o_custkey % 6 AS BIGINT) AS end_pos
FROM {orders}""",
    "v_items": """
SELECT l_orderkey AS ok, l_partkey AS pk, CAST(l_quantity AS INT) AS q,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS BIGINT) AS rn,
 count(*) OVER (PARTITION BY l_orderkey) AS n
FROM {lineitem}""",
    "v_scan_runs": f"""
SELECT concat('repo', CAST(o_custkey % 40 AS STRING)) AS repo_id, concat('s', CAST(o_orderkey % 6 AS STRING)) AS snapshot_id, {_lang('o_orderkey')} AS language,
 CASE WHEN max(o_orderstatus) = 'P' THEN 'partial' WHEN min(o_orderstatus) = 'F' AND count(*) % 2 = 0 THEN 'failed' ELSE 'complete' END AS status,
 CAST(count(*) AS BIGINT) AS files_scanned, CAST(sum(o_orderkey % 1000 + 1) AS BIGINT) AS parse_extract_ms
FROM {{orders}} GROUP BY 1, 2, 3""",
    "v_diagnostics": f"""
SELECT concat('repo', CAST(o_custkey % 40 AS STRING)) AS repo_id, concat('s', CAST(o_orderkey % 6 AS STRING)) AS snapshot_id, {_lang('o_orderkey')} AS language,
 CAST(o_orderkey AS BIGINT) AS ordinal,
 CASE o_orderstatus WHEN 'F' THEN 'warning' WHEN 'O' THEN 'info' ELSE 'error' END AS severity,
 CASE o_orderkey % 64 WHEN 0 THEN 'parse_failed' WHEN 1 THEN 'root_not_found' WHEN 2 THEN 'ds_import_unresolved' ELSE CASE o_orderkey % 2 WHEN 0 THEN 'discover_package_conflict' ELSE 'import_unresolved' END END AS code,
 concat('message ', CAST(o_orderkey % 100 AS STRING)) AS message
FROM {{orders}}""",
}


def _names(sql: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


class Facts:
    """Lazy access to driver tables and projected fact tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._cache = spark, sf_dir, {}
        # the given text tables are single row groups
        self.partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in VIEWS:
                sql = VIEWS[name]
                self._cache[name] = self.spark.sql(sql, **{n: self[n] for n in _names(sql)})
            else:
                table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                self._cache[name] = spread(table, self.partitions) if name in TEXTS else table
        return self._cache[name]


def oracle(sql: str) -> str:
    """Prefix a checking query with the views it uses, as CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for n in _names(text):
            if n in VIEWS and n not in needed:
                visit(VIEWS[n])
                needed.append(n)

    visit(sql)
    fmt = {n: n for n in re.findall(r"\{(\w+)\}", sql + "".join(VIEWS[n] for n in needed))}
    body = sql.format(**fmt).strip()
    if not needed:
        return body
    ctes = ", ".join(f"{n} AS ({VIEWS[n].format(**fmt).strip()})" for n in needed)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
