"""S01-S06, X01-X05, X07-X09, X16, X18, X19, X22, X27, J01 over texts and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import identity as idf, text as tx
from ...operators import diagnostics as dg, intervals as iv, text_scan as ts
from ...sources import files as fs
from . import query

# A code-like tree: one path per order, with the file kinds that matter.
PATHS = """
SELECT concat('repo', CAST(o_custkey % 9 AS STRING)) AS repo_id, 's1' AS snapshot_id, 'react' AS language,
 concat(CASE o_orderkey % 6 WHEN 0 THEN 'app/src/' WHEN 1 THEN 'packages/ui/src/' WHEN 2 THEN 'packages/app-x/src/generated/' WHEN 3 THEN 'packages/ui/node_modules/lib/' WHEN 4 THEN 'lib/' ELSE '' END,
  'F', CAST(o_orderkey AS STRING), CASE o_orderkey % 11 WHEN 0 THEN '.kt' WHEN 1 THEN '.swift' WHEN 2 THEN '.tsx' WHEN 3 THEN '.d.ts' WHEN 4 THEN '.stories.tsx' WHEN 5 THEN '.test.js' WHEN 6 THEN '.JSX' WHEN 7 THEN '.jsx' WHEN 8 THEN '.md' WHEN 9 THEN '' ELSE '.ts' END) AS path
FROM {orders}"""


def _paths(t):
    return t.spark.sql(PATHS, orders=t["orders"])


def _keep(cond: str) -> str:
    return f"SELECT repo_id, path FROM ({PATHS}) p WHERE {cond}"


_REACT = "(regexp_matches(path, '[^/]\\.(js|jsx|ts|tsx)$') AND NOT path LIKE '%.d.ts')"
query("s01_select_language", _keep(_REACT))(
    lambda t: fs.select_language(_paths(t), "react").select("repo_id", "path"))
query("s02_resolve_roots", _keep("path LIKE 'app/src/_%' OR regexp_matches(path, '^packages/[^/]+/src/.') OR path LIKE 'app-*/_%'"))(
    lambda t: fs.resolve_roots(_paths(t), ["app/src", "packages/*/src", "app-*"]).select("repo_id", "path"))
query("s03_glob_filter", _keep("NOT (regexp_matches(path, '(^|/)generated/') OR regexp_matches(path, '^packages/[^/]*/src/[^/]*\\.(tsx|kt)$') OR path LIKE 'lib/%')"))(
    lambda t: fs.glob_filter(_paths(t), ["**/generated/**", "packages/*/src/*.{tsx,kt}", "lib/**"]).select("repo_id", "path"))
query("s04_include_filter", _keep("lower(path) LIKE '%.jsx' OR path LIKE '%.swift' OR path LIKE '%.stories.tsx'"))(
    lambda t: fs.include_filter(_paths(t), [".jsx", "SWIFT"], ["*.stories.tsx"]).select("repo_id", "path"))
query("s05_default_ignores", _keep("NOT (regexp_matches(path, '(^|/)(node_modules|generated|__generated__)/') OR path LIKE '%.d.ts' OR regexp_matches(path, '\\.(stories|spec|test)\\.(ts|tsx|js|jsx)$') OR path LIKE 'lib/%')"))(
    lambda t: fs.default_ignores(_paths(t), ["lib/**"]).select("repo_id", "path"))
query("s06_missing_roots", f"""
WITH f AS ({PATHS}), r AS (SELECT DISTINCT repo_id FROM ({PATHS}) p)
SELECT repo_id, root, code FROM (SELECT repo_id, 'unused' AS root, 'root_not_found' AS code, 'unused/' AS pre FROM r UNION ALL SELECT repo_id, 'app/src', 'root_not_found', 'app/src/' FROM r
 UNION ALL SELECT repo_id, 'nowhere/*/src', 'root_glob_not_found', 'nowhere/' FROM r) w
WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.repo_id = w.repo_id AND starts_with(f.path, w.pre))""")(
    lambda t: fs.missing_roots(
        _paths(t).select("repo_id", "snapshot_id", "language").distinct(),
        _paths(t), ["unused", "app/src", "nowhere/*/src"]).select("repo_id", "root", "code"))

# Lines as the checking engine sees them: RE2 has no class for all Unicode blanks.
SP = r"[\t\n\x0b\f\r\x{{85}}\p{{Z}}]"
LINES = """
SELECT repo_id, path, generate_subscripts(a, 1) AS line, unnest(a) AS text FROM (
 SELECT repo_id, path, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM (
  SELECT repo_id, path, string_split_regex(content, '\\r?\\n') AS a FROM ({src}) f) g) h"""


def _lines(src: str = "SELECT repo_id, path, content FROM {v_source_files}") -> str:
    return LINES.replace("{src}", src)


def _scannable(src: str = "SELECT repo_id, path, content FROM {v_source_files}") -> str:
    return f"""SELECT * FROM (SELECT repo_id, path, CAST(line AS BIGINT) AS line, CAST(strlen(text) - strlen(regexp_replace(text, '^{SP}+', '')) AS BIGINT) AS start_col,
  regexp_replace(split_part(regexp_replace(text, '^{SP}+', ''), '//', 1), '{SP}+$', '') AS code FROM ({_lines(src)}) l) m WHERE code <> ''"""


_MASK = "CASE WHEN contains(code, '\"') THEN list_aggregate(list_transform(string_split(code, '\"'), lambda p, i: CASE WHEN i % 2 = 0 THEN repeat(' ', length(p)) ELSE p END), 'string_agg', ' ') ELSE code END"


def _masked(src: str = "SELECT repo_id, path, content FROM {v_source_files}") -> str:
    return f"SELECT *, {_MASK} AS masked FROM ({_scannable(src)}) s"


query("x01_explode_lines", f"SELECT repo_id, path, CAST(line AS BIGINT) AS line, text FROM ({_lines()}) l")(
    lambda t: tx.explode_lines(t["v_source_files"]).select("repo_id", "path", "line", "text"))
query("x02_scannable_line", _scannable())(
    lambda t: tx.scannable_lines(tx.explode_lines(t["v_source_files"])).select("repo_id", "path", "line", "start_col", "code"))
query("x03_mask_strings", f"SELECT repo_id, path, line, masked FROM ({_masked()}) q WHERE contains(code, '\"')")(
    lambda t: ts.masked_lines(t["v_source_files"]).filter(F.contains("code", F.lit('"'))).select("repo_id", "path", "line", "masked"))

# Dense calls: every " the " becomes a call, and pages have their own.
CALLS = "SELECT repo_id, snapshot_id, language, path, replace(replace(content, ' the ', ' the( '), ' and ', ' x.and( ') AS content FROM {v_source_files}"
ALIASES = [("the", "The"), ("The", "The"), ("track", "Track"), ("and", "And"), ("x.and", "And"), ("missing", "Missing")]
_ALIAS_SQL = " UNION ALL ".join(f"SELECT '{a}' AS symbol, '{b}' AS registry_symbol" for a, b in ALIASES)


def _calls(t):
    return t.spark.sql(CALLS, v_source_files=t["v_source_files"])


def _aliases(t):
    """Every repository of the files declares the same aliases."""
    names = F.array(*[F.struct(F.lit(a).alias("call_symbol"), F.lit(b).alias("registry_symbol")) for a, b in ALIASES])
    return t["v_source_files"].select("repo_id", "language").distinct().select("repo_id", "language", F.inline(names))


# Pieces between "(" end in the called name; their byte lengths give its place.
query("x04_symbol_calls", f"""
WITH m AS ({_masked('SELECT repo_id, path, content FROM (' + CALLS + ') c')}),
p AS (SELECT repo_id, path, line, start_col, generate_subscripts(a, 1) AS i, a FROM (SELECT repo_id, path, line, start_col, string_split(masked, '(') AS a FROM m WHERE contains(masked, '(')) b),
c AS (SELECT repo_id, path, line, start_col, a[i] AS piece, strlen(array_to_string(a[1:i], '(')) AS stop FROM p WHERE i < len(a)),
w AS (SELECT repo_id, path, line, regexp_extract(piece, '[A-Za-z0-9_.]+$') AS run, start_col, stop FROM c),
s AS (SELECT repo_id, path, line, start_col + stop - strlen(run) + 1 AS col, run AS symbol FROM w WHERE run <> '')
SELECT repo_id, concat('usage.', path, ':', line, ':', col, ':', symbol) AS id, path AS file, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, symbol, registry_symbol FROM s JOIN ({_ALIAS_SQL}) k USING (symbol)""")(
    lambda t: ts.symbol_calls(_calls(t), _aliases(t)).select("repo_id", "id", "file", "line", "col", "symbol", "registry_symbol"))

TOKEN_KEYS = [("the", "t.the", "color"), ("the,", "t.comma", "spacing"), ("wh", "t.wh", "radius"), ("où", "t.ou", "color"), ("***", "t.stars", "typography")]


def _token_keys(t):
    keys = F.array(*[F.struct(F.lit(k).alias("match_key"), F.lit(i).alias("token_id"), F.lit(c).alias("category")) for k, i, c in TOKEN_KEYS])
    return t["v_source_files"].select("repo_id", "language").distinct().select("repo_id", "language", F.inline(keys))


# Marks are put around each match; the pieces in between give the byte columns.
query("x05_token_substring_refs", f"""
WITH l AS (SELECT repo_id, path, CAST(line AS BIGINT) AS line, regexp_replace(text, '(the,|the|wh|où|\\*\\*\\*)', chr(1) || '\\1' || chr(1), 'g') AS marked FROM ({_lines()}) x),
p AS (SELECT repo_id, path, line, generate_subscripts(a, 1) AS i, a FROM (SELECT repo_id, path, line, string_split(marked, chr(1)) AS a FROM l WHERE contains(marked, chr(1))) b)
SELECT repo_id, path AS file, line, CAST(strlen(array_to_string(a[1:i - 1], '')) + 1 AS BIGINT) AS col, a[i] AS key,
 CASE a[i] WHEN 'the' THEN 't.the' WHEN 'the,' THEN 't.comma' WHEN 'wh' THEN 't.wh' WHEN 'où' THEN 't.ou' ELSE 't.stars' END AS token_id FROM p WHERE i % 2 = 0""")(
    lambda t: ts.token_refs(t["v_source_files"], _token_keys(t)).select("repo_id", "file", "line", "col", "key", "token_id"))

# A registry of every short word of its repository: thousands of keys, many of them beginnings of others.
def _word_keys(t):
    words = t["v_source_files"].select("repo_id", "language", F.explode(F.flatten(F.transform(
        tx.lines_of(F.col("content")), lambda line: F.slice(F.split(line, " "), F.lit(2), F.size(F.split(line, " ")))))).alias("w"))
    return words.filter(F.char_length("w").between(1, 5)).distinct().select(
        "repo_id", "language", F.concat(F.lit(" "), "w").alias("match_key"), F.concat(F.lit("t."), "w").alias("token_id"), F.lit("color").alias("category"))


# A key is a blank and letters, so none overlap: at each blank the longest beginning that is a key counts.
query("x05_large_registries", f"""
WITH s AS (SELECT repo_id, path, CAST(line AS BIGINT) AS line, string_split(text, ' ') AS a FROM ({_lines()}) x WHERE contains(text, ' ')),
p AS (SELECT repo_id, path, line, CAST(strlen(array_to_string(a[1:i - 1], ' ')) + 1 AS BIGINT) AS col, a[i] AS w FROM (SELECT *, generate_subscripts(a, 1) AS i FROM s) y WHERE i > 1 AND a[i] <> ''),
k AS (SELECT DISTINCT repo_id, w FROM p WHERE length(w) <= 5),
c AS (SELECT p.*, n, substr(w, 1, n) AS key_part FROM p, unnest([1, 2, 3, 4, 5]) AS u(n) WHERE n <= length(w)),
h AS (SELECT c.repo_id, path, line, col, max(n) AS n, max_by(key_part, n) AS key_part FROM c JOIN k ON k.repo_id = c.repo_id AND k.w = c.key_part GROUP BY 1, 2, 3, 4)
SELECT repo_id, path AS file, line, col, concat(' ', key_part) AS key, concat('t.', key_part) AS token_id FROM h""")(
    lambda t: ts.token_refs(t["v_source_files"], _word_keys(t)).select("repo_id", "file", "line", "col", "key", "token_id"))

query("x09_positions", f"""
SELECT repo_id, path, CAST(line AS BIGINT) AS line, CAST(strlen(split_part(text, 'è', 1)) + 1 AS BIGINT) AS col FROM ({_lines()}) l WHERE contains(text, 'è')""")(
    lambda t: tx.explode_lines(t["v_source_files"]).filter(F.contains("text", F.lit("è"))).select(
        "repo_id", "path", "line", (F.octet_length(F.substring_index("text", "è", 1)) + 1).cast("bigint").alias("col")))

query("x16_package_identity", f"""
SELECT path, CASE WHEN regexp_matches(path, '(^|/)Sources/[^/]+/[^/]+$') THEN regexp_extract(path, '(^|/)Sources/([^/]+)/[^/]+$', 2) ELSE regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') END AS swift_module,
 regexp_replace(path, '([^/])\\.[^./]*$', '\\1') AS react_module FROM (SELECT CASE WHEN length(path) % 2 = 0 THEN concat('x/Sources/Mod/', regexp_extract(path, '[^/]*$')) ELSE path END AS path FROM ({PATHS}) p) q""")(
    lambda t: _paths(t).select(F.when(F.length("path") % 2 == 0, F.concat(F.lit("x/Sources/Mod/"), tx.file_name(F.col("path")))).otherwise(F.col("path")).alias("path"))
    .select("path", idf.swift_module(F.col("path")).alias("swift_module"), idf.react_module(F.col("path")).alias("react_module")))

query("x22_site_ids", "SELECT id, concat('hardcoded.', language, ':', file, ':', line, ':', col, ':', upper(category[1]), category[2:]) AS site_id FROM {v_style_sites}")(
    lambda t: t["v_style_sites"].select("id", idf.site_id(
        F.concat(F.lit("hardcoded."), "language"), "file", "line", "col", idf.category_label(F.col("category"))).alias("site_id")))

query("x27_scan_status", f"""
SELECT r.repo_id, r.snapshot_id, r.language, CASE WHEN coalesce(g, false) THEN 'partial' ELSE 'complete' END AS status FROM (SELECT DISTINCT repo_id, snapshot_id, language FROM {{v_scan_runs}}) r
LEFT JOIN (SELECT repo_id, snapshot_id, language, bool_or(code IN ('parse_failed', 'root_not_found', 'root_glob_not_found', 'ds_import_unresolved', 'ds_export_unresolved', 'package_entrypoint_unresolved', 'ds_usage_unresolved')) AS g FROM {{v_diagnostics}} GROUP BY 1, 2, 3) d USING (repo_id, snapshot_id, language)""")(
    lambda t: dg.scan_status(t["v_scan_runs"].select("repo_id", "snapshot_id", "language"), t["v_diagnostics"]))



def _sites(t):
    return t["v_usage_sites"].select("id", "file", F.col("line").alias("pos"))


query("j01_parent_scope", """
WITH p AS (SELECT file, line, scope_id FROM (SELECT u.file, u.line, s.scope_id, row_number() OVER (PARTITION BY u.file, u.line ORDER BY s.end_pos - s.start_pos, s.start_pos, s.scope_id) AS rn
 FROM (SELECT DISTINCT file, line FROM {v_usage_sites}) u JOIN {v_scopes} s ON s.file = u.file AND s.start_pos <= u.line AND s.end_pos >= u.line) x WHERE rn = 1)
SELECT u.id, u.file, u.line AS pos, p.scope_id FROM {v_usage_sites} u LEFT JOIN p ON p.file = u.file AND p.line = u.line""")(
    lambda t: iv.parent_scope(_sites(t), t["v_scopes"], ["file"]).select("id", "file", "pos", "scope_id"))
query("x18_preview_filter", """
SELECT u.id, u.file, u.line AS pos FROM {v_usage_sites} u WHERE NOT EXISTS (SELECT 1 FROM {v_scopes} s WHERE s.file = u.file AND s.start_pos <= u.line AND s.end_pos >= u.line AND s.end_pos - s.start_pos < 2)""")(
    lambda t: iv.outside_scopes(_sites(t), t["v_scopes"].filter("end_pos - start_pos < 2"), ["file"]).select("id", "file", "pos"))
query("x19_ui_scope_gate", """
WITH p AS (SELECT file, line, scope_id FROM (SELECT u.file, u.line, s.scope_id, row_number() OVER (PARTITION BY u.file, u.line ORDER BY s.end_pos - s.start_pos, s.start_pos, s.scope_id) AS rn
 FROM (SELECT DISTINCT file, line FROM {v_usage_sites}) u JOIN {v_scopes} s ON s.file = u.file AND s.start_pos <= u.line AND s.end_pos >= u.line) x WHERE rn = 1)
SELECT u.id, p.scope_id FROM {v_usage_sites} u JOIN p ON p.file = u.file AND p.line = u.line WHERE CAST(substr(p.scope_id, 2) AS BIGINT) % 20 = 0""")(
    lambda t: iv.ui_scope_gate(
        _sites(t), t["v_scopes"].withColumn("is_ui", F.substring("scope_id", 2, 12).cast("bigint") % 20 == 0), ["file"]).select("id", "scope_id"))
query("x07_containment_dedupe", """
WITH r AS (SELECT file, start_pos, end_pos, min(scope_id) AS scope_id FROM {v_scopes} GROUP BY file, start_pos, end_pos)
SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.file = r.file AND o.start_pos <= r.start_pos AND o.end_pos >= r.end_pos AND o.end_pos - o.start_pos > r.end_pos - r.start_pos)""")(
    lambda t: iv.containment_dedupe(t["v_scopes"], ["file"], cell=2))
query("x08_first_by_priority", """
SELECT id, priority, symbol FROM (SELECT symbol AS id, line AS priority, id AS symbol, row_number() OVER (PARTITION BY symbol ORDER BY line, id) AS rn FROM {v_usage_sites}) x WHERE rn = 1""")(
    lambda t: iv.first_by_priority(t["v_usage_sites"].select(F.col("symbol").alias("id"), F.col("line").alias("priority"), F.col("id").alias("symbol")), ["id"]))
