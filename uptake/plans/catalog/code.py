"""X06, X10-X15, X17, X20, X21, X23, X24, X28 and J03-J13 over written source files.

The checking SQL never sees the texts: it says from the line items which facts
each file holds and on which line and column they stand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import registry as rg, resolve as rs
from ...operators.extract import kotlin, react, swift
from ...operators.extract.kotlin import lookup
from .. import code_files as cf, scan
from . import query
from .metrics import PARENT_SQL, RATIO_SQL, RAW_SQL

REPO = "concat('repo', CAST(ok % 4 AS VARCHAR))"
KT = "concat('app/src/m', CAST(ok % 7 AS VARCHAR), '/F', CAST(ok AS VARCHAR), '.kt')"
SW = "concat('app/Sources/Mod', CAST(ok % 7 AS VARCHAR), '/V', CAST(ok AS VARCHAR), '.swift')"
TS = "concat('src/m', CAST(ok % 7 AS VARCHAR), '/F', CAST(ok AS VARCHAR), '.tsx')"
SYM = "CASE WHEN pk % 50 < 38 THEN concat('Sym', CAST(pk % 50 AS VARCHAR)) ELSE concat('Local', CAST(pk % 5 AS VARCHAR)) END"
ORDERS = "(SELECT DISTINCT ok, n FROM {v_items})"


def _s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


# --- Compose -------------------------------------------------------------------

KT_CALLS = f"""
SELECT {REPO} AS repo_id, {KT} AS file, 6 + rn AS line, CAST(5 AS BIGINT) AS col, {SYM} AS symbol, ok, pk,
 concat('compose:composable:com.acme.m', {_s('ok % 7')}, '.Screen', {_s('ok')}) AS parent_id FROM {{v_items}} WHERE ok % 3 = 0
UNION ALL SELECT {REPO}, {KT}, n + 16, CAST(24 AS BIGINT), 'Sym2', ok, 2, concat('compose:composable:com.acme.m', {_s('ok % 7')}, '.Local', {_s('ok % 5')}) FROM {ORDERS} o WHERE ok % 3 = 0"""

query("x11_compose_calls", f"SELECT repo_id, file, line, col, symbol, parent_id FROM ({KT_CALLS}) c")(
    lambda t: kotlin.calls(cf.kotlin_files(t)).select(
        "repo_id", F.col("path").alias("file"), "line", "col", "symbol", "parent_id"))

query("x13_kotlin_imports", f"""
SELECT {REPO} AS repo_id, {KT} AS file, 'named' AS imported_kind, concat('Sym', {_s('ok % 50')}) AS local_name, 'com.acme.ds' AS package FROM {ORDERS} o WHERE ok % 3 = 0
UNION ALL SELECT {REPO}, {KT}, 'wildcard', NULL, 'com.acme.wild' FROM {ORDERS} o WHERE ok % 6 = 0""")(
    lambda t: kotlin.imports(cf.kotlin_files(t)).select("repo_id", "file", "imported_kind", "local_name", "package"))

KT_DEFS = f"""
SELECT {REPO} AS repo_id, {KT} AS file, concat('local.compose:com.acme.m', {_s('ok % 7')}, '.Screen', {_s('ok')}) AS id, concat('Screen', {_s('ok')}) AS symbol, CAST(6 AS BIGINT) AS line, CAST(5 AS BIGINT) AS col, ok FROM {ORDERS} o WHERE ok % 3 = 0
UNION ALL SELECT {REPO}, {KT}, concat('local.compose:com.acme.m', {_s('ok % 7')}, '.Local', {_s('ok % 5')}), concat('Local', {_s('ok % 5')}), n + 16, 13, ok FROM {ORDERS} o WHERE ok % 3 = 0"""

query("x20_compose_definitions", f"SELECT repo_id, file, id, symbol, line, col FROM ({KT_DEFS}) d")(
    lambda t: kotlin.definitions(cf.kotlin_files(t)).select("repo_id", "file", "id", "symbol", "line", "col"))
query("x17_compose_scopes", f"""
SELECT {REPO} AS repo_id, {KT} AS file, name, composable, preview, hidden, line FROM (
 SELECT ok, n, concat('Screen', {_s('ok')}) AS name, true AS composable, false AS preview, false AS hidden, 6 AS line FROM {ORDERS} o WHERE ok % 3 = 0
 UNION ALL SELECT ok, n, concat('Preview', {_s('ok')}), true, true, false, n + 11 FROM {ORDERS} o WHERE ok % 3 = 0
 UNION ALL SELECT ok, n, concat('Local', {_s('ok % 5')}), true, false, true, n + 16 FROM {ORDERS} o WHERE ok % 3 = 0) s""")(
    lambda t: kotlin.with_scopes(cf.kotlin_files(t)).select("repo_id", F.col("path").alias("file"), F.inline("scopes")).select(
        "repo_id", "file", "name", "composable", "preview", "hidden", "line"))

query("x21_compose_styles", f"""
SELECT concat('hardcoded.compose:', {KT}, ':', {_s('6 + rn')}, ':', {_s(f'5 + length({SYM}) + 21')}, ':Spacing') AS id, {KT} AS file, 6 + rn AS line,
 concat({_s('q')}, '.dp') AS value, 'spacing' AS category, 'padding' AS context FROM {{v_items}} WHERE ok % 3 = 0""")(
    lambda t: kotlin.style_sites(cf.kotlin_files(t)).select("id", "file", "line", "value", "category", "context"))


def _tokens(module, files):
    def run(t):
        f = files(t)
        return module.token_sites(f, cf.registry_of(f)[1]).select("file", "line", "col", "key", "token_id")
    return run


query("x06_compose_tokens", f"""
SELECT {KT} AS file, 6 + rn AS line, CAST(5 + length({SYM}) + 29 + length({_s('q')}) + 13 AS BIGINT) AS col, concat('Theme.t', {_s('pk % 60')}, '.main') AS key, concat('tok.', {_s('pk % 60')}) AS token_id
FROM {{v_items}} WHERE ok % 3 = 0 AND pk % 60 < 40""")(_tokens(kotlin, cf.kotlin_files))


def _classified(extract, files):
    def run(t):
        f = files(t)
        aliases, keys = cf.registry_of(f)
        return extract(f, aliases, keys)["usage_sites"].select(
            "repo_id", "id", "qualified_symbol", "match_status", "registry_symbol", "local_definition_id")
    return run


KT_USAGE = f"""
WITH c AS ({KT_CALLS}), d AS ({KT_DEFS}),
p AS (SELECT c.*, concat('com.acme.m', {_s('ok % 7')}) AS package, CASE WHEN symbol = concat('Sym', {_s('ok % 50')}) THEN 'com.acme.ds' WHEN ok % 2 = 0 THEN 'com.acme.wild' END AS import_package,
  CASE WHEN symbol LIKE 'Sym%' AND CAST(substr(symbol, 4) AS INT) < 30 THEN symbol END AS target, CASE WHEN symbol LIKE 'Sym%' AND CAST(substr(symbol, 4) AS INT) < 20 THEN 'com.acme.ds' END AS target_package FROM c),
l AS (SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.repo_id = p.repo_id AND d.id = concat('local.compose:', p.package, '.', p.symbol)) THEN concat('local.compose:', p.package, '.', p.symbol) END AS local_definition_id FROM p),
m AS (SELECT *, CASE WHEN local_definition_id IS NOT NULL THEN 'local' WHEN target IS NULL THEN 'unresolved' WHEN target_package IS NULL THEN 'resolved' WHEN import_package IS NULL THEN 'candidate'
  WHEN import_package = target_package THEN 'resolved' ELSE 'unresolved' END AS match_status FROM l)
SELECT repo_id, parent_id, concat('usage.compose:', file, ':', {_s('line')}, ':', {_s('col')}, ':', symbol) AS id,
 CASE WHEN match_status = 'local' THEN concat(package, '.', symbol) WHEN import_package IS NOT NULL THEN concat(import_package, '.', symbol) END AS qualified_symbol,
 match_status, CASE WHEN match_status IN ('resolved', 'candidate') THEN target END AS registry_symbol, local_definition_id FROM m"""

query("j10_classify_compose", f"SELECT repo_id, id, qualified_symbol, match_status, registry_symbol, local_definition_id FROM ({KT_USAGE}) u")(
    _classified(scan.scan_compose, cf.kotlin_files))

# --- Swift ---------------------------------------------------------------------

SW_CALLS = f"""
SELECT {REPO} AS repo_id, {SW} AS file, 6 + rn AS line, CAST(9 + CASE WHEN pk % 4 = 0 THEN 3 ELSE 0 END AS BIGINT) AS col, {SYM} AS symbol, CASE WHEN pk % 4 = 0 THEN 'DS' END AS qualifier, ok, pk,
 concat('swiftui:view:Mod', {_s('ok % 7')}, '#Screen', {_s('ok')}) AS parent_id FROM {{v_items}} WHERE ok % 3 = 2
UNION ALL SELECT {REPO}, {SW}, n + 15, 27, 'Sym2', NULL, ok, 2, concat('swiftui:view:Mod', {_s('ok % 7')}, '#Local', {_s('ok % 5')}) FROM {ORDERS} o WHERE ok % 3 = 2"""

query("x12_swift_calls", f"SELECT repo_id, file, line, col, symbol, qualifier, parent_id FROM ({SW_CALLS}) c")(
    lambda t: swift.calls(cf.swift_files(t)).select(
        "repo_id", F.col("path").alias("file"), "line", "col", "symbol", "qualifier", "parent_id"))
query("x14_swift_imports", f"""
SELECT {REPO} AS repo_id, {SW} AS file, 'module' AS imported_kind, NULL AS local_name, 'SwiftUI' AS package FROM {ORDERS} o WHERE ok % 3 = 2
UNION ALL SELECT {REPO}, {SW}, CASE WHEN ok % 2 = 0 THEN 'module' ELSE 'named' END, CASE WHEN ok % 2 = 1 THEN concat('Sym', {_s('ok % 50')}) END, CASE WHEN ok % 2 = 0 THEN 'DesignSystem' ELSE 'Kit' END FROM {ORDERS} o WHERE ok % 3 = 2""")(
    lambda t: swift.imports(cf.swift_files(t)).select("repo_id", "file", "imported_kind", "local_name", "package"))

SW_DEFS = f"""
SELECT {REPO} AS repo_id, {SW} AS file, concat('local.swift:Mod', {_s('ok % 7')}, '#Screen', {_s('ok')}) AS id, concat('Screen', {_s('ok')}) AS symbol, CAST(5 AS BIGINT) AS line, CAST(8 AS BIGINT) AS col, ok FROM {ORDERS} o WHERE ok % 3 = 2
UNION ALL SELECT {REPO}, {SW}, concat('local.swift:Mod', {_s('ok % 7')}, '#Local', {_s('ok % 5')}), concat('Local', {_s('ok % 5')}), n + 14, 8, ok FROM {ORDERS} o WHERE ok % 3 = 2"""
query("x20_swift_definitions", f"SELECT repo_id, file, id, symbol, line, col FROM ({SW_DEFS}) d")(
    lambda t: swift.definitions(cf.swift_files(t)).select("repo_id", "file", "id", "symbol", "line", "col"))
query("x21_swift_styles", f"""
SELECT {SW} AS file, 6 + rn AS line, CAST(9 + CASE WHEN pk % 4 = 0 THEN 3 ELSE 0 END + length({SYM}) + 47 + length({_s('pk % 60')}) AS BIGINT) AS col, {_s('q')} AS value, 'spacing' AS category, 'padding' AS context
FROM {{v_items}} WHERE ok % 3 = 2""")(
    lambda t: swift.style_sites(cf.swift_files(t)).select("file", "line", "col", "value", "category", "context"))
query("x06_swift_tokens", f"""
SELECT {SW} AS file, 6 + rn AS line, CAST(9 + CASE WHEN pk % 4 = 0 THEN 3 ELSE 0 END + length({SYM}) + 25 AS BIGINT) AS col, concat('Theme.t', {_s('pk % 60')}, '.main') AS key, concat('tok.', {_s('pk % 60')}) AS token_id
FROM {{v_items}} WHERE ok % 3 = 2 AND pk % 60 < 40""")(_tokens(swift, cf.swift_files))

SW_USAGE = f"""
WITH c AS ({SW_CALLS}), d AS ({SW_DEFS}),
p AS (SELECT c.*, concat('Mod', {_s('ok % 7')}) AS module, coalesce(qualifier, CASE WHEN ok % 2 = 1 THEN CASE WHEN symbol = concat('Sym', {_s('ok % 50')}) THEN 'Kit' ELSE 'SwiftUI' END END) AS import_package,
  CASE WHEN symbol LIKE 'Sym%' AND CAST(substr(symbol, 4) AS INT) < 30 THEN symbol END AS target, CASE WHEN symbol LIKE 'Sym%' AND CAST(substr(symbol, 4) AS INT) < 20 THEN 'DesignSystem' END AS target_package FROM c),
l AS (SELECT p.*, CASE WHEN qualifier IS NULL AND EXISTS (SELECT 1 FROM d WHERE d.repo_id = p.repo_id AND d.id = concat('local.swift:', p.module, '#', p.symbol)) THEN concat('local.swift:', p.module, '#', p.symbol) END AS local_definition_id FROM p),
m AS (SELECT *, CASE WHEN local_definition_id IS NOT NULL THEN 'local' WHEN target IS NULL THEN 'unresolved' WHEN target_package IS NULL THEN 'resolved' WHEN import_package IS NULL THEN 'candidate'
  WHEN import_package = target_package THEN 'resolved' ELSE 'unresolved' END AS match_status FROM l)
SELECT repo_id, parent_id, concat('usage.swift:', file, ':', {_s('line')}, ':', {_s('col')}, ':', symbol) AS id,
 CASE WHEN match_status = 'local' THEN concat(module, '.', symbol) WHEN import_package IS NOT NULL THEN concat(import_package, '.', symbol) END AS qualified_symbol,
 match_status, CASE WHEN match_status IN ('resolved', 'candidate') THEN target END AS registry_symbol, local_definition_id FROM m
WHERE local_definition_id IS NOT NULL OR target IS NOT NULL OR import_package IS NULL OR import_package = 'SwiftUI'"""

query("j11_classify_swift", f"SELECT repo_id, id, qualified_symbol, match_status, registry_symbol, local_definition_id FROM ({SW_USAGE}) u")(
    _classified(scan.scan_swift, cf.swift_files))

# --- React ---------------------------------------------------------------------

PANELS = f"(SELECT DISTINCT {REPO} AS repo_id, unnest(range(5)) AS k FROM {{v_items}} WHERE ok % 3 = 1)"
TS_CALLS = f"""
SELECT {REPO} AS repo_id, {TS} AS file, 6 + rn AS line, CAST(7 AS BIGINT) AS col, concat('Sym', {_s('pk % 50')}) AS symbol, ok, pk,
 concat('react:component:src/m', {_s('ok % 7')}, '/F', {_s('ok')}, '#Screen', {_s('ok')}) AS parent_id FROM {{v_items}} WHERE ok % 3 = 1
UNION ALL SELECT {REPO}, {TS}, n + 11, 21 + length({_s('ok')}), concat('Panel', {_s('ok % 5')}), ok, -1, NULL FROM {ORDERS} o WHERE ok % 3 = 1
UNION ALL SELECT repo_id, concat('src/lib/impl/p', {_s('k')}, '.tsx'), 2, 10, 'Sym0', NULL, 0, concat('react:component:src/lib/impl/p', {_s('k')}, '#Panel', {_s('k')}) FROM {PANELS} p"""
query("x10_jsx_usages", f"SELECT repo_id, file, line, col, symbol, parent_id FROM ({TS_CALLS}) c")(
    lambda t: react.calls(cf.react_files(t)).select(
        "repo_id", F.col("path").alias("file"), "line", "col", "symbol", "parent_id"))
query("x15_es_imports", f"""
SELECT {REPO} AS repo_id, {TS} AS file, '@acme/ds' AS specifier, 'named' AS imported_kind, concat('Sym', {_s('ok % 50')}) AS local_name, concat('Sym', {_s('ok % 50')}) AS imported_symbol FROM {ORDERS} o WHERE ok % 3 = 1
UNION ALL SELECT {REPO}, {TS}, '@acme/ds', 'named', 'Alias', 'Sym77' FROM {ORDERS} o WHERE ok % 3 = 1
UNION ALL SELECT {REPO}, {TS}, concat('../lib/p', {_s('ok % 5')}), 'named', concat('Panel', {_s('ok % 5')}), concat('Panel', {_s('ok % 5')}) FROM {ORDERS} o WHERE ok % 3 = 1""")(
    lambda t: react.imports(cf.react_files(t)).select(
        "repo_id", "file", "specifier", "imported_kind", "local_name", "imported_symbol"))
query("x15_es_exports", f"""
SELECT {REPO} AS repo_id, {TS} AS file, concat('Screen', {_s('ok')}) AS export_name, 'local' AS kind, NULL AS source_specifier FROM {ORDERS} o WHERE ok % 3 = 1
UNION ALL SELECT repo_id, concat('src/lib/p', {_s('k')}, '.ts'), concat('Panel', {_s('k')}), 'reexport', concat('./impl/p', {_s('k')}) FROM {PANELS} p
UNION ALL SELECT repo_id, concat('src/lib/impl/p', {_s('k')}, '.tsx'), concat('Panel', {_s('k')}), 'local', NULL FROM {PANELS} p""")(
    lambda t: react.exports(cf.react_files(t)).select("repo_id", "file", "export_name", "kind", "source_specifier"))

TS_DEFS = f"""
SELECT {REPO} AS repo_id, {TS} AS file, concat('Screen', {_s('ok')}) AS symbol, CAST(4 AS BIGINT) AS line, CAST(17 AS BIGINT) AS col FROM {ORDERS} o WHERE ok % 3 = 1
UNION ALL SELECT {REPO}, {TS}, concat('Inner', {_s('ok')}), n + 11, 7 FROM {ORDERS} o WHERE ok % 3 = 1
UNION ALL SELECT repo_id, concat('src/lib/impl/p', {_s('k')}, '.tsx'), concat('Panel', {_s('k')}), 1, 17 FROM {PANELS} p"""
query("x20_react_definitions", f"SELECT *, concat('react:component:', regexp_replace(file, '\\.tsx$', ''), '#', symbol) AS id FROM ({TS_DEFS}) d")(
    lambda t: react.definitions(cf.react_files(t)).select("repo_id", "file", "symbol", "line", "col", "id"))
query("x28_shadowed_names", f"""
SELECT {REPO} AS repo_id, {TS} AS file, 6 + rn AS line, concat('Sym', {_s('pk % 50')}) AS symbol FROM {{v_items}} WHERE ok % 3 = 1 AND pk % 50 NOT IN (7, 9)
UNION ALL SELECT {REPO}, {TS}, n + 11, concat('Panel', {_s('ok % 5')}) FROM {ORDERS} o WHERE ok % 3 = 1
UNION ALL SELECT repo_id, concat('src/lib/impl/p', {_s('k')}, '.tsx'), 2, 'Sym0' FROM {PANELS} p""")(
    lambda t: react.calls(cf.react_files(t).withColumn(
        "content", F.regexp_replace("content", r"\(\) \{\n  return", "({ as: Sym7 }) {  const Sym9 = null;\n  return"))).select(
        "repo_id", F.col("path").alias("file"), "line", "symbol"))
query("x21_react_styles", f"""
SELECT concat('hardcoded.react:', {TS}, ':', {_s('6 + rn')}, ':', {_s(f"7 + 1 + length(concat('Sym', {_s('pk % 50')})) + 10")}, ':Spacing') AS id, {_s('q')} AS value, 'spacing' AS category, 'padding' AS context FROM {{v_items}} WHERE ok % 3 = 1
UNION ALL SELECT concat('hardcoded.react:', {TS}, ':', {_s('6 + rn')}, ':', {_s(f"7 + 1 + length(concat('Sym', {_s('pk % 50')})) + 21 + length({_s('q')})")}, ':Color'), concat('"#0', {_s('pk % 10')}, 'f"'), 'color', 'color' FROM {{v_items}} WHERE ok % 3 = 1""")(
    lambda t: react.style_sites(cf.react_files(t)).select("id", "value", "category", "context"))
query("x06_react_tokens", f"""
SELECT {TS} AS file, 6 + rn AS line, concat('theme.t', {_s('pk % 60')}, '.main') AS key, concat('tok.', {_s('pk % 60')}) AS token_id,
 CAST(7 + 1 + length(concat('Sym', {_s('pk % 50')})) + 21 + length({_s('q')}) + 23 AS BIGINT) AS col FROM {{v_items}} WHERE ok % 3 = 1 AND pk % 60 < 40""")(
    _tokens(react, cf.react_files))

TS_USAGE = f"""
WITH c AS ({TS_CALLS}), k AS (SELECT *, CASE WHEN symbol LIKE 'Sym%' THEN CAST(substr(symbol, 4) AS INT) END AS s, coalesce(symbol = concat('Sym', {_s('ok % 50')}), false) AS imported FROM c)
SELECT repo_id, parent_id, concat('usage.', file, ':', {_s('line')}, ':', {_s('col')}, ':', symbol) AS id,
 CASE WHEN s IS NULL THEN concat('src/lib/impl/p', substr(symbol, 6), '#', symbol) END AS qualified_symbol,
 CASE WHEN s IS NULL THEN 'local' WHEN s >= 20 OR imported THEN 'resolved' ELSE 'candidate' END AS match_status, CASE WHEN s IS NOT NULL THEN symbol END AS registry_symbol,
 CASE WHEN s IS NULL THEN concat('react:component:src/lib/impl/p', substr(symbol, 6), '#', symbol) END AS local_definition_id
FROM k WHERE s IS NULL OR s < 30"""

query("j09_classify_react", f"SELECT repo_id, id, qualified_symbol, match_status, registry_symbol, local_definition_id FROM ({TS_USAGE}) u")(_classified(scan.scan_react, cf.react_files))

CONFIG = rs.ModuleConfig(packages={"@acme/ds": {".": "src/lib/p0.ts", "missing": "src/none.ts"}}, aliases={"@lib/*": ["src/lib/*"]})


def _modules(t, config=rs.ModuleConfig()):
    return scan.react_modules(cf.react_files(t), config)


query("j07_specifier_resolve", f"""
SELECT {REPO} AS repo_id, {TS} AS file, 'Alias' AS local_name, 'src/lib/p0.ts' AS source_module FROM {ORDERS} o WHERE ok % 3 = 1
UNION ALL SELECT {REPO}, {TS}, concat('Sym', {_s('ok % 50')}), 'src/lib/p0.ts' FROM {ORDERS} o WHERE ok % 3 = 1
UNION ALL SELECT {REPO}, {TS}, concat('Panel', {_s('ok % 5')}), concat('src/lib/p', {_s('ok % 5')}, '.ts') FROM {ORDERS} o WHERE ok % 3 = 1""")(
    lambda t: _modules(t, CONFIG)[0].select("repo_id", "file", "local_name", "source_module"))


def _resolved(t, config):
    imports, exports = _modules(t, config)
    return rs.resolved_imports(imports, rs.module_edges(imports, exports, config), config)


query("j06_export_chain", f"""
SELECT {REPO} AS repo_id, {TS} AS file, concat('Panel', {_s('ok % 5')}) AS local_name, concat('src/lib/impl/p', {_s('ok % 5')}, '.tsx') AS final_module, concat('Panel', {_s('ok % 5')}) AS final_symbol FROM {ORDERS} o WHERE ok % 3 = 1""")(
    lambda t: _resolved(t, rs.ModuleConfig()).filter("final_module IS NOT NULL").select(
        "repo_id", "file", "local_name", "final_module", "final_symbol"))
query("j08_package_provenance", f"""
SELECT {REPO} AS repo_id, {TS} AS file, concat('Sym', {_s('ok % 50')}) AS local_name, true AS through_package FROM {ORDERS} o WHERE ok % 3 = 1
UNION ALL SELECT {REPO}, {TS}, 'Alias', true FROM {ORDERS} o WHERE ok % 3 = 1
UNION ALL SELECT {REPO}, {TS}, concat('Panel', {_s('ok % 5')}), false FROM {ORDERS} o WHERE ok % 3 = 1""")(
    lambda t: _resolved(t, CONFIG).select("repo_id", "file", "local_name", "through_package"))


def _import_diagnostics(t):
    files = cf.react_files(t).filter("path NOT LIKE 'src/lib/impl/%'")
    aliases = cf.registry_of(files)[0]
    extra = aliases.select("repo_id", "language", F.concat(F.lit("Panel"), F.substring("call_symbol", 4, 1)).alias("call_symbol")).distinct()
    named = aliases.unionByName(extra.withColumn("registry_symbol", F.col("call_symbol")).withColumn("registry_package", F.lit(None).cast("string")))
    imports, exports = scan.react_modules(files, rs.ModuleConfig())
    return rs.import_diagnostics(imports, exports, named, rs.ModuleConfig())


query("j13_import_diagnostics", f"""
SELECT repo_id, concat('src/lib/p', {_s('k')}, '.ts') AS file, 'ds_export_unresolved' AS code, concat('Panel', {_s('k')}) AS name FROM {PANELS} p""")(
    lambda t: _import_diagnostics(t).select("repo_id", "file", "code", "name"))
query("j13_entrypoints", f"SELECT DISTINCT {REPO} AS repo_id, 'package_entrypoint_unresolved' AS code, '@acme/ds' AS package, 'missing' AS entrypoint FROM {{v_items}} WHERE ok % 3 = 1")(
    lambda t: rs.entrypoint_diagnostics(
        cf.react_files(t).select("repo_id", "snapshot_id", "language").distinct(), cf.react_files(t), CONFIG).select(
        "repo_id", "code", "package", "entrypoint"))

# --- lookups and discovery --------------------------------------------------------

_CALLS = "SELECT concat('repo', CAST(l_suppkey % 4 AS STRING)) AS repo_id, 's1' AS snapshot_id, 'react' AS language, concat('Sym', CAST(l_partkey % 50 AS STRING)) AS symbol, CASE l_suppkey % 3 WHEN 0 THEN '@acme/ds' WHEN 1 THEN '@other/x' END AS import_package, concat(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), ':', CAST(l_suppkey AS STRING)) AS id FROM {lineitem}"


def _alias_calls(t):
    calls = t.spark.sql(_CALLS, lineitem=t["lineitem"])
    return rs.alias_resolve(calls, cf.registry_of(calls)[0])


query("j03_alias_resolve", f"SELECT repo_id, id, symbol, CASE WHEN CAST(substr(symbol, 4) AS INT) < 30 THEN symbol END AS target FROM ({_CALLS}) c")(
    lambda t: _alias_calls(t).select("repo_id", "id", "symbol", "target"))
query("j04_import_match", f"""
SELECT repo_id, id, symbol, CASE WHEN CAST(substr(symbol, 4) AS INT) >= 20 THEN 'legacy_name_only' WHEN import_package IS NULL THEN 'candidate' WHEN import_package = '@acme/ds' THEN 'resolved' ELSE 'mismatch' END AS import_match
FROM ({_CALLS}) c WHERE CAST(substr(symbol, 4) AS INT) < 30""")(
    lambda t: _alias_calls(t).filter("target IS NOT NULL").select(
        "repo_id", "id", "symbol", rs.import_match(F.col("target_package"), F.col("import_package")).alias("import_match")))

# What each language takes for a style, spelled out once more for the checking SQL: names, category, context.
_STYLES = {
    "j02_style_props": (react.STYLE_PROPS, (
        ("color backgroundColor borderColor", "color", "color"),
        ("padding paddingTop paddingRight paddingBottom paddingLeft paddingInline paddingBlock paddingInlineStart paddingInlineEnd paddingBlockStart paddingBlockEnd", "spacing", "padding"),
        ("margin marginTop marginRight marginBottom marginLeft marginInline marginBlock marginInlineStart marginInlineEnd marginBlockStart marginBlockEnd", "spacing", "margin"),
        ("gap rowGap columnGap", "spacing", "gap"), ("width", "spacing", "width"), ("height", "spacing", "height"),
        ("fontSize fontWeight lineHeight", "typography", "typography"), ("borderRadius", "radius", "radius"), ("boxShadow shadow", "elevation", "elevation"))),
    "j02_compose_style_calls": (kotlin.STYLE_CALLS, (
        ("Color background", "color", "color"), ("padding", "spacing", "padding"), ("size", "spacing", "size"), ("width", "spacing", "width"),
        ("height", "spacing", "height"), ("spacedBy", "spacing", "gap"), ("fontSize TextStyle", "typography", "typography"),
        ("clip cornerRadius RoundedCornerShape", "radius", "radius"), ("shadow elevation", "elevation", "elevation"))),
    "j02_swift_style_calls": (swift.STYLE_CALLS, (
        ("foregroundStyle foregroundColor background", "color", "color"), ("padding", "spacing", "padding"), ("frame", "spacing", "size"),
        ("spacing", "spacing", "gap"), ("font fontWeight", "typography", "typography"), ("cornerRadius clipShape", "radius", "radius"),
        ("shadow", "elevation", "elevation"))),
    "j02_swift_style_labels": (swift.STYLE_LABELS, (
        ("spacing", "spacing", "gap"), ("width", "spacing", "width"), ("height", "spacing", "height"),
        ("padding leading trailing top bottom horizontal vertical", "spacing", "padding"), ("size weight pointSize", "typography", "typography"),
        ("cornerRadius radius", "radius", "radius"), ("blur", "elevation", "elevation"))),
}
#: Names that are no style in any language.
_NO_STYLE = ["zIndex", "display", "onClick", "Text", "maxLines"]


def _style_query(name, table, spelled):
    names = sorted({n for ns, *_ in spelled for n in ns.split()} | set(_NO_STYLE))
    quoted = ", ".join(f"'{n}'" for n in names)

    def cases(field: int) -> str:
        whens = " ".join(f"WHEN prop IN ({', '.join(repr(n) for n in row[0].split())}) THEN '{row[field]}'" for row in spelled)
        return f"CASE {whens} END"

    query(name, f"""
SELECT id, prop, {cases(1)} AS category, {cases(2)} AS context FROM (
 SELECT concat(CAST(l_orderkey AS VARCHAR), ':', CAST(l_linenumber AS VARCHAR), ':', CAST(l_suppkey AS VARCHAR)) AS id, [{quoted}][CAST(l_partkey % {len(names)} + 1 AS INT)] AS prop FROM {{lineitem}}) p""")(
        lambda t: t["lineitem"].select(
            F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("id"),
            F.element_at(F.array(*[F.lit(p) for p in names]), (F.col("l_partkey") % len(names) + 1).cast("int")).alias("prop"))
        .withColumns({"category": lookup(table, F.col("prop"), 0), "context": lookup(table, F.col("prop"), 1)}))


for _name, (_table, _spelled) in _STYLES.items():
    _style_query(_name, _table, _spelled)

_LOCALS = f"""
SELECT 'repo0' AS repo_id, 's1' AS snapshot_id, 'compose' AS language, concat('f', CAST(l_orderkey % 97 AS VARCHAR), '.kt') AS file, concat('Sym', CAST(l_partkey % 50 AS VARCHAR)) AS symbol,
 concat('com.m', CAST(l_suppkey % 9 AS VARCHAR)) AS package, concat(CAST(l_orderkey AS VARCHAR), ':', CAST(l_linenumber AS VARCHAR), ':', CAST(l_partkey AS VARCHAR), ':', CAST(l_suppkey AS VARCHAR)) AS id FROM {{lineitem}}"""
_LOCAL_DEFS = """
SELECT DISTINCT 'repo0' AS repo_id, 's1' AS snapshot_id, 'compose' AS language, concat('f', CAST(p_partkey % 97 AS VARCHAR), '.kt') AS file, concat('Sym', CAST(p_size AS VARCHAR)) AS symbol,
 concat('com.m', CAST(p_partkey % 13 AS VARCHAR), '.Sym', CAST(p_size AS VARCHAR)) AS qualified_symbol, concat('local:', CAST(p_partkey % 97 AS VARCHAR), ':', CAST(p_size AS VARCHAR), ':', CAST(p_partkey % 13 AS VARCHAR)) AS id,
 CAST(p_partkey % 13 AS BIGINT) AS line, CAST(1 AS BIGINT) AS col FROM {part}"""


def _local_resolve(t):
    text = lambda sql: sql.replace("VARCHAR", "STRING")
    calls = t.spark.sql(text(_LOCALS.replace("{{", "{").replace("}}", "}")), lineitem=t["lineitem"])
    found = t.spark.sql(text(_LOCAL_DEFS), part=t["part"])
    steps = [("file", F.col("symbol")), ("name", F.concat("package", F.lit("."), F.col("symbol")))]
    return rs.local_resolve(calls, found, steps).select("id", "file", "symbol", "package", "local_definition_id")


query("j05_local_resolve", f"""
WITH d AS ({_LOCAL_DEFS}), c AS ({_LOCALS}),
f AS (SELECT file, symbol, arg_max(id, line) AS id FROM d GROUP BY file, symbol),
q AS (SELECT qualified_symbol, arg_max(id, concat(file, ':', lpad(CAST(line AS VARCHAR), 4, '0'))) AS id FROM d GROUP BY qualified_symbol)
SELECT c.id, c.file, c.symbol, c.package, coalesce(f.id, q.id) AS local_definition_id FROM c LEFT JOIN f ON f.file = c.file AND f.symbol = c.symbol
LEFT JOIN q ON q.qualified_symbol = concat(c.package, '.', c.symbol)""")(_local_resolve)

query("j12_ds_relevance", f"""
SELECT {REPO} AS repo_id, {TS} AS file, 6 + rn AS line, concat('Sym', {_s('pk % 50')}) AS symbol, concat('@acme/ds#Sym', {_s('pk % 50')}) AS qualified_symbol
FROM {{v_items}} WHERE ok % 3 = 1 AND pk % 50 = ok % 50 AND pk % 50 < {cf.PACKAGED}""")(
    lambda t: _foreign_registry(t).filter("match_status = 'unresolved'").select("repo_id", "file", "line", "symbol", "qualified_symbol"))


def _foreign_registry(t):
    """The registry names another package, so imported components mismatch."""
    files = cf.react_files(t)
    aliases, keys = cf.registry_of(files)
    foreign = aliases.withColumn("registry_package", F.when(F.col("registry_package").isNotNull(), "@foreign/ds"))
    return scan.scan_react(files, foreign, keys)["usage_sites"]


query("x23_discover_compose", f"""
SELECT {REPO} AS repo_id, concat('Screen', {_s('ok')}) AS symbol, concat('com.acme.m', {_s('ok % 7')}) AS package, {KT} AS path FROM {ORDERS} o WHERE ok % 3 = 0""")(
    lambda t: kotlin.discovered(cf.kotlin_files(t)).select("repo_id", "symbol", "package", "path"))
query("x23_discover_swift", f"""
SELECT repo_id, symbol, concat('Mod', {_s('ok % 7')}) AS package, file AS path FROM ({SW_DEFS}) d""")(
    lambda t: swift.discovered(cf.swift_files(t)).select("repo_id", "symbol", "package", "path"))


def _package_jsons(t):
    """A manifest in every third module folder, and one at the root."""
    files = cf.react_files(t)
    top = files.select("repo_id", "snapshot_id").distinct().select(
        "repo_id", "snapshot_id", F.lit("package.json").alias("path"), F.lit('{"name":"root"}').alias("content"))
    folder = F.regexp_extract("path", r"\A(src/m[036])/", 1)
    inner = files.select("repo_id", "snapshot_id", folder.alias("_f")).filter("_f <> ''").distinct().select(
        "repo_id", "snapshot_id", F.concat("_f", F.lit("/package.json")).alias("path"),
        F.concat(F.lit('{"name":"@acme/'), F.substring("_f", 5, 9), F.lit('"}')).alias("content"))
    return top.unionByName(inner)


_PACKAGE = "CASE WHEN ok % 7 IN (0, 3, 6) THEN concat('@acme/m', CAST(ok % 7 AS VARCHAR)) ELSE 'root' END"
query("x24_npm_package_for_file", f"""
SELECT {REPO} AS repo_id, {TS} AS path, {_PACKAGE} AS package FROM {ORDERS} o WHERE ok % 3 = 1
UNION ALL SELECT repo_id, concat('src/lib/p', {_s('k')}, '.ts'), 'root' FROM {PANELS} p
UNION ALL SELECT repo_id, concat('src/lib/impl/p', {_s('k')}, '.tsx'), 'root' FROM {PANELS} p""")(
    lambda t: rs.npm_package_for_file(cf.react_files(t).select("repo_id", "snapshot_id", "path"), _package_jsons(t)).select("repo_id", "path", "package"))


def _react_packages(t):
    files = cf.react_files(t).select("repo_id", "snapshot_id", "path")
    return rs.npm_package_for_file(files, _package_jsons(t)).withColumnRenamed("path", "file")


query("x23_discover_react", f"""
SELECT {REPO} AS repo_id, concat('Screen', {_s('ok')}) AS symbol, {_PACKAGE} AS package, {TS} AS path FROM {ORDERS} o WHERE ok % 3 = 1
UNION ALL SELECT repo_id, concat('Panel', {_s('k')}), 'root', concat('src/lib/impl/p', {_s('k')}, '.tsx') FROM {PANELS} p""")(
    lambda t: react.discovered(cf.react_files(t), _react_packages(t)).select("repo_id", "symbol", "package", "path"))
query("r01_registry_from_sources", f"""
SELECT {REPO} AS repo_id, concat('ds.screen', {_s('ok')}) AS id, concat('Screen', {_s('ok')}) AS symbol, concat('com.acme.m', {_s('ok % 7')}) AS package FROM {ORDERS} o WHERE ok % 3 = 0""")(
    lambda t: rg.build_registry(rg.package_conflicts(kotlin.discovered(cf.kotlin_files(t)))).select("repo_id", "id", "symbol", "package"))

# --- brackets to any depth, nested comments, templates, interpolation, JSX text -----

query("x11_compose_hard_calls", f"""
SELECT {REPO} AS repo_id, concat('hard/K', {_s('ok')}, '.kt') AS file, 4 + rn AS line, CAST(16 AS BIGINT) AS col, concat('Sym', {_s('pk % 50')}) AS symbol, concat('Deep', {_s('ok')}) AS parent FROM {{v_items}} WHERE ok % 3 = 0
UNION ALL SELECT {REPO}, concat('hard/K', {_s('ok')}, '.kt'), n + 8, 22 + length({_s('ok')}), 'Sym2', concat('Body', {_s('ok')}) FROM {ORDERS} o WHERE ok % 3 = 0
UNION ALL SELECT {REPO}, concat('hard/K', {_s('ok')}, '.kt'), n + 9, 3, 'Sym3', concat('Body', {_s('ok')}) FROM {ORDERS} o WHERE ok % 3 = 0""")(
    lambda t: kotlin.calls(cf.hard_files(t, "compose")).select("repo_id", F.col("path").alias("file"), "line", "col", "symbol", F.col("parent_symbol").alias("parent")))

query("x12_swift_hard_calls", f"""
SELECT {REPO} AS repo_id, concat('App/Sources/Hard/V', {_s('ok')}, '.swift') AS file, 5 + rn AS line, CAST(17 AS BIGINT) AS col, concat('Sym', {_s('pk % 50')}) AS symbol, concat('Deep', {_s('ok')}) AS parent FROM {{v_items}} WHERE ok % 3 = 2
UNION ALL SELECT {REPO}, concat('App/Sources/Hard/V', {_s('ok')}, '.swift'), 5 + rn, 9, 'Text', concat('Deep', {_s('ok')}) FROM {{v_items}} WHERE ok % 3 = 2
UNION ALL SELECT {REPO}, concat('App/Sources/Hard/V', {_s('ok')}, '.swift'), n + 9, 42 + length({_s('ok')}) + 4 * (ok % 25), 'Sym4', concat('Banner', {_s('ok')}) FROM {ORDERS} o WHERE ok % 3 = 2""")(
    lambda t: swift.calls(cf.hard_files(t, "swift")).select("repo_id", F.col("path").alias("file"), "line", "col", "symbol", F.col("parent_symbol").alias("parent")))

query("x10_jsx_hard_usages", f"""
SELECT {REPO} AS repo_id, concat('hard/F', {_s('ok')}, '.tsx') AS file, 3 + rn AS line, CAST(13 AS BIGINT) AS col, concat('Sym', {_s('pk % 50')}) AS symbol, concat('Deep', {_s('ok')}) AS parent FROM {{v_items}} WHERE ok % 3 = 1
UNION ALL SELECT {REPO}, concat('hard/F', {_s('ok')}, '.tsx'), 3 + rn, 27 + length({_s('pk % 50')}) + 3 * (pk % 25), 'Sym1', concat('Deep', {_s('ok')}) FROM {{v_items}} WHERE ok % 3 = 1
UNION ALL SELECT {REPO}, concat('hard/F', {_s('ok')}, '.tsx'), 3 + rn, 60 + length({_s('pk % 50')}) + 4 * (pk % 25) + length({_s('ok')}), 'Sym2', concat('Deep', {_s('ok')}) FROM {{v_items}} WHERE ok % 3 = 1""")(
    lambda t: react.calls(cf.hard_files(t, "react")).select("repo_id", F.col("path").alias("file"), "line", "col", "symbol", F.col("parent_symbol").alias("parent")))

# --- files of all languages to gaps, runs and adoption -------------------------------


def _scanned(t):
    files = cf.all_files(t)
    return scan.scan(files, *cf.registry_of(files))


query("x27_parse_gaps", f"""
SELECT {REPO} AS repo_id, language, file, line, col, 'error' AS severity, 'parse_failed' AS code, concat('source cannot be read (', what, '); file scanned with gaps') AS message FROM (
 SELECT ok, 'compose' AS language, {KT} AS file, n + 17 AS line, 1 AS col, 'unmatched }}}}' AS what FROM {ORDERS} o WHERE ok % 3 = 0
 UNION ALL SELECT ok, 'swift', {SW}, n + 17, 14, 'open literal' FROM {ORDERS} o WHERE ok % 3 = 2
 UNION ALL SELECT ok, 'react', {TS}, n + 12, 20, 'open bracket' FROM {ORDERS} o WHERE ok % 3 = 1) g WHERE ok % 4 = 1 AND ok % 7 = 3""")(
    lambda t: _scanned(t)["diagnostics"].filter("code = 'parse_failed'").select("repo_id", "language", "file", "line", "col", "severity", "code", "message"))

_FILES = f"""
SELECT {REPO} AS repo_id, CASE ok % 3 WHEN 0 THEN 'compose' WHEN 1 THEN 'react' ELSE 'swift' END AS language, ok % 4 = 1 AND ok % 7 = 3 AS broken FROM {ORDERS} o
UNION ALL SELECT repo_id, 'react', false FROM {PANELS} p UNION ALL SELECT repo_id, 'react', false FROM {PANELS} p"""
_ALL_USAGE = " UNION ALL ".join(
    f"SELECT repo_id, '{k}' AS language, match_status, local_definition_id, parent_id FROM ({u}) {k}"
    for k, u in (("compose", KT_USAGE), ("react", TS_USAGE), ("swift", SW_USAGE)))
_ALL_DEFS = f"""
SELECT repo_id, 'compose' AS language FROM ({KT_DEFS}) k UNION ALL SELECT repo_id, 'swift' FROM ({SW_DEFS}) s UNION ALL SELECT repo_id, 'react' FROM ({TS_DEFS}) r"""
query("a02_files_to_adoption", f"""
WITH f AS (SELECT repo_id, language, count(*) AS files_scanned, CASE WHEN bool_or(broken) THEN 'partial' ELSE 'complete' END AS status FROM ({_FILES}) f GROUP BY 1, 2),
u AS (SELECT repo_id, language, {RAW_SQL}, count(DISTINCT CASE WHEN match_status = 'local' THEN local_definition_id END) AS invoked_local_definition_count, {PARENT_SQL} FROM ({_ALL_USAGE}) u GROUP BY 1, 2),
d AS (SELECT repo_id, language, count(*) AS local_definition_count FROM ({_ALL_DEFS}) d GROUP BY 1, 2),
j AS (SELECT *, raw_resolved + raw_local + raw_unresolved AS eligible_invocation_count, raw_resolved AS adopted_invocation_count, raw_local + raw_unresolved AS non_adopted_invocation_count,
 greatest(0, local_definition_count - invoked_local_definition_count) AS unused_local_definition_count FROM f JOIN u USING (repo_id, language) JOIN d USING (repo_id, language))
SELECT 's1' AS snapshot_id, *, {RATIO_SQL} FROM j""")(lambda t: scan.measure(_scanned(t)))
