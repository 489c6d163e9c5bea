"""Reading and writing files: sources, registries, facts."""

import json

from pyspark.sql import functions as F

from uptake.operators import metrics, quality, resolve
from uptake.sources import facts as sf, files as fs, registry as sr


def test_read_source_files(spark, tmp_path):
    for p, text in {"a/x y.tsx": "one\n\ntwo", "a/b+c.d.ts": "no", "b/é.ts": "é", "b/n.kt": "kt", "b/.ts": "dot"}.items():
        f = tmp_path / p
        f.parent.mkdir(exist_ok=True)
        f.write_text(text)
    got = {r.path: (r.ext, r.content) for r in fs.read_source_files(spark, str(tmp_path), "react", "r", "s").collect()}
    assert got == {"a/x y.tsx": ("tsx", "one\n\ntwo"), "b/é.ts": ("ts", "é")}
    kotlin = fs.read_source_files(spark, str(tmp_path), "compose", "r", "s").collect()
    assert [r.path for r in kotlin] == ["b/n.kt"]
    # Spark does not list hidden names such as ".ts".
    assert fs.read_source_files(spark, str(tmp_path), "basic", "r", "s").count() == 4


DOC = {
    "schema_version": 1,
    "components": [
        {"id": "a", "symbol": "Button", "aliases": ["Btn", "Link"], "package": "@x"},
        {"id": "b", "symbol": "Link"}, {"id": "c", "symbol": "Card", "package": ""}],
    "tokens": [{"id": "t", "key": "k", "category": "color", "aliases": ["k", "j"], "value": "#fff"}, {"id": "u", "key": "v", "category": "shade"}],
}


def test_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(DOC, indent=1))
    docs = sr.read_registries(spark, str(tmp_path)).select(F.lit("r").alias("repo_id"), F.lit("react").alias("language"), "doc")
    parsed = sr.parse_registries(docs)
    rows = sr.components(parsed)
    aliases = {r.call_symbol: (r.registry_symbol, r.registry_package) for r in sr.registry_aliases(rows).collect()}
    assert aliases == {"Button": ("Button", "@x"), "Btn": ("Button", "@x"), "Link": ("Link", None), "Card": ("Card", "")}
    assert [r.symbol for r in sr.invalid_components(rows).collect()] == ["Card"]
    tokens = sr.tokens(parsed)
    assert [r.id for r in sr.invalid_tokens(tokens).collect()] == ["u"]
    dup = quality.token_key_unique(sr.token_keys(tokens), ["repo_id", "language"]).collect()
    assert [(r.match_key, r.row_count) for r in dup] == [("k", 2)]
    assert quality.registry_shape(docs).count() == 0


FACTS = {
    "schema_version": 3, "language": {"id": "react", "parser_name": "p"}, "snapshot_id": "s1", "status": "complete",
    "metrics": {"files_scanned": 2, "parse_extract_ms": 5, "invocation_adoption_ratio": None},
    "usage_sites": [
        {"id": "u1", "symbol": "A", "match_status": "resolved", "registry_symbol": "A", "location": {"file": "f", "line": 1},
         "parent": {"parent_id": "p", "symbol": "P", "scope_kind": "component", "identity_basis": "b"}},
        {"id": "u2", "symbol": "B", "match_status": "unresolved", "location": {"file": "f", "line": 2, "column": None}, "qualified_symbol": None}],
}


def test_facts_round_trip(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "react.json").write_text(json.dumps(FACTS))
    tables = sf.read_scan_facts(spark, str(src), "r")
    usage = tables["usage_sites"]
    assert {r.id: (r.parent_id, r.parent_symbol, r.line) for r in usage.collect()} == {"u1": ("p", "P", 1), "u2": (None, None, 2)}
    assert quality.linkage(usage).count() == 0

    both = usage.unionByName(usage.withColumn("language", F.lit("swift")))
    sf.write_outputs({"usage_sites": both}, str(out))
    stored = spark.read.parquet(str(out / "usage_sites"))
    assert stored.count() == 4
    assert [tuple(r) for r in sf.stale_partitions(stored, usage).collect()] == [("r", "swift")]
    # A later full run without Swift leaves no Swift rows behind.
    sf.write_outputs({"usage_sites": usage}, str(out))
    assert spark.read.parquet(str(out / "usage_sites")).count() == 2
    # A run of one repository replaces that repository only.
    sf.write_repository({"usage_sites": usage.limit(1).withColumn("repo_id", F.lit("q"))}, str(out))
    assert spark.read.parquet(str(out / "usage_sites")).count() == 3
    assert metrics.run_metrics(tables["scan_runs"]).collect()[0].files_scanned == 2

    docs = spark.read.text(str(src), wholetext=True).select(F.lit("r").alias("repo_id"), F.col("value").alias("doc"))
    nulls = sorted((r.section, r.item_index, r.path) for r in quality.null_policy(docs).collect())
    assert nulls == [("usage_sites", 1, "location.column"), ("usage_sites", 1, "qualified_symbol")]


def test_nearest_manifest(spark):
    files = spark.createDataFrame([("r", "s", p) for p in ("a/b/x.ts", "a/y.ts", "z.ts", "a/c/d/w.ts")], "repo_id string, snapshot_id string, path string")
    jsons = spark.createDataFrame(
        [("r", "s", "a/package.json", '{"name":"a"}'), ("r", "s", "a/b/package.json", '{"name":""}'), ("r", "s", "a/c/package.json", '{"name":"c"}')],
        "repo_id string, snapshot_id string, path string, content string")
    got = {r.path: r.package for r in resolve.npm_package_for_file(files, jsons).collect()}
    assert got == {"a/b/x.ts": "a", "a/y.ts": "a", "z.ts": None, "a/c/d/w.ts": "c"}
