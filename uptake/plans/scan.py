"""From source files to finished fact tables, and on to adoption per run.

The texts are parsed once per language and the parse is materialised; every
fact table is then an explode of it, followed by the joins that resolve names.
Facts that several joins read are small next to the texts and are materialised
too, so each extraction runs once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import diagnostics as dg, metrics as m, resolve as rs
from ..operators.extract import kotlin, react, swift
from ..schemas import KEYS
from .stages import materialize


def scan_compose(files: DataFrame, aliases: DataFrame, token_keys: DataFrame) -> dict[str, DataFrame]:
    files = materialize(kotlin.with_scopes(files))
    found = materialize(kotlin.definitions(files))
    return {
        "local_components": found,
        "usage_sites": rs.classify_compose(kotlin.calls(files), materialize(kotlin.imports(files)), found, aliases),
        "token_sites": kotlin.token_sites(files, token_keys),
        "hardcoded_style_sites": kotlin.style_sites(files),
        "diagnostics": dg.parse_gaps(files),
    }


def scan_swift(files: DataFrame, aliases: DataFrame, token_keys: DataFrame) -> dict[str, DataFrame]:
    files = materialize(swift.with_scopes(files))
    found = materialize(swift.definitions(files))
    return {
        "local_components": found,
        "usage_sites": rs.classify_swift(swift.calls(files), materialize(swift.imports(files)), found, aliases),
        "token_sites": swift.token_sites(files, token_keys),
        "hardcoded_style_sites": swift.style_sites(files),
        "diagnostics": dg.parse_gaps(files),
    }


def react_modules(files: DataFrame, config: rs.ModuleConfig) -> tuple[DataFrame, DataFrame]:
    """Imports and exports with the module each specifier leads to."""
    if "code" not in files.columns:
        files = materialize(react.modules(files))
    imports, exports = materialize(react.imports(files)), materialize(react.exports(files))
    known = files.filter(F.col("language") == react.LANGUAGE)
    bound = rs.resolve_specifiers(
        imports.withColumn("symbol", F.when(F.col("imported_kind") == "named", F.col("imported_symbol")).otherwise("")), known, config)
    passed = rs.resolve_specifiers(
        exports.withColumnsRenamed({"source_specifier": "specifier", "source_export": "symbol"}), known, config
    ).withColumnsRenamed({"specifier": "source_specifier", "symbol": "source_export"})
    return materialize(bound.drop("symbol")), materialize(passed)


def scan_react(files: DataFrame, aliases: DataFrame, token_keys: DataFrame,
               config: rs.ModuleConfig | None = None) -> dict[str, DataFrame]:
    config = config or rs.ModuleConfig()
    files = materialize(react.with_scopes(files))
    found = materialize(react.definitions(files))
    imports, exports = react_modules(files, config)
    return {
        "local_components": found,
        "usage_sites": rs.classify_react(
            materialize(react.calls(files)), imports, exports, found, react.declared(files), aliases, config, materialize),
        "token_sites": react.token_sites(files, token_keys),
        "hardcoded_style_sites": react.style_sites(files),
        "diagnostics": dg.parse_gaps(files).unionByName(rs.import_diagnostics(imports, exports, aliases, config), allowMissingColumns=True),
    }


#: Extractors by language: ``(files, aliases, token_keys) -> fact tables``.
EXTRACTORS = {"compose": scan_compose, "react": scan_react, "swift": scan_swift}


def scan(files: DataFrame, aliases: DataFrame, token_keys: DataFrame,
         config: rs.ModuleConfig | None = None) -> dict[str, DataFrame]:
    """All languages of a file table, as one set of fact tables with one row per run in ``scan_runs``.

    Every table and column that some language has is there; a column that a
    language lacks is null in its rows.
    """
    out: dict[str, DataFrame] = {}
    for language, extract in EXTRACTORS.items():
        settings = {"config": config} if language == react.LANGUAGE else {}
        for name, rows in extract(files, aliases, token_keys, **settings).items():
            out[name] = out[name].unionByName(rows, allowMissingColumns=True) if name in out else rows
    scanned = files.filter(F.col("language").isin(*EXTRACTORS)).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("files_scanned"))
    out["scan_runs"] = dg.scan_status(scanned, out["diagnostics"])
    return out


def measure(facts: dict[str, DataFrame]) -> DataFrame:
    """A01, A02, A04, A06 and A07 of every run in the tables of :func:`scan`; a run without calls has zeros and no ratios."""
    usage = materialize(facts["usage_sites"])
    runs = facts["scan_runs"]
    for counts in (m.adoption(m.raw_invocations(usage)), m.definition_counts(usage, facts["local_components"]), m.parent_scope_counts(usage)):
        runs = runs.join(counts, KEYS, "left")
    return m.with_ratios(runs.fillna(0))
