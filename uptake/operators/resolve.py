"""Resolution of call sites against definitions, imports and registries.

Call sites, imports and definitions are plain fact tables; every rule is a join
on (run, file, name), (run, module, name) or (repository, name).  Each lookup
side is reduced to one row per key first, so no join multiplies rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import site_id
from ..functions.text import npm_package_root
from ..schemas import KEYS
from .diagnostics import DS_EXPORT_UNRESOLVED, DS_IMPORT_UNRESOLVED, PACKAGE_ENTRYPOINT_UNRESOLVED
from .extract.common import PARENT_FIELDS
from .extract.swift import FRAMEWORK_SYMBOLS

FILE = [*KEYS, "file"]
REGISTRY = ["repo_id", "language"]
# File types a module specifier may leave out, in probing order.
SOURCE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx"]


def same(df: DataFrame) -> DataFrame:
    return df


def last_by(df: DataFrame, key: list[str], order: list, **values) -> DataFrame:
    """One row per key: the last one in ``order``, as in a map that overwrites."""
    row = F.max_by(F.struct(*[F.col(c).alias(n) for n, c in values.items()]), F.struct(*order))
    return df.groupBy(*key).agg(row.alias("_l")).select(*key, *[F.col(f"_l.{n}").alias(n) for n in values])


# --- shared rules --------------------------------------------------------------

def alias_resolve(calls: DataFrame, aliases: DataFrame, symbol: str = "symbol") -> DataFrame:
    """The registry symbol and package behind a called name, null if none."""
    named = aliases.select(
        *REGISTRY, F.col("call_symbol").alias(symbol), F.col("registry_symbol").alias("target"),
        F.col("registry_package").alias("target_package"))
    return calls.join(named, [*REGISTRY, symbol], "left")


def import_match(registry_package: Column, import_package: Column) -> Column:
    """Name-only, candidate, resolved or mismatch."""
    return (
        F.when(registry_package.isNull(), "legacy_name_only")
        .when(import_package.isNull(), "candidate")
        .when(registry_package == import_package, "resolved")
        .otherwise("mismatch"))


def match_status(local_id: Column, target: Column, match: Column) -> Column:
    """Local first, then the registry; a package mismatch stays unresolved."""
    return (
        F.when(local_id.isNotNull(), "local")
        .when(target.isNull() | (match == "mismatch"), "unresolved")
        .when(match == "candidate", "candidate")
        .otherwise("resolved"))


def with_import_package(calls: DataFrame, imports: DataFrame, wide_kind: str) -> DataFrame:
    """Package of a called name: its own import, else the only wide one.

    ``wide_kind`` is ``wildcard`` (Kotlin) or ``module`` (Swift).
    """
    own = last_by(
        imports.filter(F.col("imported_kind") == "named"), [*FILE, "local_name"], ["start"],
        own_package="package", imported_symbol="imported_symbol").withColumnRenamed("local_name", "symbol")
    wide = imports.filter(F.col("imported_kind") == wide_kind).groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("_n"), F.max("package").alias("_p"),
        F.bool_or(F.col("package") == "SwiftUI").alias("imports_swiftui"))
    # the definitions of the file follow by the key of ``own``, so the calls stay where they are
    joined = calls.join(wide, FILE, "left").join(own, [*FILE, "symbol"], "left")
    return joined.withColumn("import_package", F.coalesce("own_package", F.when(F.col("_n") == 1, F.col("_p")))).drop("_n", "_p", "own_package")


def _definition_index(definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions by (file, symbol) and by qualified symbol; the last one wins."""
    order = ["file", "line", "col"]
    by_file = last_by(definitions, [*FILE, "symbol"], order, def_id="id", def_qualified="qualified_symbol")
    by_name = last_by(definitions, [*KEYS, "qualified_symbol"], order, def_id="id")
    return by_file, by_name


def local_resolve(calls: DataFrame, definitions: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """The first step that finds a definition.

    A step is ``("file", symbol)`` or ``("name", qualified symbol)``; a null
    value skips the step.
    """
    by_file, by_name = _definition_index(definitions)
    out = calls
    for i, (kind, value) in enumerate(steps):
        key = f"_k{i}"
        side = (
            by_file.select(*FILE, F.col("symbol").alias(key), F.struct("def_id", "def_qualified").alias(f"_s{i}"))
            if kind == "file" else
            by_name.select(*KEYS, F.col("qualified_symbol").alias(key),
                           F.struct("def_id", F.col("qualified_symbol").alias("def_qualified")).alias(f"_s{i}")))
        out = out.withColumn(key, value).join(side, [*(FILE if kind == "file" else KEYS), key], "left")
    found = F.coalesce(*[F.col(f"_s{i}") for i in range(len(steps))])
    return out.withColumns({"local_definition_id": found["def_id"], "local_qualified": found["def_qualified"]}).drop(
        *[f"_k{i}" for i in range(len(steps))], *[f"_s{i}" for i in range(len(steps))])


def usage_rows(df: DataFrame, prefix: str) -> DataFrame:
    """Usage sites with their ids (X22); ``prefix`` carries its own separator."""
    return df.select(
        *KEYS, site_id(F.concat(F.lit(prefix), F.col("file")), "line", "col", "symbol").alias("id"), "file", "line", "col",
        "symbol", "qualified_symbol", "match_status", "registry_symbol", "local_definition_id", *PARENT_FIELDS)


def _dotted(package: Column, symbol: Column) -> Column:
    return F.when(package.isNotNull(), F.concat(package, F.lit("."), symbol))


# --- Compose and Swift -----------------------------------------------------------

def classify_compose(calls: DataFrame, imports: DataFrame, definitions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Same file, imported package, current package, registry, unresolved."""
    c = with_import_package(calls.withColumnRenamed("path", "file"), imports, "wildcard")
    imported = F.coalesce("imported_symbol", "symbol")
    c = local_resolve(c, definitions, [
        ("file", F.col("symbol")), ("name", _dotted(F.col("import_package"), imported)),
        ("name", _dotted(F.col("package"), F.col("symbol")))])
    c = alias_resolve(c, aliases)
    match = import_match(F.col("target_package"), F.col("import_package"))
    c = c.withColumn("match_status", match_status(F.col("local_definition_id"), F.col("target"), match))
    return usage_rows(c.withColumns({
        "registry_symbol": F.when(F.col("match_status").isin("resolved", "candidate"), F.col("target")),
        "qualified_symbol": F.when(F.col("match_status") == "local", F.col("local_qualified")).otherwise(
            _dotted(F.col("import_package"), imported)),
    }), "usage.compose:")


def classify_swift(calls: DataFrame, imports: DataFrame, definitions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Local, registry, else a component of the file's own SwiftUI code.

    A qualified call only looks in the module it names.
    """
    c = with_import_package(calls.withColumnRenamed("path", "file"), imports, "module")
    c = c.withColumn("import_package", F.coalesce("qualifier", "import_package"))
    bare = F.col("qualifier").isNull()
    symbol = F.col("symbol")
    c = local_resolve(c, definitions, [
        ("file", F.when(bare, symbol)), ("name", _dotted(F.col("import_package"), symbol)),
        ("name", F.when(bare, _dotted(F.col("module"), symbol)))])
    c = alias_resolve(c, aliases)
    match = import_match(F.col("target_package"), F.col("import_package"))
    c = c.withColumn("match_status", match_status(F.col("local_definition_id"), F.col("target"), match))
    foreign = F.coalesce(F.col("import_package") != "SwiftUI", F.lit(False))
    shaped = (
        F.col("parent_id").isNotNull() & F.coalesce("imports_swiftui", F.lit(False))
        & F.coalesce(F.col("qualifier") != "SwiftUI", F.lit(True)) & ~symbol.isin(FRAMEWORK_SYMBOLS) & ~foreign)
    kept = c.filter(F.col("local_definition_id").isNotNull() | F.col("target").isNotNull() | shaped)
    return usage_rows(kept.withColumns({
        "registry_symbol": F.when(F.col("match_status").isin("resolved", "candidate"), F.col("target")),
        "qualified_symbol": F.when(F.col("match_status") == "local", F.col("local_qualified")).otherwise(
            _dotted(F.col("import_package"), symbol)),
    }), "usage.swift:")


# --- React modules ---------------------------------------------------------------

@dataclass
class ModuleConfig:
    """Configured aliases, tsconfig paths and packages of a React scan."""

    aliases: dict[str, list[str]] = field(default_factory=dict)
    ts_base_url: str = ""
    ts_paths: dict[str, list[str]] = field(default_factory=dict)
    packages: dict[str, dict[str, str]] = field(default_factory=dict)


def normalize_path(path: Column) -> Column:
    """Resolve ``.`` and ``..``; null when the path leaves the repository."""
    none = F.lit(None).cast("array<string>")

    def step(acc, seg):
        return (
            F.when(seg.isin("", "."), acc)
            .when(seg == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(none))
            .otherwise(F.concat(acc, F.array(seg))))

    return F.when(F.startswith(path, F.lit("/")), None).otherwise(
        F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def wildcard_part(pattern: str, value: Column) -> Column:
    """What ``*`` stands for in ``value``; empty for a plain match, else null."""
    if "*" not in pattern:
        return F.when(value == pattern, F.lit(""))
    head, tail = pattern.split("*", 1)
    return F.when(
        F.startswith(value, F.lit(head)) & F.endswith(value, F.lit(tail))
        & (F.char_length(value) >= len(head) + len(tail)),
        F.substr(value, F.lit(len(head) + 1), F.char_length(value) - len(head) - len(tail)))


def filled(target: str, part: Column) -> Column:
    if "*" not in target:
        return F.when(part.isNotNull(), F.lit(target))
    head, tail = target.split("*", 1)
    return F.concat(F.lit(head), part, F.lit(tail))


def configured_package(specifier: Column, config: ModuleConfig) -> Column:
    """The longest configured package the specifier lies in, null if none."""
    hits = [
        F.when((specifier == p) | F.startswith(specifier, F.lit(p + "/")), F.lit(p))
        for p in sorted(config.packages, key=lambda p: (-len(p), p))]
    return F.coalesce(*hits, F.lit(None).cast("string"))


def _targets(specifier: Column, symbol: Column, folder: Column, config: ModuleConfig) -> Column:
    """Possible paths of a specifier in a file of ``folder`` (empty or up to its last ``/``), best first."""
    relative = F.startswith(specifier, F.lit("."))
    out = [F.when(relative, F.concat(folder, specifier))]

    def by_specificity(patterns: dict[str, list[str]]) -> list[str]:
        return sorted(patterns, key=lambda p: (-(p.index("*") if "*" in p else len(p)), p))

    for base, patterns in (("", config.aliases), (config.ts_base_url, config.ts_paths)):
        for p in by_specificity(patterns):
            for t in patterns[p]:
                target = filled(t, wildcard_part(p, specifier))
                out.append(F.when(~relative, F.concat(F.lit(f"{base.rstrip('/')}/" if base else ""), target)))
    package = configured_package(specifier, config)
    for name, entries in config.packages.items():
        rest = F.substr(specifier, F.lit(len(name) + 2))
        inside = ~relative & (package == name)
        keys = [F.when(inside & (rest == ""), symbol), F.when(inside & (rest == ""), F.lit(".")),
                F.when(inside & (rest != ""), F.concat(F.lit("./"), rest))]
        out += [F.when(key == entry, F.lit(entries[entry])) for key in keys for entry in sorted(entries)]
        out += [filled(entries[entry], wildcard_part(entry, key)) for entry in sorted(entries) for key in keys]
    return F.array_compact(F.array(*out))


def resolve_specifiers(refs: DataFrame, files: DataFrame, config: ModuleConfig) -> DataFrame:
    """The source module of each import or re-export, null if there is none.

    ``refs`` has ``file``, ``specifier`` and ``symbol``.  A target depends on the folder
    of the file only: distinct references of a folder are expanded to candidate paths,
    which meet the file table once.
    """
    key = [*KEYS, "_folder", "specifier", "symbol"]
    refs = refs.withColumn("_folder", F.regexp_replace("file", r"[^/]*\z", ""))
    wanted = refs.select(*key).filter(F.col("specifier").isNotNull()).distinct()
    base = wanted.select(*key, F.posexplode(_targets(
        F.col("specifier"), F.col("symbol"), F.col("_folder"), config)).alias("_t", "_raw"))
    path = normalize_path(F.col("_raw"))
    typed = F.exists(F.array(*[F.lit(e) for e in SOURCE_EXTENSIONS]), lambda e: F.endswith(path, e))
    probes = F.when(typed, F.array(path)).otherwise(F.array(
        path, *[F.concat(path, F.lit(e)) for e in SOURCE_EXTENSIONS],
        *[F.concat(path, F.lit(f"/index{e}")) for e in SOURCE_EXTENSIONS]))
    candidates = base.select(*key, "_t", F.posexplode(probes).alias("_i", "_path")).filter(F.col("_path").isNotNull())
    known = files.select(*KEYS, F.col("path").alias("_path")).distinct()
    best = candidates.join(known, [*KEYS, "_path"]).groupBy(*key).agg(
        F.min_by("_path", F.struct("_t", "_i")).alias("source_module"))
    return refs.join(best, key, "left").drop("_folder")


def module_edges(imports: DataFrame, exports: DataFrame, config: ModuleConfig) -> DataFrame:
    """One row per (module, exported name) with the place it leads to.

    A local export of an imported name and a re-export lead on to another
    module; any other local export ends here.  A broken edge has no next place.
    """
    last = last_by(exports, [*KEYS, "file", "export_name"], ["ordinal"], kind="kind", source_export="source_export",
                   source_specifier="source_specifier", source_module="source_module")
    bound = import_bindings(imports).select(
        *KEYS, "file", F.col("local_name").alias("source_export"), F.struct("specifier", "imported_symbol", "source_module").alias("_i"))
    joined = last.join(bound, [*FILE, "source_export"], "left")
    passed = (F.col("kind") == "local") & F.col("_i").isNotNull()
    reexport = F.col("kind") == "reexport"
    next_module = F.when(reexport, F.col("source_module")).when(passed, F.col("_i.source_module")).otherwise(F.col("file"))
    via = F.when(reexport, F.col("source_specifier")).when(passed, F.col("_i.specifier"))
    return joined.select(
        *KEYS, F.col("file").alias("module"), "export_name",
        next_module.alias("next_module"),
        F.when(next_module.isNotNull(), F.when(passed, F.col("_i.imported_symbol")).otherwise(F.col("source_export"))).alias("next_symbol"),
        (~reexport & ~passed).alias("ends"), reexport.alias("reexport"),
        (next_module.isNotNull() & configured_package(via, config).isNotNull()).alias("configured"))


def import_bindings(imports: DataFrame) -> DataFrame:
    return last_by(imports, [*FILE, "local_name"], ["ordinal"], imported_kind="imported_kind",
                   imported_symbol="imported_symbol", specifier="specifier", source_module="source_module")


def export_chain(df: DataFrame, edges: DataFrame, module: str, symbol: str, prefix: str) -> DataFrame:
    """Follow at most two edges; keep the last place that is known."""
    def hop(i: int, m: str, s: str) -> DataFrame:
        return edges.select(
            *KEYS, F.col("module").alias(m), F.col("export_name").alias(s),
            *[F.col(c).alias(f"_{prefix}{i}_{c}") for c in ("next_module", "next_symbol", "ends", "reexport", "configured")])

    e0 = df.join(hop(0, module, symbol), [*KEYS, module, symbol], "left")
    on = {c: F.when(~F.col(f"_{prefix}0_ends"), F.col(f"_{prefix}0_next_{c}")) for c in ("module", "symbol")}
    e1 = e0.withColumns({f"_{prefix}m": on["module"], f"_{prefix}s": on["symbol"]}).join(
        hop(1, f"_{prefix}m", f"_{prefix}s"), [*KEYS, f"_{prefix}m", f"_{prefix}s"], "left")
    ahead = F.col(f"_{prefix}1_next_module").isNotNull()
    twice = F.coalesce(F.col(f"_{prefix}0_reexport") & F.col(f"_{prefix}1_reexport") & F.col(f"_{prefix}1_configured"), F.lit(False))
    return e1.withColumns({
        f"{prefix}_module": F.when(ahead, F.col(f"_{prefix}1_next_module")).otherwise(F.col(f"_{prefix}0_next_module")),
        f"{prefix}_symbol": F.when(ahead, F.col(f"_{prefix}1_next_symbol")).otherwise(F.col(f"_{prefix}0_next_symbol")),
        f"{prefix}_configured": F.coalesce(F.col(f"_{prefix}0_configured"), F.lit(False)) | twice,
    }).drop(f"_{prefix}m", f"_{prefix}s", *[f"_{prefix}{i}_{c}" for i in (0, 1) for c in ("next_module", "next_symbol", "ends", "reexport", "configured")])


def reached(imports: DataFrame, exports: DataFrame, keep=same) -> tuple[DataFrame, DataFrame]:
    """The imports and exports of modules that an import or a re-export leads to: no other edge is followed."""
    modules = imports.select(*KEYS, "source_module").unionByName(exports.select(*KEYS, "source_module"))
    wanted = keep(modules.filter(F.col("source_module").isNotNull()).distinct().withColumnRenamed("source_module", "file"))
    return imports.join(wanted, FILE, "left_semi"), exports.join(wanted, FILE, "left_semi")


def import_places(imports: DataFrame, edges: DataFrame) -> DataFrame:
    """Where each distinct (source module, imported symbol) leads to."""
    refs = imports.filter(F.col("source_module").isNotNull()).select(*KEYS, "source_module", "imported_symbol").distinct()
    return export_chain(refs, edges, "source_module", "imported_symbol", "chain").withColumns({
        "final_module": F.coalesce("chain_module", "source_module"),
        "final_symbol": F.coalesce("chain_symbol", "imported_symbol")}).drop("chain_module", "chain_symbol")


def bound_imports(imports: DataFrame, places: DataFrame, config: ModuleConfig) -> DataFrame:
    """Each import binding with its place, what else ``places`` say of it, and its provenance."""
    known = F.col("source_module").isNotNull()
    joined = import_bindings(imports).join(places, [*KEYS, "source_module", "imported_symbol"], "left")
    return joined.withColumns({
        # without an exported name of that module the import ends where it leads to
        "final_module": F.coalesce("final_module", "source_module"),
        "final_symbol": F.when(known, F.coalesce("final_symbol", "imported_symbol")),
        "through_package": known & (configured_package(F.col("specifier"), config).isNotNull() | F.coalesce("chain_configured", F.lit(False))),
        "import_package": npm_package_root(F.col("specifier"))}).drop("chain_configured")


def resolved_imports(imports: DataFrame, edges: DataFrame, config: ModuleConfig) -> DataFrame:
    """Each import binding with its final place and its provenance."""
    return bound_imports(imports, import_places(imports, edges), config).select(
        *FILE, "local_name", "imported_kind", "imported_symbol", "specifier", "source_module",
        "final_module", "final_symbol", "through_package", "import_package")


def registry_names(aliases: DataFrame) -> DataFrame:
    """One row per called name with its registry symbol and package."""
    return aliases.groupBy(*REGISTRY, "call_symbol").agg(
        F.min(F.struct(F.col("registry_symbol").alias("_t"), F.col("registry_package").alias("_p"))).alias("_b"))


def named_target(df: DataFrame, named: DataFrame, name: Column, into: str) -> DataFrame:
    """Adds what the registry has for a name; a null name has nothing."""
    side = named.select(*REGISTRY, F.col("call_symbol").alias("_n"), F.col("_b").alias(into))
    return df.withColumn("_n", name).join(side, [*REGISTRY, "_n"], "left").drop("_n")


def design_system_import(specifier: Column, kind: Column, imported: Column, local: Column, config: ModuleConfig) -> tuple[Column, Column]:
    """(is relevant for sure, name whose registration makes it relevant)."""
    configured = configured_package(specifier, config).isNotNull()
    aliased = F.lit(False)
    for p in config.aliases:
        aliased = aliased | wildcard_part(p, specifier).isNotNull()
    bare = ~F.startswith(specifier, F.lit(".")) & ~configured & ~aliased
    name = F.when(bare, None).when(kind == "named", imported).when(kind == "default", local)
    return configured, name


def member_calls(calls: DataFrame, imports: DataFrame, by_file: DataFrame, edges: DataFrame, named: DataFrame, keep=same) -> DataFrame:
    """What calls of a member (``Menu.Item``) alone can lead to, by (file, binding, symbol): a definition of
    that very name, and behind a namespace import the registry symbols of the export and of the member."""
    dotted = keep(calls.filter(F.col("symbol") != F.col("binding_name")).select(*FILE, "binding_name", "symbol").distinct())
    spaces = import_bindings(imports.join(
        dotted.select(*FILE, F.col("binding_name").alias("local_name")).distinct(), [*FILE, "local_name"], "left_semi")).filter(
        F.col("imported_kind") == "namespace").select(*FILE, F.col("local_name").alias("binding_name"), F.col("source_module").alias("_space"))
    prefix = F.concat("binding_name", F.lit("."))
    c = dotted.join(spaces.withColumn("_namespace", F.lit(True)), [*FILE, "binding_name"], "left").withColumn("_member", F.when(
        F.col("_namespace") & F.startswith("symbol", prefix), F.substr("symbol", F.char_length("binding_name") + 2)))
    c = export_chain(c, edges, "_space", "_member", "member")
    for name, into in (("member_symbol", "_through"), ("_member", "_direct")):
        c = named_target(c, named, F.col(name), into)
    own = by_file.select(*FILE, "symbol", F.struct("def_id", "def_qualified").alias("_own_member"))
    return keep(c.join(own, [*FILE, "symbol"], "left").select(
        *FILE, "binding_name", "symbol", "_own_member", F.coalesce("_through", "_direct").alias("_member_target")))


def classify_react(calls: DataFrame, imports: DataFrame, exports: DataFrame, definitions: DataFrame,
                   declared: DataFrame, aliases: DataFrame, config: ModuleConfig, keep=same) -> DataFrame:
    """J09 with J12: local, local through an import, registry, relevant unresolved.

    Everything else (foreign packages, unknown names) is dropped.  What depends on distinct
    names or places only is resolved before it meets the calls, and ``keep`` may write it
    down, so that Spark knows how small it is.  The calls move twice: to the definitions of
    their module, and to the imports, definitions and declared names of their file.
    """
    named = keep(registry_names(aliases))
    edges = keep(module_edges(*reached(imports, exports, keep), config))
    by_file, by_name = _definition_index(definitions)

    places = import_places(imports, edges)
    stem = F.regexp_replace("final_module", r"(?<=[^/])\.[^./]*\z", "")
    places = keep(places.withColumn("_hop", F.concat(stem, F.lit("#"), F.col("final_symbol"))))
    hops = definitions.join(
        places.select(*KEYS, F.col("_hop").alias("qualified_symbol")).distinct(), [*KEYS, "qualified_symbol"], "left_semi")
    places = local_resolve(places, hops, [("name", F.col("_hop"))]).withColumnsRenamed(
        {"local_definition_id": "_far", "local_qualified": "_far_q"}).drop("_hop")
    places = keep(named_target(places, named, F.when(F.col("final_symbol") != "*", F.col("final_symbol")), "_final_target"))

    sure, wanted = design_system_import(
        F.col("specifier"), F.col("imported_kind"), F.col("imported_symbol"), F.col("local_name"), config)
    bindings = bound_imports(imports, places, config).withColumns({"_has": F.lit(True), "_sure": sure, "_named": wanted})
    bindings = alias_resolve(bindings, aliases, "_named").withColumnRenamed("target", "_relevant").withColumnRenamed(
        "local_name", "binding_name").drop("target_package", "_named")

    c = calls.withColumnRenamed("path", "file")
    members = member_calls(c, imports, by_file, edges, named, keep)
    c = c.withColumn("_q", F.concat("module", F.lit("#"), F.col("symbol"))).join(by_name.select(
        *KEYS, F.col("qualified_symbol").alias("_q"), F.struct("def_id", F.col("qualified_symbol").alias("def_qualified")).alias("_own_name")),
        [*KEYS, "_q"], "left").drop("_q")
    local = by_file.select(*FILE, F.col("symbol").alias("binding_name"), F.struct("def_id", "def_qualified").alias("_own_file"))
    names = declared.select(*FILE, F.col("name").alias("binding_name")).distinct().withColumn("_declared", F.lit(True))
    for side in (bindings, local, names):
        c = c.join(side, [*FILE, "binding_name"], "left")
    c = c.join(members, [*FILE, "binding_name", "symbol"], "left")
    for name in ("symbol", "binding_name"):
        c = named_target(c, named, F.col(name), f"_{name}_target")

    own = F.coalesce("_own_file", "_own_member", "_own_name")
    imported_ok = ~F.coalesce(F.col("through_package"), F.lit(False))
    # a call without a file has no site to be registered at
    target = F.when(F.col("file").isNotNull() & F.col("snapshot_id").isNotNull(), F.coalesce(
        "_member_target", "_final_target", "_symbol_target", "_binding_name_target"))
    c = c.withColumns({
        "local_definition_id": F.coalesce(own["def_id"], F.when(imported_ok, F.col("_far"))),
        "local_qualified": F.when(own["def_id"].isNotNull(), own["def_qualified"]).when(imported_ok, F.col("_far_q")),
        "target": target["_t"], "target_package": target["_p"],
    })

    has_import = F.col("_has").isNotNull()
    match = import_match(F.col("target_package"), F.col("import_package"))
    mismatch = F.col("target").isNotNull() & (match == "mismatch")
    relevant = F.col("_declared").isNull() & F.when(
        has_import,
        mismatch | F.when(F.col("source_module").isNotNull(), F.col("through_package")).otherwise(F.col("_sure") | F.col("_relevant").isNotNull()),
    ).otherwise(F.col("target").isNotNull())
    c = c.withColumn("match_status", match_status(F.col("local_definition_id"), F.col("target"), match))
    kept = c.filter((F.col("match_status") != "unresolved") | relevant)
    imported_name = F.when(F.col("imported_kind") == "named", F.col("imported_symbol")).when(
        F.col("imported_kind") == "default", F.col("binding_name"))
    return usage_rows(kept.withColumns({
        "registry_symbol": F.when(F.col("match_status").isin("resolved", "candidate"), F.col("target")),
        "qualified_symbol": F.when(F.col("match_status") == "local", F.col("local_qualified")).when(
            F.col("match_status") == "unresolved", F.concat("import_package", F.lit("#"), imported_name)),
    }), "usage.")


def import_diagnostics(imports: DataFrame, exports: DataFrame, aliases: DataFrame, config: ModuleConfig) -> DataFrame:
    """Relevant imports and re-exports that lead to no file."""
    sure, named = design_system_import(
        F.col("specifier"), F.col("imported_kind"), F.col("imported_symbol"), F.col("local_name"), config)
    lost = imports.filter(F.col("source_module").isNull()).withColumns({"_sure": sure, "_named": named})
    bad_imports = alias_resolve(lost, aliases, "_named").filter(F.col("_sure") | F.col("target").isNotNull()).select(
        *FILE, F.lit(DS_IMPORT_UNRESOLVED).alias("code"), F.col("local_name").alias("name"), "specifier")

    broken = exports.filter((F.col("kind") == "reexport") & F.col("source_module").isNull())
    esure, by_export = design_system_import(
        F.col("source_specifier"), F.lit("named"), F.col("export_name"), F.col("export_name"), config)
    _, by_source = design_system_import(
        F.col("source_specifier"), F.lit("named"), F.col("source_export"), F.col("export_name"), config)
    flagged = broken.withColumns({"_sure": esure, "_a": by_export, "_b": by_source})
    flagged = alias_resolve(flagged, aliases, "_a").withColumnRenamed("target", "_ta").drop("target_package")
    bad_exports = alias_resolve(flagged, aliases, "_b").filter(
        F.col("_sure") | F.col("_ta").isNotNull() | F.col("target").isNotNull()).select(
        *FILE, F.lit(DS_EXPORT_UNRESOLVED).alias("code"), F.col("export_name").alias("name"),
        F.col("source_specifier").alias("specifier"))
    return bad_imports.unionByName(bad_exports).withColumn("severity", F.lit("warning"))


def entrypoint_diagnostics(runs: DataFrame, files: DataFrame, config: ModuleConfig) -> DataFrame:
    """Configured plain entry points of a package that name no file."""
    entries = [(p, e, t) for p, es in sorted(config.packages.items()) for e, t in sorted(es.items()) if "*" not in e + t]
    wanted = F.array(*[F.struct(F.lit(p).alias("package"), F.lit(e).alias("symbol"), F.lit("./" + t).alias("specifier")) for p, e, t in entries])
    refs = runs.select(*KEYS, F.lit("").alias("file"), F.inline(wanted))
    return resolve_specifiers(refs, files, ModuleConfig()).filter(F.col("source_module").isNull()).select(
        *KEYS, F.lit("warning").alias("severity"), F.lit(PACKAGE_ENTRYPOINT_UNRESOLVED).alias("code"),
        "package", F.col("symbol").alias("entrypoint"))


def npm_package_for_file(files: DataFrame, package_jsons: DataFrame, by=("repo_id", "snapshot_id")) -> DataFrame:
    """The name in the nearest ``package.json`` above each file.

    Folders are resolved once each, not once per file.
    """
    folder = F.regexp_replace("path", r"/?[^/]*\z", "")
    placed = files.withColumn("_folder", folder)
    named = package_jsons.select(
        *by, folder.alias("_at"), F.get_json_object("content", "$.name").alias("package")).filter("package <> ''")
    parts = F.filter(F.split("_folder", "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    nearest = (
        placed.select(*by, "_folder").distinct().select(*by, "_folder", F.explode(above).alias("_at"))
        .join(named, [*by, "_at"]).groupBy(*by, "_folder").agg(F.max_by("package", F.length("_at")).alias("package")))
    return placed.join(nearest, [*by, "_folder"], "left").drop("_folder")
