"""Identifiers: symbol ids, identity basis, site ids, package identity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import file_name


def symbol_id(language, match_status, registry_symbol, local_definition_id, qualified_symbol, symbol) -> Column:
    """The snapshot-stable id of a used symbol."""
    c = [F.col(x) if isinstance(x, str) else x for x in
         (language, match_status, registry_symbol, local_definition_id, qualified_symbol, symbol)]
    lang, status, registry, local, qualified, sym = c
    pack_prefix = F.concat(F.lit("local."), lang, F.lit(":"))
    lang_prefix = F.concat(lang, F.lit(":"))
    rest = F.substr(local, F.length(lang_prefix) + 1)
    identity = (
        F.when(F.startswith(local, pack_prefix), F.substr(local, F.length(pack_prefix) + 1))
        .when(F.startswith(local, lang_prefix), F.regexp_replace(rest, r"(?s)\A[^:]*:", ""))
        .otherwise(F.coalesce(qualified, local))
    )
    kind = F.when(status == "candidate", F.lit(":candidate:")).otherwise(F.lit(":registry:"))
    return (
        F.when(registry.isNotNull(), F.concat(lang, kind, registry))
        .when(local.isNotNull(), F.concat(lang, F.lit(":local:"), identity))
        .otherwise(F.concat(lang, F.lit(":symbol:"), F.coalesce(qualified, sym)))
    )


def identity_basis(registry_symbol: Column, local_definition_id: Column, qualified_symbol: Column) -> Column:
    """Which column identifies the symbol."""
    return (
        F.when(registry_symbol.isNotNull(), "registry_id")
        .when(local_definition_id.isNotNull(), "local_definition_id")
        .when(qualified_symbol.isNotNull(), "qualified_symbol")
        .otherwise("source_symbol")
    )


def identity_stability(registry_symbol: Column, local_definition_id: Column, qualified_symbol: Column) -> Column:
    known = F.coalesce(registry_symbol, local_definition_id, qualified_symbol)
    return F.when(known.isNotNull(), "semantic").otherwise("scan_local")


def symbol_kind(match_status: Column) -> Column:
    return F.when(match_status == "resolved", F.lit("registry")).otherwise(match_status)


def site_id(prefix: str | Column, *parts) -> Column:
    """``prefix:file:line:col:tail`` ids of fact rows."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat_ws(":", head, *[F.col(p) if isinstance(p, str) else p for p in parts])


def category_label(category: Column) -> Column:
    """Categories appear capitalised inside hard-coded site ids."""
    return F.initcap(category)


def kotlin_package(content: Column) -> Column:
    """Package header of a Kotlin file, null without one."""
    found = F.regexp_extract(content, r"(?m)^[ \t]*package[ \t]+([A-Za-z_][\w.]*)", 1)
    return F.when(found != "", found)


def swift_module(path: Column) -> Column:
    """``Sources/<Module>/file`` names the module, else the file stem."""
    module = F.regexp_extract(path, r"(?:\A|/)Sources/([^/]+)/[^/]+\z", 1)
    stem = F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*\z", "")
    return F.when(module != "", module).otherwise(stem)


def react_module(path: Column) -> Column:
    """Path without extension."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*\z", "")
