"""Fact-table schemas, key columns and the closed value domains.

Every fact table starts with :data:`KEYS`.  The parent scope of a site is kept
as flat ``parent_*`` columns so that Spark can prune and push down each one.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F, types as T

KEYS = ["repo_id", "snapshot_id", "language"]
RUN = ["repo_id", "snapshot_id"]

# Closed enums, in their declared (sort) order.
SCAN_STATUSES = ["complete", "partial", "failed"]
MATCH_STATUSES = ["resolved", "candidate", "local", "unresolved"]
SYMBOL_KINDS = ["registry", "local", "candidate", "unresolved"]
IDENTITY_STABILITIES = ["semantic", "path_sensitive", "scan_local"]
SEVERITIES = ["info", "warning", "error"]
CATEGORIES = ["color", "spacing", "typography", "radius", "elevation", "unknown"]
CONTEXTS = [
    "padding", "margin", "gap", "width", "height", "size",
    "radius", "color", "typography", "elevation", "unknown",
]
CLASSIFICATIONS = ["exact", "near", "unmatched", "unassessed"]
CONFIDENCES = ["low", "medium", "high", "very_high"]
EVIDENCE = [
    "exact_value", "within_numeric_tolerance", "clear_usage_context",
    "generic_dimension_context", "multiple_equal_matches",
    "missing_canonical_values", "incomplete_canonical_coverage",
    "unsupported_canonical_format", "incompatible_units",
    "outside_numeric_tolerance",
]
CLEAR_CONTEXTS = ["padding", "margin", "gap", "radius", "color", "typography", "elevation"]
U32_MAX = 4294967295
SCHEMA_VERSION = 3
REGISTRY_SCHEMA_VERSION = 1
DEFAULT_NUMERIC_TOLERANCE = 2.0


def rank_of(col: Column, domain: list[str]) -> Column:
    """Ordinal of an enum value inside ``domain``; null outside of it."""
    pairs = chain.from_iterable((F.lit(v), F.lit(i)) for i, v in enumerate(domain))
    return F.try_element_at(F.create_map(*pairs), col)


PARENT_COLUMNS = [
    "parent_id", "parent_symbol", "parent_qualified_symbol", "parent_scope_kind",
    "parent_identity_basis", "parent_identity_stability",
]

_LOCATION = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("line", T.LongType()),
    T.StructField("column", T.LongType()),
])
_PARENT = T.StructType([
    T.StructField("parent_id", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("qualified_symbol", T.StringType()),
    T.StructField("scope_kind", T.StringType()),
    T.StructField("identity_basis", T.StringType()),
    T.StructField("identity_stability", T.StringType()),
    T.StructField("location", _LOCATION),
])


def _struct(spec: str, *extra: T.StructField) -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in spec.split()]
    return T.StructType(fields + list(extra))


_TOKEN = _struct("id key category value", T.StructField("aliases", T.ArrayType(T.StringType())))

#: The JSON document one scan of one language leaves behind.
SCAN_FACTS = T.StructType([
    T.StructField("schema_version", T.LongType()),
    T.StructField("language", _struct("id version ecosystem parser_name parser_version")),
    T.StructField("snapshot_id", T.StringType()),
    T.StructField("scanned_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("metrics", T.StructType([
        T.StructField("invocation_adoption_ratio", T.DoubleType()),
        T.StructField("registry_resolution_ratio", T.DoubleType()),
        T.StructField("files_scanned", T.LongType()),
        T.StructField("parse_extract_ms", T.LongType()),
    ])),
    T.StructField("design_system_components", T.ArrayType(_struct("id symbol registry_symbol package"))),
    T.StructField("local_components", T.ArrayType(_struct(
        "id symbol qualified_symbol identity_basis identity_stability",
        T.StructField("location", _LOCATION)))),
    T.StructField("usage_sites", T.ArrayType(_struct(
        "id symbol qualified_symbol match_status registry_symbol local_definition_id",
        T.StructField("location", _LOCATION), T.StructField("parent", _PARENT)))),
    T.StructField("design_system_tokens", T.ArrayType(_TOKEN)),
    T.StructField("token_sites", T.ArrayType(_struct(
        "id token_id key category",
        T.StructField("location", _LOCATION), T.StructField("parent", _PARENT)))),
    T.StructField("hardcoded_style_sites", T.ArrayType(_struct(
        "id value category context",
        T.StructField("location", _LOCATION), T.StructField("parent", _PARENT)))),
    T.StructField("diagnostics", T.ArrayType(_struct(
        "severity code message", T.StructField("location", _LOCATION)))),
])

#: A registry document: components with aliases, and design tokens.
REGISTRY = T.StructType([
    T.StructField("schema_version", T.LongType()),
    T.StructField("components", T.ArrayType(_struct(
        "id symbol package", T.StructField("aliases", T.ArrayType(T.StringType()))))),
    T.StructField("tokens", T.ArrayType(_TOKEN)),
])
