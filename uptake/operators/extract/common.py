"""Steps shared by the language extractors."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from ...functions.identity import category_label, site_id
from ...functions.lexer import with_lexemes
from ...functions.lexing import count_up_to, once, place
from ...functions.text import find_all, let
from ...schemas import KEYS

FILE = [*KEYS, "path"]
#: More than any column or place in a list: (line, column) as one number keeps their order.
COLUMNS = 1 << 31
#: Files whose scopes are Python objects at a time.
FILES = 256
PARENT_FIELDS = ["parent_id", "parent_symbol", "parent_qualified_symbol", "parent_scope_kind",
                 "parent_identity_basis", "parent_identity_stability"]


def parsed(files: DataFrame, language: str) -> DataFrame:
    """Masked text, line offsets and brackets of every file of a language.

    A table that is prepared already is passed through, so that one
    materialised parse can feed all extractors of a language.
    """
    if "masked" in files.columns:
        return files
    return with_lexemes(files.filter(F.col("language") == language).select(*FILE, "content"))


def _last_open(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Ascending (offset, number of the last scope that is open from there on, or -1)."""
    events = sorted([(e, 0, k) for k, e in enumerate(ends)] + [(s, 1, k) for k, s in enumerate(starts)])
    out: list[tuple[int, int]] = []
    active: list[int] = []
    done = [False] * len(starts)
    for at, opens, k in events:
        if opens:
            heapq.heappush(active, -k)
        else:
            done[k] = True
        while active and done[-active[0]]:
            heapq.heappop(active)
        top = -active[0] if active else -1
        if out and out[-1][0] == at:
            out[-1] = (at, top)
        else:
            out.append((at, top))
    return out


def _bounds_of(starts: pa.Array, ends: pa.Array) -> pa.Array:
    rows = [_last_open(s, e) if s else [] for s, e in zip(starts.to_pylist(), ends.to_pylist(), strict=True)]
    flat = [x for r in rows for x in r]
    values = pa.StructArray.from_arrays(
        [pa.array([a for a, _ in flat], pa.int64()), pa.array([k for _, k in flat], pa.int32())], ["at", "scope"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), values)


@F.arrow_udf(ArrayType(StructType().add("at", "long").add("scope", "integer")))
def _bounds(starts: pa.Array, ends: pa.Array) -> pa.Array:
    # some files at a time, since Python objects take many times the arrays
    parts = [_bounds_of(starts.slice(k, FILES), ends.slice(k, FILES)) for k in range(0, max(len(starts), 1), FILES)]
    return pa.concat_arrays(parts)


def tree(scopes: Column, start: str = "start", end: str = "end") -> Column:
    """The scopes in source order with the offsets where the innermost one changes."""
    return F.struct(scopes.alias("scopes"), _bounds(F.transform(scopes, lambda s: s[start]), F.transform(scopes, lambda s: s[end])).alias("bounds"))


def inner(scopes: Column, pos: Column) -> Column:
    """The innermost scope of a :func:`tree` around ``pos``, by binary search."""
    def found(n):
        k = F.when(n > 0, F.try_element_at(scopes["bounds"], n)["scope"])
        return F.when(k >= 0, F.try_element_at(scopes["scopes"], k + 1))

    return let(count_up_to(scopes["bounds"], pos, lambda b: b["at"]), found)


def around(starts: Column, ends: Column, pos: Column, of=lambda v: v) -> Column:
    """How many spans that begin before ``pos`` end behind it; both arrays ascend (``of`` a start)."""
    return count_up_to(starts, pos - 1, of) - count_up_to(ends, pos)


def hits(df: DataFrame, pattern: str, *keep: str, text: str = "masked") -> DataFrame:
    """One row per match with ``start`` and ``text``."""
    return df.filter(F.col(text).rlike(pattern)).select(*FILE, *keep, F.inline(find_all(F.col(text), pattern)))


def sites(df: DataFrame, found: Column, *keep: str, **of) -> DataFrame:
    """One row per match with its place and what ``of`` it is computed, all inside the file's row.

    Only the small structs leave the row, so no match carries the arrays of its file.
    """
    def read(h):
        fields = [h[c].alias(c) for c in ("start", "text")]
        return F.struct(*fields, place(F.col("ends"), h["start"]).alias("_p"), *[f(h).alias(n) for n, f in of.items()])

    rows = df.select(*FILE, *keep, F.inline(F.transform(found, read)))
    return rows.withColumns({"line": F.col("_p.line"), "col": F.col("_p.col")}).drop("_p")


def parent_columns(parent: Column, parent_id: Column, qualified: Column, kind: str, basis: Column, stability: Column) -> dict:
    known = parent.isNotNull()
    return {
        "parent_id": F.when(known, parent_id),
        "parent_symbol": parent["name"],
        "parent_qualified_symbol": F.when(known, qualified),
        "parent_scope_kind": F.when(known, F.lit(kind)),
        "parent_identity_basis": F.when(known, basis),
        "parent_identity_stability": F.when(known, stability),
    }


def style_rows(df: DataFrame, language: str) -> DataFrame:
    """Hard-coded style sites with their ids."""
    return df.select(
        *KEYS,
        site_id(f"hardcoded.{language}", "path", "line", "col", category_label(F.col("category"))).alias("id"),
        F.col("path").alias("file"), "line", "col", "value", "category", "context", *PARENT_FIELDS)


def token_rows(df: DataFrame, token_keys: DataFrame, language: str) -> DataFrame:
    """Chain candidates that are token keys (X06), by equi join."""
    keys = token_keys.select("repo_id", "language", F.col("match_key").alias("text"), "token_id", "category")
    return df.join(keys, ["repo_id", "language", "text"]).select(
        *KEYS, site_id(f"token.{language}", "path", "line", "col", "token_id").alias("id"),
        F.col("path").alias("file"), "line", "col", "token_id", F.col("text").alias("key"), "category",
        *PARENT_FIELDS)


# A declared name, an import or a package line is no reference: it is matched with its keywords, and dropped for the blank in it.
CHAIN = (
    r"(?=[A-Za-z_$])(?<![\w.@])(?:(?:(?:val|var|let|const|fun|func|class|struct|enum|object|interface|protocol|typealias|import|package|function|type)\s++)+[A-Za-z_$][\w$]*+"
    r"|[A-Za-z_$][\w$]*+(?:\??\.[A-Za-z_$][\w$]*+)*+)")


def chain_candidates(df: DataFrame, *keep: str, members: bool = True, dropped: str | None = None, **of) -> DataFrame:
    """Every identifier chain, its prefixes and (if asked) its single names.

    What ``dropped`` matches holds a blank or a colon and is no reference either.
    """
    found = F.filter(find_all(F.col("masked"), f"{dropped}|{CHAIN}" if dropped else CHAIN), lambda h: ~h["text"].rlike(r"[\s:]"))
    chains = sites(df, found, *keep, **of)
    parts = F.split("text", r"\.")
    prefixes = F.transform(parts, lambda _p, i: F.struct(
        F.lit(0).cast("bigint").alias("at"), F.array_join(F.slice(parts, F.lit(1), i + 1), ".").alias("text")))
    if members:
        singles = F.transform(parts, lambda p, i: F.struct(
            (F.octet_length(F.array_join(F.slice(parts, F.lit(1), i + 1), ".")) - F.octet_length(p)).cast("bigint").alias("at"),
            p.alias("text")))
        candidates = F.array_distinct(F.concat(prefixes, singles))
    else:
        candidates = prefixes
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("at"), F.col("text").alias("text")))
    candidates = F.when(F.contains("text", F.lit(".")), candidates).otherwise(whole)
    # a chain has no line break, so its parts stand on one line
    return chains.select(*FILE, *keep, *of, "start", "line", "col", F.explode(candidates).alias("c")).select(
        *FILE, *keep, *of, (F.col("start") + F.col("c.at")).alias("start"), "line", (F.col("col") + F.col("c.at")).alias("col"),
        F.col("c.text").alias("text"))
