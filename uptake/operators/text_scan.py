"""Line-based scanning of any text for registry symbols and token keys."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.identity import site_id
from ..functions.text import explode_lines, find_all, mask_strings, scannable_lines
from ..plans.stages import materialize

FILE = ["repo_id", "snapshot_id", "language", "path"]
# A run of name characters directly before "(", and where a symbol may start in
# it: after anything but an ASCII letter, digit, underscore or dot.
NAME_CALL = r"[\p{L}\p{N}_.$-]++\("
SYMBOL_START = r"(?<=[^A-Za-z0-9_.])"
#: Branches inside each other in the pattern of a registry.
NESTED = 100
#: Bytes of text that meet one copy of their registry, and hits that go on together.
PART, HITS = 1 << 22, 1 << 15
REGISTRY = ["repo_id", "language"]


def masked_lines(files: DataFrame) -> DataFrame:
    """Scannable lines (X02) with string literals blanked."""
    return scannable_lines(explode_lines(files)).withColumn("masked", mask_strings(F.col("code")))


def symbol_calls(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every ``symbol(`` call of a registry symbol or alias.

    Each line is tokenised once and the called names meet the aliases in an
    equi join, so the cost does not grow with the registry.
    """
    hits = masked_lines(files).filter(F.contains("masked", F.lit("("))).select(
        *FILE, "line", "start_col", F.explode(find_all(F.col("masked"), NAME_CALL)).alias("h"))
    runs = hits.select(
        *FILE, "line", F.rtrim("h.text", F.lit("(")).alias("run"),
        (F.col("start_col") + F.col("h.start") + 1).alias("run_col"))
    parts = F.split("run", SYMBOL_START)
    suffixes = F.transform(parts, lambda _p, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), ""))
    called = runs.select(*FILE, "line", "run", "run_col", F.explode(suffixes).alias("symbol")).select(
        *FILE, "line", "symbol",
        (F.col("run_col") + F.octet_length("run") - F.octet_length("symbol")).alias("col"))
    named = aliases.select("repo_id", "language", F.col("call_symbol").alias("symbol"), "registry_symbol")
    return called.join(named, ["repo_id", "language", "symbol"]).select(
        "repo_id", "snapshot_id", "language",
        site_id(F.concat(F.lit("usage."), F.col("path")), "line", "col", "symbol").alias("id"),
        F.col("path").alias("file"), "line", "col", "symbol", F.lit("resolved").alias("match_status"), "registry_symbol",
    )


def prefix_pattern(keys: list[str], depth: int = 0) -> str:
    """A pattern of the keys, which are sorted and distinct, that takes the longest one at a position.

    Keys that begin alike share that part, so a position is left as soon as no
    key goes on, however many keys there are.  Beyond ``NESTED`` branches inside
    each other the rest are plain alternatives, longest first.
    """
    if depth == NESTED:
        return "(?:" + "|".join(_quoted(k) for k in sorted(keys, key=len, reverse=True)) + ")"
    out = []
    for _, group in groupby([k for k in keys if k], key=lambda k: k[0]):
        same = list(group)
        shared = os.path.commonprefix([same[0], same[-1]])
        rest = [k[len(shared):] for k in same]
        out.append(_quoted(shared) + (prefix_pattern(rest, depth + 1) if len(rest) > 1 else ""))
    return "(?:" + "|".join(out) + ")" + ("?" if "" in keys[:1] else "")


def _quoted(text: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else "\\x{%x}" % ord(c) for c in text)


@lru_cache(maxsize=8)
def _matcher(keys: tuple[bytes, ...]) -> re.Pattern:
    """The pattern of sorted keys for UTF-8 texts; a byte stands for a character of Latin-1 while it is made."""
    pattern = prefix_pattern([k.decode("latin-1") for k in keys])
    return re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\x{int(m.group(1), 16):02x}", pattern).encode())


def _refs(files: pa.Table, keys: pa.Table) -> pa.Table:
    """Hits in the lines of the files, each with the rows of its key."""
    of_key: dict[bytes, list[int]] = {}
    for k, name in enumerate(keys["key"].to_pylist()):
        of_key.setdefault(name.encode(), []).append(k)
    number = {name: k for k, name in enumerate(of_key)}
    sizes = np.array([len(r) for r in of_key.values()], np.int64)
    first, rows = np.cumsum(sizes) - sizes, np.array([k for r in of_key.values() for k in r], np.int64)
    # a line holds no line break, so such a key is on none
    known = tuple(sorted(k for k in of_key if b"\n" not in k))
    pattern = _matcher(known)
    named, told = files.select(FILE), keys.select(["key", "token_id", "category"])
    out, waiting = [], []

    def flush() -> None:
        file, line, col, which = np.concatenate(waiting, axis=1)
        many = sizes[which]
        hit = np.repeat(np.arange(len(which)), many)
        row = rows[first[which][hit] + np.arange(len(hit)) - (np.cumsum(many) - many)[hit]]
        part = named.take(pa.array(file[hit]))
        for name, values in (("line", line), ("col", col)):
            part = part.append_column(name, pa.array(values[hit]))
        for name, values in zip(told.column_names, told.take(pa.array(row)).columns, strict=True):
            part = part.append_column(name, values)
        out.extend(part.combine_chunks().to_batches())
        waiting.clear()

    for f, content in enumerate(files["content"] if known else []):
        text = (content.as_py() or b"").replace(b"\r\n", b"\n")
        found = [(m.start(), number[m[0]]) for m in pattern.finditer(text)]
        if found:
            at, which = np.array(found, np.int64).T
            begins = np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1])
            line = np.searchsorted(begins, at, "right")
            waiting.append(np.stack([np.full(len(at), f), line, at - begins[line - 1] + 1, which]))
            if sum(w.shape[1] for w in waiting) >= HITS:
                flush()
    if waiting:
        flush()
    fields = [*named.schema, pa.field("line", pa.int64()), pa.field("col", pa.int64()), *told.schema]
    return pa.Table.from_batches(out, pa.schema(fields))


def token_refs(files: DataFrame, token_keys: DataFrame, id_prefix: str = "token.basic") -> DataFrame:
    """Leftmost, longest, non-overlapping token keys on each raw line.

    The texts of a registry are dealt to parts of about ``PART`` bytes, and each part meets
    its own copy of the keys: a task holds one part, however large a repository is, and the
    copies stay in proportion to the texts.  The keys of a registry come from a single
    document, which is one input row already.  An empty key names nothing.
    """
    parts = materialize(files.groupBy(*REGISTRY).agg(
        F.greatest(F.ceil(F.coalesce(F.sum(F.octet_length("content").cast("bigint")), F.lit(0)) / PART), F.lit(1)).alias("_parts")))
    dealt = files.join(parts, REGISTRY).select(
        *FILE, F.col("content").cast("binary").alias("content"), F.pmod(F.xxhash64("path", "snapshot_id"), "_parts").alias("_part"))
    keys = token_keys.filter(F.col("match_key") != "").join(parts, REGISTRY).select(
        F.col("repo_id").alias("_repo"), F.col("language").alias("_language"), F.col("match_key").alias("key"),
        F.col("token_id").alias("token_id"), F.col("category").alias("category"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_copy"))
    schema = ", ".join([*(f"{c} string" for c in FILE), "line bigint", "col bigint",
                        *(f"{c} {keys.schema[c].dataType.simpleString()}" for c in ("key", "token_id", "category"))])
    hits = dealt.groupBy(*REGISTRY, "_part").cogroup(keys.groupBy("_repo", "_language", "_copy")).applyInArrow(_refs, schema)
    return hits.select(
        "repo_id", "snapshot_id", "language",
        site_id(F.concat(F.lit(id_prefix + ":"), F.col("path")), "line", "col", "token_id").alias("id"),
        F.col("path").alias("file"), "line", "col", "token_id", "key", "category",
    )
