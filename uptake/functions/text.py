"""Text expressions: lines, masking, match positions, names and path globs.

Everything here is a JVM-side Column expression; none of it shuffles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# The Unicode white space characters.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = "[" + BLANKS + "]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_start(s: Column) -> Column:
    return F.ltrim(s, F.lit(BLANKS))


def trim_end(s: Column) -> Column:
    return F.rtrim(s, F.lit(BLANKS))


def trim(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def remove_spaces(s: Column) -> Column:
    return F.regexp_replace(s, rf"{SPACE}++", "")


def byte_len(s: Column) -> Column:
    return F.octet_length(s)


# --- lines -----------------------------------------------------------------

def lines_of(content: Column) -> Column:
    """Array of lines; ``\\n`` or ``\\r\\n`` ends a line, no empty last line."""
    return let(
        F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n"),
        lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts),
    )


def explode_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line with a 1-based ``line`` number and its ``text``."""
    keep = [c for c in files.columns if c != content]
    return files.select(*keep, F.posexplode(lines_of(F.col(content))).alias("_i", "text")).select(
        *keep, (F.col("_i") + 1).cast("bigint").alias("line"), "text"
    )


def scannable_lines(lines: DataFrame) -> DataFrame:
    """Drop blank and comment lines, cut at the first ``//``, trim.

    ``start_col`` is the byte offset of the first non-blank character.
    """
    lead = byte_len(F.col("text")) - byte_len(trim_start(F.col("text")))
    code = trim_end(F.substring_index(trim_start(F.col("text")), "//", 1))
    return (
        lines.withColumn("code", code)
        .filter(F.col("code") != "")
        .withColumn("start_col", lead.cast("bigint"))
    )


def mask_strings(s: Column) -> Column:
    """Blank every character of a ``"..."`` run and both quotes."""
    blanked = F.array_join(
        F.transform(
            F.split(s, '"'),
            lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.char_length(p))).otherwise(p),
        ),
        " ",
    )
    return F.when(F.contains(s, F.lit('"')), blanked).otherwise(s)


# --- match positions ---------------------------------------------------------

def running_ends(lengths: Column, block: int = 32) -> Column:
    """Inclusive running sums of an array of lengths.

    Sums are collected block by block and one accumulator carries the total, so the
    work stays close to linear even for the many matches of a minified line.
    """
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("out"))

    def add(acc, v):
        total = acc["total"] + v
        return F.struct(total.alias("total"), F.array_append(acc["out"], total).alias("out"))

    def summed(values, start):
        return F.aggregate(values, F.struct(start.alias("total"), zero["out"].alias("out")), add)

    def blocked(a):
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")),
            lambda b: F.slice(a, b * block + 1, block))
        first = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<array<bigint>>").alias("out"))

        def add_block(acc, values):
            return let(summed(values, acc["total"]), lambda s: F.struct(
                s["total"].alias("total"), F.array_append(acc["out"], s["out"]).alias("out")))

        return F.flatten(F.aggregate(blocks, first, add_block, lambda acc: acc["out"]))

    return let(lengths, lambda a: F.when(F.size(a) <= block, summed(a, F.lit(0).cast("bigint"))["out"]).otherwise(blocked(a)))


#: Set around matches; a text that holds one of them is searched without them.
BEGIN, END = "\ufdd0", "\ufdd1"


def find_all(text: Column, pattern: Column | str, tail: str | None = None) -> Column:
    """All leftmost matches as ``array<struct<start, text>>``.

    ``start`` is a 0-based byte offset.  ``pattern`` must have no capturing
    group; it may differ per row.  With ``tail`` a match must be followed by
    that pattern, and what it covers is a third field, ``tail``.
    """
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.contains(text, F.lit(BEGIN)) | F.contains(text, F.lit(END))
    hits = F.when(marked, _find_by_groups(text, pat, tail)).otherwise(_find_by_marks(text, pat, tail))
    return F.filter(hits, lambda h: h["text"] != "")


def _find_by_marks(text: Column, pat: Column, tail: str | None) -> Column:
    """One search that sets marks around each match; the text is cut in front of the matches."""
    ahead = F.lit(f")(?=({tail}))" if tail else ")")
    put = f"{BEGIN}$1{END}" + (f"$2{END}" if tail else "")
    pieces = F.split(F.regexp_replace(text, F.concat(F.lit("(?s)("), pat, ahead), F.lit(put)), BEGIN)

    def read(p, i):
        """A match, its tail and the bytes that the piece has in the text."""
        match = F.when(i > 0, F.substring_index(p, END, 1)).otherwise(F.lit(""))
        behind = F.when(i > 0, F.substring_index(F.substring_index(p, END, 2), END, -1)).otherwise(F.lit("")) if tail else None
        added = byte_len(F.lit(END)) * (2 if tail else 1)
        size = byte_len(p) - F.when(i > 0, added + byte_len(behind) if tail else added).otherwise(0)
        return F.struct(size.cast("bigint").alias("size"), match.alias("text"), *([behind.alias("tail")] if tail else []))

    def placed(found):
        def at(ends):
            return F.transform(F.slice(found, F.lit(2), F.size(found) - 1), lambda m, i: F.struct(
                F.get(ends, i).alias("start"), m["text"].alias("text"), *([m["tail"].alias("tail")] if tail else [])))
        return let(running_ends(F.transform(found, lambda m: m["size"])), at)

    return F.when(text.isNotNull() & pat.isNotNull(), let(F.transform(pieces, read), placed))


def _find_by_groups(text: Column, pat: Column, tail: str | None) -> Column:
    scan = F.concat(F.lit("(?s).*?("), pat, F.lit(f")(?=({tail}))|.+" if tail else ")|.+"))

    def group(i: int) -> Column:
        return F.regexp_extract_all(text, scan, F.lit(i))

    ends = running_ends(F.transform(group(0), lambda p: byte_len(p).cast("bigint")))
    parts = [ends.alias("end"), group(1).alias("text"), *([group(2).alias("tail")] if tail else [])]
    return F.transform(F.arrays_zip(*parts), lambda z: F.struct(
        (z["end"] - byte_len(z["text"])).alias("start"), z["text"].alias("text"),
        *([z["tail"].alias("tail")] if tail else [])))


# --- names -------------------------------------------------------------------

def npm_package_root(specifier: Column) -> Column:
    """``@scope/name/x`` -> ``@scope/name``, ``lodash/debounce`` -> ``lodash``."""
    scoped = F.regexp_extract(specifier, r"\A(@[^/]+/[^/]+)", 1)
    return F.when(
        F.startswith(specifier, F.lit("@")), F.when(scoped != "", scoped).otherwise(specifier)
    ).otherwise(F.substring_index(specifier, "/", 1))


def kebab_id(symbol: Column) -> Column:
    """``HTTPServerView`` -> ``http-server-view``."""
    split = F.regexp_replace(symbol, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "-")
    return F.lower(F.btrim(F.regexp_replace(split, r"[^A-Za-z0-9]+", "-"), F.lit("-")))


# --- paths -------------------------------------------------------------------

def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; empty for dot-files."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)\z", 1)


def expand_braces(pattern: str) -> list[str]:
    """``a/{b,c}`` -> ``a/b``, ``a/c``; leftmost group first, recursively."""
    start = pattern.find("{")
    end = pattern.find("}", start) if start >= 0 else -1
    if end < 0:
        return [pattern]
    head, tail = pattern[:start], pattern[end + 1:]
    return [x for alt in pattern[start + 1:end].split(",") for x in expand_braces(head + alt + tail)]


def glob_regex(pattern: str) -> str:
    """One anchored regex for a path glob.

    ``**`` spans any number of whole segments and, as the last segment, any
    rest; ``*`` stays inside a segment; everything else is literal.
    """
    def one(p: str) -> str:
        out = ""
        segments = [s for s in p.split("/") if s]
        for i, seg in enumerate(segments):
            last = i == len(segments) - 1
            if seg == "**":
                out += r"(?:[^/]+/)*+[^/]*" if last else r"(?:[^/]+/)*"
            else:
                body = "[^/]+" if seg == "*" else "[^/]*".join(re.escape(x) for x in seg.split("*"))
                out += body + ("" if last else "/")
        # `a/**` also matches `a` itself.
        return out.replace(r"/(?:[^/]+/)*+[^/]*", r"(?:/.*)?") if out.endswith(r"/(?:[^/]+/)*+[^/]*") else out

    return r"(?s)\A(?:" + "|".join(one(p) for p in expand_braces(pattern)) + r")\z"


def root_regex(root: str) -> str:
    """Regex for files below a configured root.

    Only whole segments ``*`` and ``**`` are wild; ``app-*`` and ``?`` are literal.
    """
    out = ""
    for seg in (s for s in root.split("/") if s and s != "."):
        out += {"*": "[^/]+/", "**": "(?:[^/]+/)*"}.get(seg, re.escape(seg) + "/")
    return r"(?s)\A" + out + r"[^/].*\z"


def has_wildcard_segment(root: str) -> bool:
    return any(s in ("*", "**") for s in root.split("/"))
