"""One pass over a source text that knows where code ends and literals begin.

A text is read mark by mark with a stack of modes: code, string, template, JSX tag, JSX
children.  Code inside a template or an interpolation is code again, to any depth, and so is
code inside JSX.  Comments nest in Kotlin and Swift.  All offsets are 0-based bytes.

The work is a Python function per file on Arrow batches, because SQL expressions have no
stack.  It is linear in the text: each mark is met once.  What it yields are sorted arrays,
which the extractors search.
"""

from __future__ import annotations

import gc
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LANGUAGES = ("compose", "swift", "react")
#: Bytes of text that go on together: what is found in them takes about 45 times their size in Python objects.
BATCH = 1 << 19
#: JSX elements without an end that are read again as comparisons; beyond that a file has no JSX.
RETRIES = 8

_CODE = {
    "compose": re.compile(rb"//[^\n]*|/\*|\"\"\"|\"|'(?:[^'\\\n]|\\.)*'|@[\w.:]+\(|[(){}\[\],;]"),
    "swift": re.compile(rb"//[^\n]*|/\*|#*\"\"\"|#*\"|@\w+\(|#Preview\s*\(|[(){}\[\],;]"),
    "react": re.compile(rb"//[^\n]*|/\*|\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?|`|[(){}\[\],;]|<|/"),
}
_OPENS, _CLOSES = frozenset([b"(", b"{", b"["]), {b")": b"(", b"}": b"{", b"]": b"["}
_IS_CODE = frozenset([b"F", b"(", b"{", b"[", b"I"])
_COMMENT = re.compile(rb"/\*|\*/")
_TEMPLATE = re.compile(rb"`|\\[\s\S]|\$\{")
_TAG = re.compile(rb"\"[^\"]*\"?|'[^']*'?|//[^\n]*|/\*|/>|>|\{|<[^<>]*>")
_CHILD = re.compile(rb"\{|</[^>]*>|<(?=[A-Za-z_$>])")
_REGEX = re.compile(rb"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_GENERIC = re.compile(rb"<\s*\w+\s*(?:,|extends\b)")
_WORD = re.compile(rb"[\w$]+\Z")
# Keywords that an expression follows.
_BEFORE_EXPRESSION = {b"return", b"typeof", b"case", b"in", b"of", b"do", b"else", b"void", b"delete", b"throw", b"new", b"await", b"yield", b"default"}
_LINE = re.compile(rb"[ \t\r]*\n\s*")
# Characters and keywords that a statement goes on behind, and those that go on with one.
_WORDS = frozenset([b"else", b"return", b"in", b"as", b"is", b"of"])
_CONDITION = re.compile(rb"\b(?:if|while|for)\s*\Z")
_BEHIND = {"compose": frozenset(b"=+*/%&|,([{.:?!"), "react": frozenset(b"=+*/%&|,([{.:?!<>^~-")}
_GOES_ON = {
    "compose": re.compile(rb"\.(?!\.)|\?[.:]|&&|\|\||(?:else|as|in|is)\b|[)\]}]"),
    "react": re.compile(rb"[.,?:&|+*/%=<>()\[\]}^-]|(?:as|in)\b"),
}
_BEHIND["swift"], _GOES_ON["swift"] = _BEHIND["compose"], _GOES_ON["compose"]
_BREAK = re.compile(rb"\n")
_NOT_LINE = re.compile(rb"[^\n]")


class Lexed(NamedTuple):
    """Texts of the same bytes as the source, and sorted arrays of offsets."""

    masked: bytes                       # comments and literals blank
    code: bytes                         # comments blank; React only
    skeleton: bytes                     # as masked, arguments of annotations blank too; not React
    parens: list[tuple[int, int]]       # (open, close)
    braces: list[tuple[int, int]]
    opened: list[int]                   # where the depth grows: brackets, JSX elements, interpolations
    closed: list[int]
    commas: list[tuple[int, int]]       # (depth, at)
    stops: list[tuple[int, int]]        # (depth, at): where a statement or its group ends
    gaps: list[tuple[int, str]]         # (at, what is open or unmatched)
    ends: list[int]                     # offset behind each line break


@lru_cache(maxsize=64)
def _string(quotes: bytes, hashes: int, language: str) -> re.Pattern:
    """Marks of a string: its end, an interpolation, an escape, a line break that must not be there."""
    end = quotes + b"#" * hashes
    if language == "swift":
        slash = rb"\\" + b"#" * hashes
        marks = [slash + rb"\(", slash + rb"[\s\S]", re.escape(end)]
    elif len(quotes) == 3:
        marks = [rb"\$\{", rb"\"{3,}"]
    else:
        marks = [rb"\$\{", rb"\\.", b'"']
    return re.compile(b"|".join([*marks, *([b"\n"] if len(quotes) == 1 else [])]))


def _blank(data: bytes, regions: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in regions:
        if b > at:
            if a < at:
                a = at
            out.append(data[at:a])
            # most regions lie in one line
            out.append(b" " * (b - a) if data.find(b"\n", a, b) < 0 else _NOT_LINE.sub(b" ", data[a:b]))
            at = b
    return b"".join([*out, data[at:]])


def _trimmed(data: bytes, at: int) -> int:
    """Offset behind the last byte before ``at`` that is no blank."""
    while at:
        piece = data[max(0, at - 64):at]
        kept = len(piece.rstrip())
        if kept:
            return at - len(piece) + kept
        at -= len(piece)
    return 0


def _comment_end(data: bytes, at: int, nests: bool) -> int:
    """Offset behind a block comment, or -1."""
    if not nests:
        end = data.find(b"*/", at + 2)
        return end + 2 if end >= 0 else -1
    depth = 0
    for m in _COMMENT.finditer(data, at):
        depth += 1 if m.group() == b"/*" else -1
        if not depth:
            return m.end()
    return -1


def _line_ends(data: bytes) -> list[int]:
    return [m.end() for m in _BREAK.finditer(data)]


def lex(data: bytes, language: str, jsx: bool = True, never: frozenset[int] = frozenset()) -> Lexed:
    """Read a text; ``never`` are offsets of ``<`` that begin no JSX."""
    comments: list[tuple[int, int]] = []
    hidden: list[tuple[int, int]] = []   # literals and comments, ascending
    annotated: list[tuple[int, int]] = []
    pairs: dict[bytes, list[tuple[int, int]]] = {b"(": [], b"{": [], b"[": []}
    opened, closed, commas, stops, gaps = [], [], [], [], []
    # (mode, offset, detail): brackets and I (interpolation, its closing bracket) are code; S string, T tag, C children
    stack: list[tuple[bytes, int, object]] = [(b"F", 0, None)]
    depth, pos, size, code = 0, 0, len(data), _CODE[language]

    def hide(a: int, b: int) -> None:
        if a < b:
            hidden.append((a, b))

    def expects_expression(at: int) -> bool:
        k, at = len(comments) - 1, _trimmed(data, at)
        while k >= 0 and comments[k][1] == at:
            at, k = _trimmed(data, comments[k][0]), k - 1
        if not at:
            return True
        c = data[at - 1:at]
        word = _WORD.search(data, max(0, at - 24), at)
        if word:
            return word.group() in _BEFORE_EXPRESSION
        return c not in b")]}\"'`" and c < b"\x80"

    def close_element(at: int) -> None:
        nonlocal depth
        stack.pop()
        closed.append(at)
        depth -= 1

    search = code.search
    while True:
        mode, begun, detail = stack[-1]
        is_code = mode in _IS_CODE
        # the frequent marks of code first, without a look at the stack where it stays as it is
        while is_code and (m := search(data, pos)):
            token = m[0]
            if token == b",":
                pos = m.end()
                commas.append((depth, pos - 1))
            elif token in _OPENS:
                pos = m.end()
                mode, begun, detail = token, pos - 1, False
                opened.append(begun)
                depth += 1
                stack.append((mode, begun, detail))
            elif not detail and _CLOSES.get(token) == mode:
                pos = m.end()
                stops.append((depth, pos - 1))
                closed.append(pos - 1)
                depth -= 1
                pairs[mode].append((begun, pos - 1))
                del stack[-1]
                mode, begun, detail = stack[-1]
                is_code = mode in _IS_CODE
            else:
                break
        if not is_code:
            m = detail.search(data, pos)
        if not m:
            break
        (at, end), token = m.span(), m[0]
        if mode == b"C":
            hide(pos, at)
        if mode == b"S":
            hide(pos, end)
            pos = end
            if token.startswith(b"$") or token.endswith(b"(") and token.startswith(b"\\"):
                stack.append((b"I", at, b"}" if token.startswith(b"$") else b")"))
                opened.append(at)
                depth += 1
            elif token == b"\n":
                gaps.append((begun, "open literal"))
                stack.pop()
            elif not token.startswith(b"\\"):
                stack.pop()
            continue
        pos = end
        if token.startswith(b"//") or token == b"/*":
            if token == b"/*":
                end = _comment_end(data, at, language != "react")
                if end < 0:
                    gaps.append((at, "open comment"))
                    end = size
                pos = end
            comments.append((at, end))
            hide(at, end)
        elif mode == b"T" and token in (b"/>", b">"):
            if token == b">":
                stack[-1] = (b"C", begun, _CHILD)
            else:
                close_element(end - 1)
        elif mode == b"T" and token.startswith(b"<"):
            continue
        elif mode == b"C" and token.startswith(b"</"):
            close_element(end - 1)
        elif token == b"<":
            if mode == b"C" or (jsx and at not in never and data[at + 1:at + 2].isalpha() | (data[at + 1:at + 2] in (b">", b"_", b"$"))
                                and not _GENERIC.match(data, at) and expects_expression(at)):
                fragment = data[at + 1:at + 2] == b">"
                stack.append((b"C" if fragment else b"T", at, _CHILD if fragment else _TAG))
                pos = end + fragment
                opened.append(at)
                depth += 1
        elif token == b"/":
            literal = _REGEX.match(data, at)
            if literal and expects_expression(at):
                hide(at, literal.end())
                pos = literal.end()
        elif token == b"`":
            hide(at, end)
            stack.append((b"S", at, _TEMPLATE))
        elif language != "react" and token.endswith(b'"'):
            hide(at, end)
            hashes = token.count(b"#")
            stack.append((b"S", at, _string(token[hashes:], hashes, language)))
        elif token[:1] in b"\"'":
            hide(at, end)
            if len(token) == 1 or not token.endswith(token[:1]):
                gaps.append((at, "open literal"))
        elif token == b",":
            commas.append((depth, at))
        elif token == b";":
            stops.append((depth, at))
        elif token[-1:] in b"({[":
            opened.append(end - 1)
            depth += 1
            stack.append((token[-1:], end - 1, len(token) > 1))
        else:
            # a closing bracket: what is open inside its partner stays open
            k = len(stack) - 1
            while stack[k][0] in b"({[" and stack[k][0] != _CLOSES[token]:
                k -= 1
            kind, begin, flag = stack[k]
            if kind != _CLOSES[token] and not (kind == b"I" and flag == token):
                gaps.append((at, f"unmatched {token.decode()}"))
                continue
            for _, inner, _ in stack[:k:-1]:
                gaps.append((inner, "open bracket"))
                closed.append(at)
                depth -= 1
            del stack[k:]
            stops.append((depth, at))
            closed.append(at)
            depth -= 1
            if kind == b"I":
                hide(at, end)
            else:
                pairs[kind].append((begin, at))
                if flag is True:
                    annotated.append((begin, end))
    if stack[-1][0] in b"SC":
        hide(pos, size)
    elements = [at for kind, at, _ in stack if kind in (b"T", b"C")]
    if elements:
        if len(never) < RETRIES:
            return lex(data, language, jsx, never | {elements[0]})
        out = lex(data, language, False)
        return out._replace(gaps=sorted([*out.gaps, (elements[0], "open element")]))
    gaps += [(at, "open literal" if kind == b"S" else "open bracket") for kind, at, _ in stack[1:]]
    gaps += [(at, "open element") for at in never]
    masked = _blank(data, hidden)
    behind, goes_on = _BEHIND[language], _GOES_ON[language]
    opener = {close: begin for begin, close in pairs[b"("]}
    opened.sort()
    closed.sort()
    for m in _LINE.finditer(masked):
        at = m.start()
        if not at or masked[at - 1] in behind or goes_on.match(masked, m.end()) or masked.endswith(b"->", 0, at):
            continue
        if masked[at - 1] == 41 and at - 1 in opener and _CONDITION.search(masked, max(0, opener[at - 1] - 16), opener[at - 1]):
            continue
        if masked[at - 1] < 123 and masked[max(0, at - 7):at].isascii():
            word = _WORD.search(masked, max(0, at - 7), at)
            if word and word.group() in _WORDS:
                continue
        stops.append((bisect_left(opened, at) - bisect_left(closed, at), at))
    skeleton = _blank(masked, sorted(annotated)) if annotated else masked
    return Lexed(masked, _blank(data, comments) if language == "react" else b"", b"" if language == "react" else skeleton, sorted(pairs[b"("]), sorted(pairs[b"{"]), opened, closed,
                 sorted(commas), sorted(stops), sorted(gaps), _line_ends(data))


_PAIR = pa.struct([("open", pa.int64()), ("close", pa.int64())])
_LEVEL = pa.struct([("depth", pa.int64()), ("at", pa.int64())])
_GAP = pa.struct([("at", pa.int64()), ("what", pa.string())])
#: Added columns and their types.
COLUMNS = {
    "masked": "string", "code": "string", "skeleton": "string", "parens": "array<struct<open:bigint,close:bigint>>",
    "braces": "array<struct<open:bigint,close:bigint>>", "opened": "array<bigint>", "closed": "array<bigint>",
    "commas": "array<struct<depth:bigint,at:bigint>>", "stops": "array<struct<depth:bigint,at:bigint>>", "gaps": "array<struct<at:bigint,what:string>>",
    "ends": "array<bigint>",
}


def _lists(rows: list[list], kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32())
    count = offsets[-1].as_py()
    flat = chain.from_iterable(rows)
    if not pa.types.is_struct(kind):
        values = pa.array(np.fromiter(flat, np.int64, count), kind)
    else:
        fields = [kind.field(k) for k in range(kind.num_fields)]
        if all(f.type == pa.int64() for f in fields):
            # number by number, as a transposition makes an iterator per element
            columns = np.fromiter(chain.from_iterable(flat), np.int64, count * len(fields)).reshape(count, len(fields)).T
        else:
            columns = zip(*flat, strict=True) if count else ([] for _ in fields)
        values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(offsets, values)


def _lexed(texts: list, kinds: list, paths: list) -> list[Lexed]:
    """Texts in a row.  Nothing here refers to itself, so the search for cycles among all those tuples is put off."""
    searched = gc.isenabled()
    gc.disable()
    try:
        return [lex((t or "").encode(), k, not (p or "").endswith(".ts")) if k in LANGUAGES
                else Lexed(*[(t or "").encode()] * 3, *[[] for _ in range(8)])
                for t, k, p in zip(texts, kinds, paths, strict=True)]
    finally:
        if searched:
            gc.enable()


def with_lexemes(files: DataFrame, content: str = "content", language: str = "language", path: str = "path") -> DataFrame:
    """Adds ``COLUMNS``; the texts of files in other languages are not changed, a null text is empty."""
    keep = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [0 if v is None else v for v in pc.binary_length(batch.column(keep.index(content))).to_pylist()]
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(BATCH, sum(sizes) + BATCH, BATCH)).tolist()
            edges = sorted({0, *(min(c + 1, batch.num_rows) for c in cuts), batch.num_rows})
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                texts, kinds, paths = (part.column(keep.index(c)).to_pylist() for c in (content, language, path))
                out = _lexed(texts, kinds, paths)
                shown = [pa.array([getattr(o, c) for o in out], pa.binary()).cast(pa.string()) for c in ("masked", "code", "skeleton")]
                kinds = (_PAIR, _PAIR, pa.int64(), pa.int64(), _LEVEL, _LEVEL, _GAP, pa.int64())
                rest = [_lists([o[k + 3] for o in out], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *shown, *rest], names=[*keep, *COLUMNS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema), *(f"{c} {t}" for c, t in COLUMNS.items())])
    return files.mapInArrow(run, schema)
