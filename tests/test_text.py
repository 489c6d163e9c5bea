"""Text expressions and interval operators against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from uptake.functions import lexing as lx, text as tx
from uptake.functions.lexer import lex
from uptake.operators import intervals as iv, text_scan as ts
from uptake.sources import files as fs


def one(spark, value, expr, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize("text, want", [
    ("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\n\n", ["a", "b", ""]), ("\n", [""]), ("a\rb\n", ["a\rb"])])
def test_lines(spark, text, want):
    assert one(spark, text, tx.lines_of(F.col("v"))) == want


def test_scannable_lines_and_masks(spark):
    text = '// all comment\n   \n  call("x(", y) // tail\nurl = "http://x"\n  "é" foo('
    files = spark.createDataFrame([("r", "s", "basic", "f", text)], "repo_id string, snapshot_id string, language string, path string, content string")
    rows = {r.line: r for r in ts.masked_lines(files).collect()}
    assert sorted(rows) == [3, 4, 5]
    assert (rows[3].start_col, rows[3].code, rows[3].masked) == (3, 'call("x(", y)', "call(    , y)")
    assert rows[4].code == 'url = "http:'
    assert rows[5].masked == "    foo("


def test_symbol_calls(spark):
    text = "Foo(Bar(x.Baz(Foo( my-card( Ns.Btn( aNs.Btn( größe( r(\nqFoo( _Foo( éFoo("
    files = spark.createDataFrame([("r", "s", "basic", "f", text)], "repo_id string, snapshot_id string, language string, path string, content string")
    names = ["Foo", "Bar", "Baz", "my-card", "card", "Ns.Btn", "Btn", "größe", "r"]
    aliases = spark.createDataFrame([("r", "basic", n, n.upper()) for n in names], "repo_id string, language string, call_symbol string, registry_symbol string")
    got = sorted((r.line, r.col, r.symbol) for r in ts.symbol_calls(files, aliases).collect())
    line1, line2 = [ln.encode() for ln in text.split("\n")]
    want = []
    for no, line in ((1, line1), (2, line2)):
        for n in names:
            pat = n.encode() + b"("
            for m in re.finditer(b"(?=" + re.escape(pat) + b")", line):
                before = line[m.start() - 1:m.start()]
                if m.start() == 0 or not re.match(rb"[A-Za-z0-9_.]", before):
                    want.append((no, m.start() + 1, n))
    assert got == sorted(want)


def test_token_refs_longest_first(spark):
    files = spark.createDataFrame([("r", "s", "basic", "f", "a.b.c a.b é a.bc.d\n(x)* a")], "repo_id string, snapshot_id string, language string, path string, content string")
    keys = spark.createDataFrame([("r", "basic", k, "t" + str(i), "color") for i, k in enumerate(["a.b", "a.b.c", "a", "(x)*"])],
                                 "repo_id string, language string, match_key string, token_id string, category string")
    got = sorted((r.line, r.col, r.key) for r in ts.token_refs(files, keys).collect())
    assert got == [(1, 1, "a.b.c"), (1, 7, "a.b"), (1, 14, "a.b"), (2, 1, "(x)*"), (2, 6, "a")]


def test_find_all_on_long_and_odd_texts(spark):
    rng = random.Random(1)
    for n in (0, 1, 31, 32, 33, 700):
        text = "".join(rng.choice("ab{é }\n") for _ in range(n))
        got = [(h.start, h.text) for h in one(spark, text, tx.find_all(F.col("v"), "[ab]++"))]
        want = [(len(text[:m.start()].encode()), m.group()) for m in re.finditer("[ab]+", text)]
        assert got == want


def test_bracket_pairs_and_places(spark):
    rng = random.Random(3)
    text, depth = "", 0
    for _ in range(300):
        c = rng.choice("{}x\né")
        if c == "}" and depth == 0:
            continue
        depth += {"{": 1, "}": -1}.get(c, 0)
        text += c
    text += "}" * depth
    stack, want, at = [], [], 0
    for c in text:
        if c == "{":
            stack.append(at)
        elif c == "}":
            want.append((stack.pop(), at))
        at += len(c.encode())
    assert lex(text.encode(), "compose").braces == sorted(want)
    for off in (0, 5, 60, 200):
        raw = text.encode()[:off]
        p = one(spark, text, lx.place(lx.line_ends(F.col("v")), F.lit(off).cast("bigint")))
        assert (p.line, p.col) == (raw.count(b"\n") + 1, off - (raw.rfind(b"\n") + 1) + 1)


def test_mask_keeps_bytes_and_lines(spark):
    text = 'a "é\\"x" /* c\n é */ b // "d\n\'q\' e "unclosed\n'
    out = lex(text.encode(), "react")
    got = out.masked.decode()
    assert len(got.encode()) == len(text.encode())
    assert got.split() == ["a", "b", "e"] and out.gaps == [(text.encode().index(b'"unclosed'), "open literal")]
    assert got.count("\n") == text.count("\n")


GLOBS = [
    ("**/node_modules/**", "a/node_modules/x.ts", True), ("**/node_modules/**", "node_modules/x.ts", True),
    ("src/**", "src", True), ("src/**", "src/a/b", True), ("src/*", "src/a/b", False),
    ("src/*.{ts,tsx}", "src/a.tsx", True), ("src/*.{ts,tsx}", "src/a.js", False),
    ("**/*.stories.{ts,tsx}", "x/y/B.stories.tsx", True), ("**/gen", "a/b/gen", True), ("**/gen", "a/gen/b", False),
    ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a?c", "abc", False), ("a.c", "abc", False),
    ("**", "any/thing", True), ("{a,b}/{c,d}.x", "b/c.x", True),
]


def test_globs(spark):
    for pattern, path, want in GLOBS:
        assert one(spark, path, F.col("v").rlike(tx.glob_regex(pattern))) == want, (pattern, path)


def test_roots(spark):
    rows = [("app/src/a.kt",), ("app-x/src/a.kt",), ("packages/ui/src/b.kt",), ("packages/x/y/src/b.kt",), ("lib",)]
    files = spark.createDataFrame(rows, "path string")

    def kept(*roots):
        return sorted(r.path for r in fs.resolve_roots(files, list(roots)).collect())

    assert kept("app/src") == ["app/src/a.kt"]
    assert kept("app-*") == []
    assert kept("packages/*/src") == ["packages/ui/src/b.kt"]
    assert kept("packages/**/src") == ["packages/ui/src/b.kt", "packages/x/y/src/b.kt"]


@pytest.mark.parametrize("wide", [20, 5000])
def test_intervals_against_brute_force(spark, wide):
    """One file holds nearly everything, as a hot key would."""
    rng = random.Random(wide)
    files = ["hot"] * 9 + ["f1", "f2"]
    scopes = []
    for i in range(300):
        start = rng.randrange(1, wide)
        scopes.append((rng.choice(files), f"s{i:03}", start, start + rng.randrange(0, wide // 3 + 1)))
    sites = [(f"u{i}", rng.choice(files), rng.randrange(0, wide + wide // 3)) for i in range(500)]
    sc = spark.createDataFrame(scopes, "file string, scope_id string, start_pos long, end_pos long")
    si = spark.createDataFrame(sites, "id string, file string, pos long")

    got = {r.id: r.scope_id for r in iv.parent_scope(si, sc, ["file"]).collect()}
    for uid, f, pos in sites:
        around = [(e - s, s, i) for g, i, s, e in scopes if g == f and s <= pos <= e]
        assert got[uid] == (min(around)[2] if around else None)

    outside = {r.id for r in iv.outside_scopes(si, sc.filter("end_pos - start_pos < 9"), ["file"]).collect()}
    assert outside == {u for u, f, p in sites if not any(g == f and s <= p <= e and e - s < 9 for g, _, s, e in scopes)}

    kept = {(r.file, r.start_pos, r.end_pos) for r in iv.containment_dedupe(sc, ["file"], cell=7).collect()}
    spans = {(f, s, e) for f, _, s, e in scopes}
    assert kept == {
        (f, s, e) for f, s, e in spans if not any(g == f and a <= s and e <= b and (a, b) != (s, e) for g, a, b in spans)}


def test_token_refs_of_one_registry_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(ts, "PART", 64)
    lines = ["the \u00e9 the,\r\nwho the", "\ufdd0 \u00e9\u00e9th \ufdd1\n\nthe", "a\rthe,the", "", None]
    rows = [("r", "s", "basic", f"f{i}", lines[i % 5]) for i in range(100)] + [("q", "s", "basic", "g", "the"), (None, "s", "basic", "n", "the")]
    files = spark.createDataFrame(rows, "repo_id string, snapshot_id string, language string, path string, content string")
    named = ["the", "the", "the,", "\u00e9", "\ufdd0 ", "wh", "", None, "o\nt", "a\r"]
    keys = spark.createDataFrame([("r", "basic", k, f"t{i}", None) for i, k in enumerate(named)] + [(None, "basic", "the", "t", None)],
                                 "repo_id string, language string, match_key string, token_id string, category string")
    pattern = re.compile("|".join(re.escape(k) for k in sorted({k for k in named if k}, key=len, reverse=True)))
    want = [(path, n, len(line[:m.start()].encode()) + 1, m.group(), f"t{i}")
            for repo, _, _, path, text in rows if repo == "r"
            for n, line in enumerate((text or "").replace("\r\n", "\n").split("\n"), 1)
            for m in pattern.finditer(line) for i, k in enumerate(named) if k == m.group()]
    got = ts.token_refs(files, keys)
    assert sorted((r.file, r.line, r.col, r.key, r.token_id) for r in got.collect()) == sorted(want)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        used = got.filter("repo_id = 'r'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert used > 1  # one registry is no longer one task


def test_prefix_pattern_takes_the_longest_key(spark):
    keys = ["a", "ab", "abc", "b.c", "b.cd", "é", "é*", "$x", "x" * 150] + ["y" * n for n in range(1, 120)]
    texts = ["abcab.cd a é*é$x", "x" * 151 + "y" * 125, "b.b.c", "", "nothing else", "😀abé"]

    def plain(text):
        at, out = 0, []
        while at < len(text):
            hit = max((k for k in keys if text.startswith(k, at)), key=len, default="")
            if hit:
                out.append((len(text[:at].encode()), hit))
            at += len(hit) or 1
        return out

    pattern = ts.prefix_pattern(sorted(keys))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.find_all(F.col("t"), pattern).alias("h")).collect()
    assert {r.t: [(h.start, h.text) for h in r.h] for r in got} == {t: plain(t) for t in texts}


def test_running_ends_of_many_lengths(spark):
    for n in (0, 1, 7, 8, 9, 64, 513, 5000):
        row = spark.range(1).select(tx.running_ends(F.transform(F.sequence(F.lit(1), F.lit(n + 1)), lambda x: (x % 7).cast("bigint"))).alias("e")).collect()[0]
        want, total = [], 0
        for x in range(1, n + 2):
            total += x % 7
            want.append(total)
        assert row.e == want
    assert spark.range(1).select(tx.running_ends(F.array().cast("array<bigint>")).alias("e")).collect()[0].e == []


def test_matches_by_marks_equal_matches_by_groups(spark):
    """One search with marks finds what a search per group finds; a text that holds a mark is searched by groups."""
    texts = [None, "", "a", "é(x) = {\nB( ", f"fun F(){tx.BEGIN} {{A()}}", f"f(){tx.END}()", "F()" * 300, "\x00a.b\r\nFoo(", " x $1 \\ " * 40, "😀()é()"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern, tail in ((r"[A-Za-z]\w*+(?=\()", None), (r"\)", r"\s*+\S?"), (r"(?<=\()\w|=", None), (r"(?m)^[^\n]++", None), (r"\A.|x", r"[\s\S]{0,2}")):
        fields = ["start", "text"] + (["tail"] if tail else [])
        rows = df.select("t", tx.find_all(F.col("t"), pattern, tail).alias("a"), tx._find_by_groups(F.col("t"), F.lit(pattern), tail).alias("b")).collect()
        for r in rows:
            want = None if r.b is None else [tuple(h[f] for f in fields) for h in r.b if h["text"] != ""]
            assert (None if r.a is None else [tuple(h[f] for f in fields) for h in r.a]) == want
    by_marks = df.filter(f"t NOT LIKE '%{tx.BEGIN}%' AND t NOT LIKE '%{tx.END}%'").select(
        "t", tx._find_by_marks(F.col("t"), F.lit(r"\w"), None).alias("a")).collect()
    for r in by_marks:
        assert [(h.start, h.text) for h in r.a] == [(len(r.t[:m.start()].encode()), m.group()) for m in re.finditer(r"(?a:\w)", r.t)]
