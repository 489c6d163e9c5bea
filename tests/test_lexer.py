"""Where code ends and literals begin: modes to any depth, gaps, statement ends."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from uptake.functions import lexer
from uptake.functions.lexer import lex, with_lexemes
from uptake.operators.extract import kotlin, react, swift
from uptake.operators.extract.common import FILES, _bounds_of
from test_extract import table


def words(text, language, **settings):
    out = lex(text.encode(), language, **settings)
    assert len(out.masked) == len(text.encode()) and out.masked.count(b"\n") == text.count("\n")
    return out.masked.decode().split()


@pytest.mark.parametrize("language, text, left", [
    ("react", "<A>Don't <B/> it's http://x.y </A>", ["<A>", "<B/>", "</A>"]),
    ("react", "x = a < b && c > d // no", ["x", "=", "a", "<", "b", "&&", "c", ">", "d"]),
    ("react", "r = /[/\"']/g; y = a / b / c", ["r", "=", ";", "y", "=", "a", "/", "b", "/", "c"]),
    ("react", "t = `a ${f(`b ${<B/>} }`)} c` + 1", ["t", "=", "f(", "<B/>", ")", "+", "1"]),
    ("react", "f = <T,>(x: T) => <C/>", ["f", "=", "<T,>(x:", "T)", "=>", "<C/>"]),
    ("react", "<A b='}' c={{d: \"x\"}}>{/* <E/> */}{x && <F/>}</A>", ["<A", "b=", "c={{d:", "}}>{", "}{x", "&&", "<F/>}</A>"]),
    ("react", "<>é's <A/></>", ["<>", "<A/></>"]),
    ("compose", "a /* x /* y */ z */ b", ["a", "b"]),
    ("compose", 'f("${g("}")} $x \\" ") + """ "q" ${h()} """"', ["f(", "g(", ")", ")", "+", "h()"]),
    ("compose", "c = '\"' + '\\''", ["c", "=", "+"]),
    ("swift", '#"a \\(x) " \\#(F("y"))"# + "b \\(G()) c"', ["F(", ")", "+", "G()"]),
    ("swift", '"""\nq "z" \\(H())\n""" + 1', ["H()", "+", "1"]),
])
def test_modes(language, text, left):
    assert words(text, language) == left
    assert not lex(text.encode(), language).gaps


@pytest.mark.parametrize("language, text, gaps", [
    ("compose", "fun f() { g(", [(8, "open bracket"), (11, "open bracket")]), ("compose", "f) x", [(1, "unmatched )")]),
    ("compose", "f(a { b) c", [(4, "open bracket")]), ("compose", 'x = "abc\ny', [(4, "open literal")]), ("swift", "/* /* */", [(0, "open comment")]),
    ("react", "x = `a", [(4, "open literal")]), ("react", "x = <A>", [(4, "open element")]), ("react", "", []),
])
def test_gaps(language, text, gaps):
    assert lex(text.encode(), language).gaps == gaps


def test_an_element_without_end_hides_nothing():
    assert words("a = <B>c; d('x')", "react") == ["a", "=", "<B>c;", "d(", ")"]
    assert words("a = <B>c; d('x')", "react", jsx=False) == ["a", "=", "<B>c;", "d(", ")"]


def test_any_bytes_give_sorted_arrays():
    draw = random.Random(2)
    marks = list("(){}[]<>/\"'`,;\n\\$#@ab =") + ["${", "/*", "*/", "//", '"""', "<A", "/>", "</A>", "é"]
    for _ in range(2000):
        text = "".join(draw.choices(marks, k=draw.randrange(40)))
        for language in ("compose", "swift", "react"):
            out = lex(text.encode(), language)
            assert len(out.masked) == len(text.encode())
            assert all(list(x) == sorted(x) for x in out[3:]) and len(out.opened) >= len(out.closed)


@pytest.mark.parametrize("depth", [0, 7, 200])
def test_any_depth(spark, depth):
    nest = "f(" * depth + "1" + ")" * depth
    files = table(spark, "compose", {"A.kt": f"@Composable\nfun S(a: Int = {nest}) {{\n  Btn(padding({nest}, 4.dp))\n}}\n"})
    assert [(r.symbol, r.parent_symbol) for r in kotlin.calls(files).collect()] == [("Btn", "S")]
    assert [r.value for r in kotlin.style_sites(files).collect()] == (["1"] if not depth else ["4.dp"])
    files = table(spark, "swift", {"A.swift": f"func S(_ a: Int = {nest}) -> some View {{\n  Btn().padding({nest}).frame(width: 2)\n}}\n"})
    assert [(r.symbol, r.parent_symbol) for r in swift.calls(files).collect()] == [("Btn", "S")]
    assert [r.value for r in swift.style_sites(files).collect()] == (["1"] if not depth else []) + ["2"]
    files = table(spark, "react", {"a.tsx": f"export const S = (a = {nest}) => <Btn style={{{{ gap: 1, width: {nest}, x: {{ gap: 2 }} }}}} />;\n"})
    assert [(r.symbol, r.parent_symbol) for r in react.calls(files).collect()] == [("Btn", None)]
    assert [r.symbol for r in react.definitions(files).collect()] == ["S"]


def test_expression_bodies_end_with_their_statement(spark):
    files = table(spark, "compose", {"A.kt": "@Composable\nfun S(a: Boolean) = if (a)\n  One()\nelse Two { \n Three() }\nval x = Four()\n@Composable fun T() = Five()\n"})
    assert {(r.symbol, r.parent_symbol) for r in kotlin.calls(files).collect()} == {("One", "S"), ("Two", "S"), ("Three", "S"), ("Five", "T")}


def test_names_with_a_type_are_no_references(spark):
    text = "@Composable\nfun S(primary: Color, a: Theme.size = Theme.size) {\n  val b = primary\n  val c: Theme.size = x ?: Theme.size\n  if (b is Theme.size) d()\n}\nenum class primary\nfun interface primary\n"
    keys = spark.createDataFrame([("r", "compose", k, k, "color") for k in ("primary", "Theme.size")], "repo_id string, language string, match_key string, token_id string, category string")
    files = table(spark, "compose", {"A.kt": text})
    repo = files.first()["repo_id"]
    keys = keys.replace("r", repo, "repo_id")
    assert sorted((r.line, r.key) for r in kotlin.token_sites(files, keys).collect()) == [(2, "Theme.size"), (3, "primary"), (4, "Theme.size")]


def test_lexer_holds_a_bounded_piece_of_a_batch():
    """A batch of many small files goes on in pieces, since what is found in a text takes many times its size."""
    class Files:
        columns, schema = ["path", "content", "language"], []

        def mapInArrow(self, run, schema):
            return run

    text = "fun f() { " + "id(" * 400 + ")" * 400 + " }\n"
    files = pa.RecordBatch.from_arrays([pa.array(v) for v in (["a.kt"] * 1500, [text] * 1500, ["compose"] * 1500)], names=Files.columns)
    out = list(with_lexemes(Files())(iter([files])))
    assert sum(b.num_rows for b in out) == 1500
    assert max(pc.sum(pc.binary_length(b.column(1))).as_py() for b in out) < (1 << 20)


def test_scope_bounds_of_more_files_than_go_together():
    n = 2 * FILES + 3
    bounds = _bounds_of(pa.array([[0, 2]] * n), pa.array([[9, 5]] * n))
    assert bounds.to_pylist() == [[{"at": 0, "scope": 0}, {"at": 2, "scope": 1}, {"at": 5, "scope": 0}, {"at": 9, "scope": -1}]] * n


def test_lists_keep_their_rows():
    """Empty rows, rows of numbers, of pairs and of pairs with a text become the same lists."""
    pairs, gaps = [[], [(1, 2), (3, 1 << 40)], []], [[(5, "open bracket")], [], []]
    assert lexer._lists([[1, 2], [], [3]], lexer.pa.int64()).to_pylist() == [[1, 2], [], [3]]
    assert lexer._lists(pairs, lexer._PAIR).to_pylist() == [[], [{"open": 1, "close": 2}, {"open": 3, "close": 1 << 40}], []]
    assert lexer._lists(gaps, lexer._GAP).to_pylist() == [[{"at": 5, "what": "open bracket"}], [], []]
    assert lexer._lists([[], []], lexer._PAIR).to_pylist() == [[], []]
