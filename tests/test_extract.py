"""Extraction and resolution on small hand-written sources."""

import pytest
from pyspark.sql import functions as F

from uptake.operators import resolve as rs
from uptake.operators.extract import kotlin, react, swift
from uptake.plans import code_files, scan

FILES = "repo_id string, snapshot_id string, language string, path string, content string"


def table(spark, language, sources):
    return spark.createDataFrame([("r", "s", language, p, c) for p, c in sources.items()], FILES)


def registry(spark, language, entries):
    rows = [("r", language, call, target, package) for call, target, package in entries]
    return spark.createDataFrame(rows, "repo_id string, language string, call_symbol string, registry_symbol string, registry_package string")


def token_keys(spark, language, keys):
    return spark.createDataFrame([("r", language, k, "t." + k, "color") for k in keys],
                                 "repo_id string, language string, match_key string, token_id string, category string")


KOTLIN = {
    "a/Home.kt": '''package shop.home
import design.kit.Card
import design.kit.Chip as Pill
import shop.rows.*

private const val NOTE = "Card(hidden)" // Card(also hidden)
/* Card(
   in a block */
@Composable
fun Home(onDone: @Composable () -> Unit = { Card() }) {
    Card(Modifier.padding(8.dp)) { Pill("x") }
    Row()
    helper.Card()
    ProvideTheme { LaunchedEffect(Unit) {} }
    fun plain() { Card() }
    val size = Theme.size.large
    Badge(elevation(2, max(3, 4)), background(if (on) 0xFF00FF00 else other()))
}

@Composable
internal fun Badge(a: Int) = Card { Text("é") }

fun notComposable() { Card(); Badge(1) }

@Preview(showBackground = true)
@Composable
fun HomePreview() { Home { }; Card(Modifier.padding(1.dp)) }

val slot = @Composable { Card() }
''',
    "b/Row.kt": "package shop.rows\n@Composable fun Row() { Badge() }\n",
}


def test_kotlin(spark):
    files = table(spark, "compose", KOTLIN)
    aliases = registry(spark, "compose", [("Card", "Card", "design.kit"), ("Chip", "Chip", None), ("Pill", "Chip", "design.kit"), ("Text", "Text", "other.kit")])
    out = scan.scan_compose(files, aliases, token_keys(spark, "compose", ["Theme.size.large", "Theme.size", "NOTE"]))
    got = {(r.file, r.line, r.symbol): r for r in out["usage_sites"].collect()}
    assert sorted(got) == [
        ("a/Home.kt", 10, "Card"), ("a/Home.kt", 11, "Card"), ("a/Home.kt", 11, "Pill"), ("a/Home.kt", 12, "Row"),
        ("a/Home.kt", 17, "Badge"), ("a/Home.kt", 21, "Card"), ("a/Home.kt", 21, "Text"), ("a/Home.kt", 29, "Card"),
        ("b/Row.kt", 2, "Badge")]
    status = {k: v.match_status for k, v in got.items()}
    assert status[("a/Home.kt", 11, "Card")] == "resolved"
    assert status[("a/Home.kt", 11, "Pill")] == "resolved"
    assert status[("a/Home.kt", 12, "Row")] == "local"
    assert got[("a/Home.kt", 12, "Row")].local_definition_id == "local.compose:shop.rows.Row"
    assert got[("a/Home.kt", 17, "Badge")].qualified_symbol == "shop.home.Badge"
    assert status[("a/Home.kt", 21, "Text")] == "unresolved"
    assert status[("b/Row.kt", 2, "Badge")] == "unresolved"
    assert got[("a/Home.kt", 11, "Card")].parent_id == "compose:composable:shop.home.Home"
    assert got[("a/Home.kt", 29, "Card")].parent_id is None
    assert got[("a/Home.kt", 11, "Pill")].qualified_symbol == "design.kit.Chip"

    styles = sorted((r.line, r.value, r.context) for r in out["hardcoded_style_sites"].collect())
    assert styles == [(11, "8.dp", "padding"), (17, "2", "elevation")]
    tokens = sorted((r.line, r.key) for r in out["token_sites"].collect())
    assert tokens == [(16, "Theme.size"), (16, "Theme.size.large")]
    assert sorted(r.symbol for r in kotlin.discovered(files).collect()) == ["Home", "Row"]
    assert sorted(r.symbol for r in out["local_components"].collect()) == ["Badge", "Home", "Row"]


SWIFT = {
    "App/Sources/Shop/Home.swift": '''import SwiftUI
import struct Kit.Card
@testable import Extras

struct Home: View {
    let card: Card
    var body: some View {
        VStack(spacing: 12) {
            Card(title: "Chip(no)") { Chip() }
            Kit.Chip().padding(4).shadow(radius: 3)
            Extras.Star { }
            Strange(size: 9)
            Row { }
            Text("x").foregroundStyle(Color("brand")).frame(width: side, height: 2.5)
        }
        // Card()
        let t = Theme.space.large
    }
}

fileprivate struct Row<T>: SwiftUI.View {
    var body: some View { EmptyView() }
}

struct Model { let body: Int }
struct Bare: View { }

func Banner(_ n: Int) -> some View { Card() }

#Preview("x") { Home().padding(7) }
''',
    "Tool.swift": "import Foundation\nfunc run() { Card(); Widget() }\n",
}


def test_swift(spark):
    files = table(spark, "swift", SWIFT)
    aliases = registry(spark, "swift", [("Card", "Card", "Kit"), ("Chip", "Chip", "Kit"), ("Star", "Star", "Kit")])
    out = scan.scan_swift(files, aliases, token_keys(spark, "swift", ["Theme.space", "Theme.space.large", "large"]))
    got = {(r.file[-10:], r.line, r.symbol): r for r in out["usage_sites"].collect()}
    status = {k: v.match_status for k, v in got.items()}
    assert status == {
        ("Home.swift", 9, "Card"): "resolved", ("Home.swift", 9, "Chip"): "candidate", ("Home.swift", 10, "Chip"): "resolved",
        ("Home.swift", 11, "Star"): "unresolved", ("Home.swift", 12, "Strange"): "unresolved", ("Home.swift", 13, "Row"): "local",
        ("Home.swift", 28, "Card"): "resolved", ("Tool.swift", 2, "Card"): "unresolved"}
    assert got[("Home.swift", 9, "Card")].parent_id == "swiftui:view:Shop#Home"
    assert got[("Home.swift", 28, "Card")].parent_symbol == "Banner"
    styles = sorted((r.line, r.value, r.context) for r in out["hardcoded_style_sites"].collect())
    assert styles == [(8, "12", "gap"), (10, "3", "elevation"), (10, "4", "padding"), (14, '2.5', "height"), (14, 'Color("brand")', "color")]
    assert [(r.line, r.key) for r in out["token_sites"].collect()] == [(17, "Theme.space.large")]
    assert sorted(r.symbol for r in out["local_components"].collect()) == ["Banner", "Home", "Row"]
    assert sorted((r.symbol, r.package) for r in swift.discovered(files).collect()) == [("Banner", "Shop"), ("Home", "Shop")]


REACT = {
    "src/App.tsx": '''import Deflt, { Card, Chip as Pill } from "@kit/core";
import * as Kit from "@kit/core/all";
import type { Props } from "./types";
import { Wrapped, Fancy } from "./parts";
import { Ghost } from "./nowhere";
import { Other } from "elsewhere";
import { Near } from "~/near";
// import { Fake } from "./fake";

export function App({ items, as: Shadow }: Props): JSX.Element {
  const note = "<Card />";
  const list = useMemo<Card>(() => [], []);
  function inner() { const Fancy = pick(); return <Fancy />; }
  return (
    <Kit.Panel title={`<Card/>`} style={{ padding: 4, margin: "1px 2px", ...rest, color: `red`, width: w, height: -3, nested: { gap: 1 }, "borderRadius": 2 }}>
      <Card tone={theme.color.main}>
        {items.map((i) => <Pill key={i} />)}
        <Wrapped /> <Fancy /> <Ghost /> <Other /> <Near /> <Loose /> <Shadow /> <App />
      </Card>
    </Kit.Panel>
  );
}

const Hidden = () => null;
export const Memo = React.memo(App);
export const Ref = forwardRef((p, ref) => { return null; });
class Old extends React.Component { render() { return <Deflt />; } }
export default Hidden;
''',
    "src/parts/index.ts": 'export { Wrapped } from "./wrapped";\nimport { Inner } from "./inner";\nexport { Inner as Fancy };\n',
    "src/parts/wrapped.tsx": "export const Wrapped = () => <b/>;\n",
    "src/parts/inner.jsx": "export function Inner() { return cond ? <i/> : null; }\n",
    "lib/near.js": "export function Near() { const x = <u/>; return x; }\n",
    "kit/all.ts": "export function Panel() { return null; }\n",
}
CONFIG = rs.ModuleConfig(aliases={"~/*": ["lib/*"], "~/never": ["none"]}, packages={"@kit/core": {"./all": "kit/all.ts"}})


def test_react(spark):
    files = table(spark, "react", REACT)
    aliases = registry(spark, "react", [("Card", "Card", "@kit/core"), ("Chip", "Chip", "@kit/other"), ("Panel", "Panel", "@kit/core"), ("Ghost", "Ghost", None), ("Loose", "Loose", "@kit/core")])
    out = scan.scan_react(files, aliases, token_keys(spark, "react", ["theme.color", "theme.color.main"]), CONFIG)
    got = {(r.line, r.symbol): r for r in out["usage_sites"].collect()}
    assert {k: v.match_status for k, v in got.items()} == {
        (15, "Kit.Panel"): "resolved", (16, "Card"): "resolved", (17, "Pill"): "unresolved",
        (18, "Wrapped"): "local", (18, "Fancy"): "local", (18, "Ghost"): "resolved", (18, "Near"): "local",
        (18, "Loose"): "candidate", (27, "Deflt"): "unresolved"}
    assert got[(18, "Wrapped")].local_definition_id == "react:component:src/parts/wrapped#Wrapped"
    assert got[(18, "Fancy")].local_definition_id == "react:component:src/parts/inner#Inner"
    assert got[(18, "Near")].local_definition_id == "react:component:lib/near#Near"
    assert got[(17, "Pill")].qualified_symbol == "@kit/core#Chip"
    assert got[(16, "Card")].parent_id == "react:component:src/App#App"
    assert got[(27, "Deflt")].parent_symbol == "Old"

    styles = sorted((r.context, r.value) for r in out["hardcoded_style_sites"].collect())
    assert styles == [("color", "`red`"), ("height", "-3"), ("margin", '"1px 2px"'), ("padding", "4"), ("radius", "2")]
    assert sorted(r.key for r in out["token_sites"].collect()) == ["theme.color", "theme.color.main"]
    assert sorted(r.symbol for r in out["local_components"].collect()) == ["App", "Inner", "Memo", "Near", "Old", "Ref", "Wrapped"]
    flagged = sorted((r.code, r.name) for r in out["diagnostics"].collect())
    assert flagged == [("ds_import_unresolved", n) for n in ("Card", "Deflt", "Ghost", "Pill")]


def test_all_languages_in_one_scan(spark):
    files = table(spark, "compose", KOTLIN).unionByName(table(spark, "swift", SWIFT)).unionByName(table(spark, "react", REACT))
    aliases = registry(spark, "compose", [("Card", "Card", "design.kit")]).unionByName(registry(spark, "swift", [("Card", "Card", "Kit")]))
    out = scan.scan(files, aliases, token_keys(spark, "react", ["theme.color"]))
    counts = {r.language: r["count"] for r in out["local_components"].groupBy("language").count().collect()}
    assert counts == {"compose": 3, "swift": 3, "react": 7}
    assert {r.language for r in out["usage_sites"].select("language").distinct().collect()} == {"compose", "swift", "react"}


@pytest.mark.parametrize("file, spec, want", [
    ("src/a/b.ts", "./c", "src/a/c"), ("src/a/b.ts", "../x/./y", "src/x/y"), ("a.ts", "../../z", None), ("a.ts", "./", "")])
def test_relative_paths(spark, file, spec, want):
    folder = file[: file.rfind("/") + 1]
    row = spark.createDataFrame([(folder + spec,)], "p string").select(rs.normalize_path(F.col("p")).alias("x")).first()
    assert row.x == want


def test_probe_order(spark):
    files = table(spark, "react", {p: "" for p in ("s/m.tsx", "s/m.ts", "s/m/index.ts", "s/n/index.jsx", "s/k.js", "deep/q.ts", "wide/deep/q.ts")})
    refs = spark.createDataFrame(
        [("r", "s", "react", "s/x.ts", spec, "") for spec in ("./m", "./n", "./k.js", "./k.ts", "d/q", "d/deep/q")],
        "repo_id string, snapshot_id string, language string, file string, specifier string, symbol string")
    config = rs.ModuleConfig(aliases={"d/*": ["wide/*"], "d/deep/*": ["deep/*"]}, ts_base_url="wide", ts_paths={"d/*": ["deep/*"]})
    got = {r.specifier: r.source_module for r in rs.resolve_specifiers(refs, files, config).collect()}
    assert got == {"./m": "s/m.ts", "./n": "s/n/index.jsx", "./k.js": "s/k.js", "./k.ts": None, "d/q": "wide/deep/q.ts", "d/deep/q": "deep/q.ts"}


def test_any_number_of_blanks_behind_a_keyword(spark):
    files = table(spark, "compose", {"a/A.kt": "@Composable\nfun S() {\n  class      Foo(val x: Int)\n  val y = x as      Bar { }\n  Btn()\n}\n"})
    assert [r.symbol for r in kotlin.calls(files).collect()] == ["Btn"]
    files = table(spark, "swift", {"A.swift": "struct S: View {\n  var body: some View {\n    let y = x as      Bar {\n    }\n    Btn()\n  }\n}\n"})
    assert [r.symbol for r in swift.calls(files).collect()] == ["Btn"]


def test_sources_with_gaps_are_reported_and_still_read(spark):
    rows = [("compose", "app/A.kt", "package a\n@Composable\nfun Screen() {\n    Btn(onClick = {})\n}\nfun Broken(\n"),
            ("compose", "app/B.kt", "package a\n@Composable\nfun Fine() { Btn() }\n"),
            ("swift", "app/V.swift", 'import SwiftUI\nstruct S: View { var body: some View { Btn() } }\nlet a = "x\n'),
            ("react", "src/F.tsx", "export function F() {\n  return <Btn />;\n}\n/* open\n"),
            ("react", "src/Empty.tsx", ""), ("react", "src/None.tsx", None)]
    files = spark.createDataFrame([("r", "s", *r) for r in rows], "repo_id string, snapshot_id string, language string, path string, content string")
    none = spark.createDataFrame([], "repo_id string, language string, call_symbol string, registry_symbol string, registry_package string")
    keys = spark.createDataFrame([], "repo_id string, language string, match_key string, token_id string, category string")
    facts = scan.scan(files, none, keys)
    gaps = {(r["file"], r["line"], r["col"], r["message"].split("(")[1].split(")")[0]) for r in facts["diagnostics"].filter("code = 'parse_failed'").collect()}
    assert gaps == {("app/A.kt", 6, 11, "open bracket"), ("app/V.swift", 3, 9, "open literal"), ("src/F.tsx", 4, 1, "open comment")}
    runs = {r["language"]: (r["files_scanned"], r["status"], r["raw_total"], r["local_definition_count"]) for r in scan.measure(facts).collect()}
    assert runs == {"compose": (2, "partial", 2, 2), "swift": (1, "partial", 1, 1), "react": (3, "partial", 0, 1)}
    empty = scan.measure(scan.scan(files.limit(0), none, keys))
    assert empty.count() == 0


def test_react_modules_parse_once(spark, monkeypatch):
    """Imports, exports and the places they lead to read one written parse."""
    plans, write = [], scan.materialize
    monkeypatch.setattr(scan, "materialize", lambda df, *by: (plans.append(df._jdf.queryExecution().toString()), write(df, *by))[1])
    files = table(spark, "react", {
        "src/a/x.tsx": 'import { P } from "../p";\n', "src/a/y.tsx": 'import { P } from "../p";\n', "z.tsx": 'import { P } from "./src/p";\n',
        "src/p.ts": 'export { P } from "./q";\n', "src/q.tsx": "export function P() { return <A />; }\n"})
    imports, exports = scan.react_modules(files, rs.ModuleConfig())
    assert sum("MapInArrow" in p for p in plans) == 1
    assert sorted((r.file, r.source_module) for r in imports.collect()) == [("src/a/x.tsx", "src/p.ts"), ("src/a/y.tsx", "src/p.ts"), ("z.tsx", "src/p.ts")]
    assert [(r.file, r.source_module) for r in exports.collect() if r.kind == "reexport"] == [("src/p.ts", "src/q.tsx")]


def test_react_calls_are_read_once_to_be_classified(spark):
    files = table(spark, "react", REACT)
    aliases = registry(spark, "react", [("Card", "Card", "@kit/core"), ("Panel", "Panel", "@kit/core")])
    imports, exports = scan.react_modules(files, CONFIG)
    calls = scan.materialize(react.calls(files))
    facts = scan.materialize(react.definitions(files)), scan.materialize(react.declared(files))
    usage = rs.classify_react(calls, imports, exports, *facts, aliases, CONFIG, scan.materialize)
    plan = usage._jdf.queryExecution().optimizedPlan().toString()
    # names, members and places are written down: no second copy of the calls meets the first
    assert sum("Relation" in line and "parent_id" in line for line in plan.splitlines()) == 1
    assert {(r.line, r.symbol) for r in usage.collect()} >= {(15, "Kit.Panel"), (16, "Card"), (18, "Wrapped")}


def test_parses_keep_no_text_that_nothing_reads(spark):
    assert not {"content", "code"} & set(kotlin.with_scopes(table(spark, "compose", KOTLIN)).columns)
    assert not {"content", "skeleton", "commas"} & set(react.with_scopes(table(spark, "react", REACT)).columns)


def test_registry_of_files_is_asked_without_the_files(spark):
    for rows in code_files.registry_of(table(spark, "react", REACT)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" in plan and "Aggregate" not in plan


def test_texts_are_parsed_once(spark):
    """What is left to run after a table was asked for reads no texts a second time."""
    def parses(df):
        return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")

    files = table(spark, "swift", SWIFT)
    found = swift.token_sites(files, token_keys(spark, "swift", ["Theme.space", "Theme.space.large", "large"]))
    assert parses(found) <= 1
    assert [(r.line, r.key) for r in found.collect()] == [(17, "Theme.space.large")]

    files = table(spark, "react", {"src/a.tsx": "export const Row = () => <div />;\nconst Own = () => <p />;\nexport default Own;\nexport const size = 3;\n"})
    packages = spark.createDataFrame([("r", "s", "src/a.tsx", "kit")], "repo_id string, snapshot_id string, file string, package string")
    found = react.discovered(files, packages)
    assert parses(found) <= 1
    assert sorted((r.symbol, r.package) for r in found.collect()) == [("Own", "kit"), ("Row", "kit")]
