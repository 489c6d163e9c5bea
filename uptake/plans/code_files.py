"""Source files written from the line items: one UI file per order.

Orders are dealt to the three languages.  Every line item becomes one component
call with a style literal and a token reference, so the facts that extraction
must find are known from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import KEYS
from ..sources.files import spread
from .stages import materialize

COMPONENTS = 30  # Sym0 .. Sym29 are registered
PACKAGED = 20    # Sym0 .. Sym19 name their package
PANELS = 5

_KOTLIN = """
SELECT concat('repo', CAST(ok % 4 AS STRING)) AS repo_id, 's1' AS snapshot_id, 'compose' AS language,
 concat('app/src/m', CAST(ok % 7 AS STRING), '/F', CAST(ok AS STRING), '.kt') AS path,
 concat('package com.acme.m', CAST(ok % 7 AS STRING), '\\nimport com.acme.ds.Sym', CAST(ok % 50 AS STRING), '\\n',
  CASE WHEN ok % 2 = 0 THEN 'import com.acme.wild.*' ELSE '' END, '\\n// Sym1( "x" ) é\\n@Composable\\nfun Screen', CAST(ok AS STRING), '(title: String) {{\\n',
  listagg(line, '\\n') WITHIN GROUP (ORDER BY rn), '\\n}}\\n\\n@Preview\\n@Composable\\nfun Preview', CAST(ok AS STRING), '() {{\\n    Sym1(Modifier.padding(9.dp))\\n}}\\n\\n@Composable\\nprivate fun Local', CAST(ok % 5 AS STRING), '() {{ Sym2() }}\\n') AS content
FROM (SELECT ok, rn, concat('    ', symbol, '(modifier = Modifier.padding(', CAST(q AS STRING), '.dp), tint = Theme.t', CAST(pk % 60 AS STRING), '.main) // Sym3(') AS line
 FROM (SELECT *, CASE WHEN pk % 50 < 38 THEN concat('Sym', CAST(pk % 50 AS STRING)) ELSE concat('Local', CAST(pk % 5 AS STRING)) END AS symbol FROM {v_items} WHERE ok % 3 = 0) a) b
GROUP BY ok"""

_SWIFT = """
SELECT concat('repo', CAST(ok % 4 AS STRING)) AS repo_id, 's1' AS snapshot_id, 'swift' AS language,
 concat('app/Sources/Mod', CAST(ok % 7 AS STRING), '/V', CAST(ok AS STRING), '.swift') AS path,
 concat('import SwiftUI\\n', CASE WHEN ok % 2 = 0 THEN 'import DesignSystem' ELSE concat('import struct Kit.Sym', CAST(ok % 50 AS STRING)) END,
  '\\n/* Sym1(\\n */\\nstruct Screen', CAST(ok AS STRING), ': View {{\\n    var body: some View {{\\n', listagg(line, '\\n') WITHIN GROUP (ORDER BY rn),
  '\\n    }}\\n}}\\n\\n#Preview {{\\n    Sym1().padding(3)\\n}}\\n\\nstruct Local', CAST(ok % 5 AS STRING), ': View {{\\n    var body: some View {{ Sym2() }}\\n}}\\n') AS content
FROM (SELECT ok, rn, concat('        ', CASE WHEN pk % 4 = 0 THEN 'DS.' ELSE '' END, symbol, '(title: "Sym3(x)", tint: Theme.t', CAST(pk % 60 AS STRING), '.main).padding(', CAST(q AS STRING), ')') AS line
 FROM (SELECT *, CASE WHEN pk % 50 < 38 THEN concat('Sym', CAST(pk % 50 AS STRING)) ELSE concat('Local', CAST(pk % 5 AS STRING)) END AS symbol FROM {v_items} WHERE ok % 3 = 2) a) b
GROUP BY ok"""

_REACT = """
SELECT concat('repo', CAST(ok % 4 AS STRING)) AS repo_id, 's1' AS snapshot_id, 'react' AS language,
 concat('src/m', CAST(ok % 7 AS STRING), '/F', CAST(ok AS STRING), '.tsx') AS path,
 concat('import {{ Sym', CAST(ok % 50 AS STRING), ',\\n  type Sym77 as Alias }} from "@acme/ds";\\nimport {{ Panel', CAST(ok % 5 AS STRING), ' }} from "../lib/p', CAST(ok % 5 AS STRING), '";\\n',
  'export function Screen', CAST(ok AS STRING), '() {{\\n  return (\\n    <div title="<Sym1 />">\\n', listagg(line, '\\n') WITHIN GROUP (ORDER BY rn),
  '\\n    </div>\\n  );\\n}}\\n\\nconst Inner', CAST(ok AS STRING), ' = () => <Panel', CAST(ok % 5 AS STRING), ' />;\\n') AS content
FROM (SELECT ok, rn, concat('      <Sym', CAST(pk % 50 AS STRING), ' style={{{{ padding: ', CAST(q AS STRING), ', color: "#0', CAST(pk % 10 AS STRING), 'f" }}}} tint={{theme.t', CAST(pk % 60 AS STRING), '.main}} />') AS line
 FROM {v_items} WHERE ok % 3 = 1) b
GROUP BY ok"""

_REACT_RUNS = "SELECT DISTINCT concat('repo', CAST(ok % 4 AS STRING)) AS repo_id, 's1' AS snapshot_id, 'react' AS language FROM {v_items} WHERE ok % 3 = 1"


# Files that brackets, comments and literals make hard to read.  ``depth`` calls stand inside each other.
_HARD = {
    "compose": """
SELECT concat('repo', CAST(ok % 4 AS STRING)) AS repo_id, 's1' AS snapshot_id, 'compose' AS language, concat('hard/K', CAST(ok AS STRING), '.kt') AS path,
 concat('package com.acme.h\n/* a /* b */ Sym1() */\n@Composable\nfun Deep', CAST(ok AS STRING), '(t: String = ', repeat('id(', CAST(ok % 25 AS INT)), '"("', repeat(')', CAST(ok % 25 AS INT)), ') {{\n',
  listagg(line, '\n') WITHIN GROUP (ORDER BY rn), '\n}}\n\n@Composable\nfun Body', CAST(ok AS STRING), '() = if (ok) Sym2() else\n  Sym3(id({{ x -> "$x" }}))\nval free = Sym4()\n') AS content
FROM (SELECT ok, rn, concat('    val v = "${{Sym', CAST(pk % 50 AS STRING), '(', repeat('id(', CAST(pk % 25 AS INT)), '"}}"', repeat(')', CAST(pk % 25 AS INT)), ')}}"') AS line FROM {v_items} WHERE ok % 3 = 0) a
GROUP BY ok""",
    "swift": """
SELECT concat('repo', CAST(ok % 4 AS STRING)) AS repo_id, 's1' AS snapshot_id, 'swift' AS language, concat('App/Sources/Hard/V', CAST(ok AS STRING), '.swift') AS path,
 concat('import SwiftUI\n/* a /* b */ Sym1() */\nstruct Deep', CAST(ok AS STRING), ': View {{\n    let s = #"Sym2("x") \\\\(Sym3())"#\n    var body: some View {{\n',
  listagg(line, '\n') WITHIN GROUP (ORDER BY rn), '\n    }}\n}}\n\nfunc Banner', CAST(ok AS STRING), '(_ n: Int = ', repeat('id(', CAST(ok % 25 AS INT)), '1', repeat(')', CAST(ok % 25 AS INT)), ') -> some View {{ Sym4() }}\n') AS content
FROM (SELECT ok, rn, concat('        Text("\\\\(Sym', CAST(pk % 50 AS STRING), '(title: "}} " + ', repeat('id(', CAST(pk % 25 AS INT)), '"x"', repeat(')', CAST(pk % 25 AS INT)), '))")') AS line FROM {v_items} WHERE ok % 3 = 2) a
GROUP BY ok""",
    "react": """
SELECT concat('repo', CAST(ok % 4 AS STRING)) AS repo_id, 's1' AS snapshot_id, 'react' AS language, concat('hard/F', CAST(ok AS STRING), '.tsx') AS path,
 concat('export function Deep', CAST(ok AS STRING), '({{ a = ', repeat('id(', CAST(ok % 25 AS INT)), '/[{{("]/', repeat(')', CAST(ok % 25 AS INT)), ' }}) {{\n  return (\n    <div>\n',
  listagg(line, '\n') WITHIN GROUP (ORDER BY rn), '\n    </div>\n  );\n}}\n') AS content
FROM (SELECT ok, rn, concat('      Don\\'t <Sym', CAST(pk % 50 AS STRING), ' v={{`}}${{f(', repeat('id(', CAST(pk % 25 AS INT)), '<Sym1 />', repeat(')', CAST(pk % 25 AS INT)), ')}}`}} /> it\\'s http://x.y/', CAST(ok AS STRING), ' <Sym2 />') AS line FROM {v_items} WHERE ok % 3 = 1) a
GROUP BY ok""",
}


def hard_files(t, language: str) -> DataFrame:
    return spread(t.spark.sql(_HARD[language], v_items=t["v_items"]), t.partitions)


def kotlin_files(t) -> DataFrame:
    return spread(t.spark.sql(_KOTLIN, v_items=t["v_items"]), t.partitions)


def swift_files(t) -> DataFrame:
    return spread(t.spark.sql(_SWIFT, v_items=t["v_items"]), t.partitions)


def react_files(t) -> DataFrame:
    """Screens, and per repository a barrel and an implementation per panel."""
    screens = spread(t.spark.sql(_REACT, v_items=t["v_items"]), t.partitions)
    n = F.explode(F.sequence(F.lit(0), F.lit(PANELS - 1))).alias("n")
    panels = t.spark.sql(_REACT_RUNS, v_items=t["v_items"]).select(*KEYS, n)
    k = F.col("n").cast("string")
    barrels = panels.select(
        *KEYS, F.concat(F.lit("src/lib/p"), k, F.lit(".ts")).alias("path"),
        F.concat(F.lit("export { Panel"), k, F.lit(' } from "./impl/p'), k, F.lit('";\n')).alias("content"))
    bodies = panels.select(
        *KEYS, F.concat(F.lit("src/lib/impl/p"), k, F.lit(".tsx")).alias("path"),
        F.concat(F.lit("export function Panel"), k, F.lit("() {\n  return <Sym0 />;\n}\n")).alias("content"))
    return screens.unionByName(barrels).unionByName(bodies)


# Last lines that open or close what nothing closes or opens.
_BROKEN = {"compose": "}\n", "swift": 'let broken = "abc\n', "react": "const broken = call(\n"}


def all_files(t) -> DataFrame:
    """The files of all languages; those of repo1 in the folders m3 and Mod3 end in a fault."""
    files = kotlin_files(t).unionByName(swift_files(t)).unionByName(react_files(t))
    tail = F.coalesce(*[F.when(F.col("language") == k, F.lit(v)) for k, v in _BROKEN.items()])
    faulty = (F.col("repo_id") == "repo1") & F.col("path").rlike("/(m|Mod)3/")
    return files.withColumn("content", F.when(faulty, F.concat("content", tail)).otherwise(F.col("content")))


def registry_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases and token keys that every repository of the files declares."""
    # written down, so that no join that asks the registry writes the files again
    repos = materialize(files.select("repo_id", "language").distinct())
    n = F.col("n")
    symbol = F.concat(F.lit("Sym"), n.cast("string"))
    package = (
        F.when(F.col("language") == "compose", "com.acme.ds")
        .when(F.col("language") == "swift", "DesignSystem").otherwise("@acme/ds"))
    aliases = repos.select("repo_id", "language", F.explode(F.sequence(F.lit(0), F.lit(COMPONENTS - 1))).alias("n")).select(
        "repo_id", "language", symbol.alias("call_symbol"), symbol.alias("registry_symbol"),
        F.when(n < PACKAGED, package).alias("registry_package"))
    theme = F.when(F.col("language") == "react", "theme.t").otherwise("Theme.t")
    keys = repos.select("repo_id", "language", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("n")).select(
        "repo_id", "language", F.concat(theme, n.cast("string"), F.lit(".main")).alias("match_key"),
        F.concat(F.lit("tok."), n.cast("string")).alias("token_id"), F.lit("color").alias("category"))
    return aliases, keys
