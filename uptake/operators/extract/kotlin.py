"""Compose facts from Kotlin sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.identity import kotlin_package
from ...functions.lexing import arguments, close_of, element_at, once, place, statement_end, with_bytes
from ...functions.text import find_all, let
from ...schemas import KEYS
from .common import (
    COLUMNS, FILE, PARENT_FIELDS, around, chain_candidates, hits, inner, parent_columns, parsed, sites, style_rows, token_rows, tree,
)

LANGUAGE = "compose"
# Arguments of annotations are blank in the skeleton.
_MODIFIER = (
    r"(?:@[\w.:]++\s*+|(?:public|private|internal|protected|inline|override|suspend|open|abstract|final"
    r"|operator|tailrec|infix|external|expect|actual)\s++)")
_NAME = r"\bfun\s++(?:<[^>{}()]*+>\s*+)?(?:\w++(?:<[^>{}()]*+>)?\??\.)*+"
# A function head up to its parameters, and what stands between them and its body.
FUNCTION = rf"(?=[@a-z])(?<!\w){_MODIFIER}*+{_NAME}\w++\s*+\("
BODY = r"(?:\s*+:\s*+[^={}\n]*+)?\s*+(?:\{|=(?!=))"
LAMBDA = r"@Composable\s*+\{"
# A cheap look at the first letter spares the look-behinds almost everywhere.
# A declared, tested or annotated name is matched together with what makes it one, and dropped.
_NO_CALL = r"(?=[a-z:])(?:(?<![\w.@])(?:fun|class|object|interface|is|as|import|package)\s++|(?<!\?):\s*+)[A-Z]\w*+"
CALL = rf"{_NO_CALL}|(?=[A-Z])(?<![\w.@])[A-Z]\w*+(?=(?:<[^<>(){{}}]*+>)?[ \t]*+[({{])"
IMPORT = r"(?m)^[ \t]*+import[ \t]++\w++(?:\.\w++)*+(?:\.\*)?(?:[ \t]++as[ \t]++\w++)?"

# Names with a type (parameters, variables, results) and the type itself, which are no references.
TYPED = (
    r"(?=[A-Za-z_:])(?:(?<![\w.@])[A-Za-z_]\w*+\s*+:(?!:)(?:\s*+[A-Za-z_][\w.]*+)?|(?<![?:]):(?!:)\s*+[A-Za-z_][\w.]*+"
    r"|(?<![\w.@])(?:is|as)\??\s++[A-Za-z_][\w.]*+)")

# Styling calls with category and context.
STYLE_CALLS = {
    "Color": ("color", "color"), "background": ("color", "color"),
    "padding": ("spacing", "padding"), "size": ("spacing", "size"),
    "width": ("spacing", "width"), "height": ("spacing", "height"),
    "spacedBy": ("spacing", "gap"),
    "fontSize": ("typography", "typography"), "TextStyle": ("typography", "typography"),
    "clip": ("radius", "radius"), "cornerRadius": ("radius", "radius"), "RoundedCornerShape": ("radius", "radius"),
    "shadow": ("elevation", "elevation"), "elevation": ("elevation", "elevation"),
}


def lookup(table: dict, name: Column, field: int) -> Column:
    """A small fixed table as a map expression."""
    pairs = [F.lit(x) for k, v in table.items() for x in (k, v[field])]
    return F.try_element_at(F.create_map(*pairs), name)


def is_component_name(name: Column) -> Column:
    return name.rlike(r"\A[A-Z]") & ~name.rlike(r"\AProvide") & ~name.rlike(r"Effect\z")


def with_scopes(files: DataFrame) -> DataFrame:
    """Functions and composable lambdas of every file, in source order."""
    if "scopes" in files.columns:
        return files
    base = once(parsed(files, LANGUAGE).drop("content", "code"), package=kotlin_package(F.col("masked")),
                heads=find_all(F.col("skeleton"), f"{FUNCTION}|{LAMBDA}"), bodies=find_all(F.col("masked"), r"\)", BODY))

    def read(h):
        head, opener = h["text"], h["start"] + F.octet_length(h["text"]) - 1
        return F.struct(
            h["start"].alias("start"), opener.alias("opener"), F.endswith(head, F.lit("{")).alias("is_lambda"),
            close_of(F.col("parens"), opener).alias("close"),
            F.regexp_extract(head, rf"(?s)\A(.*?{_NAME})\w", 1).alias("before"),
            F.regexp_extract(head, rf"(?s)\A.*?{_NAME}(\w++)", 1).alias("name"))

    def bounded(r):
        def ended(body):
            stop = r["close"] + F.octet_length(body)  # the brace or the equals sign
            return (
                F.when(r["is_lambda"], close_of(F.col("braces"), r["opener"]) + 1)
                .when(F.endswith(body, F.lit("{")), close_of(F.col("braces"), stop) + 1)
                .when(F.endswith(body, F.lit("=")), statement_end(stop))
                .otherwise(r["close"] + 1))

        body = element_at(F.col("bodies"), r["close"], lambda b: b["start"])["tail"]
        return F.struct(*[r[c].alias(c) for c in ("name", "start", "before")], let(body, ended).alias("end"))

    def placed(r):
        # Annotations and modifiers stand before the name; a lambda has only them.
        marks = F.when(r["name"] == "", F.lit("@Composable")).otherwise(r["before"])
        return F.struct(
            r["name"].alias("name"), r["start"].alias("start"), marks.alias("marks"), r["end"].alias("end"),
            place(F.col("ends"), r["start"] + F.octet_length(r["before"])).alias("at"))

    def scope(r):
        marks = r["marks"]
        return F.struct(
            r["name"].alias("name"), r["start"].alias("start"),
            F.coalesce(r["end"], F.octet_length(F.col("masked")).cast("bigint")).alias("end"),
            marks.rlike(r"@(?:[\w.]+\.)?Composable\b").alias("composable"),
            marks.rlike(r"@(?:[\w.]+\.)?Preview\b").alias("preview"),
            marks.rlike(r"\b(?:private|internal)\b").alias("hidden"),
            r["at"]["line"].alias("line"), r["at"]["col"].alias("col"), (r["name"] == "").alias("is_lambda"))

    scoped = once(base, scopes=F.transform(F.transform(F.transform(F.transform("heads", read), bounded), placed), scope)).drop("heads", "bodies")
    composables = F.filter("scopes", lambda s: s["composable"])
    return once(scoped, every=tree(F.col("scopes")), parents=tree(F.filter(composables, lambda s: s["name"].rlike(r"\A[A-Z]"))),
                previews=tree(F.filter(composables, lambda s: s["preview"])))


def _shown(pos: Column) -> Column:
    """Whether a place is in no preview."""
    return inner(F.col("previews"), pos).isNull()


def _qualified(name: Column) -> Column:
    return F.concat_ws(".", F.col("package"), name)


def _parent(pos: Column) -> dict:
    p = F.col("_parent")
    return parent_columns(
        p, F.concat(F.lit("compose:composable:"), _qualified(p["name"])),
        F.when(F.col("package").isNotNull(), _qualified(p["name"])), "composable",
        F.lit("package_qualified_symbol"), F.lit("semantic"))


def _near(h: Column) -> Column:
    """J01 inside the row: the nearest composable with an upper-case name."""
    return inner(F.col("parents"), h["start"])


def calls(files: DataFrame) -> DataFrame:
    """X11 with X18 and X19: component calls inside composables, without previews."""
    named = F.filter(find_all(F.col("masked"), CALL), lambda h: is_component_name(h["text"]) & _shown(h["start"]))
    found = sites(with_scopes(files), named, "package", _parent=_near, _inner=lambda h: inner(F.col("every"), h["start"]))
    ui = found.filter(F.col("_inner.is_lambda") | (F.col("_inner.composable") & ~F.col("_inner.preview")))
    direct = ui.withColumn("_parent", F.when(~F.col("_inner.is_lambda"), F.col("_parent")))
    return direct.withColumns(_parent(F.col("start"))).select(
        *FILE, "package", "line", "col", F.col("text").alias("symbol"), *PARENT_FIELDS)


def definitions(files: DataFrame) -> DataFrame:
    """Composables that are components."""
    ends = F.array_sort(F.transform("scopes", lambda s: s["end"]))
    rows = once(with_scopes(files), _ends=ends).select(*FILE, "package", F.explode(F.transform(
        F.filter("scopes", lambda s: s["composable"] & ~s["preview"] & is_component_name(s["name"]) & _shown(s["start"])),
        lambda s: s.withField("depth", around(F.col("scopes"), F.col("_ends"), s["start"], lambda o: o["start"])))).alias("s"))
    kept = rows
    qualified = _qualified(F.col("s.name"))
    return kept.select(
        *KEYS, F.concat(F.lit("local.compose:"), qualified).alias("id"), F.col("s.name").alias("symbol"),
        qualified.alias("qualified_symbol"), F.lit("package_qualified_symbol").alias("identity_basis"),
        F.lit("semantic").alias("identity_stability"), F.col("path").alias("file"),
        F.col("s.line").alias("line"), F.col("s.col").alias("col"), F.col("s.hidden").alias("hidden"),
        F.col("package"), F.col("s.depth").alias("depth"),
    )


def imports(files: DataFrame) -> DataFrame:
    """Named and wildcard imports with their package."""
    rows = hits(parsed(files, LANGUAGE), IMPORT)
    target = F.regexp_extract("text", r"import[ \t]+([\w.]+?)(?:\.\*)?(?:[ \t]|\z)", 1)
    wildcard = F.endswith("text", F.lit(".*"))
    alias = F.regexp_extract("text", r"[ \t]as[ \t]+(\w+)\z", 1)
    symbol = F.substring_index(target, ".", -1)
    package = F.when(wildcard, target).otherwise(F.regexp_replace(target, r"\.?\w+\z", ""))
    return rows.select(
        *KEYS, F.col("path").alias("file"), F.when(wildcard, "wildcard").otherwise("named").alias("imported_kind"),
        F.when(~wildcard, F.when(alias != "", alias).otherwise(symbol)).alias("local_name"),
        F.when(~wildcard, symbol).alias("imported_symbol"), package.alias("package"), "start",
    ).filter(F.col("package") != "")


def style_sites(files: DataFrame) -> DataFrame:
    """The first literal of a styling call's own arguments."""
    names = "|".join(STYLE_CALLS)
    number = r"(?<![\w.])(?:0[xX][0-9A-Fa-f_]++|[0-9][0-9_]*+(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?[fFLuU]*+)"
    literal = {
        "color": number,
        "typography": rf"{number}(?:\.sp\b|(?!\.\w))",
        "other": rf"{number}(?:\.dp\b|(?!\.\w))",
    }

    def called(h, raw):
        opener = h["start"] + F.octet_length(h["text"]) + F.octet_length(h["tail"]) - 1
        return F.struct(
            h["start"].alias("start"), lookup(STYLE_CALLS, h["text"], 0).alias("category"), lookup(STYLE_CALLS, h["text"], 1).alias("context"),
            arguments(opener, close_of(F.col("parens"), opener), raw).alias("args"))

    def valued(c):
        # an argument with a call in it is not a literal of this call
        own = F.filter(c["args"], lambda a: ~a.rlike(r"\w\s*+[({]"))
        values = F.filter(F.transform(own, lambda a: (
            F.when(c["category"] == "color", F.regexp_extract(a, literal["color"], 0))
            .when(c["category"] == "typography", F.regexp_extract(a, literal["typography"], 0))
            .otherwise(F.regexp_extract(a, literal["other"], 0)))), lambda v: v != "")
        return F.struct(*[c[f].alias(f) for f in ("start", "category", "context")], F.try_element_at(values, F.lit(1)).alias("text"))

    calls_ = find_all(F.col("masked"), rf"(?=[A-Za-z])(?<![\w@])(?:{names})", tail=r"\s*+\(")
    styled = F.filter(F.transform(with_bytes(F.col("masked"), lambda raw: F.transform(calls_, lambda h: called(h, raw))), valued), lambda v: v["text"].isNotNull() & _shown(v["start"]))
    rows = sites(with_scopes(files), styled, "package", _parent=_near, category=lambda v: v["category"], context=lambda v: v["context"])
    return style_rows(rows.withColumnRenamed("text", "value").withColumns(_parent(F.col("start"))), LANGUAGE)


def token_sites(files: DataFrame, token_keys: DataFrame) -> DataFrame:
    """Identifier chains that are token keys, outside of previews."""
    found = chain_candidates(with_scopes(files), "package", dropped=TYPED, _parent=_near, _shown=lambda h: _shown(h["start"])).filter("_shown")
    return token_rows(found.withColumns(_parent(F.col("start"))), token_keys, LANGUAGE)


def discovered(files: DataFrame) -> DataFrame:
    """Public top-level components with their package."""
    rows = definitions(files).filter("NOT hidden AND depth = 0")
    return rows.select(
        "repo_id", "language", "symbol", F.col("file").alias("path"),
        (F.col("line") * COLUMNS + F.col("col")).alias("ordinal"), "package")
