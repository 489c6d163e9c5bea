"""SwiftUI facts from Swift sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.identity import swift_module
from ...functions.lexing import byte_slice, close_of, depth_at, element_at, once, place, with_bytes
from ...functions.text import find_all
from ...plans.stages import materialize
from ...schemas import KEYS
from ..intervals import containment_dedupe
from .common import (
    COLUMNS, FILE, PARENT_FIELDS, around, chain_candidates, hits, inner, parent_columns, parsed, sites, style_rows, token_rows, tree,
)
from .kotlin import lookup

LANGUAGE = "swift"
# Arguments of attributes and of previews are blank in the skeleton.
_MODIFIER = r"(?:@\w++\s*+|(?:public|private|fileprivate|internal|open|final|static|override|mutating|nonisolated)\s++)"
STRUCT = rf"(?=[@a-z])(?<!\w){_MODIFIER}*+\bstruct\s++\w++(?:<[^{{}}]*?>)?\s*+:[^{{}}]*+\{{"
# A function head up to its parameters, and what stands between them and its body.
FUNCTION = rf"(?=[@a-z])(?<!\w){_MODIFIER}*+\bfunc\s++\w++(?:<[^(){{}}]*+>)?\s*+\("
BODY = r"[^(){}=]*?->\s*+some\s++(?:SwiftUI\.)?View\b[^(){}]*+\{"
PREVIEW = r"#Preview\s*+\{"
_NAME = r"\b(?:struct|func)\s++"
_NOT_A_CALL = r"(?<![\w@#])(?<!\w\.)"
_CHAIN = r"(?:\w++[?!]?\.)*+"
# A cheap look ahead spares the look-behinds almost everywhere.
_START = r"(?=[A-Z]|\w++[?!]?\.)"
# With a closure only, a name behind a colon, comma or arrow is a type.
# Declared and tested names are matched together with what stands before them, and dropped.
CALL = (
    rf"(?=[a-z])(?<![\w@#])(?:struct|class|enum|extension|protocol|actor|func|case|import|typealias|is|as|some|any)\s++{_CHAIN}[A-Z]\w*+"
    rf"|[:,&>]\s*+{_CHAIN}[A-Z]\w*+(?=[ \t]*+\{{)"
    rf"|{_START}{_NOT_A_CALL}{_CHAIN}[A-Z]\w*+(?=(?:<[^<>(){{}}]*+>)?\()"
    rf"|{_START}{_NOT_A_CALL}{_CHAIN}[A-Z]\w*+(?=[ \t]*+\{{)")
IMPORT = r"(?m)^[ \t]*+(?:@\w++[ \t]++)?import[ \t]++(?:(?:struct|class|enum|protocol|func|var|let|typealias)[ \t]++)?[\w.]++"

# Framework symbols that never count as unresolved components.
FRAMEWORK_SYMBOLS = [
    "AnyView", "Button", "Capsule", "Circle", "Color", "Divider", "Ellipse", "EmptyView", "ForEach", "Form",
    "Group", "HStack", "Image", "Label", "LazyHGrid", "LazyHStack", "LazyVGrid", "LazyVStack", "List",
    "NavigationLink", "NavigationStack", "Picker", "ProgressView", "Rectangle", "RoundedRectangle", "ScrollView",
    "Section", "Slider", "Spacer", "Text", "TextField", "Toggle", "UnevenRoundedRectangle", "VStack", "ZStack",
]
# Styling callees, callees that only take style labels, labels.
STYLE_CALLS = {
    "foregroundStyle": ("color", "color"), "foregroundColor": ("color", "color"), "background": ("color", "color"),
    "padding": ("spacing", "padding"), "frame": ("spacing", "size"), "spacing": ("spacing", "gap"),
    "font": ("typography", "typography"), "fontWeight": ("typography", "typography"),
    "cornerRadius": ("radius", "radius"), "clipShape": ("radius", "radius"), "shadow": ("elevation", "elevation"),
}
LABEL_CALLS = [
    "VStack", "HStack", "ZStack", "LazyVStack", "LazyHStack", "LazyVGrid", "LazyHGrid", "Grid", "GridRow",
    "RoundedRectangle", "UnevenRoundedRectangle", "Rectangle", "Circle", "Ellipse", "Capsule", "system", "custom",
]
STYLE_LABELS = {
    "spacing": ("spacing", "gap"), "width": ("spacing", "width"), "height": ("spacing", "height"),
    "padding": ("spacing", "padding"), "leading": ("spacing", "padding"), "trailing": ("spacing", "padding"),
    "top": ("spacing", "padding"), "bottom": ("spacing", "padding"), "horizontal": ("spacing", "padding"),
    "vertical": ("spacing", "padding"),
    "size": ("typography", "typography"), "weight": ("typography", "typography"), "pointSize": ("typography", "typography"),
    "cornerRadius": ("radius", "radius"), "radius": ("radius", "radius"), "blur": ("elevation", "elevation"),
}


def has_module(path: Column) -> Column:
    """The path names a module, so ids do not depend on the file."""
    return path.rlike(r"(?:\A|/)Sources/[^/]+/[^/]+\z")


def with_scopes(files: DataFrame) -> DataFrame:
    """Views, view functions and previews of every file, in source order."""
    if "scopes" in files.columns:
        return files
    base = once(
        parsed(files, LANGUAGE), module=swift_module(F.col("path")),
        heads=find_all(F.col("skeleton"), f"{STRUCT}|{FUNCTION}|{PREVIEW}"), bodies=find_all(F.col("masked"), r"\)", BODY))

    size = F.octet_length("masked").cast("bigint")

    def read(h):
        head, opener = h["text"], h["start"] + F.octet_length(h["text"]) - 1
        close = F.when(F.endswith(head, F.lit("(")), close_of(F.col("parens"), opener))
        return F.struct(
            h["start"].alias("start"), head.alias("head"), opener.alias("opener"), close.alias("close"),
            element_at(F.col("bodies"), close, lambda b: b["start"])["tail"].alias("body"),
            F.regexp_extract(head, rf"(?s)\A(.*?{_NAME})\w", 1).alias("before"),
            F.regexp_extract(head, rf"(?s)\A.*?{_NAME}(\w++)", 1).alias("name"))

    def bounded(r):
        brace = F.when(F.endswith(r["head"], F.lit("{")), r["opener"]).otherwise(r["close"] + F.octet_length(r["body"]))
        return F.struct(
            *[r[c].alias(c) for c in ("start", "head", "before", "name")], (brace + 1).alias("stop"),
            F.coalesce(close_of(F.col("braces"), brace) + 1, size).alias("end"))

    def placed(r, raw):
        head = r["head"]
        preview = F.startswith(head, F.lit("#Preview"))
        is_struct = r["before"].rlike(r"\bstruct\s++\z")
        inherits = F.regexp_extract(head, r"(?s):([^{}]*+)\{\z", 1).rlike(r"(?:\A|[,&\s])(?:SwiftUI\.)?View\b")
        view = (
            F.when(preview | ~r["name"].rlike(r"\A[A-Z]"), False).when(~is_struct, True).when(~inherits, False)
            .otherwise(byte_slice(raw, r["stop"], r["end"] - r["stop"]).rlike(r"\bvar\s++body\b")))
        return F.struct(
            r["name"].alias("name"), r["start"].alias("start"), r["end"].alias("end"), preview.alias("preview"),
            view.alias("view"), r["before"].rlike(r"\b(?:private|fileprivate)\b").alias("hidden"),
            place(F.col("ends"), r["start"] + F.octet_length(r["before"])).alias("at"))

    def scope(r):
        return F.struct(
            *[r[c].alias(c) for c in ("name", "start", "end", "preview", "view", "hidden")],
            r["at"]["line"].alias("line"), r["at"]["col"].alias("col"))

    known = F.filter(F.transform(F.transform("heads", read), bounded), lambda r: r["stop"].isNotNull())
    scoped = once(base, scopes=with_bytes(F.col("masked"), lambda raw: F.transform(F.transform(known, lambda r: placed(r, raw)), scope))).drop("heads", "bodies")
    return once(scoped, views=tree(F.filter("scopes", lambda s: s["view"])), previews=tree(F.filter("scopes", lambda s: s["preview"])))


def _shown(pos: Column) -> Column:
    """Whether a place is in no preview."""
    return inner(F.col("previews"), pos).isNull()


def _identity() -> tuple[Column, Column]:
    semantic = has_module(F.col("path"))
    return (
        F.when(semantic, "module_qualified_symbol").otherwise("module_path_and_symbol"),
        F.when(semantic, "semantic").otherwise("path_sensitive"),
    )


def _view(h: Column) -> Column:
    """J01 inside the row: the innermost view."""
    return inner(F.col("views"), h["start"])


def _with_parent(df: DataFrame) -> DataFrame:
    p, (basis, stability) = F.col("_parent"), _identity()
    return df.withColumns(parent_columns(
        p, F.concat(F.lit("swiftui:view:"), "module", F.lit("#"), p["name"]),
        F.concat("module", F.lit("."), p["name"]), "view", basis, stability))


def calls(files: DataFrame) -> DataFrame:
    """Capitalised calls with the root of their qualifier."""
    def named(h):
        symbol = F.substring_index(h["text"], ".", -1)
        return F.struct((h["start"] + F.octet_length(h["text"]) - F.octet_length(symbol)).alias("start"), symbol.alias("text"),
                        F.when(F.contains(h["text"], F.lit(".")), F.regexp_extract(h["text"], r"\A(\w+)", 1)).alias("qualifier"))

    found = F.filter(find_all(F.col("masked"), CALL), lambda h: h["text"].rlike(r"\A\w") & ~h["text"].rlike(r"\s"))
    shown = F.filter(F.transform(found, named), lambda h: _shown(h["start"]))
    rows = sites(with_scopes(files), shown, "module", _parent=_view, qualifier=lambda h: h["qualifier"])
    return _with_parent(rows).select(*FILE, "module", "line", "col", F.col("text").alias("symbol"), "qualifier", *PARENT_FIELDS)


def definitions(files: DataFrame) -> DataFrame:
    """Views and view functions."""
    ends = F.array_sort(F.transform("braces", lambda b: b["close"]))
    rows = once(with_scopes(files), _ends=ends).select(*FILE, "module", F.explode(F.transform(
        F.filter("scopes", lambda s: s["view"]),
        lambda s: s.withField("depth", around(F.col("braces"), F.col("_ends"), s["start"], lambda b: b["open"])))).alias("s"))
    basis, stability = _identity()
    return rows.select(
        *KEYS, F.concat(F.lit("local.swift:"), "module", F.lit("#"), F.col("s.name")).alias("id"),
        F.col("s.name").alias("symbol"), F.concat("module", F.lit("."), F.col("s.name")).alias("qualified_symbol"),
        basis.alias("identity_basis"), stability.alias("identity_stability"),
        F.col("path").alias("file"), F.col("s.line").alias("line"), F.col("s.col").alias("col"),
        F.col("s.hidden").alias("hidden"), F.col("module"),
        F.col("s.depth").alias("depth"))


def imports(files: DataFrame) -> DataFrame:
    """Module imports and symbol imports."""
    rows = hits(parsed(files, LANGUAGE), IMPORT)
    target = F.regexp_extract("text", r"([\w.]+)\z", 1)
    dotted = F.contains(target, F.lit("."))
    return rows.select(
        *KEYS, F.col("path").alias("file"), F.when(dotted, "named").otherwise("module").alias("imported_kind"),
        F.when(dotted, F.substring_index(target, ".", -1)).alias("local_name"),
        F.when(dotted, F.substring_index(target, ".", -1)).alias("imported_symbol"),
        F.when(dotted, F.regexp_replace(target, r"\.\w+\z", "")).otherwise(target).alias("package"), "start")


def style_sites(files: DataFrame) -> DataFrame:
    """Labelled and bare literals of styling calls, ``Color(...)`` as a whole."""
    names = "|".join(["Color", *STYLE_CALLS, *LABEL_CALLS])
    number = r"(?<![\w.])[0-9][0-9_]*+(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?(?![\w.])"
    string = r'"(?:[^"\\\n]|\\.)*+"'
    literal = rf"(?:\w++\s*+:\s*+)?(?:{number}|{string})"

    def called(h):
        opener = h["start"] + F.octet_length(h["text"])
        return F.struct(h["start"].alias("start"), h["text"].alias("callee"), opener.alias("at"), close_of(F.col("parens"), opener).alias("close"))

    def read(c, raw):
        # Literals are searched in the raw text, so that strings are seen; those in deeper brackets belong to others.
        inside = byte_slice(raw, c["at"] + 1, c["close"] - c["at"] - 1)

        def own(p):
            label = F.regexp_extract(p["text"], r"\A([A-Za-z_]\w*)\s*:", 1)
            lead = F.regexp_extract(p["text"], r"\A([A-Za-z_]\w*\s*:\s*)?", 0)
            return F.struct((c["at"] + 1 + p["start"] + F.octet_length(lead)).alias("start"), F.substr(p["text"], F.char_length(lead) + 1).alias("text"),
                            c["callee"].alias("callee"), label.alias("label"))

        literals = F.filter(F.transform(find_all(inside, literal), own), lambda p: depth_at(p["start"]) == depth_at(c["at"]))
        whole = F.struct(c["start"].alias("start"), F.concat(F.lit("Color"), byte_slice(raw, c["at"], c["close"] - c["at"] + 1)).alias("text"),
                         c["callee"].alias("callee"), F.lit("").alias("label"))
        return F.when(c["callee"] == "Color", F.array(whole)).otherwise(literals)

    calls_ = find_all(F.col("masked"), rf"(?=[A-Za-z])(?<![\w@])(?:{names})", tail=r"\(")
    closed = F.filter(F.transform(calls_, called), lambda c: c["close"].isNotNull())
    found = F.filter(F.flatten(with_bytes(F.col("content"), lambda raw: F.transform(closed, lambda c: read(c, raw)))), lambda p: _shown(p["start"]))
    rows = sites(with_scopes(files), found, "module", _parent=_view, callee=lambda p: p["callee"], label=lambda p: p["label"])

    def meta(field: int) -> Column:
        own, by_label = lookup(STYLE_CALLS, F.col("callee"), field), lookup(STYLE_LABELS, F.col("label"), field)
        # The radius of a shadow is depth, not rounding.
        depth = (F.col("label") == "radius") & (F.col("callee") == "shadow")
        return F.when(depth, own).otherwise(F.coalesce(by_label, own))

    def of_color(field: int) -> Column:
        return F.when(F.col("callee") == "Color", F.lit("color")).otherwise(meta(field))

    valued = rows.withColumnRenamed("text", "value").withColumns({"category": of_color(0), "context": of_color(1)}).filter(
        F.col("category").isNotNull() & ((F.col("category") == "color") | F.col("value").rlike(r"\A[0-9]")))
    return style_rows(_with_parent(valued), LANGUAGE)


def token_sites(files: DataFrame, token_keys: DataFrame) -> DataFrame:
    """X06 with X07: chains that are token keys; of nested hits the longest."""
    found = chain_candidates(with_scopes(files), "module", _parent=_view, _shown=lambda h: _shown(h["start"])).filter("_shown")
    keys = token_keys.select("repo_id", "language", F.col("match_key").alias("text")).distinct()
    # written down, as the ranges are read twice and each time would parse the files
    known = materialize(found.join(keys, ["repo_id", "language", "text"], "left_semi"))
    spans = known.withColumns({"start_pos": F.col("start"), "end_pos": F.col("start") + F.octet_length("text") - 1}).drop("start")
    longest = containment_dedupe(spans, FILE)
    return token_rows(_with_parent(longest), token_keys, LANGUAGE)


def discovered(files: DataFrame) -> DataFrame:
    """Non-private top-level views with their module, if the path has one."""
    rows = definitions(files).filter("NOT hidden AND depth = 0")
    return rows.select(
        "repo_id", "language", "symbol", F.col("file").alias("path"),
        (F.col("line") * COLUMNS + F.col("col")).alias("ordinal"),
        F.when(has_module(F.col("file")), F.col("module")).alias("package"))
