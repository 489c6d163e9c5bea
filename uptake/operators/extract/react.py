"""React facts from JavaScript and TypeScript sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.identity import react_module
from ...functions.lexing import byte_slice, close_of, count_up_to, depth_at, element_at, once, place, statement_end, with_bytes
from ...functions.text import find_all, let
from ...plans.stages import materialize
from ...schemas import KEYS
from .common import (
    COLUMNS, FILE, PARENT_FIELDS, around, chain_candidates, hits, inner, parent_columns, parsed, sites, style_rows, token_rows, tree,
)
from .kotlin import lookup

LANGUAGE = "react"
_ID = r"[A-Za-z_$][\w$]*+"
# Heads reach up to their parameters; what follows the parameters tells a function or an arrow.
_FUNCTION = rf"\bfunction\b\s*+\*?\s*+(?:{_ID})?\s*+(?:<[^(){{}}]*+>)?\s*+\("
_ARROW = rf"(?:async\s++)?(?:(?:<[^(){{}}=]*+>)?\(|{_ID}\s*+=>\s*+[({{]?)"
BODY = r"(?:\s*+:\s*+[^{};=]++)?\s*+\{|(?:\s*+:\s*+[^{}=;()]++)?\s*+=>\s*+[({]?"
_WRAPPER = rf"(?:{_ID}\.)?(?:memo|forwardRef)(?:<[^(){{}}]*+>)?\(\s*+"
_CLASS = rf"\bclass\s++{_ID}[^{{}}]*+\{{"
_BINDING = rf"\b(?:const|let|var)\s++{_ID}\s*+(?::(?:[^=;]|=>)*?)?=(?![=>])\s*+"
HEAD = rf"{_BINDING}(?:{_WRAPPER})?+(?:{_ARROW}|(?:async\s++)?{_FUNCTION}|(?<=\(){_ID}\s*+[,)])|(?:async\s++)?{_FUNCTION}|{_CLASS}"
JSX = r"(?=<[A-Z])(?<![\w)\]$])<[A-Z][\w$]*+(?:\.[\w$]++)*+(?=[\s/>])(?!\s++extends\b)"
_RETURNS = (
    r"(?s)\breturn\b\s*+(?:\(\s*+)*+<[A-Za-z>]|\breturn\b[^;{}]*?(?:\?|&&|\|\||:)\s*+(?:\(\s*+)*+<[A-Za-z>]"
    r"|\b(?:const|let|var)\s++(\w++)\s*+=\s*+(?:\(\s*+)*+<[A-Za-z>].*?\breturn\s++(?:\(\s*+)*+\1\b")
_IS_JSX = r"(?s)\A(?:\s*+\(?)*+\s*+<[A-Za-z>]|(?:\?|&&|\|\|)\s*+(?:\(\s*+)*+<[A-Za-z>]"

# Style properties with category and context.
_SIDES = ["", "Top", "Right", "Bottom", "Left", "Inline", "Block", "InlineStart", "InlineEnd", "BlockStart", "BlockEnd"]
STYLE_PROPS = {
    **{p: ("color", "color") for p in ("color", "backgroundColor", "borderColor")},
    **{f"padding{s}": ("spacing", "padding") for s in _SIDES},
    **{f"margin{s}": ("spacing", "margin") for s in _SIDES},
    **{p: ("spacing", "gap") for p in ("gap", "rowGap", "columnGap")},
    "width": ("spacing", "width"), "height": ("spacing", "height"),
    **{p: ("typography", "typography") for p in ("fontSize", "fontWeight", "lineHeight")},
    "borderRadius": ("radius", "radius"),
    "boxShadow": ("elevation", "elevation"), "shadow": ("elevation", "elevation"),
}


def _parsed(files: DataFrame) -> DataFrame:
    if "module" in files.columns:
        return files
    return once(parsed(files, LANGUAGE).drop("content", "skeleton", "commas"), module=react_module(F.col("path")))


def modules(files: DataFrame) -> DataFrame:
    """What imports and exports are read from: the texts without comments."""
    return _parsed(files).select(*FILE, "code", "module")


def with_scopes(files: DataFrame) -> DataFrame:
    """Functions, classes and component bindings, in source order."""
    if "scopes" in files.columns:
        return files
    base = once(_parsed(files), heads=find_all(F.col("masked"), HEAD), bodies=find_all(F.col("masked"), r"\)", BODY),
                brace_ends=F.array_sort(F.transform("braces", lambda p: p["close"])))
    size = F.octet_length("masked").cast("bigint")

    def read(h):
        head, opener = h["text"], h["start"] + F.octet_length(h["text"]) - 1
        lead = rf"(?s)\A((?:(?:async\s++)?function\s*+\*?|class|const|let|var)\s*+)({_ID})"
        close = F.when(F.endswith(head, F.lit("(")) & ~head.rlike(r"=>\s*\(\z"), close_of(F.col("parens"), opener))
        return F.struct(
            h["start"].alias("head"), head.alias("text"), opener.alias("opener"), close.alias("close"),
            F.endswith(head, F.lit("(")).alias("open"), head.rlike(r"=>\s*[({]?\z").alias("arrow"),
            element_at(F.col("bodies"), close, lambda b: b["start"])["tail"].alias("tail"),
            F.regexp_extract(head, lead, 1).alias("lead"), F.regexp_extract(head, lead, 2).alias("name"),
            F.regexp_extract(head, rf"(?s)\A{_BINDING}", 0).alias("binding"))

    def complete(r):
        """Whether the head is done, or its parameters are followed by the body of its kind."""
        is_function = r["text"].rlike(r"\bfunction\b[^(]*+\(\z")
        return ~r["open"] | r["arrow"] | F.coalesce(F.contains(r["tail"], F.lit("=>")) != is_function, F.lit(False))

    def bounded(r):
        last = F.coalesce(r["tail"], r["text"])
        stop = F.when(r["tail"].isNotNull(), r["close"] + F.octet_length(r["tail"])).otherwise(r["opener"])  # the last byte of the head
        end = (
            F.when(F.endswith(last, F.lit("{")), close_of(F.col("braces"), stop) + 1)
            .when(F.endswith(last, F.lit("(")), close_of(F.col("parens"), stop) + 1)
            .when(F.endswith(F.rtrim(last, F.lit(" \t\r\n")), F.lit("=>")), statement_end(stop))
            .otherwise(stop + 1))
        return F.struct(r.alias("r"), (stop + 1).alias("stop"), F.substr(last, F.lit(-1)).alias("last"), F.coalesce(end, size).alias("end"))

    def read_body(b, raw):
        return F.struct(
            b["r"].alias("r"), b["end"].alias("end"), b["last"].alias("last"),
            byte_slice(raw, b["stop"], b["end"] - b["stop"]).alias("body"),
            F.when(b["r"]["tail"].isNotNull(), byte_slice(raw, b["r"]["opener"], b["r"]["close"] - b["r"]["opener"] + 1))
            .otherwise(F.lit("")).alias("first"),
            place(F.col("ends"), b["r"]["head"] + F.octet_length(b["r"]["lead"])).alias("at"))

    def scope(b):
        r, body = b["r"], b["body"]
        is_class = F.startswith(r["text"], F.lit("class"))
        jsx = F.when(b["last"] == "{", body.rlike(_RETURNS)).otherwise(body.rlike(_IS_JSX))
        first = b["first"]
        return F.struct(
            r["name"].alias("name"), (r["head"] + F.octet_length(r["binding"])).alias("start"), b["end"].alias("end"),
            (r["binding"] != "").alias("binding"), (jsx & (~is_class | body.rlike(r"\brender\s*+\("))).alias("jsx"),
            r["text"].rlike(rf"(?s)\A{_BINDING}(?:{_ID}\.)?forwardRef\b").alias("forward_ref"),
            F.regexp_extract(r["text"], rf"(?s)\A{_BINDING}(?:{_ID}\.)?memo\b[^(]*+\(\s*+({_ID})\s*+[,)]\z", 1).alias("memo_of"),
            F.regexp_extract_all(first, F.lit(r"(?<![.\w$])([A-Z][\w$]*+)(?=\s*+[,}=)])"), F.lit(1)).alias("params"),
            (count_up_to(F.col("braces"), r["head"], lambda p: p["open"]) > count_up_to(F.col("brace_ends"), r["head"])).alias("nested"),
            b["at"]["line"].alias("line"), b["at"]["col"].alias("col"))

    def components(scopes):
        """Names that are components: JSX results, forwardRef, memo of one."""
        def pick(cond):
            return F.transform(F.filter(scopes, lambda s: ~s["nested"] & s["name"].rlike(r"\A[A-Z]") & cond(s)), lambda s: s["name"])

        plain = pick(lambda s: s["jsx"] | s["forward_ref"])
        return let(plain, lambda p: F.array_union(p, pick(lambda s: F.array_contains(p, s["memo_of"]))))

    known = F.filter(F.transform("heads", read), complete)
    stages = with_bytes(F.col("masked"), lambda raw: F.transform(F.transform(known, bounded), lambda b: read_body(b, raw)))
    scoped = once(base, scopes=F.transform(stages, scope)).drop("heads", "bodies")
    shown = F.filter("scopes", lambda s: s["jsx"] & s["name"].rlike(r"\A[A-Z]"))
    return once(scoped, components=components(F.col("scopes")), every=tree(shown), declared_in=tree(F.filter(shown, lambda s: ~s["binding"])))


def _with_parent(df: DataFrame) -> DataFrame:
    p = F.col("_parent")
    return df.withColumns(parent_columns(
        p, F.concat(F.lit("react:component:"), "module", F.lit("#"), p["name"]),
        F.concat("module", F.lit("#"), p["name"]), "component",
        F.lit("module_path_and_symbol"), F.lit("path_sensitive")))


def _component(h: Column) -> Column:
    """J01 inside the row: the innermost component around the site."""
    return inner(F.col("every"), h["start"])


def _hidden(names: Column, name: Column, pos: Column) -> Column:
    """Whether a span of ``name`` is around ``pos``; ``names`` are sorted by name, so only its own are looked at."""
    def span(at):
        return F.struct(name.alias("name"), F.lit(at).cast("bigint").alias("open"), F.lit(at).cast("bigint").alias("close"))

    def any_of(low):
        own = F.slice(names, low + 1, count_up_to(names, span(1 << 62)) - low)
        return F.exists(own, lambda d: (d["open"] < pos) & (pos < d["close"]))

    return let(count_up_to(names, span(-1)), any_of)


def calls(files: DataFrame) -> DataFrame:
    """X10 with X28: capitalised JSX elements, without self and shadowed names.

    The parent of a usage is a function or class declaration.
    """
    local = rf"\b(?:const|let|var|function|class)\s++(?:[A-Z][\w$]*+)"

    def spanned(name, open_at, close_at):
        return F.struct(name.alias("name"), open_at.cast("bigint").alias("open"), close_at.cast("bigint").alias("close"))

    # Inner declarations hide a name up to the end of their block, parameters in their function.
    scoped = once(with_scopes(files).filter(F.col("masked").rlike(JSX)), blocks=tree(F.col("braces"), "open", "close"))
    declared = F.filter(F.transform(find_all(F.col("masked"), local), lambda h: let(
        inner(F.col("blocks"), h["start"]),
        lambda b: spanned(F.regexp_extract(h["text"], r"([A-Z][\w$]*+)\z", 1), b["open"], b["close"]))), lambda d: d["open"].isNotNull())
    params = F.flatten(F.transform("scopes", lambda s: F.transform(s["params"], lambda p: spanned(p, s["start"] - 1, s["end"]))))
    hiding = once(scoped, hiding=F.array_sort(F.concat(declared, params)))
    free = F.filter(find_all(F.col("masked"), JSX), lambda h: ~_hidden(
        F.col("hiding"), F.substring_index(F.substr(h["text"], F.lit(2)), ".", 1), h["start"]))
    found = sites(hiding, free, "module", _parent=lambda h: inner(F.col("declared_in"), h["start"]))
    named = found.withColumn("symbol", F.substr("text", F.lit(2))).withColumn("binding_name", F.substring_index("symbol", ".", 1))
    kept = _with_parent(named).filter(F.col("parent_symbol").isNull() | (F.col("parent_symbol") != F.col("binding_name")))
    return kept.select(*FILE, "module", "line", "col", "symbol", "binding_name", *PARENT_FIELDS)


def definitions(files: DataFrame) -> DataFrame:
    """Top-level components."""
    rows = with_scopes(files).select(*FILE, "module", "components", F.explode("scopes").alias("s"))
    qualified = F.concat("module", F.lit("#"), F.col("s.name"))
    return rows.filter(~F.col("s.nested") & F.array_contains("components", F.col("s.name"))).select(
        *KEYS, F.concat(F.lit("react:component:"), qualified).alias("id"), F.col("s.name").alias("symbol"),
        qualified.alias("qualified_symbol"), F.lit("module_path_and_symbol").alias("identity_basis"),
        F.lit("path_sensitive").alias("identity_stability"), F.col("path").alias("file"),
        F.col("s.line").alias("line"), F.col("s.col").alias("col"), "module")


def declared(files: DataFrame) -> DataFrame:
    """Names declared at the top level of a module."""
    pattern = rf"\b(?:const|let|var|function\b\s*+\*?|class)\s*+{_ID}"
    ends = F.array_sort(F.transform("braces", lambda b: b["close"]))
    top = F.filter(find_all(F.col("masked"), pattern), lambda h: around(F.col("braces"), F.col("_ends"), h["start"], lambda b: b["open"]) == 0)
    rows = once(_parsed(files), _ends=ends).select(*FILE, F.inline(top))
    return rows.select(
        *KEYS, F.col("path").alias("file"), F.regexp_extract("text", r"([A-Za-z_$][\w$]*)\z", 1).alias("name")).distinct()


_STRING = r"""(?:"[^"\n]*+"|'[^'\n]*+')"""
IMPORT = rf"(?m)^[ \t]*+import\b(?!\s*+[(.])[^;'\"()]*+{_STRING}"


def _names(clause: Column) -> Column:
    """``a, b as c`` -> array of (source, name)."""
    items = F.filter(F.transform(F.split(clause, ","), lambda x: F.regexp_replace(F.btrim(x, F.lit(" \t\r\n")), r"\Atype\s++", "")), lambda x: x != "")
    return F.transform(items, lambda x: F.struct(
        F.regexp_extract(x, r"\A([\w$]+)", 1).alias("source"), F.regexp_extract(x, r"([\w$]+)\z", 1).alias("name")))


def imports(files: DataFrame) -> DataFrame:
    """Default, namespace and named bindings of every import."""
    rows = hits(_parsed(files), IMPORT, text="code")
    specifier = F.regexp_extract("text", r"""["']([^"'\n]*)["']\z""", 1)
    clause = F.regexp_replace(F.regexp_extract("text", r"(?s)\A\s*+import\b(.*?)(?:\bfrom\b)?\s*+[\"'][^\"'\n]*+[\"']\z", 1), r"\A\s*+type\s++(?=[{*\w])", " ")
    default = F.regexp_extract(clause, r"\A\s*+([A-Za-z_$][\w$]*+)", 1)
    namespace = F.regexp_extract(clause, r"\*\s*+as\s++([\w$]++)", 1)
    named = _names(F.regexp_extract(clause, r"\{([^}]*+)\}", 1))

    def binding(kind: str, local: Column, symbol: Column) -> Column:
        return F.struct(F.lit(kind).alias("imported_kind"), local.alias("local_name"), symbol.alias("imported_symbol"))

    bindings = F.filter(F.concat(
        F.array(binding("default", default, F.lit("default"))), F.array(binding("namespace", namespace, F.lit("*"))),
        F.transform(named, lambda n: F.struct(F.lit("named").alias("imported_kind"), n["name"].alias("local_name"), n["source"].alias("imported_symbol"))),
    ), lambda b: b["local_name"] != "")
    return rows.select(
        *KEYS, F.col("path").alias("file"), specifier.alias("specifier"), "start", F.posexplode(bindings).alias("ordinal", "b")
    ).select(*KEYS, "file", "specifier", F.col("b.imported_kind").alias("imported_kind"), F.col("b.local_name").alias("local_name"),
             F.col("b.imported_symbol").alias("imported_symbol"), (F.col("start") * COLUMNS + F.col("ordinal")).alias("ordinal"))


EXPORT = (
    rf"\bexport\s*+(?:type\s++)?\{{[^}}]*+\}}(?:\s*+from\s*+{_STRING})?"
    rf"|\bexport\s++default\s++(?:(?:async\s++)?function\b\s*+\*?\s*+|class\s++)?(?:{_ID})?"
    rf"|\bexport\s++(?:async\s++)?(?:function\b\s*+\*?|class|const|let|var)\s*+{_ID}")


def exports(files: DataFrame) -> DataFrame:
    """Local exports and re-exports with their names."""
    rows = hits(_parsed(files), EXPORT, text="code")
    text = F.col("text")
    specifier = F.regexp_extract(text, r"""["']([^"'\n]*)["']\z""", 1)
    listed = F.transform(_names(F.regexp_extract(text, r"\{([^}]*+)\}", 1)), lambda n: F.struct(
        n["name"].alias("export_name"), n["source"].alias("source_export")))
    default_name = F.regexp_extract(text, r"\bdefault\s++(?:(?:async\s++)?function\b\s*+\*?\s*+|class\s++)?([A-Za-z_$][\w$]*+)", 1)
    is_default = text.rlike(r"\Aexport\s++default\b")
    # A call or a wrapped component has no name of its own.
    default = F.when(default_name.isin("", "memo", "forwardRef", "React", "function", "class", "async"), "default").otherwise(default_name)
    declared = F.regexp_extract(text, r"([A-Za-z_$][\w$]*+)\z", 1)
    single = F.when(is_default, F.struct(F.lit("default").alias("export_name"), default.alias("source_export"))).otherwise(
        F.struct(declared.alias("export_name"), declared.alias("source_export")))
    found = F.when(F.contains(text, F.lit("{")), listed).otherwise(F.array(single))
    return rows.select(
        *KEYS, F.col("path").alias("file"), specifier.alias("specifier"), "start", F.posexplode(found).alias("ordinal", "e")
    ).select(
        *KEYS, "file", F.col("e.export_name").alias("export_name"),
        F.when(F.col("specifier") != "", "reexport").otherwise("local").alias("kind"), F.col("e.source_export").alias("source_export"),
        F.when(F.col("specifier") != "", F.col("specifier")).alias("source_specifier"),
        (F.col("start") * COLUMNS + F.col("ordinal")).alias("ordinal"))


def style_sites(files: DataFrame) -> DataFrame:
    """Literal properties of ``style={{...}}`` objects."""
    number = r"-?\s*+(?:0[xX][0-9A-Fa-f]++|[0-9]++(?:\.[0-9]*+)?(?:[eE][+-]?[0-9]++)?|\.[0-9]++)"
    value = rf"""(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\$]|\\.|\$(?!\{{))*+`|{number})"""
    key = rf"(?:{_ID}|{_STRING}|\[\s*+{_STRING}\s*+\])"
    prop = rf"(?:\A|,)\s*+{key}\s*+:\s*+{value}(?=\s*+(?:,|\z|\bas\b))"

    def own(o, raw):
        """Properties of the object itself, not of groups inside."""
        at = o["start"] + F.octet_length(o["text"])
        body = byte_slice(raw, at, close_of(F.col("braces"), at - 1) - at)
        lead = r"(?s)\A,?\s*+"
        level = depth_at(at - 1)
        props = F.filter(find_all(body, prop), lambda p: let(
            at + p["start"] + F.octet_length(F.regexp_extract(p["text"], lead, 0)), depth_at) == level)

        def read(p):
            return F.struct(
                (at + p["start"] + F.octet_length(F.regexp_extract(p["text"], lead, 0))).alias("start"),
                F.regexp_extract(p["text"], rf"(?s):\s*+({value})\z", 1).alias("text"),
                F.regexp_extract(p["text"], rf"(?s)\A,?\s*+\[?\s*+[\"']?([A-Za-z_$][\w$]*+)", 1).alias("name"))

        return F.transform(props, read)

    styled = F.flatten(with_bytes(F.col("code"), lambda raw: F.transform(
        find_all(F.col("masked"), r"(?<![\w$-])style=\{\s*+\{"), lambda o: own(o, raw))))
    rows = sites(with_scopes(files), styled, "module", _parent=_component, name=lambda p: p["name"]).withColumnRenamed("text", "value").withColumns({
        "category": lookup(STYLE_PROPS, F.col("name"), 0), "context": lookup(STYLE_PROPS, F.col("name"), 1)})
    return style_rows(_with_parent(rows.filter("category IS NOT NULL")), LANGUAGE)


def token_sites(files: DataFrame, token_keys: DataFrame) -> DataFrame:
    """Member chains and identifiers that are token keys."""
    found = chain_candidates(with_scopes(files), "module", members=False, _parent=_component)
    return token_rows(_with_parent(found), token_keys, LANGUAGE)


def discovered(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Exported components with the npm package of their file.

    ``packages`` has (repo_id, snapshot_id, file, package).
    """
    if "scopes" not in files.columns:
        # parsed once: exports are read from the code, components from the scopes
        files = materialize(with_scopes(files).select(*FILE, "code", "module", "components", "scopes"))
    own = exports(files).filter("kind = 'local'")
    exported = own.select(
        *KEYS, "file", F.when(F.col("export_name") == "default", F.col("source_export")).otherwise(F.col("export_name")).alias("symbol"),
        F.col("source_export").alias("local"), "ordinal")
    components = definitions(files).select(*KEYS, "file", F.col("symbol").alias("local"))
    rows = exported.join(components, [*KEYS, "file", "local"], "left_semi")
    return rows.join(packages, ["repo_id", "snapshot_id", "file"], "left").select(
        "repo_id", "language", "symbol", F.col("file").alias("path"), "ordinal", "package")
