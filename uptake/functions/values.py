"""Normalisation of style values and token values.

The normal form of a value is four columns:

* ``kind``   ``color`` | ``numeric`` | ``text`` | ``unsupported``
* ``scalar`` the number of a numeric value; adding 0.0 makes -0.0 equal 0.0
* ``unit``   its unit, empty for unitless
* ``text``   the lower-case ``rrggbbaa`` of a colour, or the literal text
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import CLEAR_CONTEXTS
from .text import remove_spaces, trim

# Accepted number spellings, units and context groups.
NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
NON_FINITE_WORD = r"(?i)\A[+-]?(?:inf|infinity|nan)\z"
NUMERIC_PREFIX = r"\A[+-]?\.?[0-9]"
CSS_LENGTH = r"(?is)\A(.*?)(vmin|vmax|rem|px|em|vh|vw|%)\z"
COMPOSE_LENGTH = r"(?is)\A(.*?)\.?(dp|sp)\z"
LAYOUT_CONTEXTS = ["padding", "margin", "gap", "width", "height", "size", "radius"]
TEXT_FALLBACK = ["color", "typography", "elevation"]
NEVER_NEAR = ["color", "elevation"]

#: Contexts that normalise alike share a class, so tokens need 5 variants, not 11.
CONTEXT_CLASSES = ["layout", "color", "typography", "elevation", "unknown"]


def context_class(context: Column) -> Column:
    return F.when(context.isin(LAYOUT_CONTEXTS), F.lit("layout")).otherwise(context)


def clean_value(value: Column) -> Column:
    """Trim, then strip one pair of matching quotes."""
    t = trim(value)
    return F.regexp_replace(t, r"""(?s)\A(["'])(.*)\1\z""", "$2")


def hash_color(text: Column) -> Column:
    """``#rgb[a]`` / ``#rrggbb[aa]`` -> ``rrggbbaa``; null otherwise."""
    h = F.lower(F.substring(trim(text), 2, 8))
    doubled = F.regexp_replace(h, "(.)", "$1$1")
    return (
        F.when(~trim(text).rlike(r"\A#(?:[0-9A-Fa-f]{3,4}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})\z"), None)
        .when(F.length(h) == 3, F.concat(doubled, F.lit("ff")))
        .when(F.length(h) == 4, doubled)
        .when(F.length(h) == 6, F.concat(h, F.lit("ff")))
        .otherwise(h)
    )


def argb_color(text: Column) -> Column:
    """``0xAARRGGBB`` / ``0xRRGGBB`` -> ``rrggbbaa``; null otherwise."""
    h = F.lower(F.substring(trim(text), 3, 8))
    return F.when(
        trim(text).rlike(r"\A0[xX](?:[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})\z"),
        F.when(F.length(h) == 8, F.concat(F.substring(h, 3, 6), F.substring(h, 1, 2))).otherwise(
            F.concat(h, F.lit("ff"))
        ),
    )


def parse_number(text: Column) -> Column:
    """A finite or overflowing double for a plain number spelling, else null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def finite_number(text: Column) -> Column:
    n = parse_number(text)
    return F.when(F.abs(n) < F.lit(float("inf")), n + F.lit(0.0))


def near_allowed(category: Column, context: Column) -> Column:
    """Colours and elevations are never matched by distance."""
    return ~category.isin(NEVER_NEAR) & ~context.isin(NEVER_NEAR)


def text_fallback(category: Column, context: Column) -> Column:
    """An unknown suffix may still compare as text here."""
    return category.isin(TEXT_FALLBACK) | context.isin(TEXT_FALLBACK)


def with_normal_form(df: DataFrame, category: str, context: str, value: str) -> DataFrame:
    """Add ``kind``, ``scalar``, ``unit`` and ``text`` of a value column.

    ``context`` may hold contexts or context classes; a null value has a null
    kind.  Unused columns hold neutral values (0.0, empty), so that plain
    equality on the four columns is the exact match.  ``inline`` keeps the
    optimizer from copying the long expression into every filter and join
    condition on the result.
    """
    lang, cat, ctx = F.col("language"), F.col(category), F.col(context)
    compose, swift = lang == "compose", lang == "swift"
    plain_unit = F.when(~compose & ~swift & ctx.isin([*LAYOUT_CONTEXTS, "layout"]), F.lit("px")).otherwise(F.lit(""))

    def clean(r):
        return F.struct(r.alias("raw"), clean_value(r).alias("clean"))

    def color_and_compact(r):
        argb = F.when(compose & ((cat == "color") | (ctx == "color")), argb_color(r["clean"]))
        return F.struct(
            r["raw"].alias("raw"), r["clean"].alias("clean"),
            F.coalesce(hash_color(r["clean"]), argb).alias("color"),
            F.when(compose | swift, remove_spaces(r["clean"])).otherwise(trim(r["clean"])).alias("compact"),
        )

    def suffix(r):
        # Number (1) and unit (2) of a length with a known suffix.
        def part(group: int) -> Column:
            return (
                F.when(swift, F.lit(""))
                .when(compose, F.regexp_extract(r["compact"], COMPOSE_LENGTH, group))
                .otherwise(F.regexp_extract(r["compact"], CSS_LENGTH, group))
            )

        has_unit = part(2) != ""
        return F.struct(
            r.alias("v"), F.lower(part(2)).alias("unit"),
            F.when(has_unit, part(1)).otherwise(r["compact"]).alias("number"),
        )

    def number(r):
        return F.struct(
            r["v"].alias("v"), r["unit"].alias("unit"), finite_number(r["number"]).alias("scalar"),
            (r["number"].rlike(NUMBER) | r["number"].rlike(NON_FINITE_WORD)).alias("spelled"),
        )

    def classified(r):
        v, with_unit = r["v"], r["unit"] != ""
        # Swift never falls back to text for a non-finite number.
        unreadable = F.when(swift, r["spelled"]).otherwise(
            ((with_unit & r["spelled"]) | v["compact"].rlike(NUMERIC_PREFIX)) & ~text_fallback(cat, ctx))
        kind = (
            F.when(v["raw"].isNull(), None).when(v["clean"] == "", "unsupported")
            .when(v["color"].isNotNull(), "color").when(r["scalar"].isNotNull(), "numeric")
            .when(unreadable, "unsupported").otherwise("text")
        )
        return F.struct(
            kind.alias("kind"), r["scalar"].alias("scalar"),
            F.when(with_unit, r["unit"]).otherwise(plain_unit).alias("unit"),
            v["color"].alias("color"), v["clean"].alias("clean"),
        )

    def normal(r):
        kind, numeric = r["kind"], F.coalesce(r["kind"] == "numeric", F.lit(False))
        return F.struct(
            kind.alias("kind"),
            F.when(numeric, r["scalar"]).otherwise(F.lit(0.0)).alias("scalar"),
            F.when(numeric, r["unit"]).otherwise(F.lit("")).alias("unit"),
            F.when(kind == "color", r["color"]).when(kind == "text", r["clean"]).otherwise(F.lit("")).alias("text"),
        )

    rows = F.array(F.col(value))
    for step in (clean, color_and_compact, suffix, number, classified, normal):
        rows = F.transform(rows, step)
    return df.select("*", F.inline(rows))


def confidence(classification: Column, context: Column, multiple: Column) -> Column:
    """exact/near strength, one step down for generic contexts and ties."""
    clear = context.isin(CLEAR_CONTEXTS)
    level = (
        F.when(classification == "exact", 3)
        .when(classification == "near", 1)
        - F.when(clear, 0).otherwise(1)
        - F.when(multiple, 1).otherwise(0)
    )
    return F.when(level >= 3, "very_high").when(level == 2, "high").when(level == 1, "medium").when(
        level.isNotNull(), "low"
    )
