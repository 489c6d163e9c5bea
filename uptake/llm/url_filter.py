"""URL filtering by rules and by a tree of path templates per host.

Rules come first: a rule ``host/path`` fits its host and all subdomains, if the URL's path
starts with the rule's path; the longest one that fits decides.

URLs without a rule are judged by the tree.  Runs of digits in a segment are a wildcard;
all children of a node become one wildcard if it has at least ``WIDE`` different ones with
fewer than ``VISITS`` URLs each on average.  Below ``LEVELS`` segments a path goes on as
one wildcard.  The URLs that a rule decides are the labelled ones.  From the root (all
hosts) over the host to the deepest segment, a branch whose number of blocked URLs is
within two deviations of what its parent's purity predicts is merged with its similar
siblings; the others stand alone.  The purity of a branch is its blocked share, smoothed
towards its parent's by ``PRIOR`` URLs.  A template of purity ``REJECT`` or more is blocked.

The tree is built from the distinct templates, not from the URLs, so a host with a third
of all URLs costs as many rows as it has templates.  Null URLs, and URLs without ``://``,
have an empty host and path, fit no rule and share one template.  Repeated rows are judged
one by one and count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.stages import materialize
from .license_scan import SMALL, UPPER

LEVELS, WIDE, VISITS, PRIOR, REJECT = 3, 20, 5, 4.0, 0.8
#: Templates that may be broadcast: a few dozen MiB at some hundred bytes each.
BROADCAST_TEMPLATES = 100_000

#: Rule and verdict.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL."""
    split = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, split, 1), UPPER, SMALL), F.regexp_extract(url, split, 2)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, else null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        of, slash, start = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def with_template(pages: DataFrame) -> DataFrame:
    """Adds t1, t2, ...: the segments of ``path`` with digits as wildcards; empty where the path has ended."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    tokens = F.transform(segments, lambda s: F.regexp_replace(s, "[0-9]+", "{n}"))
    levels = {f"t{k}": F.coalesce(F.get(tokens, F.lit(k - 1)), F.lit("")) for k in range(1, LEVELS + 1)}
    last = f"t{LEVELS}"
    levels[last] = F.when(F.size(tokens) > LEVELS, F.concat(levels[last], F.lit("/**"))).otherwise(levels[last])
    return pages.withColumns(levels)


def generalised(leaves: DataFrame) -> DataFrame:
    """Adds u1, u2, ...: the tokens, or ``*`` below nodes with many rare children."""
    parent = ["host"]
    for k in range(1, LEVELS + 1):
        nodes = (leaves.groupBy(*parent, f"t{k}").agg(F.sum("pages").alias("pages"))
                 .groupBy(*parent).agg(F.count(F.lit(1)).alias("children"), F.sum("pages").alias("visits")))
        wide = nodes.filter((F.col("children") >= WIDE) & (F.col("visits") < VISITS * F.col("children"))).select(*parent, F.lit("*").alias("star"))
        leaves = leaves.join(wide, parent, "left").withColumn(f"u{k}", F.coalesce("star", f"t{k}")).drop("star")
        parent = [*parent, f"u{k}"]
    return leaves


def _smoothed(blocked: str, labelled: str, prior: Column) -> Column:
    return (F.col(blocked) + PRIOR * prior) / (F.col(labelled) + PRIOR)


def purities(leaves: DataFrame) -> DataFrame:
    """(host, u1, ..., purity) of every template."""
    keys = ["host", *(f"u{k}" for k in range(1, LEVELS + 1))]
    total = leaves.agg(F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("l")).first()
    root = (total["b"] + 1.0) / (total["l"] + 2.0)
    above = None
    for k in range(1, len(keys) + 1):
        own = leaves.groupBy(*keys[:k]).agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
        own = own.withColumn("prior", F.lit(root)) if above is None else own.join(above.withColumnRenamed("purity", "prior"), keys[:k - 1])
        spread = 2 * F.sqrt(F.col("l") * F.col("prior") * (1 - F.col("prior")))
        own = own.withColumn("alike", F.abs(F.col("b") - F.col("l") * F.col("prior")) <= spread)
        if above is None:
            merged = own.filter("alike").agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
            own = own.withColumns({"sb": F.lit(merged["b"]), "sl": F.lit(merged["l"])})
        else:
            merged = own.filter("alike").groupBy(*keys[:k - 1]).agg(F.sum("b").alias("sb"), F.sum("l").alias("sl"))
            own = own.join(merged, keys[:k - 1], "left")
        purity = F.when(F.col("alike"), _smoothed("sb", "sl", F.col("prior"))).otherwise(_smoothed("b", "l", F.col("prior")))
        above = own.select(*keys[:k], purity.alias("purity"))
    return above


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, template, purity."""
    host, path = parts(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = with_template(rows.withColumn("by", longest_rule(F.col("host"), F.col("path"), rules)))
    tokens = [f"t{k}" for k in range(1, LEVELS + 1)]
    leaves = materialize(rows.groupBy("host", *tokens).agg(
        F.count(F.lit(1)).alias("pages"), F.count("by").alias("labelled"),
        F.count(F.when(F.col("by.verdict") == "block", 1)).alias("blocked")))
    tree = materialize(generalised(leaves))
    keys = ["host", *(f"u{k}" for k in range(1, LEVELS + 1))]
    judged = tree.join(purities(tree), keys).select("host", *tokens, "purity", F.concat_ws("/", "host", *(
        F.nullif(F.col(u), F.lit("")) for u in keys[1:])).alias("template"))
    judged = materialize(judged)
    if judged.count() <= BROADCAST_TEMPLATES:
        judged = F.broadcast(judged)
    verdict = F.coalesce("by.verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return rows.join(judged, ["host", *tokens], "left").select(
        "page_id", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
