"""Interval joins and interval reductions.

Containment is never tested pair by pair.  Each scope is cut into aligned
blocks of 4^k positions, each position belongs to one block per level, and both
sides meet on the block.  Blocks keep only what the question needs (the
narrowest scope, or that one exists), so dense files cannot multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BASE_BITS = 2
LEVELS = 16  # positions up to 4^16


def _blocks(start: Column, end: Column) -> Column:
    """Aligned blocks (level, node) that tile the closed interval exactly."""
    def at(level: Column) -> Column:
        bits = level * BASE_BITS
        one = F.lit(1).cast("bigint")

        def first(k: Column) -> Column:  # ceil(start / 4^k)
            return F.call_function("shiftright", start + F.call_function("shiftleft", one, k) - 1, k)

        def stop(k: Column) -> Column:  # floor((end + 1) / 4^k)
            return F.call_function("shiftright", end + 1, k)

        lo, hi = first(bits), stop(bits)
        up = bits + BASE_BITS
        plo = F.call_function("shiftleft", first(up), F.lit(BASE_BITS))
        phi = F.call_function("shiftleft", stop(up), F.lit(BASE_BITS))

        def span(a: Column, b: Column) -> Column:
            return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))

        nodes = F.when(plo < phi, F.concat(span(lo, F.least(hi, plo)), span(F.greatest(lo, phi), hi))).otherwise(span(lo, hi))
        return F.transform(nodes, lambda n: F.struct(level.alias("level"), n.alias("node")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at))


def _ancestors(pos: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS)),
        lambda k: F.struct(k.alias("level"), F.call_function("shiftright", pos, k * BASE_BITS).alias("node")))


def parent_scope(sites: DataFrame, scopes: DataFrame, on: list[str], pos: str = "pos") -> DataFrame:
    """The narrowest scope around each site, null if there is none.

    ``scopes`` has ``on``, ``scope_id``, ``start_pos`` and ``end_pos``
    (inclusive).  Equally wide scopes are decided by start, then id.  Scopes are
    resolved once per distinct position, however many sites share it.
    """
    width = F.struct((F.col("end_pos") - F.col("start_pos")).alias("w"), "start_pos", "scope_id")
    blocks = (
        scopes.select(*on, width.alias("s"), F.explode(_blocks(F.col("start_pos"), F.col("end_pos"))).alias("b"))
        .groupBy(*on, "b.level", "b.node").agg(F.min("s").alias("s"))
    )
    places = sites.select(*on, pos).distinct()
    found = (
        places.select(*on, pos, F.explode(_ancestors(F.col(pos))).alias("b")).select(*on, pos, "b.level", "b.node")
        .join(blocks, [*on, "level", "node"])
        .groupBy(*on, pos).agg(F.min("s").alias("s"))
        .select(*on, pos, F.col("s.scope_id").alias("scope_id"))
    )
    return sites.join(found, [*on, pos], "left")


def outside_scopes(sites: DataFrame, scopes: DataFrame, on: list[str], pos: str = "pos") -> DataFrame:
    """Drop sites inside any of the scopes (previews)."""
    blocks = scopes.select(*on, F.explode(_blocks(F.col("start_pos"), F.col("end_pos"))).alias("b")).select(
        *on, "b.level", "b.node").distinct()
    inside = (
        sites.select(*on, pos).distinct()
        .select(*on, pos, F.explode(_ancestors(F.col(pos))).alias("b")).select(*on, pos, "b.level", "b.node")
        .join(blocks, [*on, "level", "node"], "left_semi").select(*on, pos).distinct()
    )
    return sites.join(inside, [*on, pos], "left_anti")


def ui_scope_gate(sites: DataFrame, scopes: DataFrame, on: list[str], pos: str = "pos") -> DataFrame:
    """Keep sites whose narrowest scope is a UI scope."""
    kinds = scopes.select(*on, "scope_id", "is_ui").dropDuplicates([*on, "scope_id"])
    return parent_scope(sites, scopes, on, pos).join(kinds, [*on, "scope_id"]).filter("is_ui").drop("is_ui")


def containment_dedupe(ranges: DataFrame, on: list[str], cell: int = 4096) -> DataFrame:
    """Keep ranges that no other range contains; equal ranges keep one.

    Sorted by start (then longest first), a range survives iff it ends after
    everything before it.  The running maximum is taken per cell of starts,
    and the maximum of the earlier cells is added, so a huge file is split.
    """
    key = [*on, "start_pos", "end_pos"]
    rest = [c for c in ranges.columns if c not in key]
    one = ranges.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")) if rest else ranges.distinct()
    celled = one.withColumn("_cell", F.floor(F.col("start_pos") / cell))
    cells = celled.groupBy(*on, "_cell").agg(F.max("end_pos").alias("_m"))
    before = F.max("_m").over(Window.partitionBy(*on).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    carried = cells.select(*on, "_cell", before.alias("_before"))
    w = Window.partitionBy(*on, "_cell").orderBy("start_pos", F.desc("end_pos")).rowsBetween(Window.unboundedPreceding, -1)
    kept = (
        celled.withColumn("_inner", F.max("end_pos").over(w)).join(carried, [*on, "_cell"])
        .filter(F.coalesce(F.greatest("_inner", "_before"), F.lit(-1)) < F.col("end_pos"))
    )
    return kept.select(*key, *([F.col(f"_r.{c}").alias(c) for c in rest]))


def first_by_priority(facts: DataFrame, key: list[str], priority: str = "priority") -> DataFrame:
    """Among facts with one id the lowest priority wins."""
    rest = [c for c in facts.columns if c not in key and c != priority]
    best = F.min(F.struct(priority, *rest))
    return facts.groupBy(*key).agg(best.alias("_b")).select(
        *key, F.col(f"_b.{priority}").alias(priority), *[F.col(f"_b.{c}").alias(c) for c in rest])
