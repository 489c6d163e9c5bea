"""Token inference: the case table, ties, and a brute-force comparison."""

import math
import random

import pytest
from pyspark.sql import functions as F

from uptake.functions.values import with_normal_form
from uptake.operators import inference as inf
from uptake.operators.quality import suggestion_rules

SITE = "repo_id string, snapshot_id string, language string, id string, file string, line long, col long, category string, context string, value string"
TOKEN = "repo_id string, snapshot_id string, language string, id string, key string, category string, value string"


def infer(spark, cases, tolerance=2.0):
    """Each case gets its own repository: (language, value, category, context, [(id, category, value)])."""
    sites = [(f"r{i}", "s", c[0], "x", "f", 1, 1, c[2], c[3], c[1]) for i, c in enumerate(cases)]
    tokens = [(f"r{i}", "s", c[0], t[0], "k." + t[0], t[1], t[2]) for i, c in enumerate(cases) for t in c[4]]
    s, t = spark.createDataFrame(sites, SITE), spark.createDataFrame(tokens, TOKEN)
    rows = {r.repo_id: r for r in inf.infer_tokens(s, t, tolerance).collect()}
    sug = {}
    for r in inf.suggestions(s, t, tolerance).collect():
        sug.setdefault(r.repo_id, []).append((r.token_id, r.distance, r.normalized_unit))
    return [(rows[f"r{i}"], sorted(sug.get(f"r{i}", []))) for i in range(len(cases))]


S, C, E, T = "spacing", "color", "elevation", "typography"
CASES = [
    # language, value, category, context, tokens, class, confidence, suggested ids
    ("react", "4", S, "padding", [("a", S, "4px")], "exact", "very_high", ["a"]),
    ("react", "4", S, "width", [("a", S, "4px")], "exact", "high", ["a"]),
    ("react", "3", S, "gap", [("a", S, "4px")], "near", "medium", ["a"]),
    ("react", "3", S, "width", [("a", S, "4px")], "near", "low", ["a"]),
    ("react", "200", S, "width", [("a", S, "4px"), ("b", S, None)], "unmatched", None, []),
    ("react", "3", S, "padding", [("a", S, "4px"), ("b", S, "8pt")], "near", "medium", ["a"]),
    ("react", "3", S, "padding", [("a", "radius", "4px")], "unassessed", None, []),
    ("react", "4", S, "padding", [("z", S, "4px"), ("a", S, "4px")], "exact", "high", ["a", "z"]),
    ("react", "4", S, "unknown", [("a", S, "4px")], "unmatched", None, []),
    ("react", '"#FFF"', C, "color", [("a", C, "#fff")], "exact", "very_high", ["a"]),
    ("react", '"0 1px 2px #000"', E, "elevation", [("a", E, "0 1px 2px #000")], "exact", "very_high", ["a"]),
    ("react", '"0 0 0"', E, "elevation", [("a", E, "0")], "unmatched", None, []),
    ("react", "5 px", S, "padding", [("a", S, "5px")], "unassessed", None, []),
    ("react", "5d", S, "padding", [("a", S, "5px")], "unassessed", None, []),
    ("react", "1e999px", S, "padding", [("a", S, "5px")], "unassessed", None, []),
    ("react", "-0", S, "padding", [("a", S, "0px")], "exact", "very_high", ["a"]),
    ("react", "4PX", S, "padding", [("a", S, "4.0px")], "exact", "very_high", ["a"]),
    ("react", "2rem", S, "padding", [("a", S, "2em")], "unmatched", None, []),
    ("react", "4", S, "padding", [("a", S, None), ("b", S, "x y")], "unmatched", None, []),
    ("react", "4", S, "padding", [("a", S, None), ("b", S, "9zz")], "unassessed", None, []),
    ("compose", "4.dp", S, "padding", [("a", S, "4dp")], "exact", "very_high", ["a"]),
    ("compose", "4.dp", S, "padding", [("a", S, "4.sp")], "unmatched", None, []),
    ("compose", "0x112233", C, "color", [("a", C, "0xFF112233")], "exact", "very_high", ["a"]),
    ("compose", "0x80ff0000", C, "color", [("a", C, "#ff000080")], "exact", "very_high", ["a"]),
    ("compose", "254", C, "color", [("a", C, "255")], "unmatched", None, []),
    ("compose", "1.600e1.sp", T, "typography", [("a", T, "16.sp")], "exact", "very_high", ["a"]),
    ("compose", " 4 . dp ", S, "padding", [("a", S, "4dp")], "exact", "very_high", ["a"]),
    ("swift", "3", E, "elevation", [("a", E, "4")], "unmatched", None, []),
    ("swift", '"Brand"', C, "color", [("a", C, "brand")], "unmatched", None, []),
    ("swift", '"Bad"', C, "color", [("a", C, "bad")], "unmatched", None, []),
    ("swift", "0", S, "gap", [("a", S, "-1"), ("b", S, "1"), ("c", S, "1.0000000000000002")], "near", "low", ["a", "b"]),
    ("swift", "NaN", S, "gap", [("a", S, "1")], "unassessed", None, []),
    # Two token values that round to one distance are a tie.
    ("swift", "-1.5", S, "gap", [("a", S, "0.00000000000000001"), ("b", S, "0.00000000000000002")], "near", "low", ["a", "b"]),
    ("swift", "", S, "gap", [("a", S, "1")], "unassessed", None, []),
]


def test_case_table(spark):
    for case, (row, sug) in zip(CASES, infer(spark, [c[:5] for c in CASES])):
        assert (row.classification, row.confidence, [s[0] for s in sug]) == case[5:], case


def test_evidence(spark):
    rows = infer(spark, [c[:5] for c in CASES])
    evidence = {CASES[i][1] + "/" + CASES[i][3] + "/" + str(i): r.evidence for i, (r, _) in enumerate(rows)}
    got = list(evidence.values())
    assert got[0] == ["exact_value", "clear_usage_context"]
    assert got[3] == ["within_numeric_tolerance", "generic_dimension_context"]
    assert got[4] == ["outside_numeric_tolerance"]
    assert got[6] == ["missing_canonical_values"]
    assert got[7] == ["exact_value", "clear_usage_context", "multiple_equal_matches"]
    assert got[12] == ["unsupported_canonical_format"]
    assert got[17] == ["incompatible_units", "outside_numeric_tolerance"]
    assert got[19] == ["missing_canonical_values", "incomplete_canonical_coverage", "unsupported_canonical_format"]
    assert got[21] == ["incompatible_units", "outside_numeric_tolerance"]


def test_tolerance_zero_is_never_near(spark):
    cases = [("react", "3", S, "gap", [("a", S, "4px")]), ("swift", "0", S, "gap", [("a", S, "1e-20")])]
    assert [r.classification for r, _ in infer(spark, cases, 0.0)] == ["unmatched", "unmatched"]


@pytest.mark.parametrize("tolerance", [0.75, 2.0, 13.0])
def test_near_against_brute_force(spark, tolerance):
    """A hot scope: all values in one category, many of them shared."""
    rng = random.Random(7)
    values = [round(rng.uniform(-60, 60), rng.choice([0, 1, 3])) for _ in range(400)] + [12.0] * 200
    tokens = {f"t{i}": round(rng.uniform(-60, 60), rng.choice([0, 1])) for i in range(60)}
    sites = [("r", "s", "swift", f"x{i}", "f", 1, 1, S, "gap", repr(v)) for i, v in enumerate(values)]
    toks = [("r", "s", "swift", k, k, S, repr(v)) for k, v in tokens.items()]
    got = {}
    for r in inf.suggestions(spark.createDataFrame(sites, SITE), spark.createDataFrame(toks, TOKEN), tolerance).collect():
        got.setdefault(r.site_id, set()).add((r.token_id, r.match_kind, r.distance))
    for i, v in enumerate(values):
        exact = {(k, "exact", 0.0) for k, t in tokens.items() if t == v}
        near = [(abs(v - t), k) for k, t in tokens.items() if 0 < abs(v - t) <= tolerance]
        best = min((d for d, _ in near), default=math.inf)
        want = exact or {(k, "near", d) for d, k in near if d == best}
        assert got.get(f"x{i}", set()) == want, v


def test_normal_form_keeps_null_values_apart(spark):
    df = spark.createDataFrame([("react", S, "gap", None), ("react", S, "gap", "'7'")], "language string, c string, x string, v string")
    rows = with_normal_form(df, "c", "x", "v").orderBy(F.col("v").asc_nulls_first()).collect()
    assert rows[0].kind is None
    assert (rows[1].kind, rows[1].scalar, rows[1].unit) == ("numeric", 7.0, "px")


def test_tokens_are_not_broadcast(spark, tmp_path):
    """Spark's guess of their size is far too low once they are spread over the context classes."""
    spark.createDataFrame([("r", "s", "swift", "x", "f", 1, 1, S, "gap", "3")], SITE).write.parquet(f"{tmp_path}/sites")
    spark.createDataFrame([("r", "s", "swift", "a", "a", S, "4")], TOKEN).write.parquet(f"{tmp_path}/tokens")
    sites, tokens = spark.read.parquet(f"{tmp_path}/sites"), spark.read.parquet(f"{tmp_path}/tokens")
    observed, read = inf.observed_values(sites), inf.normalized_tokens(tokens)
    rules = suggestion_rules(inf.infer_tokens(sites, tokens), inf.suggestions(sites, tokens), tokens)

    def joins(df):
        return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]

    assert joins(inf.value_suggestions(observed, read, 2.0)) == []
    assert joins(inf.assess_values(observed, read, 2.0)) == []
    assert [line for line in joins(rules) if "token_id" in line] == []
