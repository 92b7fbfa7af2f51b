"""Grouped statistics against numpy."""

import math
import random

import numpy as np
import pytest

from helixframe.operators import stats


def box(values):
    q1, median, q3 = np.percentile(values, [25, 50, 75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in values if low <= v <= high]
    return q1, median, q3, min(inside), max(inside), len(values) - len(inside)


GROUPS = {
    "one": [3.0],
    "two": [1.0, 2.0],
    "ties": [5.0] * 9 + [7.0],
    "normal": [random.Random(1).gauss(0, 1) for _ in range(501)],
    "narrow": [0.8 + random.Random(i).random() * 1e-10 for i in range(200)],
    "wide": [10.0 ** random.Random(i).uniform(-12, 12) * (-1) ** i for i in range(300)],
    "zeros": [0.0, -0.0, 0.0, 1e-300, -1e-300],
    "large": [1e9 + i for i in range(100)],
}


@pytest.fixture(scope="module")
def values(spark):
    rows = [(g, v) for g, vs in GROUPS.items() for v in vs]
    rows += [("one", None), ("normal", float("nan")), (None, 4.0), (None, 6.0)]
    return spark.createDataFrame(rows, "g string, v double").repartition(7)


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_box_stats(spark, values, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        check_boxes(values)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def check_boxes(values):
    got = {r["g"]: r for r in stats.box_stats(values, ["g"], "v").collect()}
    assert set(got) == set(GROUPS) | {None}
    assert (got[None]["n"], got[None]["median"]) == (2, 5.0)
    for group, vs in GROUPS.items():
        r = got[group]
        assert r["n"] == len(vs)
        mine = [r[c] for c in ("q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers")]
        assert mine == pytest.approx(box(vs), rel=1e-12, abs=1e-300), group


def test_outliers(values):
    boxes = stats.box_stats(values, ["g"], "v")
    found = stats.outliers(values, boxes, ["g"], "v").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in found} == {g: box(v)[5] for g, v in GROUPS.items() if box(v)[5]}


def test_other_quantiles_and_infinity(spark):
    vs = [float(i * i) for i in range(37)] + [float("inf")]
    df = spark.createDataFrame([("a", v) for v in vs], "g string, v double")
    r = stats.exact_quantiles(df, ["g"], "v", (0.0, 0.1, 0.9, 1.0)).first()
    assert [r[f"p{i}"] for i in range(3)] == pytest.approx(np.percentile(vs[:-1] + [1e300], [0, 10, 90]))
    assert r["p3"] == float("inf")


def test_missing_values_make_the_mean_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0), ("c", 5.0)], "g string, score double")
    assert {r["g"]: r["avg_score"] for r in stats.grouped_mean(df, ["g"]).collect()} == {"a": None, "b": 3.0, "c": 5.0}
    errors = {r["g"]: r for r in stats.mean_and_error(df, ["g"]).collect()}
    assert errors["a"]["se"] is None and errors["c"]["se"] is None and errors["c"]["score_mean"] == 5.0
    assert errors["b"]["se"] == pytest.approx(math.sqrt(2) / math.sqrt(2))
    assert (errors["b"]["ymin"], errors["b"]["ymax"]) == (pytest.approx(2.0), pytest.approx(4.0))


def test_average_rank(spark):
    df = spark.createDataFrame(
        [("a", 10.0), ("a", 20.0), ("a", 20.0), ("a", 30.0), ("a", None), ("b", 5.0)], "g string, v double"
    )
    got = sorted((r["g"], r["v"] or -1, r["rank"]) for r in stats.average_rank(df, ["g"], "v").collect())
    assert got == [("a", -1, None), ("a", 10.0, 1.0), ("a", 20.0, 2.5), ("a", 20.0, 2.5), ("a", 30.0, 4.0), ("b", 5.0, 1.0)]


def test_distinct_counts_and_shape(spark):
    df = spark.createDataFrame([(1, "x", [1.0, 2.0]), (2, None, [3.0]), (2, "x", [4.0])], "a int, b string, v array<double>")
    assert {r["column"]: r["n_distinct"] for r in stats.distinct_counts(df, ["a", "b"]).collect()} == {"a": 2, "b": 1}
    assert tuple(stats.shape(df, "v").first()) == (3, 1, 2)


def test_overlay_keeps_boxes_without_a_point(spark):
    boxes = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, median double")
    points = spark.createDataFrame([("a", 9.0)], "g string, avg_score double")
    assert {r["g"]: r["test_score"] for r in stats.overlay(boxes, points, ["g"]).collect()} == {"a": 9.0, "b": None}


def test_no_group_is_gathered(spark, values):
    plan = stats.exact_quantiles(values.select("g", "v"), ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan and "percentile" not in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_zeros_count_once_and_infinity_is_no_box_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "x double")
    assert stats.distinct_counts(df, ["x"]).first()["n_distinct"] == 2
    inf = float("inf")
    df = spark.createDataFrame([("a", v) for v in [1.0, 2.0, 3.0, 4.0, inf, -inf, float("nan"), None, 90.0]], "k string, score double")
    box = stats.box_stats(df, ["k"]).first()
    assert (box["n"], box["median"], box["whisker_high"], box["n_outliers"]) == (5, 3.0, 4.0, 1)
    assert [r["score"] for r in stats.outliers(df, stats.box_stats(df, ["k"]).select("k", "q1", "q3"), ["k"]).collect()] == [90.0]


def test_close_values_leave_no_full_bin(spark):
    """Values a coarse bin cannot tell apart, large and tiny: refined until no part is over the limit."""
    near = [1.75e15 + i for i in range(20000)]
    tiny = [i * 1e-20 for i in range(20000)]
    same = [7.0] * 5000 + [8.0]
    rows = [("near", v) for v in near] + [("tiny", v) for v in tiny] + [("same", v) for v in same]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in stats.exact_quantiles(df, ["g"], "v", (0.1, 0.5), bin_rows=50).collect()}
    for g, vs in (("near", near), ("tiny", tiny), ("same", same)):
        assert [got[g]["p0"], got[g]["p1"]] == pytest.approx(np.percentile(vs, [10, 50]), rel=1e-12)
    boxes = {r["g"]: r for r in stats.box_stats(df, ["g"], "v", bin_rows=50).collect()}
    for g, vs in (("near", near), ("tiny", tiny), ("same", same)):
        assert [boxes[g][c] for c in ("q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers")] == pytest.approx(box(vs), rel=1e-12)


def test_whiskers_from_bins(spark):
    """Most bins are never read again; the ends and the outlier counts are still those of the rows."""
    draw = random.Random(4)
    groups = {
        "normal": [draw.gauss(100, 15) for _ in range(4000)],
        "skewed": [draw.lognormvariate(0, 2) for _ in range(4000)],
        "around zero": [draw.gauss(0, 1e-6) for _ in range(2000)] + [1.0, -1.0],
        "fence at zero": [1.0] * 10 + [2.0] * 10 + [-0.5, 0.0, 1e-12, -1e-12, 3.5, 3.6],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    got = {r["g"]: r for r in stats.box_stats(df, ["g"], "v").collect()}
    for g, vs in groups.items():
        mine = [got[g][c] for c in ("q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers")]
        assert mine == pytest.approx(box(vs), rel=1e-12), g


def test_empty_table_has_no_boxes(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert stats.box_stats(df, ["g"], "v").count() == 0
    assert stats.exact_quantiles(df, ["g"], "v").count() == 0
