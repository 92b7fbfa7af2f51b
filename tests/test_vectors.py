"""Pooling, standardising, components, drift and clustering scores against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions.vector import cosine_similarity, l2_distance, log_factorial
from helixframe.operators import clustering, embedding, pooling

RND = np.random.default_rng(3)
HIDDEN = {
    0: (RND.normal(size=(6, 4)), [1, 1, 1, 1, 0, 0]),
    1: (-np.abs(RND.normal(size=(5, 4))), [1, 1, 1, 0, 0]),
    2: (-np.abs(RND.normal(size=(3, 4))), [1, 1, 1]),
    3: (RND.normal(size=(2, 4)), [0, 0]),
}


@pytest.fixture(scope="module")
def hidden(spark):
    rows = [(s, p, m[p], [float(x) for x in v[p]]) for s, (v, m) in HIDDEN.items() for p in range(len(m))]
    return spark.createDataFrame(rows, "seq_id bigint, pos int, mask int, vec array<double>").repartition(4)


@pytest.mark.parametrize("empty_as_zero,exclude_pad", [(True, False), (False, True)])
def test_pooling(hidden, empty_as_zero, exclude_pad):
    out = pooling.pool(hidden, empty_as_zero=empty_as_zero, exclude_pad=exclude_pad)
    for r in out.collect():
        v, m = HIDDEN[r["seq_id"]]
        m = np.array(m)[:, None]
        n = m.sum()
        mean = (v * m).sum(axis=0) / (max(n, 1) if empty_as_zero else (n or math.nan))
        np.testing.assert_allclose(r["mean_vec"], mean, atol=1e-12)
        np.testing.assert_allclose(r["cls_vec"], v[0])
        if not exclude_pad:
            np.testing.assert_allclose(r["max_vec"], (v * m).max(axis=0))
            np.testing.assert_allclose(r["concat_vec"], np.concatenate([v[0], (v * m).max(axis=0), mean]), atol=1e-12)
        elif n:
            np.testing.assert_allclose(r["max_vec"], v[m[:, 0] == 1].max(axis=0))
        else:
            assert r["max_vec"] is None


def test_padding_hides_negative_maxima(hidden):
    got = {r["seq_id"]: r["max_vec"] for r in pooling.pool(hidden).collect()}
    assert got[1] == [0.0] * 4 and all(x < 0 for x in got[2])


def test_labelled_vectors(spark, hidden):
    labels = spark.createDataFrame([(i, f"l{i}") for i in range(4)], "seq_id bigint, label string")
    out = pooling.labelled_vectors(pooling.pool(hidden), "Base", labels)
    assert out.groupBy("vec_type").count().orderBy("vec_type").collect() == [("CLS", 4), ("Max", 4), ("Mean", 4)]
    cls = out.where("vec_type = 'CLS' and seq_id = 2").first()
    np.testing.assert_allclose(cls["vec"], HIDDEN[2][0][0])
    assert (cls["model_type"], cls["label"]) == ("Base", "l2")


@pytest.fixture(scope="module")
def matrix(spark):
    x = RND.normal(size=(80, 5)) @ np.diag([4, 2, 1, 0.5, 0.1])
    x[:, 4] = 7.0
    groups = ["a" if i % 4 else "b" for i in range(80)]
    df = spark.createDataFrame([(i, g, [float(v) for v in x[i]]) for i, g in enumerate(groups)], "id int, g string, vec array<double>")
    return x, np.array(groups), df


@pytest.mark.parametrize("sample", [False, True])
def test_standardise(matrix, sample):
    x, groups, df = matrix
    scale = lambda m: np.where(m.std(axis=0) < 1e-12, 0, (m - m.mean(axis=0)) / np.maximum(m.std(axis=0, ddof=int(sample)), 1e-12))
    got = np.array([r["scaled"] for r in embedding.standardise(df, sample_sd=sample).orderBy("id").collect()])
    np.testing.assert_allclose(got, scale(x), atol=1e-9)
    by = embedding.standardise(df, by=["g"], sample_sd=sample)
    for g in "ab":
        got = np.array([r["scaled"] for r in by.where(F.col("g") == g).orderBy("id").collect()])
        np.testing.assert_allclose(got, scale(x[groups == g]), atol=1e-9)


def test_principal_components(matrix):
    x, _, df = matrix
    coords, explained = embedding.principal_components(embedding.standardise(df), "scaled", 3)
    z = np.where(x.std(axis=0) < 1e-12, 0, (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-12))
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    signs = np.sign([v[np.abs(v).argmax()] for v in vt])
    got = np.array([r["pc"] for r in coords.orderBy("id").collect()])
    np.testing.assert_allclose(got, (z @ vt.T * signs)[:, :3], atol=1e-8)
    table = explained.orderBy("component").collect()
    np.testing.assert_allclose([r["ratio"] for r in table], (s**2 / (s**2).sum())[:3], atol=1e-9)
    assert table[0]["axis_label"] == f"PC1 ({table[0]['ratio'] * 100:.1f}%)"


def test_drift(spark):
    base = {f"t{i}_x": RND.normal(size=3) for i in range(9)} | {"zero": np.zeros(3)}
    moved = {k: v + RND.normal(size=3) for k, v in base.items() if k != "t3_x"}
    rows = [(k, "base", v) for k, v in base.items()] + [(k, "Ms", v) for k, v in moved.items()]
    df = spark.createDataFrame([(k, m, [float(x) for x in v]) for k, m, v in rows], "token string, model string, vec array<double>").repartition(3)
    l2 = {r["token"]: r["Ms"] for r in embedding.drift_wide(embedding.drift(df), ["Ms"]).collect()}
    cosine = {r["token"]: r["value"] for r in embedding.drift(df, "cosine").collect()}
    assert set(l2) == set(moved) == set(cosine)
    for k, v in moved.items():
        assert l2[k] == pytest.approx(np.linalg.norm(v - base[k]))
        if k == "zero":
            assert math.isnan(cosine[k])
        else:
            assert cosine[k] == pytest.approx(v @ base[k] / np.linalg.norm(v) / np.linalg.norm(base[k]))


@pytest.mark.parametrize("function", [l2_distance, cosine_similarity])
def test_width_mismatch_fails(spark, function):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="differ in width"):
        df.select(function(F.col("a"), F.col("b"))).collect()


def test_log_factorial(spark):
    ns = [0, 1, 2, 5, 9, 10, 19, 20, 21, 22, 50, 1000, 10**6, 10**9]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in ns], "n bigint").select(log_factorial(F.col("n"))).collect()]
    np.testing.assert_allclose(got, [math.lgamma(n + 1) for n in ns], rtol=1e-13, atol=1e-13)


def brute_agreement(pairs):
    n = len(pairs)
    a_of, b_of, ab = {}, {}, {}
    for x, y in pairs:
        a_of[x] = a_of.get(x, 0) + 1
        b_of[y] = b_of.get(y, 0) + 1
        ab[x, y] = ab.get((x, y), 0) + 1
    two = lambda k: k * (k - 1) / 2
    h = lambda c: -sum(k / n * math.log(k / n) for k in c.values())
    expected = sum(map(two, a_of.values())) * sum(map(two, b_of.values())) / two(n)
    middle = (sum(map(two, a_of.values())) + sum(map(two, b_of.values()))) / 2
    ari = (sum(map(two, ab.values())) - expected) / (middle - expected) if middle != expected else 1.0
    ha, hb = h(a_of), h(b_of)
    mi = ha + hb - h(ab)
    emi = 0.0
    for x in a_of.values():
        for y in b_of.values():
            for o in range(max(1, x + y - n), min(x, y) + 1):
                p = math.comb(x, o) * math.comb(n - x, y - o) / math.comb(n, y)
                emi += o / n * math.log(n * o / (x * y)) * p
    top = max(ha, hb)
    nmi = mi / top if top else 1.0
    return ari, (mi - emi) / (top - emi) if abs(top - emi) > 1e-12 else 1.0, 1 - nmi, nmi


def test_agreement(spark):
    rnd = random.Random(8)
    runs = {
        "identical": [(i % 3, i % 3) for i in range(60)],
        "renamed": [(i % 4, (i + 1) % 4 + 10) for i in range(80)],
        "independent": [(rnd.randrange(3), rnd.randrange(4)) for _ in range(500)],
        "noisy": [(i % 5, i % 5 if rnd.random() < 0.8 else rnd.randrange(5)) for i in range(400)],
        "uneven": [(int(i > 3), int(i > 5)) for i in range(300)],
        "one cluster": [(0, i % 2) for i in range(10)],
        "both one": [(0, 0)] * 5,
    }
    df = spark.createDataFrame([(r, a, b) for r, ps in runs.items() for a, b in ps], "run string, cluster int, label int")
    got = {r["run"]: r for r in clustering.agreement(df, ["run"]).collect()}
    for run, pairs in runs.items():
        mine = [got[run][c] for c in ("ARI", "AMI", "NID", "NMI")]
        assert mine == pytest.approx(brute_agreement(pairs), abs=1e-9), run
    swapped = {r["run"]: r for r in clustering.agreement(df, ["run"], "label", "cluster").collect()}
    assert all(swapped[r]["ARI"] == pytest.approx(got[r]["ARI"]) for r in runs)
    compat = clustering.agreement(df, ["run"], reference_compat=True)
    assert compat.where("abs(NID - AMI) > 1e-12").count() == 0


def test_expected_information_of_large_tables(spark):
    """The overlaps looked at are cut to where they can matter; check against all of them."""
    cells = [("g", "x", "u", 30000), ("g", "x", "v", 20000), ("g", "y", "u", 25000), ("g", "y", "v", 25000)]
    df = spark.createDataFrame(cells, "g string, a string, b string, n bigint")
    margins = clustering._margins(df, ["g"])
    got = clustering.expected_mutual_information(margins, ["g"], clustering._sums(df, margins, ["g"])).first()["EMI"]
    n, want = 100000, 0.0
    lf = lambda k: math.lgamma(k + 1)
    for x in (50000, 50000):
        for y in (55000, 45000):
            for o in range(max(1, x + y - n), min(x, y) + 1):
                lp = lf(x) + lf(y) + lf(n - x) + lf(n - y) - lf(n) - lf(o) - lf(x - o) - lf(y - o) - lf(n - x - y + o)
                want += o / n * math.log(n * o / (x * y)) * math.exp(lp)
    assert got == pytest.approx(want, rel=1e-6, abs=1e-12)


def test_kmeans_by_group(spark):
    rows = []
    for g, centres in {"a": [(0, 0), (9, 9)], "b": [(0, 0), (9, 0), (0, 9)], "c": [(1, 1)]}.items():
        for label, (x, y) in enumerate(centres):
            rows += [(g, float(x + RND.normal() * 0.1), float(y + RND.normal() * 0.1), str(label)) for _ in range(30)]
    df = spark.createDataFrame(rows, "g string, x double, y double, label string")
    clustered = clustering.kmeans_by_group(df, "g", ["x", "y"], "label", seed=2)
    assert clustered.count() == len(rows)
    scores = clustering.agreement(clustered, ["g"])
    assert all(r["ARI"] == pytest.approx(1.0) for r in scores.collect())
    table = clustering.score_table(scores, "g", "Set")
    assert table.count() == 12 and table.where("values < 0").count() == 0


def test_principal_components_by_group(spark):
    rng = np.random.default_rng(3)
    rows = [("a", [float(x) for x in rng.normal(size=4)]) for _ in range(30)]
    rows += [("b", [float(x) for x in rng.normal(size=4)]) for _ in range(12)] + [("one", [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "g string, vec array<double>")
    coords, explained = embedding.principal_components_by(df, "vec", 2, "g")
    for g in ("a", "b"):
        m = np.array([v for k, v in rows if k == g])
        z = (m - m.mean(0)) / m.std(0, ddof=1)
        sdev = np.linalg.svd(z, compute_uv=False) / np.sqrt(len(z) - 1)
        got = {r["component"]: r for r in explained.where(F.col("g") == g).collect()}
        assert [got[1]["sdev"], got[2]["sdev"]] == pytest.approx(sdev[:2])
        assert [got[1]["ratio"], got[2]["ratio"]] == pytest.approx(sdev[:2] ** 2 / (sdev**2).sum())
    assert coords.count() == len(rows) and [r["pc"] for r in coords.where("g = 'one'").collect()] == [None]
    none, empty = embedding.principal_components_by(df.limit(0), "vec", 2, "g")
    assert none.count() == empty.count() == 0


def test_kmeans_of_all_groups_together(spark):
    rnd = np.random.default_rng(5)
    rows = [(g, float(x), float(y), str(i % k)) for g, k in (("a", 3), ("b", 5), (None, 2)) for i, (x, y) in enumerate(rnd.normal(size=(80, 2)))]
    rows += [("a", None, 1.0, "0"), ("b", float("nan"), 1.0, "9"), ("none", 1.0, 1.0, None), ("one", 2.0, 2.0, "z"), ("same", 1.0, 1.0, "p"), ("same", 1.0, 1.0, "q")]
    df = spark.createDataFrame(rows, "g string, x double, y double, label string")
    got = clustering.kmeans_by_group(df, "g", ["x", "y"], "label").collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"g", "x", "y", "label", "cluster"}
    for g in ("a", "b", None):
        own = [r for r in got if r["g"] == g and r["cluster"] is not None]
        points, cluster = np.array([(r["x"], r["y"]) for r in own]), np.array([r["cluster"] for r in own])
        k = {"a": 3, "b": 6, None: 2}[g]
        assert len(own) == 80 and set(cluster) == set(range(k))
        means = np.array([points[cluster == c].mean(axis=0) for c in range(k)])
        away = ((points[:, None] - means) ** 2).sum(axis=2)
        assert (away[np.arange(len(own)), cluster] <= away.min(axis=1) + 1e-9).all()
    assert {r["g"]: r["cluster"] for r in got if r["g"] in ("none", "one")} == {"none": None, "one": 0}
    assert [r["cluster"] for r in got if r["g"] == "same"] == [0, 0]
    assert [r["cluster"] for r in got if r["x"] is None or np.isnan(r["x"])] == [None, None]
    assert clustering.kmeans_by_group(df.limit(0), "g", ["x", "y"], "label").count() == 0


def test_components_of_groups_with_constant_dimensions(spark):
    rng = np.random.default_rng(4)
    rows = [("a", [float(x), 7.1, float(y)]) for x, y in rng.normal(1e3, 1.0, size=(40, 2))] + [(None, [1.0, 2.0, float(i)]) for i in range(5)]
    rows += [("flat", [0.1, 0.2, 0.3])] * 3 + [("a", None)]
    df = spark.createDataFrame(rows, "g string, vec array<double>")
    coords, explained = embedding.principal_components_by(df, "vec", 2, "g")
    m = np.array([v for g, v in rows if g == "a" and v])[:, [0, 2]]
    z = (m - m.mean(0)) / m.std(0, ddof=1)
    sdev = np.linalg.svd(z, compute_uv=False) / np.sqrt(len(z) - 1)
    got = {(r["g"], r["component"]): r for r in explained.collect()}
    assert [got["a", i]["sdev"] for i in (1, 2)] == pytest.approx(sdev) and got[None, 1]["ratio"] == pytest.approx(1.0)
    assert got["flat", 1]["sdev"] == 0.0
    table = coords.collect()
    assert len(table) == len(rows) and sum(r["pc"] is None for r in table) == 1
    pcs = np.array([r["pc"] for r in table if r["g"] == "a" and r["pc"]])
    assert pcs.std(axis=0, ddof=1) == pytest.approx(sdev) and abs(np.cov(pcs.T)[0, 1]) < 1e-6
