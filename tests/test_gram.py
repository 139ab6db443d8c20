"""Correlation by block products, least-norm regression and k-means of all starts at once."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridata.operators import eda, gram, models


def pairwise(x):
    out = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            r = np.corrcoef(a, b)[0, 1] if len(a) > 1 and a.std() > 0 and b.std() > 0 else 0.0
            out[i, j] = r
    return out


def test_blocks_equal_pairwise_correlation(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 9)) * [1, 5, 0.1, 1e6, 1, 1, 2, 3, 1] + [0, 1e5, 3, 1e7, 0, 0, 0, 0, 0]
    x[:, 4] = x[:, 0] + 0.1 * x[:, 4]
    x[:, 8] = 7.0  # constant: left out
    x[rng.random((700, 9)) < [0, 0, 0.3, 0, 0, 0.9, 0, 0.5, 0.2]] = np.nan
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in x],
                               ", ".join(f"c{i} double" for i in range(9))).repartition(5)
    monkeypatch.setattr(gram, "EDGE", 3)
    monkeypatch.setattr(gram, "FANIN", 2)
    got = {(r["i"], r["j"]): r["r"] for r in eda.correlation(df, digits=9, blocks=True).collect()}
    want = pairwise(x[:, :8])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    plain = {(r["i"], r["j"]): r["r"] for r in eda.correlation(df, blocks=False).collect()}
    assert plain == {(r["i"], r["j"]): r["r"] for r in eda.correlation(df, blocks=True).collect()}


def test_infinite_values_leave_other_pairs_alone(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), float("inf") if i == 3 else float(i)) for i in range(20)],
                               "a double, b double, c double")
    for blocks in (True, False):
        got = {(r["col_a"], r["col_b"]): r["r"] for r in eda.correlation(df, blocks=blocks).collect()}
        assert got["a", "c"] == got["b", "c"] == 0.0 and got["a", "b"] == round(np.corrcoef(range(20), [i * i % 7 for i in range(20)])[0, 1], 3)
    assert eda.correlation(df.where("false"), blocks=True).collect() == []


def test_a_thousand_columns(spark):
    wide = spark.range(400).select(*[(F.rand(k) + (F.col("id") % 13) * (k % 3)).alias(f"c{k}") for k in range(1000)])
    wide = wide.repartition(4)
    out = eda.correlation(wide)
    assert len(out._jdf.queryExecution().analyzed().toString()) < 400_000  # 499,500 pairs would not fit
    got = out.agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("top")).first()
    assert got["n"] == 1000 * 999 // 2 and 0.9 < got["top"] <= 1


# ── least squares ───────────────────────────────────────────────────────────
def sample(seed=1, n=500):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        g, h, x = rng.choice("pqr"), rng.choice(["u", "v"]), rng.uniform(0, 50)
        rows.append((x, x * 2 + 1, g, h, 1e6 * rng.random(), 3 * x + {"p": 10, "q": -4, "r": 0}[g] + (h == "u") + rng.gauss(0, 1), 5.0))
    return rows


def test_least_norm_of_collinear_columns(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "x double, x2 double, g string, h string, big double, y double, one double")
    got = {r["name"]: r["value"] for r in models.least_squares(df, ["x", "x2", "g", "h", "big", "one"], "y").collect()}
    design = np.array([[x, x2, *(g == v for v in "pqr"), *(h == v for v in "uv"), big, one] for x, x2, g, h, big, _, one in rows], float)
    y = np.array([r[5] for r in rows])
    centred = design - design.mean(axis=0)
    # scaled for the rank, as a column of 1e6 must not hide the others
    scale = np.where(centred.std(axis=0) > 1e-9, centred.std(axis=0), 1)
    u, s, vt = np.linalg.svd(centred / scale, full_matrices=False)
    rank = (s > 1e-8 * s[0]).sum()
    some = (vt[:rank].T @ ((u[:, :rank].T @ (y - y.mean())) / s[:rank])) / scale
    free = np.linalg.qr((vt[rank:] / scale).T)[0]
    want = some - free @ (free.T @ some)
    names = ["x", "x2", "g_p", "g_q", "g_r", "h_u", "h_v", "big", "one"]
    assert all(abs(got[n] - w) < 1e-6 * max(1, abs(w)) for n, w in zip(names, want))
    assert abs(got["g_p"] + got["g_q"] + got["g_r"]) < 1e-9 and abs(got["h_u"] + got["h_v"]) < 1e-9
    assert abs(got["x2"] - 2 * got["x"]) < 1e-6 and got["one"] == 0.0
    assert abs(got["intercept"] - (y.mean() - design.mean(axis=0) @ want)) < 1e-6


def test_coefficients_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(sample(), "x double, x2 double, g string, h string, big double, y double, one double")
    found = {tuple(models.train(df.repartition(n), "linear", ["x", "x2", "g", "big"], "y").detail) for n in (1, 3, 8)}
    assert len(found) == 1
    res = models.train(df, "linear", ["x", "g"], "y")
    assert dict(res.metrics)["r2"] > 0.99 and res.interpretation.startswith("El modelo explica el 99.") and "«g_p»" in res.interpretation


# ── k-means ─────────────────────────────────────────────────────────────────
def plain_lloyd(x, centres, tol=models.KMEANS_TOL):
    while True:
        own = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        done = ((moved - centres) ** 2).sum() <= tol
        centres = moved
        if done:
            d = np.sqrt(((x[:, None] - centres) ** 2).sum(axis=2))
            own = d.argmin(axis=1)
            a = d[np.arange(len(x)), own]
            d[np.arange(len(x)), own] = np.inf
            b = d.min(axis=1)
            return centres, np.bincount(own, minlength=len(centres)), (a ** 2).sum(), ((b - a) / np.maximum(a, b)).mean()


def test_all_starts_equal_separate_fits(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.7, size=(200, 3)) for c in ([0, 0, 0], [4, 0, 1], [0, 5, 2], [3, 3, 3])])
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(4)
    starts = np.array([models.plus_plus(x, 4, np.random.default_rng(s)) for s in range(6)])
    starts[5, 3] = [1e6, 1e6, 1e6]  # a cluster without rows
    centres, counts, costs, silhouettes, passes = models.lloyd(rows, starts)
    longest = 0
    for i, start in enumerate(starts):
        want, held, cost, sil = plain_lloyd(x, start)
        assert np.allclose(centres[i], want) and (counts[i] == held).all()
        assert math.isclose(costs[i].sum(), cost) and math.isclose(silhouettes[i].sum() / len(x), sil)
        now, n = start, 0
        while True:  # rounds of this start alone
            own = ((x[:, None] - now) ** 2).sum(axis=2).argmin(axis=1)
            moved = np.array([x[own == c].mean(axis=0) if (own == c).any() else now[c] for c in range(4)])
            n, step, now = n + 1, ((moved - now) ** 2).sum(), moved
            if step <= models.KMEANS_TOL:
                break
        longest = max(longest, n)
    assert passes == longest + 1  # scans are rounds, not rounds times starts


def test_kmeans_finds_the_groups_and_says_so(spark):
    rows = [(float(c * 10 + (i % 5) * 0.1), "a" if c else "b", float(i % 3)) for c in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "v double, g string, w double")
    res = models.train(df, "kmeans", ["v"], None, {"k": 3})
    assert sorted(n for _, _, n in res.detail) == [40, 40, 40] and dict(res.metrics)["silhouette"] > 0.9
    assert res.interpretation == "Se agruparon 120 filas en 3 grupos. El silhouette de %.2f indica una separación fuerte entre los grupos." % dict(res.metrics)["silhouette"]
    assert models.train(df.repartition(5), "kmeans", ["v", "g", "w"], None, {"k": 3}).metrics == models.train(df, "kmeans", ["v", "g", "w"], None, {"k": 3}).metrics
    with pytest.raises(ValueError):
        models.train(df.limit(9), "kmeans", ["v"], None, {})


def test_sentences_of_trees_and_logistic(spark):
    df = spark.createDataFrame([(float(i % 10), "hi" if i % 10 > 4 else "lo", float(i % 10) * 2) for i in range(200)], "x double, c string, y double")
    assert models.train(df, "logistic", ["x"], "c").interpretation.endswith("entre 2 clases.")
    assert models.train(df, "tree", ["x"], "c").interpretation.endswith("La variable más decisiva es «x».")
    assert models.train(df, "tree", ["x"], "y").interpretation.startswith("El árbol")


def test_confusion_of_many_classes_stays_long(spark):
    df = spark.createDataFrame([(float(i % 40), f"c{i % 40:02d}") for i in range(400)], "x double, c string")
    res = models.train(df, "tree", ["x"], "c")
    cells = [d for d in res.detail if d[0] == "confusion"]
    assert 0 < len(cells) < 40 * 40 and sum(n for _, _, n in cells) == 120  # three of ten each


def test_split_shares_the_copies_of_a_row(spark, monkeypatch):
    monkeypatch.setattr(models, "RUN", 7)
    rows = [("a", 1.0)] * 101 + [("a", 2.0)] * 3 + [("a", float(10 + i)) for i in range(96)] + [("b", 5.0)] * 40 + [("c", 6.0)]
    df = spark.createDataFrame(rows, "label string, x double")
    seen = set()
    for n in (1, 4):
        train, test, _ = models.stratified_split(df.repartition(n), len(rows))
        assert train.columns == test.columns == df.columns
        got = sorted(map(tuple, test.collect()))
        seen.add(tuple(got))
        assert sorted(got + [tuple(r) for r in train.collect()]) == sorted(rows)
        assert [sum(r[0] == c for r in got) for c in "abc"] == [50, 10, 0]
        assert got.count(("a", 1.0)) in (25, 26) and got.count(("b", 5.0)) == 10
    assert len(seen) == 1
