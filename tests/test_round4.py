"""Fits that scale: what the findings of round 4 asked for, on rows built here."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.sql import functions as F

from veridata.functions import spread as S
from veridata.operators import models as M
from veridata.operators import tree as T


def _rows(spark, n, classes=2, seed=5, copies=1):
    rng = random.Random(seed)
    rows = [(rng.gauss(0, 1), float(rng.randrange(6)), rng.choice("uvwx"), rng.choice("MF"), rng.random()) for _ in range(n)]
    say = lambda r: int(r[0] + (r[2] == "u") + rng.random() * 2 > 0.8) + (rng.random() < 0.3) * (classes > 2)
    rows = [(*r, "abc"[say(r)]) for r in rows] * copies
    return spark.createDataFrame(rows, "x double, k double, g string, s string, z double, y string")


@pytest.mark.parametrize("classes, copies, depth", [(2, 1, 30), (3, 2, 4)])
def test_large_tree_is_the_library_tree(spark, monkeypatch, classes, copies, depth):
    df = _rows(spark, 1500, classes, copies=copies)
    feats = ["x", "k", "g", "s", "z"]
    want = M.train(df, "tree", feats, "y", {"max_depth": depth})
    fits = []
    monkeypatch.setattr(DecisionTreeClassifier, "fit", lambda *a, **k: fits.append(a))
    monkeypatch.setattr(S, "ROWS_PER_TASK", 1000)
    for limit, cells in ((10 ** 6, 10 ** 6), (300, 2000)):  # all in one task; a top by passes, with few nodes in each
        monkeypatch.setattr(T, "SUBTREE_ROWS", limit)
        monkeypatch.setattr(T, "TOP_CELLS", cells)
        got = M.train(df, "tree", feats, "y", {"max_depth": depth})
        assert (got.metrics, got.detail, got.n_rows, got.interpretation) == (want.metrics, want.detail, want.n_rows, want.interpretation)
    assert not fits


def test_thresholds_of_all_rows():
    rng = np.random.default_rng(3)
    values, weights = np.sort(rng.normal(size=200_000)), np.ones(200_000)
    want = T.thresholds(values, weights)
    parts = [T.thinned(values[i::7], weights[i::7], T.POINTS) for i in range(7)]
    total = parts[0]
    for p in parts[1:]:
        total = T._joined(total, p, 16 * T.POINTS)
    got = T.thresholds(*total.reshape(2, -1))
    assert len(got) == len(want) == 31 and abs(np.searchsorted(values, got) - np.searchsorted(values, want)).max() < 200_000 / 1000
    assert T.thresholds(np.array([1.0, 2.0, 4.0]), np.ones(3)).tolist() == [1.5, 3.0]


def test_weights_are_the_split(spark):
    df = _rows(spark, 300, 3, copies=4).union(_rows(spark, 200, 3, seed=9)).select(
        "x", "k", F.col("z").alias("w"), (F.ascii("y") - 97).cast("double").alias("label"))
    train, test, _ = M.stratified_split(df, 1400)
    rows, _ = M.stratified_weights(df.select("*", F.col("x").alias("_f0")), 1400, ["_f0"])
    assert rows.count() == 500 and rows.columns == ["label", "_f0", "_train", "_test"]
    for part, copies in ((train, "_train"), (test, "_test")):
        want = part.groupBy("label", F.col("x").alias("_f0")).agg(F.count(F.lit(1)).alias("n"))
        assert sorted(want.collect()) == sorted(rows.where(F.col(copies) > 0).select("label", "_f0", F.col(copies).alias("n")).collect())


def test_logistic_moves_no_copies(spark, monkeypatch):
    fitted, staged, fit, stage = [], [], LogisticRegression.fit, M.stage
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df, params=None: fitted.append(df.count()) or fit(self, df, params))
    monkeypatch.setattr(M, "stage", lambda df, name: staged.append((name, df.columns)) or stage(df, name))
    res = M.train(_rows(spark, 200, copies=50), "logistic", ["x", "k", "g"], "y")
    assert res.n_rows == 10_000 and sum(v for k, _, v in res.detail if k == "confusion") == 2500
    assert fitted == [200]  # rows that differ, with their copies; not 7,500
    assert staged == [("split-weights", ["label", "_h", "_n", "_f0", "_f1", "_f2_ix"]), ("confusion", ["actual", "predicted", "n"])]
