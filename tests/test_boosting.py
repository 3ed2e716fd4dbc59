"""Boosting against a plain version that grows leaf by leaf, and the search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import boosting, selection, tuning


def plain(model, x, y, chosen_by_tree, p):
    """The same boosting on arrays of bins: the best leaf of all is split next."""
    f, trees = np.full(len(y), model.start), []
    for chosen in chosen_by_tree:
        g, leaves, depth = f - y, {0: np.arange(len(y))}, {0: 0}
        tree = boosting.Tree()
        while len(leaves) < p.leaves:
            options = []
            for node, rows in leaves.items():
                if depth[node] >= p.depth:
                    continue
                for k in chosen:
                    for cut in np.unique(x[rows, k]):
                        left = rows[x[rows, k] <= cut]
                        if p.least_rows <= len(left) <= len(rows) - p.least_rows:
                            a, b = g[left].sum(), g[rows].sum() - g[left].sum()
                            gain = boosting.gain_of(a, len(left), p) + boosting.gain_of(b, len(rows) - len(left), p) - boosting.gain_of(a + b, len(rows), p)
                            options.append((gain, -node, -k, -int(cut), a, b, left))
            if not options or (best := max(options, key=lambda o: o[:4]))[0] <= 0:
                break
            gain, node, k, cut, a, b, left = best[0], -best[1], -best[2], -best[3], *best[4:]
            rows, d = leaves.pop(node), depth.pop(node)
            at = tree.split(node, k, cut, gain, (boosting.leaf_value(a, len(left), p), boosting.leaf_value(b, len(rows) - len(left), p)))
            leaves |= {at: left, at + 1: np.setdiff1d(rows, left)}
            depth |= {at: d + 1, at + 1: d + 1}
        f = f + tree.predict(x)
        trees.append(tree)
    return trees, f


def table(spark, n=400):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 4)).round(2)
    y = np.where(x[:, 0] > 0.3, 3 * x[:, 1], x[:, 2] ** 2) + 0.1 * rng.normal(size=n)
    rows = [(k, *map(float, x[k]), float(y[k])) for k in range(n)] + [(n, None, 0.1, 0.2, 0.3, 1.0), (n + 1, float("nan"), 0.1, None, 0.3, 2.0), (n + 2, 1.0, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double").repartition(5)


@pytest.mark.parametrize(("leaves", "depth"), [(6, 9), (31, 3)])
def test_trees_are_those_grown_leaf_by_leaf(spark, leaves, depth):
    p = boosting.Params(trees=3, leaves=leaves, depth=depth, rate=0.3, least_rows=7, features=0.75, bins=16)
    df, names = table(spark), ["a", "b", "c", "d"]
    model = boosting.leafwise(df, names, "y", p, write_every=2)
    rows = df.where("y IS NOT NULL").collect()
    x = model.binned([np.array([np.nan if r[n] is None else r[n] for r in rows], float) for n in names])
    rng = np.random.default_rng(p.seed)
    chosen = [sorted(rng.choice(4, 3, replace=False).tolist()) for _ in range(3)]
    trees, f = plain(model, x, np.array([r["y"] for r in rows]), chosen, p)
    for mine, theirs in zip(model.trees, trees, strict=True):
        assert sorted(zip(mine.feature, mine.bin, strict=True)) == sorted(zip(theirs.feature, theirs.bin, strict=True)) and np.allclose(sorted(mine.gain), sorted(theirs.gain))
        assert sum(k < 0 for k in mine.feature) <= leaves
    got = {r["id"]: r["yhat"] for r in boosting.predicted(model, df).collect()}
    assert np.allclose([got[r["id"]] for r in rows], f) and len(got) == 403
    assert abs(sum(r["importance"] for r in boosting.gain_importances(model, df).collect()) - 1) < 1e-9


def test_rows_without_a_split(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, y double")
    model = boosting.leafwise(df, ["a"], "y", boosting.Params(trees=2))
    assert model.trees == [] and [r["yhat"] for r in boosting.predicted(model, df).collect()] == [3.0, 3.0]
    assert boosting.predicted(boosting.leafwise(df.limit(0), ["a"], "y"), df.where(F.lit(False))).collect() == []


def test_exact_p_values():
    """By counting all paths; D * n * m of the published tables for equal and unequal sizes."""
    from itertools import combinations
    from math import comb

    for n, m in ((1, 1), (3, 3), (4, 6), (5, 7), (6, 6)):
        ends = np.array([np.isin(np.arange(n + m), c) for c in combinations(range(n + m), n)])
        far = np.abs(np.cumsum(ends, 1) * m - np.cumsum(~ends, 1) * n).max(1)
        for h in range(n * m + 1):
            assert abs(selection.exact_ks_p(h / (n * m), n, m) - (far >= h).sum() / comb(n + m, n)) < 1e-12
    # equal sizes have a closed form for the one-sided tails: 2 * sum of (-1)^(j-1) C(2n, n - jh) / C(2n, n)
    for n in (10, 25, 50):
        for h in (3, 5, n // 2):
            want = 2 * sum((-1) ** (j - 1) * comb(2 * n, n - j * h) / comb(2 * n, n) for j in range(1, n // h + 1))
            assert abs(selection.exact_ks_p(h / n, n, n) - want) < 1e-10


def test_search_repeats_and_beats_the_grid():
    space = {"a": tuning.Range(-5, 5), "b": tuning.Range(1e-3, 1e3, log=True), "c": tuning.Range(1, 9, whole=True)}
    surface = lambda s: (s["a"] - 0.3) ** 2 + (np.log10(s["b"]) + 2.1) ** 2 + 0.3 * abs(s["c"] - 4)
    first, again = (tuning.search(surface, space, 64, seed, 4) for seed in (3, 3))
    assert first == again and all(isinstance(s["c"], int) and 1 <= s["c"] <= 9 for s, _ in first)
    grid = min(surface({"a": space["a"].at(a), "b": space["b"].at(b), "c": space["c"].at(c)}) for a in (0, 1 / 3, 2 / 3, 1) for b in (0, 1 / 3, 2 / 3, 1) for c in (0, 1 / 3, 2 / 3, 1))
    assert np.mean([min(v for _, v in tuning.search(surface, space, 64, seed, 4)) for seed in range(5)]) < 0.5 * grid


def test_search_of_boosted_trees(spark):
    df = table(spark, 120).where("y IS NOT NULL").cache()
    space = {"leaves": tuning.Range(2, 6, whole=True), "rate": tuning.Range(0.1, 0.9, log=True), "trees": tuning.Range(1, 2, whole=True), "depth": tuning.Range(1, 2, whole=True)}
    rows = tuning.boosting_search(df.where("id % 3 <> 0"), df.where("id % 3 = 0"), ["a", "b"], "y", space, trials=3, together=3).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and rows[0]["weighted_mae"] <= rows[2]["weighted_mae"] and "leaves" in rows[0]["settings"]


def test_exact_p_of_large_samples(spark):
    rows = [("a", 0.02, 12_000, 11_000), ("b", 0.5, 20_000, 20_000), ("c", None, 3, 0), ("d", 0.5, 2, 2)]
    df = spark.createDataFrame([(f, ks, 0.0, n, m) for f, ks, n, m in rows], "feature string, ks double, ks_p double, n long, m long")
    got = {r["feature"]: r["ks_p"] for r in selection.with_exact_p(df).collect()}
    limit = 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * 0.02**2 * 12_000 * 11_000 / 23_000) for k in range(1, 20))
    assert abs(got["a"] - limit) < 2e-3 and got["b"] == 0.0 and got["c"] is None and abs(got["d"] - 1.0) < 1e-12
    # the places are held near the diagonal alone, also where the buffer moves on
    n, m, least = 5200, 5000, round(0.02 * 5200 * 5000)
    i, a = np.arange(n + 1), np.zeros(n + 1)
    for k in range(1, n + m + 1):
        j = k - i
        a = np.where((j >= 0) & (j <= m), np.where(np.abs(i * m - j * n) >= least, 1.0, (i * np.concatenate([[0.0], a[:-1]]) + j * a) / k), 0.0)
    assert abs(selection.exact_ks_p(0.02, n, m) - a[n]) < 1e-10
