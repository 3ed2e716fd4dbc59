"""Cases in which an operator once did less than its whole job."""

import numpy as np

from cadenza.operators import selection


def brute(x, y, k=5):
    x, y = x / (x.std() or 1), y / (y.std() or 1)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, 1)[:, k - 1]
    nx, ny = (dx < r[:, None]).sum(1), (dy < r[:, None]).sum(1)
    psi = lambda n: np.concatenate([[-0.5772156649015329], -0.5772156649015329 + np.cumsum(1 / np.arange(1, len(x)))])[np.maximum(n, 1) - 1]
    return max(0.0, float(psi(np.array(len(x))) + psi(np.array(k)) - psi(nx).mean() - psi(ny).mean()))


def test_mutual_information_of_all_rows(spark):
    rng = np.random.default_rng(7)
    x, e = rng.normal(size=2600), rng.normal(size=2600)
    # ties of values without a common step, whose distances no rounding can reorder
    pool = rng.normal(size=400)
    often = lambda n: pool[rng.integers(0, n, 2600)]
    data = {"line": (x, x + 0.5 * e), "ties": (often(60), often(400)), "pairs": (often(9), often(7)), "flat": (np.zeros(300), e[:300]), "steps": (often(5), e), "few": (x[:5], e[:5]), "small": (x[:40], np.abs(x[:40])), None: (x[:700], e[:700])}
    rows = [(f, float(a), float(b)) for f, (u, v) in data.items() for a, b in zip(u, v, strict=True)] + [("line", None, 1.0), ("line", 1.0, None), ("line", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "feature string, value double, y double").repartition(3)
    for tile in (512, 40):
        got = {r["feature"]: r["mi"] for r in selection.mutual_information(df, tile=tile).collect()}
        assert got.keys() == data.keys() and got["few"] == 0
        for f, (u, v) in data.items():
            assert f == "few" or abs(got[f] - brute(u, v)) < 1e-8, (f, tile, got[f], brute(u, v))  # one count more changes over 1e-7
    assert selection.mutual_information(df.limit(0)).count() == 0


def test_tiles_are_bounded_when_values_have_few_levels(spark):
    rng = np.random.default_rng(3)
    rows = [(0, float(rng.integers(0, 3)), float(v), 1) for v in rng.normal(size=4000)] + [(1, float(v), 0.0, 1) for v in rng.normal(size=900)]
    points = spark.createDataFrame(rows, "f int, x double, y double, w long")
    tiles = selection._tiles(points, 12, 50).toPandas()
    sizes = tiles.groupby(["f", "strip", "tile"]).size()
    assert len(tiles) == 4900 and sizes.max() < 75 and (sizes < 25).sum() <= 3  # one rest for each place where a feature begins or ends
    for _, g in tiles.groupby(["f", "strip"]):
        g = g.groupby("tile")["y"].agg(["min", "max"])
        assert (g["min"].to_numpy()[1:] >= g["max"].to_numpy()[:-1]).all()


def test_running_counts_share_a_common_value(spark):
    weights = spark.createDataFrame([(0, 0, float(v), 2) for v in range(50)] + [(0, 1, 7.0, 5)], "f int, axis int, v double, w long")
    asked = spark.createDataFrame([(0, 0, 7.0, k) for k in range(3000)] + [(0, 0, -1.0, 0), (0, 0, 49.5, 1), (0, 1, 7.0, 2), (0, 1, 6.9, 3)], "f int, axis int, v double, key int")
    got = selection._values_up_to(weights, asked).toPandas()
    assert len(got) == 3004 and set(got["n"][(got["v"] == 7) & (got["axis"] == 0)]) == {16}
    assert {(r.axis, r.v): r.n for r in got.itertuples()} == {(0, 7.0): 16, (0, -1.0): 0, (0, 49.5): 100, (1, 7.0): 5, (1, 6.9): 0}


def test_the_largest_of_repeated_values_counts(spark):
    rows = [(k, f, float((k * 7 + n * 3) % 11)) for k in range(40) for n, f in enumerate("ab")]
    once = selection.pairwise_correlation(spark.createDataFrame(rows, "key int, feature string, value double"), "key").first()["corr"]
    more = spark.createDataFrame(rows + [(k, f, v - 5) for k, f, v in rows[::3]], "key int, feature string, value double").repartition(5)
    assert abs(selection.pairwise_correlation(more, "key").first()["corr"] - once) < 1e-12


def test_principal_components_are_eigenvectors(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(x)], "id int, a double, b double, c double, d double")
    scores, explained = selection.principal_components(df, list("abcd"))
    z = (x - x.mean(0)) / x.std(0)
    value, vector = np.linalg.eigh(np.cov(z.T))
    vector = vector[:, ::-1][:, :2]
    vector = vector * np.sign(vector[np.abs(vector).argmax(0), [0, 1]])
    got = np.array([[r["pc1"], r["pc2"]] for r in scores.orderBy("id").collect()])
    assert np.abs(got - z @ vector).max() < 1e-8 and np.allclose(explained, value[::-1][:2] / value.sum())
