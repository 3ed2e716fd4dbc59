"""Search for settings by estimated densities: past trials are split into good and bad ones, and a new trial is
the candidate, drawn from the density of the good, whose density is largest relative to that of the bad."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import boosting
from cadenza.operators.metrics import weighted_mae


@dataclass(frozen=True)
class Range:
    """Whole or real numbers from low to high, even or (log) even in their logarithms."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def at(self, u: float) -> Any:
        """The value at a place in the unit interval."""
        if self.whole and not self.log:
            return int(min(self.high, self.low + math.floor(u * (self.high - self.low + 1))))
        value = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low))) if self.log else self.low + u * (self.high - self.low)
        return round(value) if self.whole else value


#: What the boosted trees are searched over: fixed values.
BOOSTING = {
    "leaves": Range(16, 128, whole=True), "rate": Range(0.005, 0.3, log=True), "trees": Range(80, 500, whole=True), "depth": Range(5, 24, whole=True), "least_rows": Range(10, 100, whole=True),
    "features": Range(0.5, 1.0), "l1": Range(1e-4, 1, log=True), "l2": Range(1e-4, 1, log=True),
}


class Sampler:
    """Draws places in the unit cube. Each coordinate's density is a mixture of normals at the trials' places,
    cut off at the ends, as wide as the gaps beside them, and one wide normal that keeps all of it open."""

    def __init__(self, n: int, seed: int, first: int = 10, share: float = 0.25, candidates: int = 24):
        self.n, self.rng, self.first, self.share, self.candidates = n, np.random.default_rng(seed), first, share, candidates
        self.places: list[np.ndarray] = []
        self.scores: list[float] = []

    def told(self, place: np.ndarray, score: float) -> None:
        self.places.append(place)
        self.scores.append(score if math.isfinite(score) else math.inf)

    def ask(self) -> np.ndarray:
        if len(self.scores) < self.first:
            return self.rng.random(self.n)
        order = np.argsort(self.scores, kind="stable")
        n_good = max(1, min(25, math.ceil(self.share * len(order))))
        x = np.array(self.places)
        good, bad = x[order[:n_good]], x[order[n_good:]]
        return np.array([self._coordinate(good[:, k], bad[:, k]) for k in range(self.n)])

    def _coordinate(self, good: np.ndarray, bad: np.ndarray) -> float:
        mid, wide = _mixture(good)
        some = []
        while len(some) < self.candidates:
            k = self.rng.integers(len(mid))
            v = self.rng.normal(mid[k], wide[k])
            if 0 <= v <= 1:
                some.append(v)
        some = np.array(some)
        return float(some[(_log_density(some, mid, wide) - _log_density(some, *_mixture(bad))).argmax()])


def _mixture(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middles and widths of the normals, with the wide one in the middle."""
    mid = np.sort(np.append(x, 0.5))
    edges = np.concatenate([[0.0], mid, [1.0]])
    wide = np.clip(np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1]), 1 / min(100, 1 + len(mid)), 1.0)
    wide[np.searchsorted(mid, 0.5)] = 1.0
    return mid, wide


def _log_density(at: np.ndarray, mid: np.ndarray, wide: np.ndarray) -> np.ndarray:
    cdf = lambda v: 0.5 * (1 + np.array([math.erf(t) for t in v / math.sqrt(2)]))
    inside = cdf((1 - mid) / wide) - cdf(-mid / wide)
    z = (at[:, None] - mid) / wide
    return np.log((np.exp(-0.5 * z * z) / (wide * math.sqrt(2 * math.pi) * inside)).mean(1) + 1e-300)


def search(objective: Callable[[dict], float], space: Mapping[str, Range], trials: int = 50, seed: int = 42, together: int = 4, first: int = 10) -> list[tuple[dict, float]]:
    """Settings and scores of all trials in order; less is better. `together` trials are drawn from the same
    past and run side by side. The same seed gives the same trials, however long each takes."""
    sampler, out = Sampler(len(space), seed, first), []
    with ThreadPoolExecutor(together) as pool:
        while len(out) < trials:
            places = [sampler.ask() for _ in range(min(together, trials - len(out)))]
            settings = [{n: r.at(u) for (n, r), u in zip(space.items(), p, strict=True)} for p in places]
            for place, s, score in zip(places, settings, pool.map(objective, settings), strict=True):
                sampler.told(place, score)
                out.append((s, score))
    return out


def boosting_search(train: DataFrame, valid: DataFrame, features: Sequence[str], target: str, space: Mapping[str, Range] = BOOSTING, trials: int = 50, seed: int = 42, together: int = 4) -> DataFrame:
    """trial, settings (JSON), weighted_mae on valid, and rank. Every trial is a distributed fit."""

    def objective(settings: dict) -> float:
        model = boosting.leafwise(train, features, target, boosting.Params(**settings))
        return weighted_mae(boosting.predicted(model, valid).select(F.col(target).alias("y"), "yhat")).first()[0]

    found = search(objective, space, trials, seed, together)
    table = train.sparkSession.createDataFrame([(k, json.dumps(s, sort_keys=True), v) for k, (s, v) in enumerate(found)], "trial int, settings string, weighted_mae double")
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.col("weighted_mae").asc_nulls_last(), "trial")))  # a row a trial
