"""Bayesian search for settings: a Gaussian process over the trials, expected improvement for the next ones.

Only the trials' settings and scores are on the driver; the trials of a round are fitted side by
side by `scores_of`, one Spark job for all of them where the learner allows it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators import boosting, evaluate
from talus.operators.events import folds
from talus.operators.ranks import running_sums
from talus.runtime import stage


@dataclass(frozen=True)
class Range:
    """A setting's range; whole: integers only."""

    low: float
    high: float
    whole: bool = False

    def at(self, u: float) -> float:
        v = self.low + (self.high - self.low) * u
        return int(min(self.high, math.floor(self.low + (self.high - self.low + 1) * u))) if self.whole else v

    def unit(self, v: float) -> float:
        return (v - self.low + 0.5) / (self.high - self.low + 1) if self.whole else (v - self.low) / (self.high - self.low)


#: The settings that are searched and their ranges.
SPACE = {"depth": Range(3, 10, True), "step": Range(0.01, 0.30), "gamma": Range(0.0, 5.0)}


class GaussianProcess:
    """Regression with a Matern 5/2 kernel of unit variance on standardised scores."""

    def __init__(self, x: np.ndarray, y: np.ndarray, lengths: tuple[float, ...] = (0.1, 0.2, 0.4, 0.8), noise: float = 1e-4):
        self.x, self.noise = np.atleast_2d(x), noise
        self.mean, self.scale = float(np.mean(y)), float(np.std(y)) or 1.0
        z = (np.asarray(y, np.float64) - self.mean) / self.scale
        self.length = max(lengths, key=lambda s: self._evidence(z, s))
        self.lower = np.linalg.cholesky(self._kernel(self.x, self.x, self.length) + noise * np.eye(len(z)))
        self.weights = np.linalg.solve(self.lower.T, np.linalg.solve(self.lower, z))

    @staticmethod
    def _kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
        r = math.sqrt(5) * np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)) / length
        return (1 + r + r**2 / 3) * np.exp(-r)

    def _evidence(self, z: np.ndarray, length: float) -> float:
        k = self._kernel(self.x, self.x, length) + self.noise * np.eye(len(z))
        return float(-0.5 * z @ np.linalg.solve(k, z) - 0.5 * np.linalg.slogdet(k)[1])

    def posterior(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation at the points."""
        cross = self._kernel(np.atleast_2d(at), self.x, self.length)
        half = np.linalg.solve(self.lower, cross.T)
        spread = np.sqrt(np.maximum(1 - (half**2).sum(axis=0), 1e-12))
        return self.mean + self.scale * (cross @ self.weights), self.scale * spread


def expected_improvement(mean: np.ndarray, spread: np.ndarray, best: float) -> np.ndarray:
    z = (mean - best) / spread
    density = np.exp(-0.5 * z**2) / math.sqrt(2 * math.pi)
    below = 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in z]))
    return (mean - best) * below + spread * density


def _halton(n: int, d: int) -> np.ndarray:
    """n points that fill the unit cube evenly."""
    primes, out = (2, 3, 5, 7, 11, 13, 17, 19), np.zeros((n, d))
    for j in range(d):
        for i in range(n):
            k, f = i + 1, 1.0
            while k:
                f /= primes[j]
                out[i, j] += f * (k % primes[j])
                k //= primes[j]
    return out


def search(scores_of: Callable[[list[dict]], list[float]], space: dict[str, Range] = SPACE, trials: int = 20, parallel: int = 4, first: int = 4, seed: int = 42, pool: int = 2000) -> list[tuple[dict, float]]:
    """(setting, score) of each trial in order; higher scores are better.

    The first trials fill the space evenly. Then, as often as a round has trials, the point of
    greatest expected improvement joins the round, with the mean that is expected there as its
    score until the round is fitted.
    """
    names = list(space)
    rng = np.random.default_rng(seed)
    setting = lambda u: {n: space[n].at(float(v)) for n, v in zip(names, u)}
    place = lambda s: [space[n].unit(s[n]) for n in names]
    done: list[tuple[dict, float]] = []
    start = [setting(u) for u in _halton(min(first, trials), len(names))]
    done += list(zip(start, scores_of(start)))
    while len(done) < trials:
        x, y = [place(s) for s, _ in done], [v for _, v in done]
        batch: list[dict] = []
        while len(batch) < min(parallel, trials - len(done)):
            options = [setting(u) for u in rng.random((pool, len(names)))]
            known = {tuple(s.values()) for s, _ in done} | {tuple(s.values()) for s in batch}
            options = [s for s in options if tuple(s.values()) not in known]
            if not options:
                break
            model = GaussianProcess(np.array(x), np.array(y))
            mean, spread = model.posterior(np.array([place(s) for s in options]))
            at = int(np.argmax(expected_improvement(mean, spread, max(y))))
            batch.append(options[at])
            x.append(place(options[at]))
            y.append(float(mean[at]))
        if not batch:
            break
        done += list(zip(batch, scores_of(batch)))
    return done


def aucs(scored: DataFrame, by: str) -> DataFrame:
    """(by, auc): the rank statistic of (by, p, y) rows in each group, by one distributed running sum."""
    cells = scored.groupBy(by, "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    below = running_sums(cells, [F.col("p")], {"below": "neg"}, [by], inclusive=False)
    sums = below.groupBy(by).agg(F.sum(F.col("pos") * F.col("below") + F.col("pos") * F.col("neg") * 0.5).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(by, F.try_divide(F.col("u"), F.nullif((F.col("p") * F.col("n")).cast("double"), F.lit(0.0))).alias("auc"))


def tuned(df: DataFrame, key: str, label: str, features: list[str], base: boosting.Setting = boosting.Setting(), space: dict[str, Range] = SPACE, trials: int = 20, parallel: int = 4, k: int = 5, seed: int = 42) -> DataFrame:
    """(trial, the settings of space, auc, f1, score) of each trial of a Bayesian search.

    A trial is a boosted model for each of k folds, all of a round's trials trained side by
    side; auc and f1 are of its out-of-fold scores, and score, which the search raises, is f1
    at its best threshold plus a thousandth of auc.
    """
    dealt = stage(folds(df.where(F.col(label).isNotNull()), key, label, k, seed).withColumn("y", F.col(label).cast("int")), "tuning-rows")
    rows: list[tuple] = []

    def scores_of(settings: list[dict]) -> list[float]:
        wanted = [replace(base, fold=f, **s) for s in settings for f in range(k)]
        scored = boosting.held_out(dealt, key, label, features, wanted, "fold").select(F.floor(F.col("model") / k).cast("int").alias("trial"), "p", "y")
        auc = {r.trial: r.auc for r in aucs(scored, "trial").collect()}
        f1 = {r.trial: r.f1 for r in evaluate.sweep(scored, 100, 9900, 100, by=("trial",)).groupBy("trial").agg(F.max("f1").alias("f1")).collect()}
        found = [(float(auc.get(t) or 0.0), float(f1.get(t) or 0.0)) for t in range(len(settings))]
        for s, (a, b) in zip(settings, found):
            rows.append((len(rows) + 1, *(float(s[n]) for n in space), a, b, b + a / 1000))
        return [b + a / 1000 for a, b in found]

    search(scores_of, space, trials, parallel, seed=seed)
    return df.sparkSession.createDataFrame(rows, "trial int, " + ", ".join(f"{n} double" for n in space) + ", auc double, f1 double, score double")
