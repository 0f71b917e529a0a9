"""What narratives' predictions share: the supply of attention and the competition for it (E2B-02, E2B-03, E2B-06)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.attention import deviance, fit_row, nb_size

OMEGAS, BETAS, PROFILE_WINDOWS = (0.0, 0.25, 0.5, 0.75, 1.0), (-1.0, 0.0, 1.0), 96


@dataclass
class Supply:
    """Mean volume of each hour of the week, and a level that follows the log of what came over what was usual."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(168))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(168))
    level: float = 0.0
    gain: float = 0.05

    def forecast(self, hour: int) -> float:
        if self.seen[hour]:
            usual = self.mean[hour]
        else:
            usual = self.mean[self.seen > 0].mean() if self.seen.any() else 1.0
        return max(float(usual), 1e-3) * float(np.exp(self.level))

    def push(self, hour: int, volume: float, missing: bool = False) -> None:
        """A missing or empty window changes nothing."""
        if missing or volume <= 0:
            return
        self.seen[hour] += 1
        self.mean[hour] += (volume - self.mean[hour]) / self.seen[hour]
        self.level += self.gain * (np.log(volume) - np.log(max(self.mean[hour], 1e-3)) - self.level)


def competition(supply, wanted, omega: float, beta: float = 0.0):
    """(B / (B + S)) ** omega with B = exp(beta) supply; 1 where nothing is wanted."""
    b = np.exp(beta) * np.asarray(supply, float)
    return np.where(np.asarray(wanted) > 0, (b / (b + wanted)) ** omega, 1.0)


def competed(predictions: DataFrame, supply: DataFrame, omega: float, beta: float = 0.0) -> DataFrame:
    """predictions (narrative_id, win, lam_raw) with lam, all narratives of a window held to its supply (win, supply)."""
    s = predictions.groupBy("win").agg(F.sum("lam_raw").alias("wanted")).join(supply, "win")
    b = F.exp(F.lit(float(beta))) * F.col("supply")
    c = s.select("win", F.when(F.col("wanted") > 0, F.pow(b / (b + F.col("wanted")), F.lit(float(omega)))).otherwise(1.0).alias("c"))
    return predictions.join(c, "win").withColumn("lam", F.col("lam_raw") * F.col("c")).drop("c")


@dataclass
class Coupled:
    theta: dict[str, np.ndarray]
    omega: float
    beta: float
    size: float
    held_deviance: float


def fit_coupled(designs: dict[str, np.ndarray], counts: dict[str, np.ndarray], supply: np.ndarray, free: int, present: np.ndarray, rounds: int = 2, known: tuple[float, float] | None = None) -> Coupled:
    """Rows fit one by one against a shared factor, which the fitted rows then set anew. omega and beta are the known ones, or else those with the least deviance on the last windows, which their fits don't see.

    Rows are independent given the factor, so on a cluster each round is a grouped map and one sum per window.
    """
    soft = lambda n, th: np.logaddexp(0, designs[n] @ th)
    late = np.zeros(len(supply), bool)
    late[-PROFILE_WINDOWS:] = True
    early, late = present & ~late, present & late

    def fit(rows: np.ndarray, omega: float, beta: float, times: int):
        c, theta = np.ones(len(supply)), {}
        for _ in range(times):
            for n, x in designs.items():
                # the factor scales counts' expectations, so it scales the counts down to the row's own
                theta[n] = fit_row(x[rows], counts[n][rows] / np.maximum(c[rows], 1e-6), free, cap=0.95 if omega < 0.05 else None)
            c = competition(supply, sum(soft(n, th) for n, th in theta.items()), omega, beta)
        return theta, c

    best = None
    grid = [known] if known else [(o, b) for o in (OMEGAS if late.any() and early.any() else OMEGAS[:1]) for b in (BETAS if o else BETAS[1:2])]
    for omega, beta in grid:
        theta, c = fit(early if early.any() else present, omega, beta, 1)
        dev = sum(deviance(counts[n][late], np.maximum(c * soft(n, th), 1e-9)[late]) for n, th in theta.items())
        if best is None or dev < best[0] - 1e-9:
            best = (dev, omega, beta)
    dev, omega, beta = best
    theta, c = fit(present, omega, beta, rounds)
    lam = np.concatenate([(c * soft(n, th))[present] for n, th in theta.items()])
    return Coupled(theta, omega, beta, nb_size(np.concatenate([counts[n][present] for n in theta]), lam), float(dev))
