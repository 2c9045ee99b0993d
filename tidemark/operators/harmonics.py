"""Least-squares fits by normal equations: Spark sums the products, a small system is solved."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: angular speeds of tidal constituents in degrees an hour
CONSTITUENTS = {
    "M2": 28.9841042, "S2": 30.0, "N2": 28.4397295, "K2": 30.0821373, "K1": 15.0410686, "O1": 13.9430356,
    "P1": 14.9589314, "Q1": 13.3986609, "M4": 57.9682084, "MS4": 58.9841042, "MM": 0.5443747, "SSA": 0.0821373, "SA": 0.0410686,
}


def solve(df: DataFrame, design: Sequence[Column], y: Column) -> np.ndarray:
    """Coefficients of y on the design columns: one aggregate of k(k+1)/2 + k sums, rows with nulls left out."""
    k = len(design)
    ok = y.isNotNull()
    cells = [F.sum(F.when(ok, design[i] * design[j])).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    r = df.agg(*cells, *(F.sum(F.when(ok, design[i] * y)).alias(f"b{i}") for i in range(k))).first()
    a, b = np.zeros((k, k)), np.zeros(k)
    for i in range(k):
        b[i] = r[f"b{i}"] or 0.0
        for j in range(i, k):
            a[i, j] = a[j, i] = r[f"a{i}_{j}"] or 0.0
    return np.linalg.lstsq(a, b, rcond=None)[0]


def combination(design: Sequence[Column], weights: np.ndarray) -> Column:
    out = F.lit(0.0)
    for d, w in zip(design, weights, strict=True):
        out = out + d * float(w)
    return out


def yearly(k: int = 2, day: str = "day") -> list[Column]:
    """1 and k harmonics of the year."""
    t = 2 * math.pi * F.dayofyear(day) / 365.25
    return [F.lit(1.0), *(f(h * t) for h in range(1, k + 1) for f in (F.sin, F.cos))]


def seasonal_z(df: DataFrame, col: str, train: Column | None = None, name: str | None = None) -> DataFrame:
    """z-score against a harmonic mean and a harmonic spread fitted on the train rows."""
    design, x = yearly(), F.col(col)
    fit = df.where(train) if train is not None else df
    mean = combination(design, solve(fit, design, x))
    spread = combination(design, solve(fit, design, F.abs(x - mean))) * math.sqrt(math.pi / 2)
    return df.withColumn(name or f"z_{col}", (x - mean) / F.greatest(spread, F.lit(1e-6)))


def tide_design(names: Sequence[str], time: str = "time") -> list[Column]:
    hours = F.unix_timestamp(F.col(time).cast("timestamp")) / 3600.0
    waves = (F.radians(F.lit(CONSTITUENTS[n]) * hours) for n in names)
    return [F.lit(1.0), *(f(w) for w in waves for f in (F.cos, F.sin))]


class Tide:
    """A fitted sum of constituents of fixed speed, without nodal corrections."""

    def __init__(self, names: Sequence[str], weights: np.ndarray):
        self.names, self.weights = list(names), weights

    @classmethod
    def fit(cls, df: DataFrame, col: str = "sea_level", time: str = "time", names: Sequence[str] = tuple(CONSTITUENTS)) -> Tide:
        return cls(names, solve(df, tide_design(names, time), F.col(col)))

    def predict(self, df: DataFrame, time: str = "time", name: str = "tide_m") -> DataFrame:
        return df.withColumn(name, combination(tide_design(self.names, time), self.weights))

    def amplitudes(self) -> list[tuple[str, float]]:
        """Constituents by amplitude, the largest first."""
        a = [(n, float(np.hypot(*self.weights[1 + 2 * k : 3 + 2 * k]))) for k, n in enumerate(self.names)]
        return sorted(a, key=lambda x: -x[1])


def fit_report(df: DataFrame, obs: str, pred: str) -> DataFrame:
    """(n, rmse, corr, sd_obs, mean_residual) of the rows that have both."""
    e = F.col(obs) - F.col(pred)
    return df.where(F.col(obs).isNotNull() & F.col(pred).isNotNull()).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(obs, pred).alias("corr"), F.stddev_samp(obs).alias("sd_obs"), F.avg(e).alias("mean_residual"))


def linear_fit_report(df: DataFrame, y: str, predictors: Sequence[str], train: Column) -> DataFrame:
    """(r2, residual_sd, n): of an ordinary regression fitted on the train rows, on the others."""
    design = [F.lit(1.0), *(F.col(p) for p in predictors)]
    fitted = df.withColumn("_p", combination(design, solve(df.where(train), design, F.col(y)))).where(~train & F.col(y).isNotNull())
    e = F.col(y) - F.col("_p")
    return fitted.agg((1 - F.sum(e * e) / (F.var_pop(y) * F.count("*"))).alias("r2"), F.stddev_pop(e).alias("residual_sd"), F.count("*").alias("n"))
