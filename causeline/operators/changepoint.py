"""Change-point scores by sequentially discounting autoregression in two stages."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import KEY

#: The defaults.
RATE, ORDER, SMOOTH = 0.001, 1, 5


class Sdar:
    """Discounting estimate of an autoregressive model; ``update`` returns the loss of the next value."""

    def __init__(self, rate: float, order: int):
        self.rate, self.order = rate, order
        self.mean, self.var = 0.0, 1.0
        self.cov = [0.0] * (order + 1)
        self.past: list[float] = []

    def update(self, x: float) -> float:
        r, k = self.rate, self.order
        self.mean = (1 - r) * self.mean + r * x
        past = self.past
        lagged = [x, *reversed(past)]
        for j in range(min(k, len(past)) + 1):
            self.cov[j] = (1 - r) * self.cov[j] + r * (x - self.mean) * (lagged[j] - self.mean)
        guess = self.mean
        if len(past) == k and self.cov[0] > 0:
            m = np.array([[self.cov[abs(i - j)] for j in range(k)] for i in range(k)])
            a = np.linalg.lstsq(m, np.array(self.cov[1 : k + 1]), rcond=None)[0]
            guess += sum(float(c) * (v - self.mean) for c, v in zip(a, reversed(past)))
        self.var = max((1 - r) * self.var + r * (x - guess) ** 2, 1e-12)
        self.past = [*past, x][-k:] if k else []
        return 0.5 * math.log(2 * math.pi * self.var) + (x - guess) ** 2 / (2 * self.var)


class ChangeFinder:
    """Loss of a model of the values, averaged, under a second model, averaged again."""

    def __init__(self, rate: float = RATE, order: int = ORDER, smooth: int = SMOOTH):
        self.first, self.second, self.smooth = Sdar(rate, order), Sdar(rate, order), smooth
        self.one: list[float] = []
        self.two: list[float] = []

    def update(self, x: float) -> float:
        self.one = [*self.one, self.first.update(x)][-self.smooth :]
        self.two = [*self.two, self.second.update(sum(self.one) / len(self.one))][-self.smooth :]
        return sum(self.two) / len(self.two)


def change_points(cells: DataFrame, bins: int, rate: float = RATE, order: int = ORDER, smooth: int = SMOOTH, closed: int | None = None, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, bin, value, score) for all closed bins of each event's dense series; the last, open bin is left out."""
    last = bins - 1 if closed is None else closed
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*keys).schema)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        data = np.zeros(bins)
        data[g["bin"].to_numpy()] = g["cnt"].to_numpy()
        data = data[:last]
        finder = ChangeFinder(rate, order, smooth)
        return pd.DataFrame({**{k: [g[k].iloc[0]] * last for k in keys}, "bin": np.arange(last), "value": data, "score": [finder.update(float(x)) for x in data]})

    return cells.select(*keys, "bin", "cnt").groupBy(*keys).applyInPandas(run, f"{kinds}, bin long, value double, score double")


def strongest(scores: DataFrame, k: int, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The k bins of highest score of each event."""
    best = F.slice(F.sort_array(F.collect_list(F.struct("score", "bin", "value")), asc=False), 1, k)
    return scores.groupBy(*keys).agg(best.alias("top")).select(*keys, F.explode("top").alias("x")).select(*keys, "x.*")
