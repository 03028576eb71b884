"""Periodicity by spectrum, removal and replacement of periodic parts, and greedy peeling.

Each event's series is one group; cells are sparse and made dense inside the group only.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import KEY, long_enough

#: Thresholds of the filter.
SPEC, EVAL, RESTORE, MAX_PEAKS = 0.4, 0.1, 0.5, 100


def peaks(amplitude: np.ndarray) -> np.ndarray:
    """Places above both neighbours."""
    if len(amplitude) < 3:
        return np.zeros(0, int)
    return np.flatnonzero((amplitude[1:-1] > amplitude[:-2]) & (amplitude[1:-1] > amplitude[2:])) + 1


def interval_of(data: np.ndarray, size: int, spec: float = SPEC, std: float = EVAL) -> int | None:
    """Seconds between occurrences of a periodic series, else None."""
    n = len(data)
    amp = np.abs(np.fft.fft(data))[1 : n // 2]
    freq = np.fft.fftfreq(n, d=size)[1 : n // 2]
    if not len(amp):
        return None
    top = [k for k in peaks(amp) if amp[k] > spec * amp.max()]
    if not top:
        return None
    gaps = np.diff(np.r_[0.0, freq[top]])[:MAX_PEAKS]
    if gaps.mean() == 0 or gaps.std() / gaps.mean() >= std:
        return None
    return int(1 / np.median(gaps) + 0.5)


def periodic_part(data: np.ndarray, spec: float = SPEC) -> np.ndarray:
    """The series of the strong frequencies alone."""
    f = np.fft.fft(data)
    amp = np.abs(f)
    f[amp <= spec * amp.max()] = 0
    return np.fft.ifft(f).real


def remainder(data: np.ndarray, part: np.ndarray, restore: float = RESTORE) -> np.ndarray:
    """What is left of the series without its periodic part."""
    at = (data > 0) & (part >= restore * part.max())
    out = data.astype(float).copy()
    if at.any():
        out[at] = data[at] - np.median(data[at])
    return np.maximum(out, 0)


def spectrum_filter(cells: DataFrame, bins: int, size: int, mode: str = "remove", least: int = 5, term: int = 21600, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(keys, periodic, interval_s, bin, cnt): events with their cells after the filter.

    ``remove``: periodic events lose all cells (one row with a null bin says so). ``replace``: they keep the remainder.
    Events that are too few or too short-lived pass untested (P10).
    """
    if mode not in ("remove", "replace"):
        raise ValueError(f"unknown mode {mode!r}")
    tested = long_enough(cells, least, term, size, keys).select(*keys, F.lit(True).alias("__test"))
    rows = cells.join(tested, list(keys), "left").select(*keys, "bin", "cnt", F.coalesce("__test", F.lit(False)).alias("test"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*keys).schema)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        data = np.zeros(bins)
        data[g["bin"].to_numpy()] = g["cnt"].to_numpy()
        gap = interval_of(data, size) if bool(g["test"].iloc[0]) else None
        if gap is not None:
            data = remainder(data, periodic_part(data)) if mode == "replace" else np.zeros(bins)
        at = np.flatnonzero(data > 0)
        n = max(len(at), 1)
        out = {k: [g[k].iloc[0]] * n for k in keys}
        return pd.DataFrame({**out, "periodic": gap is not None, "interval_s": pd.array([gap] * n, dtype="Int64"), "bin": pd.array(at if len(at) else [None], dtype="Int64"), "cnt": data[at] if len(at) else [0.0]})

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, periodic boolean, interval_s long, bin long, cnt double")


def periodic_in_windows(log: DataFrame, end, windows: tuple[tuple[int, int], ...] = ((86400, 1), (604800, 60)), least: int = 5, term: int = 21600) -> DataFrame:
    """(gid, host, window_s, size_s, interval_s): events that are periodic in one of the windows before ``end``.

    Each window (length, bin size) is binned over its own range, and looks only at events that none before it found.
    """
    import datetime as dt

    from .events import binned, n_bins

    out = None
    for length, size in windows:
        top = end - dt.timedelta(seconds=length)
        cells = binned(log, top, end, size)
        if out is not None:
            cells = cells.join(out.select(*KEY), list(KEY), "left_anti")
        found = spectrum_filter(cells, n_bins(top, end, size), size, "remove", least, term).filter("periodic")
        found = found.select(*KEY, F.lit(length).alias("window_s"), F.lit(size).alias("size_s"), "interval_s")
        out = found if out is None else out.unionByName(found)
    return out


#: Filter actions: the steps in turn.
ACTIONS = {"remove": ("remove",), "replace": ("replace",), "remove-corr": ("corr",), "linear": ("linear",), "remove+linear": ("remove", "linear"), "replace+linear": ("replace", "linear"), "linear+replace": ("linear", "replace")}


def filter_events(log: DataFrame, top, end, size: int, action: str = "replace+linear", lags: tuple[int, ...] = (3600, 86400), linear_size: int = 10, corr_threshold: float = 0.5) -> DataFrame:
    """(gid, host, type, note, n): events after the configured filter (C1). type 3: the remainder of a periodic event, note its interval."""
    from .events import binned, n_bins
    from .stats import correlated_events, linear_events

    events = binned(log, top, end, size)
    left = events.groupBy(*KEY).agg(F.sum("cnt").cast("double").alias("n")).withColumn("type", F.lit(0)).withColumn("note", F.lit(None).cast("long"))
    for step in ACTIONS[action]:
        if step == "linear":
            gone = linear_events(log, top, end, linear_size).select(*KEY)
            left = left.join(gone.withColumn("__gone", F.lit(True)), list(KEY), "left").filter("__gone is null or type = 3").drop("__gone")
        elif step == "corr":
            gone = correlated_events(events, top, end, size, list(lags), corr_threshold).filter("periodic").select(*KEY)
            left = left.join(gone, list(KEY), "left_anti")
        else:
            out = spectrum_filter(events, n_bins(top, end, size), size, step)
            out = out.groupBy(*KEY).agg(F.max("periodic").alias("p"), F.max("interval_s").alias("gap"), F.sum("cnt").alias("rest"))
            left = left.join(out, list(KEY)).filter("not p or rest > 0").select(
                *KEY, F.when(F.col("p"), F.col("rest")).otherwise(F.col("n")).alias("n"), F.when(F.col("p"), 3).otherwise(F.col("type")).alias("type"), F.when(F.col("p"), F.col("gap")).otherwise(F.col("note")).alias("note")
            )
    return left.select(*KEY, "type", "note", "n")


class _Left:
    """Sorted times of which some are taken off; the next one left at or after a place, the last one before it."""

    def __init__(self, times: list[int]):
        self.s = sorted(times)
        n = len(self.s)
        # places point to themselves while they are left; ``down`` is moved by one, 0 is before all
        self.up, self.down = list(range(n + 1)), list(range(n + 1))

    @staticmethod
    def _follow(to: list[int], k: int) -> int:
        end = k
        while to[end] != end:
            end = to[end]
        while to[k] != end:
            to[k], k = end, to[k]
        return end

    def next(self, place: int) -> int:
        return self._follow(self.up, place)

    def last(self, place: int) -> int:
        return self._follow(self.down, place) - 1

    def take(self, places: list[int]) -> list[int]:
        for k in places:
            self.up[k], self.down[k + 1] = k + 1, k
        return [self.s[k] for k in places]

    def rest(self) -> list[int]:
        return [t for k, t in enumerate(self.s) if self.up[k] == k]


def peel(seconds: list[int], dur: int, err: float, least: int = 2, dup: bool = False) -> tuple[list[list[int]], list[int]]:
    """Sequences whose gaps are within ``dur`` plus or minus ``int(dur * err)``, taken off greedily, and the rest.

    A sequence goes on with the time whose gap is nearest to ``dur``, the earlier of equal ones. With ``dup`` it goes on with the
    first such time, and takes along the times less than the allowed error after each of its own.
    """
    slack = int(dur * err)
    left, found = _Left(seconds), []
    s = left.s
    n = len(s)

    def nearest(at: int) -> int | None:
        want = s[at] + dur
        place = bisect_left(s, want, at + 1)
        near = []
        after = left.next(place)
        if after < n:
            near.append((s[after] - want, after))
        before = left.last(place)
        if before > at:
            before = left.next(bisect_left(s, s[before], at + 1))
            near.append((want - s[before], before))
        return min(near)[1] if near and min(near)[0] <= slack else None

    def first(at: int) -> int | None:
        k = left.next(bisect_left(s, s[at] + dur - slack, at + 1))
        return k if k < n and s[k] <= s[at] + dur + slack else None

    def same(at: int, end: int) -> list[int]:
        out, k = [], left.next(at + 1)
        while k < end and s[k] < s[at] + slack:
            out.append(k)
            k = left.next(k + 1)
        return out

    for start in range(n):
        if left.next(start) != start:
            continue
        chain, members, at = 0, [], start
        while at is not None:
            next_ = (first if dup else nearest)(at)
            chain += 1
            members += [at, *(same(at, n if next_ is None else next_) if dup else ())]
            at = next_
        if chain >= least:
            found.append(left.take(members))
    return found, left.rest()


def separate_periodic(log: DataFrame, dur: int, err: float, keys: tuple[str, ...] = KEY, dup: bool = False) -> DataFrame:
    """(keys, seq, n): the periodic sequences of each event, seq -1 for the rest (C9). ``dup``: sequences take nearly equal times along."""
    from ..functions.scalar import epoch

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.select(*keys).schema)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        found, rest = peel(g["s"].tolist(), dur, err, dup=dup)
        rows = [(k, len(f)) for k, f in enumerate(found)] + ([(-1, len(rest))] if rest else [])
        return pd.DataFrame({**{k: [g[k].iloc[0]] * len(rows) for k in keys}, "seq": [r[0] for r in rows], "n": [r[1] for r in rows]})

    return log.select(*keys, epoch(F.col("dt")).alias("s")).groupBy(*keys).applyInPandas(run, f"{kinds}, seq int, n long")
