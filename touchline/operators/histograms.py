"""Running histograms of a key's earlier values: exact scores of a whole history without an array of it a row.

Rows are range-partitioned by (key, instant), so a key may span many tasks; what a partition needs of the ones before it is one
histogram, that of the key it begins with. It reaches the driver: as many rows as the key has different values, a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from touchline.session import cut

# Fixed value: thresholds of the calibration pairs.
QUANTILES = tuple(k / 10 for k in range(1, 10))
#: Cells (rows x different values) that are worked on at a time.
CELLS = 1 << 20


class _State:
    """Counts of the values seen, and the sum of |a - b| over all pairs of them."""

    def __init__(self, values: np.ndarray | None = None, counts: np.ndarray | None = None) -> None:
        self.values = np.empty(0) if values is None else np.asarray(values, dtype=float)
        self.counts = np.empty(0, dtype=np.int64) if counts is None else np.asarray(counts, dtype=np.int64)
        # sorted values: each step between neighbours is crossed by (those below) x (those above) pairs
        below = self.counts.cumsum()[:-1]
        self.pairs = float((np.diff(self.values) * below * (self.counts.sum() - below)).sum()) if len(self.values) else 0.0

    def step(self, x: np.ndarray, at: np.ndarray, quantiles: tuple[float, ...]) -> list[np.ndarray]:
        """(n, crps, p of each quantile, y of each) of the rows ``x``, each against all rows of earlier instants; ``x`` is added.

        ``at`` numbers the instants of the rows, which no later call repeats.
        """
        v = np.union1d(self.values, x)
        base = np.zeros(len(v), dtype=np.int64)
        base[np.searchsorted(v, self.values)] = self.counts
        one = (x[:, None] == v).astype(np.int64)
        upto = base + one.cumsum(0)
        first = np.searchsorted(at, at)  # the first row of each row's instant
        ahead = upto - one
        gained = (ahead * np.abs(v - x[:, None])).sum(1)
        before = ahead[first]
        n, near = before.sum(1), (before * np.abs(v - x[:, None])).sum(1)
        pairs = self.pairs + (gained.cumsum() - gained)[first]
        self.values, self.counts, self.pairs = v, upto[-1], self.pairs + gained.sum()
        m = np.maximum(n, 1)
        out = [n, near / m - pairs / m / m]
        if quantiles:
            cum = before.cumsum(1)
            value = lambda rank: v[np.minimum((cum <= rank[:, None]).sum(1), len(v) - 1)]
            ps, ys = [], []
            for q in quantiles:
                place = (m - 1) * q
                low = np.floor(place + 1e-9).astype(np.int64)
                a, b = value(low), value(np.minimum(low + 1, m - 1))
                t = a + np.maximum(place - low, 0) * (b - a)
                ps.append((before * (v > t[:, None])).sum(1) / m)
                ys.append((x > t).astype(float))
            out += [np.stack(ps, 1), np.stack(ys, 1)]
        return out


def _carried(d: DataFrame) -> dict[int, tuple[object, np.ndarray, np.ndarray]]:
    """Partition -> (key, values, counts): the rows of the key it begins with in the partitions before it."""

    def tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        hist: dict[float, int] = {}
        for f in frames:
            if not len(f):
                continue
            first = f["_k"].iloc[0] if first is None else first
            if f["_k"].iloc[-1] != last:
                last, hist = f["_k"].iloc[-1], {}
            for x, n in f.loc[f["_k"] == last, "_x"].value_counts().items():
                hist[x] = hist.get(x, 0) + int(n)
        if last is not None:
            yield pd.DataFrame({"p": TaskContext.get().partitionId(), "first": first, "last": last, "x": list(hist), "n": list(hist.values())})

    got = d.select("_k", "_x").mapInPandas(tails, "p int, first string, last string, x double, n long").toPandas()
    out, run, key = {}, {}, None
    for p, g in got.sort_values("p").groupby("p"):
        first, last = g["first"].iloc[0], g["last"].iloc[0]
        if first == key and run:
            v = np.array(sorted(run))
            out[int(p)] = (key, v, np.array([run[x] for x in v]))
        mine = dict(zip(g["x"], g["n"], strict=True))
        run = {x: run.get(x, 0) + mine.get(x, 0) for x in {*run, *mine}} if first == last == key else mine
        key = last
    return out


def running(df: DataFrame, key: str, at: str, row: str, value: str, quantiles: tuple[float, ...] = ()) -> DataFrame:
    """(row, n, crps) of each value against all of its key at strictly earlier instants, with ``quantiles`` also arrays p and y: the
    share of earlier values above each quantile threshold of theirs (linear interpolation), and whether the row's own is above.

    Kept is one histogram, which is as large as the different values of a key. ``value`` isn't NULL.
    """
    d = df.select(F.coalesce(F.col(key).cast("string"), F.lit("\x00")).alias("_k"), F.col(at).alias("_at"), row, F.col(value).cast("double").alias("_x"))
    # equal (key, instant) stay in one partition
    d = cut(d.repartitionByRange("_k", "_at").sortWithinPartitions("_k", "_at"))
    carried = d.sparkSession.sparkContext.broadcast(_carried(d))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, values, counts = carried.value.get(TaskContext.get().partitionId(), (None, None, None))
        state, rest = _State(values, counts), None

        def work(f: pd.DataFrame) -> pd.DataFrame | None:
            nonlocal last, state
            keys, x, t, parts = f["_k"].to_numpy(), f["_x"].to_numpy(), f["_at"].to_numpy(), []
            new = np.r_[True, (keys[1:] != keys[:-1]) | (t[1:] != t[:-1])]
            instant = np.cumsum(new)
            heads = [*np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(f)]
            for a, b in zip(heads[:-1], heads[1:], strict=True):
                if keys[a] != last:
                    last, state = keys[a], _State()
                while a < b:
                    c = min(b, a + max(1, min(1024, CELLS // (len(state.values) + 1024))))
                    c = min(b, int(np.searchsorted(instant, instant[c - 1], side="right")))  # whole instants only
                    parts.append(state.step(x[a:c], instant[a:c], quantiles))
                    a = c
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
            out = {row: f[row], "n": cols[0], "crps": cols[1]}
            return pd.DataFrame(out | ({"p": list(cols[2]), "y": list(cols[3])} if quantiles else {}))

        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if not len(f):
                continue
            # the last instant may go on in the next batch
            open_ = (f["_k"] == f["_k"].iloc[-1]) & (f["_at"] == f["_at"].iloc[-1])
            rest, f = f[open_].reset_index(drop=True), f[~open_].reset_index(drop=True)
            if len(f):
                yield work(f)
        if rest is not None and len(rest):
            yield work(rest)

    kind = dict(df.dtypes)[row]
    return d.mapInPandas(run, f"{row} {kind}, n long, crps double" + (", p array<double>, y array<double>" if quantiles else ""))
