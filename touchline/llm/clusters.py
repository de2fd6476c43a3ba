"""k-means over all rows of a table. What comes out depends on the rows and their keys, not on their order or partitions.

Rows are packed into blocks once; every pass then reads the blocks and returns a few numbers a partition. There is one pass a
centre to seed (k-means++, each draw a race of exponential times over all rows) and one a sweep.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from touchline.session import cut


def packed(df: DataFrame, key: Column, features: list[str]) -> DataFrame:
    """Blocks (keys, x) of an Arrow batch's rows, materialised; ``features`` are numbers without NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys, *x = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                yield pa.RecordBatch.from_pydict({"keys": pa.array([keys.tobytes()], pa.binary()), "x": pa.array([np.column_stack(x).tobytes()], pa.binary())})

    return cut(df.select(F.xxhash64(key).alias("key"), *[F.col(c).cast("double") for c in features]).mapInArrow(run, "keys binary, x binary"))


def _uniform(keys: np.ndarray, step: int) -> np.ndarray:
    """Numbers within (0, 1), one a key, other ones for each step (splitmix64)."""
    h = keys + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(1) for c in centres], 1)


def _each(blocks: DataFrame, width: int, first: np.ndarray, add: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """One array a partition with rows: ``add`` (array so far, keys, rows) over its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for keys, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = add(first.copy() if out is None else out, np.frombuffer(keys, np.uint64), np.frombuffer(x).reshape(-1, width))
        if out is not None:
            yield pa.RecordBatch.from_pydict({"out": pa.array([out.tobytes()], pa.binary())})

    return [np.frombuffer(bytes(r[0])).reshape(first.shape) for r in blocks.mapInArrow(run, "out binary").collect()]


def centres(blocks: DataFrame, width: int, k: int, sweeps: int = 20, tol: float = 1e-4) -> np.ndarray | None:
    """``k`` centres in their order; None if there are fewer rows than ``k``.

    Centres are rounded to nine places, so that the order of additions doesn't show. A centre without rows stays; with fewer
    different rows than ``k`` some centres are equal.
    """
    now = np.zeros((0, width))
    for step in range(k):

        def race(out: np.ndarray, keys: np.ndarray, x: np.ndarray, now=now, step=step) -> np.ndarray:
            with np.errstate(divide="ignore"):
                time = -np.log(_uniform(keys, step)) / (_distances(x, now).min(1) if step else np.ones(len(x)))
            i = int(np.argmin(time)) if np.isfinite(time).any() else int(np.lexsort(x.T[::-1])[0])
            mine = np.r_[time[i], x[i]]
            return mine if tuple(mine) < tuple(out) else out

        parts = _each(blocks, width, np.full(1 + width, np.inf), race)
        if not parts:
            return None
        now = np.concatenate([now, min(parts, key=tuple)[None, 1:]])
    now = np.round(now, 9)
    for _ in range(sweeps):

        def sums(out: np.ndarray, keys: np.ndarray, x: np.ndarray, now=now) -> np.ndarray:
            at = _distances(x, now).argmin(1)
            out[:, 0] += np.bincount(at, minlength=k)
            for j in range(width):
                out[:, 1 + j] += np.bincount(at, x[:, j], k)
            return out

        total = np.sum(_each(blocks, width, np.zeros((k, 1 + width)), sums), 0)
        n = total[:, :1]
        if n.sum() < k:
            return None
        before, now = now, np.round(np.divide(total[:, 1:], n, out=now.copy(), where=n > 0), 9)
        if ((now - before) ** 2).sum(1).max() <= tol**2:
            break
    return now[np.lexsort(now.T[::-1])]


def nearest(features: list[str], centres: np.ndarray) -> Column:
    """The index of the nearest centre, the lowest on ties; in the JVM."""

    def distance(c: np.ndarray) -> Column:
        first, *rest = ((F.col(f) - float(v)) * (F.col(f) - float(v)) for f, v in zip(features, c, strict=True))
        return sum(rest, first)

    return F.least(*[F.struct(distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])["i"]
