"""Ordered sequences a key without one task holding a whole key: range partitions with margins.

Rows are range-partitioned by key *and* order, so a key with a third of all rows is spread over many tasks. What a row needs of
its neighbours across a partition's edge comes from a margin of a fixed number of readings on either side; a reading is a group
of adjacent rows that agree on some columns, so a thousand copies of one row fill no margin. Margins are the only thing that
reaches the driver: a fixed number of narrow rows a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from touchline.session import cut


def ordered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``key`` and ``order``, written once; partitions follow each other."""
    return cut(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order))


def starts(f: pd.DataFrame, ident: list[str]) -> np.ndarray:
    """Whether a row begins a reading: it differs from the one before in one of the columns. Missing values agree."""
    out = np.zeros(len(f), dtype=bool)
    if len(f):
        out[0] = True
    for c in ident:
        v = f[c].to_numpy()
        differ = v[1:] != v[:-1]
        gone = pd.isna(v)
        out[1:] |= differ & ~(gone[1:] & gone[:-1])
    return out


def _plain(f: pd.DataFrame) -> pd.DataFrame:
    """Text columns as objects: joined frames hold theirs in chunks, which a record batch can't."""
    return f.astype({c: object for c in f.columns if not isinstance(f[c].dtype, np.dtype)})


def _edges(seq: DataFrame, ident: list[str], size: int, keep: str) -> pd.DataFrame:
    """First and last ``size`` readings of each partition (one row each), of the rows where ``keep`` holds."""
    cols = seq.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, tail, at = None, None, TaskContext.get().partitionId()
        for f in frames:
            f = f[f[keep].to_numpy(bool)]
            if not len(f):
                continue
            both = f if tail is None else pd.concat([tail, f], ignore_index=True)
            tail = both[starts(both, ident)].iloc[-size:]
            if head is None or len(head) < size:
                both = f if head is None else pd.concat([head, f], ignore_index=True)
                head = both[starts(both, ident)].iloc[:size]
        for side, rows in (("head", head), ("tail", tail)):
            if rows is not None:
                yield _plain(rows.assign(_partition=at, _side=side))

    schema = ", ".join(f"`{n}` {t}" for n, t in seq.dtypes) + ", _partition int, _side string"
    return seq.mapInPandas(run, schema).toPandas()[[*cols, "_partition", "_side"]]


def margins(seq: DataFrame, ident: list[str], size: int, keep: str) -> dict[int, tuple[pd.DataFrame, pd.DataFrame]]:
    """Partition -> (readings before it, readings after it), each up to ``size`` and taken across as many partitions as it needs."""
    got = _edges(seq, ident, size, keep)
    held = sorted(got["_partition"].unique())
    side = {(p, s): g.drop(columns=["_partition", "_side"]) for (p, s), g in got.groupby(["_partition", "_side"])}
    n = seq.rdd.getNumPartitions()
    none = got.iloc[:0].drop(columns=["_partition", "_side"])

    def chain(order: list[int], name: str, last: bool) -> dict[int, pd.DataFrame]:
        out, run, known = {}, none, set(held)
        for p in order:
            out[p] = run
            if p in known:
                part = side[p, name]
                both = [part] if not len(run) or len(part) >= size else [run, part] if last else [part, run]
                run = pd.concat(both, ignore_index=True) if len(both) > 1 else part
                run = run[starts(run, ident)]
                run = run.iloc[-size:] if last else run.iloc[:size]
        return out

    before, after = chain(list(range(n)), "tail", True), chain(list(range(n - 1, -1, -1)), "head", False)
    return {p: (before[p], after[p]) for p in range(n)}


def map_with_margins(seq: DataFrame, around: dict[int, tuple[pd.DataFrame, pd.DataFrame]], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on each partition's rows with its margins; ``_own`` tells the partition's rows from them. No shuffle."""
    shared = seq.sparkSession.sparkContext.broadcast(around)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [f for f in frames if len(f)]
        if own:
            before, after = shared.value[TaskContext.get().partitionId()]
            parts = [before.assign(_own=False), pd.concat(own, ignore_index=True).assign(_own=True), after.assign(_own=False)]
            out = _plain(work(pd.concat([p for p in parts if len(p)], ignore_index=True)))
            if len(out):
                yield out

    return seq.mapInPandas(run, schema)
