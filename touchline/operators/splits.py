"""Walk-forward folds and leak guards."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Window as W, functions as F


class Fold(NamedTuple):
    name: str
    cutoff: object
    train: DataFrame
    test: DataFrame


def fold_table(df: DataFrame, by: str = "competition", at: str = "match_date", least: int = 2) -> DataFrame:
    """(by, cutoff, fold): groups in the order of their first row, those with fewer than ``least`` earlier ones left out."""
    first = df.groupBy(by).agg(F.min(at).alias("cutoff"))
    place = F.row_number().over(W.orderBy("cutoff", by)) - 1  # one row a competition
    return first.withColumn("fold", place).filter(F.col("fold") >= least)


def walk_forward(df: DataFrame, by: str = "competition", at: str = "match_date", least: int = 2) -> Iterator[Fold]:
    for r in fold_table(df, by, at, least).orderBy("fold").collect():
        yield Fold(r[by], r["cutoff"], df.filter(F.col(at) < F.lit(r["cutoff"])), df.filter(F.col(by) == r[by]))


def final_holdout(df: DataFrame, by: str = "competition", at: str = "match_date", least: int = 2) -> Fold | None:
    """The last fold; None if there is none."""
    return next(iter(list(walk_forward(df, by, at, least))[-1:]), None)


def assert_disjoint(train: DataFrame, test: DataFrame, keys: tuple[str, ...] = ("match_id", "player_id"), at: str = "match_date") -> None:
    """Raises on a shared key or a training row later than the first test row."""
    shared = train.select(*keys).join(test.select(*keys), list(keys), "left_semi").limit(3).collect()
    if shared:
        raise AssertionError(f"LEAK: keys in both parts, such as {shared[0].asDict()}")
    last, first = train.agg(F.max(at)).first()[0], test.agg(F.min(at)).first()[0]
    if last is not None and first is not None and last > first:
        raise AssertionError(f"LEAK: training reaches {last}, test begins {first}")
