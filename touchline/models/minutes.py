"""Minutes played as a distribution: a player's own past minutes, or those of starters and substitutes mixed by the chance to start."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions.scalar import bound
from touchline.operators import asof

#: Own appearances that are enough; cap of the minutes; what stands in for an empty pool of starters, of substitutes.
ENOUGH, LONGEST, STARTER, SUBSTITUTE = 3, 98.0, 90.0, 20.0


class MinutesModel(NamedTuple):
    """``own``: (player_id, own_values, own_counts), as long as a player's different minutes; pools as (values, counts)."""

    own: DataFrame
    starters: tuple[np.ndarray, np.ndarray]
    substitutes: tuple[np.ndarray, np.ndarray]


def fit(player_match: DataFrame) -> MinutesModel:
    """Pools of the rows with minutes; counts of different values (whole minutes up to the cap) stand for the values themselves."""
    played = player_match.filter("minutes > 0").select("player_id", F.coalesce("started", F.lit(False)).alias("started"), F.round(bound(F.col("minutes"), high=LONGEST)).alias("m"))
    each = played.groupBy("player_id", "m").agg(F.count("*").alias("n"))
    whole = each.groupBy("player_id").agg(F.sort_array(F.collect_list(F.struct("m", "n"))).alias("h"), F.sum("n").alias("total")).filter(F.col("total") >= ENOUGH)
    own = whole.select("player_id", F.transform("h", lambda x: x["m"]).alias("own_values"), F.transform("h", lambda x: x["n"]).alias("own_counts"))
    rows = played.groupBy("started", "m").agg(F.count("*").alias("n")).collect()  # at most 98 minutes, twice

    def pool(started: bool, default: float) -> tuple[np.ndarray, np.ndarray]:
        got = sorted((r["m"], r["n"]) for r in rows if r["started"] == started) or [(default, 1)]
        return np.array([g[0] for g in got]), np.array([g[1] for g in got])

    return MinutesModel(own, pool(True, STARTER), pool(False, SUBSTITUTE))


def pick(values: np.ndarray, counts: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The values at the shares ``u`` of a pool given by counts."""
    ends = np.cumsum(counts)
    return np.asarray(values, dtype=float)[np.minimum(np.searchsorted(ends, u * ends[-1], side="right"), len(ends) - 1)]


def sample(model: MinutesModel, rng: np.random.Generator, draws: int, p_start: float, own_values=None, own_counts=None) -> np.ndarray:
    """Minutes of one row: of the player's own pool if there is one, else of starters or substitutes."""
    u = rng.random(draws)
    if own_values is not None and len(own_values):
        return pick(np.asarray(own_values), np.asarray(own_counts), u)
    return np.where(rng.random(draws) < p_start, pick(*model.starters, u), pick(*model.substitutes, u))


def recent_start_prob(player_match: DataFrame, half_life: float = 5.0, out: str = "p_start") -> DataFrame:
    """``player_match`` with the recency-weighted share of starts strictly before each match; one half without history."""
    return attach_start_prob(player_match, player_match, half_life, out)


def attach_start_prob(rows: DataFrame, player_match: DataFrame, half_life: float = 5.0, out: str = "p_start") -> DataFrame:
    """:func:`recent_start_prob` for some ``rows`` of ``player_match`` only."""
    started: Column = F.coalesce(F.col("started"), F.lit(False)).cast("double")
    found = asof.decay_means(player_match, ["player_id"], "match_date", ["match_id"], started, half_life, out)
    return asof.attach(rows, found, ["player_id", "match_date"]).withColumn(out, F.coalesce(out, F.lit(0.5)))
