"""Team tables, ratings and schedule strength."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from touchline.functions.scalar import team_name
from touchline.operators import asof
from touchline.session import cut


def team_match(pm: DataFrame) -> DataFrame:
    """(match_id, match_date, competition, team, opponent, team_passes, possession_share, opp_passes_allowed).

    A sum over unknown counts only is 0, as the share of a match without passes is NULL; a missing opponent row gives NULL.
    """
    keys = ["match_id", "match_date", "competition", "team", "opponent"]
    t = pm.dropna(subset=keys).groupBy(*keys).agg(F.coalesce(F.sum("passes_attempted"), F.lit(0.0)).alias("team_passes"))
    share = F.try_divide(F.col("team_passes"), F.sum("team_passes").over(W.partitionBy("match_id")))
    t = t.withColumn("possession_share", share)
    other = t.groupBy(F.col("match_id").alias("m"), F.col("team").alias("o")).agg(F.max("team_passes").alias("opp_passes_allowed"))
    return t.join(other, (t.match_id == F.col("m")) & (t.opponent == F.col("o")), "left").drop("m", "o")


def _ratings(games: pd.DataFrame, k: float, home: float, start: float, draw: float) -> pd.DataFrame:
    """Ratings after each instant's games, which all see those before it."""
    games = games.sort_values(["at", "home", "away"], kind="stable")
    code, team = pd.factorize(pd.concat([games["home"], games["away"]]))
    host, guest = code[: len(games)], code[len(games) :]
    gap = (games["home_goals"] - games["away_goals"]).to_numpy(float)
    pull = k * np.where(gap == 0, draw, np.log1p(np.abs(gap)))
    share = (np.sign(gap) + 1) / 2
    level = np.full(len(team), start)
    after = np.empty((2, len(games)))
    for at in np.split(np.arange(len(games)), np.flatnonzero(np.diff(games["at"].to_numpy().astype("int64"))) + 1):
        h, g = host[at], guest[at]
        chance = 1 / (1 + np.exp((level[g] - level[h] - home) * np.log(10) / 400))
        won = pull[at] * (share[at] - chance)
        np.add.at(level, h, won)
        np.add.at(level, g, -won)
        after[:, at] = level[h], level[g]
    return pd.DataFrame({"team": np.r_[team[host], team[guest]], "at": np.r_[games["at"], games["at"]], "rating": after.ravel()})


def elo(results: DataFrame, k: float = 30.0, home: float = 55.0, start: float = 1500.0, draw: float = 1.0) -> DataFrame:
    """(team, at, rating): ratings after each result. A draw weighs ``draw``, a goal difference d weighs ln(d + 1).

    The fold depends on order across teams, so it runs in one task, by instants; its input is one narrow row a match (a century of
    international football is under 10^5 rows). Results lacking a team, an instant or a goal count are left out.
    """
    text = [F.col(c).cast("string").alias(c) for c in ("home", "away")]
    rows = results.select(*text, "at", "home_goals", "away_goals").dropna().withColumn("one", F.lit(1))
    run = lambda games: _ratings(games, k, home, start, draw)
    return rows.groupBy("one").applyInPandas(run, "team string, at timestamp_ntz, rating double")


def schedule_strength(matches: DataFrame, sweeps: int = 60, every: int = 10) -> DataFrame:
    """(team, games, rating, schedule): Jacobi sweeps of rating = mean(performance + opponent's rating), centred over all teams, those
    that are only an opponent too: they keep their rating but for the centring. The state is one row a team; lineage is cut every
    few sweeps.
    """
    perf = bounded(F.col("margin"), 3.0) + 0.04 * (F.col("possession") - 50)
    edges = cut(matches.dropna(subset=["team", "opponent", "margin", "possession"]).groupBy("team", "opponent").agg(F.sum(perf).alias("p"), F.count("*").alias("n")))
    # a constant passes through a sweep unchanged, so centring can wait for the end; teams without games stay at 0 till then
    state = edges.select("team").distinct().withColumn("rating", F.lit(0.0))
    for i in range(sweeps):
        faced = state.select(F.col("team").alias("opponent"), F.col("rating").alias("r"))
        state = edges.join(faced, "opponent", "left").groupBy("team").agg((F.sum(F.col("p") + F.col("n") * F.coalesce("r", F.lit(0.0))) / F.sum("n")).alias("rating"))
        if i % every == every - 1 or i == sweeps - 1:
            state = cut(state)
    teams = edges.select("team").union(edges.select("opponent")).distinct().join(state, "team", "left").select("team", F.coalesce("rating", F.lit(0.0)).alias("rating"))
    mean = teams.agg(F.avg("rating").alias("mean"))
    teams = cut(teams.join(F.broadcast(mean)).select("team", (F.col("rating") - F.col("mean")).alias("rating")))  # one row
    faced = edges.join(teams.select(F.col("team").alias("opponent"), F.col("rating").alias("r")), "opponent")
    faced = faced.groupBy("team").agg(F.sum("n").alias("games"), (F.sum(F.col("n") * F.col("r")) / F.sum("n")).alias("schedule"))
    return teams.join(faced, "team", "left").select("team", F.coalesce("games", F.lit(0)).alias("games"), "rating", F.coalesce("schedule", F.lit(0.0)).alias("schedule"))


def team_profiles(team_rows: DataFrame) -> DataFrame:
    """(team, games, avg_possession, avg_passes, avg_allowed), half-even to one place."""
    mean = lambda c, n: F.bround(F.avg(c), 1).alias(n)
    return team_rows.groupBy("team").agg(F.count("team_passes").alias("games"), mean("possession", "avg_possession"), mean("team_passes", "avg_passes"), mean("opp_passes_allowed", "avg_allowed"))


def attach_ratings(df: DataFrame, results: DataFrame, possession: DataFrame, probes: DataFrame | None = None, start: float = 1500.0, last: int = 10) -> DataFrame:
    """``df`` (team, opponent, match_date) with team_elo, opp_elo, team_poss_espn, opp_poss_espn of strictly before each match.

    ``results``: home, away, at, home_goals, away_goals, without home advantage if there is a column ``neutral``; ``possession``:
    team, at, possession, whose last ten readings are averaged; ``probes``: a table with the teams and instants of ``df`` that is
    cheaper to read. Names meet folded and under one name a team; teams without history have the start rating and no possession.
    """
    named = results.withColumn("home", team_name(F.col("home"))).withColumn("away", team_name(F.col("away")))
    rated = cut(elo(named, start=start, home=0.0 if "neutral" in results.columns else 55.0))
    held = cut(possession.select(team_name(F.col("team")).alias("team"), "at", "possession").dropna())
    means = asof.rolling_mean(held, "team", "at", ["possession"], "possession", last, "mean").withColumn("place", F.row_number().over(W.partitionBy("team", "at").orderBy("possession")))
    means = means.groupBy("team", "at").agg(F.max_by("mean", "place").alias("mean"))
    probes = df if probes is None else probes
    sides = probes.select("team", "match_date").union(probes.select("opponent", "match_date")).distinct()
    sides = cut(sides.select("team", team_name(F.col("team")).alias("_name"), F.col("match_date").alias("_at")))
    known = cut(asof.asof_last(sides, rated.select(F.col("team").alias("_name"), F.col("at").alias("_at"), "rating"), "_name", "_at", "rating", "elo"))
    known = asof.asof_last(known, means.select(F.col("team").alias("_name"), F.col("at").alias("_at"), "mean"), "_name", "_at", "mean", "poss")
    known = cut(known.select("team", F.col("_at").alias("match_date"), F.coalesce("elo", F.lit(start)).alias("elo"), "poss"))
    out = df
    for side, elo_name, poss_name in (("team", "team_elo", "team_poss_espn"), ("opponent", "opp_elo", "opp_poss_espn")):
        out = asof.attach(out, known.select(F.col("team").alias(side), "match_date", F.col("elo").alias(elo_name), F.col("poss").alias(poss_name)), [side, "match_date"])
    return out.withColumns({c: F.coalesce(c, F.lit(start)) for c in ("team_elo", "opp_elo")})


def bounded(c: Column, limit: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(limit)), F.lit(-limit)))
