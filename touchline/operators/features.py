"""The feature table: one row a player and match, everything but the row's own facts from strictly earlier matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from touchline.functions import scalar as S
from touchline.operators import asof, ratings
from touchline.session import cut

STYLE_HALF_LIFE = 4.0


def team_sides(player_match: DataFrame, style_map: DataFrame) -> DataFrame:
    """(match_id, team, style, team_poss_asof, allowed_asof): one row a side of a match."""
    t = cut(ratings.team_match(player_match).select("match_id", "match_date", "team", "possession_share", "opp_passes_allowed"))  # two rows a match
    t = asof.expanding_mean(t, ["team"], "match_date", {"p": "possession_share", "a": "opp_passes_allowed"})
    one = t.groupBy("match_id", "team").agg(F.max("p").alias("team_poss_asof"), F.max("a").alias("allowed_asof"))
    return one.join(style_map.select("team", "style"), "team", "left")


def build(player_match: DataFrame, style_map: DataFrame, results: DataFrame | None = None, possession: DataFrame | None = None, row: str = "row_id", half_life: float = STYLE_HALF_LIFE) -> DataFrame:
    """``player_match`` with per90, role, is_friendly, is_qualifier, opp_style, team_poss_asof, opp_allowed_asof, recent_per90,
    style_per90, anchor_per90, team_elo, opp_elo, team_poss_espn, opp_poss_espn.

    ``player_match``: ``row`` (unique), match_id, match_date, competition, team, opponent, player_id, position, minutes,
    passes_attempted; rows to come have NULL passes. ``style_map``: (team, style), fitted on training matches only; a team without
    style is -1. ``results`` and ``possession`` as :func:`ratings.attach_ratings` takes them; without them 1500 and NULL. The
    anchor falls back on the role's mean and the median over all rows given, as level and not as history, and is 1 at least.
    """
    flags = {c: S.numeric_flag(player_match, c) for c in ("is_friendly", "is_qualifier")}
    x = player_match.withColumns({**flags, "per90": S.per90(F.col("passes_attempted"), F.col("minutes")), "role": S.role_bucket(F.col("position"))})
    sides = team_sides(player_match, style_map)
    x = x.join(sides.select("match_id", "team", "team_poss_asof"), ["match_id", "team"], "left")
    other = sides.select("match_id", F.col("team").alias("opponent"), F.col("allowed_asof").alias("opp_allowed_asof"), F.col("style").alias("opp_style"))
    x = x.join(other, ["match_id", "opponent"], "left").withColumn("opp_style", F.coalesce("opp_style", F.lit(-1)))
    # histories are all taken from one written table, so that none repeats the plan of another
    x = base = cut(x)
    styled = asof.decay_means(base, ["player_id", "opp_style"], "match_date", ["match_id", row], F.col("per90"), half_life, "style_per90")
    recent = asof.last_groups_means(base, "player_id", "competition", "match_date", "per90", 2, "recent_per90")
    x = asof.attach(asof.attach(x, styled, ["player_id", "opp_style", "match_date"]), recent, ["player_id", "match_date"])
    roles = base.filter("minutes > 0").groupBy("role").agg(F.avg("per90").alias("_role"))
    median = base.agg(F.percentile("per90", 0.5).alias("_median"))
    x = x.join(F.broadcast(roles), "role", "left").join(F.broadcast(median))  # a handful of roles; one row
    x = x.withColumn("anchor_per90", S.bound(F.coalesce("recent_per90", "_role", "_median"), low=1.0)).drop("_role", "_median")
    if results is not None and possession is not None:
        return ratings.attach_ratings(x, results, possession, base)
    return x.withColumns({"team_elo": F.lit(1500.0), "opp_elo": F.lit(1500.0), "team_poss_espn": F.lit(None).cast("double"), "opp_poss_espn": F.lit(None).cast("double")})


def prior_center(rated: DataFrame, shrink: float = 2.0) -> DataFrame:
    """(player_id, n, prior): shrunken log ratio of a player's mean rate in the last two competitions to the mean of the usual role."""
    groups = rated.groupBy("player_id", "competition").agg(F.max("match_date").alias("m"), F.sum("per90").alias("s"), F.count("*").alias("n"))
    # the competitions of one player: dozens
    two = F.slice(F.sort_array(F.collect_list(F.struct("m", "competition", "s", "n")), asc=False), 1, 2)
    last = groups.groupBy("player_id").agg(two.alias("g")).select(
        "player_id", F.aggregate("g", F.lit(0.0), lambda a, x: a + x["s"]).alias("s"), F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n")
    )
    roles = rated.groupBy("player_id", "role").agg(F.count("*").alias("c")).groupBy("player_id").agg(F.min_by("role", F.struct(-F.col("c"), "role")).alias("role"))
    means = rated.groupBy("role").agg(F.avg("per90").alias("mean"))
    center = F.col("n") / (F.col("n") + shrink) * F.ln(F.greatest(F.col("s") / F.col("n"), F.lit(1.0)) / F.greatest("mean", F.lit(1.0)))
    return last.join(roles, "player_id").join(F.broadcast(means), "role").select("player_id", "n", center.alias("prior"))


def upcoming(fixtures: DataFrame, lineups: DataFrame, at: str, first_id: int = 9_100_000, competition: str = "World Cup 2026") -> DataFrame:
    """Rows to come: both sides of ``fixtures`` (home, away) with the players of ``lineups`` (team, player_id, player, position).

    (row_id, match_id, match_date, competition, season, provider, team, opponent, player_id, player, position, minutes, started,
    passes_attempted). Match ids count up from ``first_id`` in the order of (home, away): a sentinel range that picks the rows out
    afterwards; minutes and passes are NULL; teams without line-up have no rows.
    """
    f = fixtures.select("home", "away").distinct()
    order = F.struct("home", "away")
    ids = f.agg(F.sort_array(F.collect_list(order)).alias("all"))  # a match day's fixtures
    f = ids.select(F.posexplode("all").alias("i", "g")).select((F.col("i") + first_id).cast("long").alias("match_id"), "g.home", "g.away")
    sides = f.select("match_id", F.col("home").alias("team"), F.col("away").alias("opponent")).unionByName(f.select("match_id", F.col("away").alias("team"), F.col("home").alias("opponent")))
    known = S.position_name(F.col("position"))
    return sides.join(lineups, "team").select(
        (-F.pmod(F.xxhash64("match_id", "player_id"), F.lit(1 << 60)) - 1).alias("row_id"), "match_id", F.lit(at).cast("timestamp_ntz").alias("match_date"),
        F.lit(competition).alias("competition"), F.lit(competition).alias("season"), F.lit("statsbomb").alias("provider"), "team", "opponent", "player_id", "player",
        F.when(F.length("position") <= 3, known).otherwise(F.coalesce("position", F.lit("Center Midfield"))).alias("position"),
        F.lit(None).cast("double").alias("minutes"), F.lit(True).alias("started"), F.lit(None).cast("double").alias("passes_attempted"),
    )
