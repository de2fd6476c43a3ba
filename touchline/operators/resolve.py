"""Resolution of names against known players by a cascade of equi-joins, and inference of opponents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions.scalar import fold, synthetic_id


def known_keys(players: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exact, first and last, last): each key with the id it stands for. ``players``: player_id, player, team."""
    p = players.dropna(subset=["player", "team"]).select("player_id", fold(F.col("team")).alias("team"), fold(F.col("player")).alias("name")).distinct()
    words = F.split("name", r"\s+")
    loose = p.filter(F.size(words) >= 2).withColumn("first", words[0]).withColumn("last", F.element_at(words, -1))
    return (
        p.groupBy("team", "name").agg(F.max("player_id").alias("id1")),
        loose.groupBy("team", "first", "last").agg(F.min("player_id").alias("id2")),
        loose.groupBy("team", "last").agg(F.min("player_id").alias("id3")),
    )


def resolve(queries: DataFrame, players: DataFrame) -> DataFrame:
    """``queries`` (row_id, player, team) with ``player_id`` and ``step`` 1 to 3, or NULL where nothing fits."""
    one, two, three = known_keys(players)
    q = queries.select("row_id", fold(F.col("team")).alias("team"), fold(F.col("player")).alias("name"))
    words = F.split("name", r"\s+")
    q = q.withColumn("first", F.when(F.size(words) >= 2, words[0])).withColumn("last", F.when(F.size(words) >= 2, F.element_at(words, -1)))
    q = q.join(one, ["team", "name"], "left").join(two, ["team", "first", "last"], "left").join(three, ["team", "last"], "left")
    step = F.when(F.col("id1").isNotNull(), 1).when(F.col("id2").isNotNull(), 2).when(F.col("id3").isNotNull(), 3)
    return q.select("row_id", F.coalesce("id1", "id2", "id3").alias("player_id"), step.alias("step"))


def infer_opponent(sides: DataFrame) -> DataFrame:
    """(match_id, team, opponent): the other team of matches with exactly two."""
    t = sides.dropna(subset=["match_id", "team"]).groupBy("match_id").agg(F.min("team").alias("a"), F.max("team").alias("b"), F.count_distinct("team").alias("n"))
    two = t.filter("n = 2")
    return two.selectExpr("match_id", "a AS team", "b AS opponent").unionByName(two.selectExpr("match_id", "b AS team", "a AS opponent"))


def opponents(props: DataFrame, fixtures: DataFrame | None = None, unknown: str = "_OPP_") -> DataFrame:
    """``props`` (match_id, team) with ``opponent``: the other team of the same match id if there are exactly two, else the team's
    fixture, else a sentinel. ``fixtures``: team, opponent."""
    known = infer_opponent(props).withColumnRenamed("opponent", "_other")
    out = props.join(known, ["match_id", "team"], "left")
    if fixtures is not None:
        out = out.join(fixtures.groupBy("team").agg(F.max("opponent").alias("_fixed")), "team", "left")
    return out.withColumn("opponent", F.coalesce("_other", *(["_fixed"] if fixtures is not None else []), F.lit(unknown))).drop("_other", "_fixed").select(*props.columns, "opponent")


def _pool(players: DataFrame) -> DataFrame:
    """One row a (team, player_id, folded name), with its words."""
    p = players.dropna(subset=["player_id", "player", "team"]).groupBy("team", "player_id", fold(F.col("player")).alias("known")).agg(F.max("player").alias("known_as"))
    return p.withColumn("known_words", F.split("known", r"\s+"))


def match_within_team(names: DataFrame, players: DataFrame, overrides: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """``names`` (row_id, player, team) with player_id, known_as and is_new, by the last word of a name.

    A player fits who has the name's last word among the words of theirs; an override (team, name) -> text fits who has that text.
    Of several the lowest id is taken; without any a stable negative id stands in and ``is_new`` is true. The join is on (team, word).
    """
    pool = _pool(players)
    by_word = pool.select("team", "player_id", "known_as", F.explode(F.array_distinct("known_words")).alias("word"))
    q = names.select("row_id", "team", "player", F.element_at(F.split(fold(F.col("player")), r"\s+"), -1).alias("word"))
    fits = q.join(by_word, ["team", "word"])
    if overrides:
        wanted = names.sparkSession.createDataFrame([(t, n, v) for (t, n), v in overrides.items()], "team string, player string, text string")
        fixed = q.join(F.broadcast(wanted), ["team", "player"]).join(pool, "team").filter(F.col("known").contains(fold(F.col("text"))))
        fits = fits.join(F.broadcast(wanted), ["team", "player"], "left_anti").select("row_id", "player_id", "known_as").unionByName(fixed.select("row_id", "player_id", "known_as"))
    best = fits.groupBy("row_id").agg(F.min(F.struct("player_id", "known_as")).alias("b")).select("row_id", "b.player_id", "b.known_as")
    out = names.join(best, "row_id", "left")
    return out.withColumn("is_new", F.col("player_id").isNull()).withColumn("player_id", F.coalesce("player_id", synthetic_id(F.col("player")))).withColumn("known_as", F.coalesce("known_as", "player"))


def match_loosely(names: DataFrame, players: DataFrame) -> DataFrame:
    """(row_id, player_id) of ``names`` (row_id, player, team): equal, one within the other, or the same last word, within the team.

    Lowest id of those that fit. Names are compared within their team only: at most a squad's history a name.
    """
    q = names.select("row_id", "team", fold(F.col("player")).alias("name"))
    both = q.join(_pool(players).select("team", "player_id", "known"), "team")
    last = lambda c: F.element_at(F.split(c, r"\s+"), -1)
    fits = F.col("known").contains(F.col("name")) | F.col("name").contains(F.col("known")) | (last("known") == last("name"))
    return both.filter(fits & (F.col("name") != "") & (F.col("known") != "")).groupBy("row_id").agg(F.min("player_id").alias("player_id"))
