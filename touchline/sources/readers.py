"""File sources -> typed tables. Batch readers; a streaming reader takes the same schema and projection.

Unreadable records, absent parts and failed casts give NULL or no row, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from touchline.functions import scalar as S
from touchline.operators import nested

LINES = "date date, competition string, team string, player string, stat string, line double, multiplier_boost double"
SCOREBOARD = (
    "events array<struct<id: string, status: struct<type: struct<description: string>>, competitions: array<struct<date: string, status: struct<type: struct<completed: boolean>>, "
    "competitors: array<struct<homeAway: string, team: struct<displayName: string>, score: string>>>>>>"
)
EVENTS = "match_id long, id string, type string, minute int, player_id long, player string, team string, position string, pass_outcome string"
LINEUPS = "match_id long, team string, player_id long, positions array<struct<`from`: string, `to`: string, start_reason: string>>"
MATCHES = "match_id long, match_date timestamp_ntz, competition string, season string, provider string, has_360 boolean"
UPCOMING = "row_id long, match_id long, match_date timestamp_ntz, competition string, provider string, team string, opponent string, player_id long, player string, position string, minutes double, started boolean, line double, p_start double"
PROPS = (
    "players array<struct<id: string, first_name: string, last_name: string, country: string>>, appearances array<struct<id: string, player_id: string, match_id: long>>, "
    "over_under_lines array<struct<stat_value: string, over_under: struct<appearance_stat: struct<stat: string, appearance_id: string>>>>"
)
ROSTERS = "rosters array<struct<team: struct<displayName: string>, roster: array<struct<starter: boolean, athlete: struct<displayName: string>, position: struct<abbreviation: string>>>>>"
# Outcomes of passes that weren't completed; the statistic of the props; scoreboard team names by the corpus's.
INCOMPLETE = ("Incomplete", "Out", "Pass Offside", "Injury Clearance", "Unknown")
PASS_PROP = "period_1_2_passes"
SCOREBOARD_NAMES = {"Cape Verde": "Cabo Verde", "USA": "United States", "Korea Republic": "South Korea"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that are there, in the order asked for."""
    return df.select(*[c for c in columns if c in df.columns])


def competitions(df: DataFrame) -> DataFrame:
    cols = ["competition_id", "season_id", "competition", "season"]
    return project(df, cols).distinct().orderBy(*[c for c in cols if c in df.columns])


def months(first: str, last: str) -> list[str]:
    """``yyyyMM`` from one month to another, both included."""
    a, b = (int(x[:4]) * 12 + int(x[-2:]) - 1 for x in (first, last))
    return [f"{m // 12}{m % 12 + 1:02d}" for m in range(a, b + 1)]


# --- lines and rows to come -------------------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str, stat: str = "passes attempted") -> DataFrame:
    """Lines of one statistic from CSV history; an empty table where there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], LINES)
    return spark.read.schema(LINES).csv(path, header=True).filter(F.lower("stat") == stat)


def attach_lines(lines: DataFrame, player_match: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched (match_id, player_id, line), lines without a match), by folded player name and day."""
    pm = player_match.select("match_id", "player_id", S.fold(F.col("player")).alias("name"), F.to_date("match_date").alias("date")).distinct()
    named = lines.withColumn("name", S.fold(F.col("player")))
    return named.join(pm, ["name", "date"]).select("match_id", "player_id", "line"), named.join(pm, ["name", "date"], "left_anti").drop("name")


def read_upcoming(spark: SparkSession, path: str) -> DataFrame:
    """Rows to come; columns the file lacks are NULL, rows without id get a stable negative one."""
    t = spark.read.csv(path, header=True)
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], UPCOMING).schema}
    t = t.select(*[(F.col(c).try_cast(k) if c in t.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()])
    own = -F.pmod(F.xxhash64("match_id", "player_id", "player"), F.lit(1 << 60)) - 1
    return t.withColumn("row_id", F.coalesce("row_id", own))


# --- event and line-up files ------------------------------------------------------------------------------------------------


def player_labels(events: DataFrame, lineups: DataFrame, matches: DataFrame) -> DataFrame:
    """One row a (match, player) from events (:data:`EVENTS`), line-ups (:data:`LINEUPS`) and match facts (:data:`MATCHES`).

    Passes are counted from events, without an outcome they count as completed; the position is the commonest of the player's events
    (least name on ties). Minutes and start come from the line-up; who never played has 0 minutes and, without events, no name, team
    or position. The opponent is the other of exactly two teams.
    """
    done = ~F.coalesce(F.col("pass_outcome").isin(*INCOMPLETE), F.lit(False))
    passes = events.filter("type = 'Pass' and player_id is not null and player is not null and team is not null")
    label = passes.groupBy("match_id", "player_id", "player", "team").agg(F.count("*").alias("passes_attempted"), F.count_if(done).alias("passes_completed"))
    position = events.filter("player_id is not null and position is not null").groupBy("match_id", "player_id").agg(F.mode("position", True).alias("position"))
    label = label.join(position, ["match_id", "player_id"], "left")
    ends = events.groupBy("match_id").agg(F.max("minute").cast("double").alias("match_end"))
    on = lineups.filter("player_id is not null").join(ends, "match_id", "left").select("match_id", "player_id", *S.minutes_from_positions(F.col("positions"), F.col("match_end")))
    on = on.groupBy("match_id", "player_id").agg(F.max("minutes").alias("minutes"), F.max("started").alias("started"))
    out = label.join(on, ["match_id", "player_id"], "full").fillna(0, ["passes_attempted", "passes_completed"])
    sides = events.filter("team is not null").select("match_id", "team").distinct()
    two = sides.groupBy("match_id").agg(F.min("team").alias("t1"), F.max("team").alias("t2"), F.count("*").alias("n")).filter("n = 2")
    out = out.join(two.drop("n"), "match_id", "left").withColumn("opponent", F.when(F.col("team") == F.col("t1"), F.col("t2")).when(F.col("team") == F.col("t2"), F.col("t1")))
    facts = ["match_date", "competition", "season", "provider", "has_360"]
    out = out.join(matches.select("match_id", *facts), "match_id")
    cols = ["match_id", *facts, "team", "opponent", "player_id", "player", "position", "minutes", "passes_attempted", "passes_completed", "started"]
    return out.select(*cols)


def build_player_match(events: DataFrame, lineups: DataFrame, matches: DataFrame, target: str, force: bool = False) -> DataFrame:
    """The player table at ``target`` with the matches it lacks added, or all of them built again with ``force``.

    Only matches not seen are read; a match's rows replace those of the same match, in partitions by competition that are staged
    beside the table first, so a lost job leaves the table as it was.
    """
    spark = events.sparkSession
    built = exists(spark, target) and not force
    if built:
        old = spark.read.parquet(target).select("match_id").distinct()
        matches = unseen(matches, old)
        events, lineups = (t.join(matches.select("match_id"), "match_id", "left_semi") for t in (events, lineups))
    rows = player_labels(events, lineups, matches).dropDuplicates(["match_id", "player_id"])
    rows.repartition("competition").sortWithinPartitions("match_date", "match_id").write.partitionBy("competition").mode("append" if built else "overwrite").parquet(target)
    return spark.read.parquet(target)


def fbref_rows(summary: DataFrame, passing: DataFrame | None, competition: str, provider: str = "opta") -> DataFrame:
    """Player rows of a summary table, with pass counts where there is a passing table (game, player, Att)."""
    out = summary.drop("passes_attempted")
    if passing is not None:
        one = passing.groupBy("game", "player").agg(F.max("Att").cast("double").alias("passes_attempted"))
        out = out.join(one, ["game", "player"], "left")
    else:
        out = out.withColumn("passes_attempted", F.lit(None).cast("double"))
    return out.withColumn("competition", F.lit(competition)).withColumn("provider", F.lit(provider))


# --- scoreboards and box scores ---------------------------------------------------------------------------------------------


def scoreboard_events(raw: DataFrame) -> DataFrame:
    """(event_id, at, status, completed, competitors) of raw scoreboard ``payload``s; every day of the month counts."""
    events = raw.select(F.explode(F.from_json("payload", SCOREBOARD)["events"]).alias("e"))
    games = events.select(F.col("e.id").alias("event_id"), F.col("e.status.type.description").alias("status"), F.explode("e.competitions").alias("c"))
    return games.select("event_id", F.col("c.date").alias("at"), "status", F.coalesce("c.status.type.completed", F.lit(False)).alias("completed"), F.col("c.competitors").alias("competitors"))


def completed_ids(raw: DataFrame) -> DataFrame:
    return scoreboard_events(raw).filter("completed").select("event_id").distinct()


def _sides(raw: DataFrame) -> DataFrame:
    side = lambda name, field: F.max(F.when(F.col("x.homeAway") == name, F.col(field)))
    each = scoreboard_events(raw).select("event_id", "at", "status", "completed", F.explode("competitors").alias("x"))
    return each.groupBy("event_id", "at", "status", "completed").agg(
        side("home", "x.team.displayName").alias("home"), side("away", "x.team.displayName").alias("away"),
        side("home", "x.score").try_cast("int").alias("home_goals"), side("away", "x.score").try_cast("int").alias("away_goals"),
    )


def results(raw: DataFrame, competition: str) -> DataFrame:
    """(at, competition, home, away, home_goals, away_goals) of completed games with both scores; one row a (at, home, away), that of the
    greatest event id, in order of time."""
    games = _sides(raw).filter("completed").drop("status").dropna()
    last = games.groupBy("at", "home", "away").agg(F.max_by(F.struct("home_goals", "away_goals"), "event_id").alias("g"))
    return last.select("at", F.lit(competition).alias("competition"), "home", "away", "g.home_goals", "g.away_goals").orderBy("at", "home", "away")


def fixtures(raw: DataFrame) -> DataFrame:
    """(event_id, at, status, home, away) of all games of a scoreboard; a side that is missing is ``?``."""
    return _sides(raw).select("event_id", "at", "status", F.coalesce("home", F.lit("?")).alias("home"), F.coalesce("away", F.lit("?")).alias("away"))


def fixture_map(raw: DataFrame) -> DataFrame:
    """(team, opponent) of games with both sides, under the corpus's team names."""
    table = F.create_map(*[F.lit(x) for kv in SCOREBOARD_NAMES.items() for x in kv])
    name = lambda c: F.coalesce(F.try_element_at(table, F.col(c)), F.col(c))
    f = _sides(raw).dropna(subset=["home", "away"]).select(name("home").alias("a"), name("away").alias("b"))
    return f.selectExpr("a AS team", "b AS opponent").union(f.selectExpr("b", "a")).distinct()


def lineups(raw: DataFrame) -> DataFrame:
    """(team, player, position) of the starters in summary ``payload``s (raw_id, payload); the latest record of a team counts."""
    r = raw.select("raw_id", F.explode(F.from_json("payload", ROSTERS)["rosters"]).alias("r"))
    xi = F.filter("r.roster", lambda p: F.coalesce(p["starter"], F.lit(False)))
    teams = r.select("raw_id", F.coalesce("r.team.displayName", F.lit("?")).alias("team"), xi.alias("xi")).filter(F.size("xi") > 0)
    last = teams.groupBy("team").agg(F.max_by("xi", "raw_id").alias("xi")).select("team", F.explode("xi").alias("p"))
    return last.select("team", F.coalesce("p.athlete.displayName", F.lit("?")).alias("player"), F.coalesce("p.position.abbreviation", F.lit("")).alias("position"))


def box_scores(summaries: DataFrame, competition: str | None = None) -> DataFrame:
    """(raw_id, competition, date, team, opponent, possession, team_passes, opp_passes_allowed, goals_for, goals_against, margin) of
    summary payloads with exactly two teams. A row lacks only itself if one of its numbers can't be read; goals may be missing."""
    stats = nested.team_statistics(summaries)
    named = lambda *names: F.max(F.when(F.col("label").isin(*names) | F.col("name").isin(*names), F.col("value")))
    stats = stats.groupBy("raw_id", "team_pos").agg(named("Possession", "possessionPct").alias("possession"), named("Passes", "totalPasses").alias("team_passes"))
    teams = nested.teams(summaries).filter("team is not null").select("raw_id", "team_pos", "team")
    both = teams.groupBy("raw_id").agg(F.count_distinct("team").alias("n"), F.count("*").alias("m")).filter("n = 2 and m = 2").select("raw_id")
    get, doc = nested.get, F.col("doc")
    head = nested.parsed(summaries).select("raw_id", get(doc, "$.header.league.slug", "string").alias("league"), F.try_element_at(nested.elements(get(doc, "$.header.competitions")), F.lit(1)).alias("c"))
    dates = head.select("raw_id", "league", get(F.col("c"), "$.date", "string").alias("date"))
    goals = head.select("raw_id", F.explode(nested.elements(get(F.col("c"), "$.competitors"))).alias("x"))
    goals = goals.groupBy("raw_id", get(F.col("x"), "$.team.displayName", "string").alias("team")).agg(F.max(get(F.col("x"), "$.score", "double")).alias("goals"))
    t = teams.join(both, "raw_id", "left_semi").join(stats, ["raw_id", "team_pos"], "left").join(goals, ["raw_id", "team"], "left").drop("team_pos")
    other = t.select("raw_id", F.col("team").alias("opponent"), F.col("team_passes").alias("opp_passes_allowed"), F.col("goals").alias("goals_against"))
    out = t.join(other, "raw_id").filter("team <> opponent").join(dates, "raw_id").withColumnRenamed("goals", "goals_for")
    out = out.dropna(subset=["possession", "team_passes", "opp_passes_allowed"]).withColumn("margin", F.col("goals_for") - F.col("goals_against"))
    cols = ["team", "opponent", "possession", "team_passes", "opp_passes_allowed", "goals_for", "goals_against", "margin"]
    return out.select("raw_id", (F.lit(competition) if competition else F.col("league")).alias("competition"), "date", *cols)


# --- match details ----------------------------------------------------------------------------------------------------------


def matches_of_day(raw: DataFrame) -> DataFrame:
    """(match_id, league, home, away, finished, started) of day ``payload``s; a missing status is false."""
    schema = "leagues array<struct<name: string, matches: array<struct<id: long, home: struct<name: string>, away: struct<name: string>, status: struct<finished: boolean, started: boolean>>>>>"
    league = raw.select(F.explode(F.from_json("payload", schema)["leagues"]).alias("l")).select(F.col("l.name").alias("league"), F.explode("l.matches").alias("m"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return league.select(F.col("m.id").alias("match_id"), "league", F.col("m.home.name").alias("home"), F.col("m.away.name").alias("away"), flag("m.status.finished").alias("finished"), flag("m.status.started").alias("started"))


def _last(label: str, value: str) -> Column:
    return F.max_by(F.when(F.col("label") == label, F.col(value)), F.when(F.col("label") == label, F.col("group_pos")))


def match_passes(raw: DataFrame) -> DataFrame:
    """(raw_id, match_id, player_id, player, team, minutes, passes_attempted, passes_completed) of match-detail payloads.

    The last group that has a statistic counts; players without attempted passes are left out. A team's name is that of the line-up,
    else of the header.
    """
    s = nested.statistics(raw).filter(F.col("label").isin("Accurate passes", "Minutes played"))
    s = s.groupBy("raw_id", "player_key").agg(_last("Accurate passes", "total").alias("passes_attempted"), _last("Accurate passes", "value").alias("passes_completed"), _last("Minutes played", "value").alias("minutes"))
    p = nested.players(raw).join(s.filter("passes_attempted is not null"), ["raw_id", "player_key"])
    doc, get = F.col("doc"), nested.get
    places = [f"$.{part}.{side}Team" for part in ("content.lineup", "general") for side in ("home", "away")]
    named = F.array(*[F.struct(get(doc, f"{x}.id", "string").alias("k"), get(doc, f"{x}.name", "string").alias("v"), F.lit(i).alias("i")) for i, x in enumerate(places)])
    names = nested.parsed(raw).select("raw_id", F.inline(named)).filter("k is not null").groupBy("raw_id", F.col("k").alias("team_id")).agg(F.min_by("v", "i").alias("team"))
    p = p.join(names, ["raw_id", "team_id"], "left").join(raw.select("raw_id", "match_id"), "raw_id")
    known = F.coalesce(F.col("player_id").try_cast("long"), F.col("player_key").try_cast("long"))
    return p.select("raw_id", "match_id", known.alias("player_id"), "player", "team", "minutes", "passes_attempted", "passes_completed")


def training_rows(raw: DataFrame) -> DataFrame:
    """Corpus rows of match-detail payloads (raw_id, match_id, payload) of international football: facts of the match from its header, team, opponent,
    depth and position of a player from the line-up (an unknown depth is midfield), counts as :func:`match_passes` has them."""
    doc, get = F.col("doc"), nested.get
    facts = nested.parsed(raw).select(
        "raw_id", "doc", F.coalesce(get(doc, "$.general.leagueName", "string"), F.lit("")).alias("league"), get(doc, "$.general.matchTimeUTCDate", "string").alias("utc"),
        F.coalesce(F.nullif(get(doc, "$.general.leagueRoundName", "string"), F.lit("")), get(doc, "$.general.matchRound", "string")).alias("round"),
        get(doc, "$.general.homeTeam.name", "string").alias("home"), get(doc, "$.general.awayTeam.name", "string").alias("away"),
    ).filter(S.is_international(F.col("league")))
    sides = F.array(*[
        F.struct(get(doc, f"$.content.lineup.{s}Team.name", "string").alias("team"), F.col(o).alias("opponent"), F.flatten(F.array(*[nested.elements(get(doc, f"$.content.lineup.{s}Team.{g}")) for g in ("starters", "subs")])).alias("who"))
        for s, o in (("home", "away"), ("away", "home"))
    ])
    who = facts.select("raw_id", F.inline(sides)).select("raw_id", "team", "opponent", F.explode("who").alias("p"))
    node = F.coalesce(get(F.col("p"), "$[0]"), F.col("p"))  # a player may stand in an array of one
    who = who.select("raw_id", get(node, "$.id", "long").alias("player_id"), "team", "opponent", get(node, "$.horizontalLayout.x", "double").alias("depth"))
    who = who.filter("player_id is not null").groupBy("raw_id", "player_id").agg(F.max_by(F.struct("team", "opponent", "depth"), F.struct("team")).alias("w")).select("raw_id", "player_id", "w.*")
    rows = match_passes(raw).drop("team", "passes_completed").join(facts.drop("doc", "home", "away"), "raw_id").join(who, ["raw_id", "player_id"], "left")
    league = F.col("league")
    return rows.select(
        "raw_id", "match_id", F.col("player_id").alias("fm_player_id"), "player", "team", "opponent", S.position_from_depth(F.col("depth")).alias("position"), "depth", "minutes", "passes_attempted",
        S.stage(F.col("round")).alias("stage"), league.contains("Friendl").cast("int").alias("is_friendly"), league.contains("Qualif").cast("int").alias("is_qualifier"),
        F.to_utc_timestamp(F.try_to_timestamp("utc"), "UTC").cast("timestamp_ntz").alias("match_date"), S.competition_name(league).alias("competition"), (F.col("minutes") >= 45).alias("started"),
    )


# --- props ------------------------------------------------------------------------------------------------------------------


def props(raw: DataFrame, countries: dict[str, str] | None = None) -> DataFrame:
    """(row_id, player, team, line, match_id) of prop ``payload``s (raw_id, payload): three arrays joined on their ids within a record.

    An unknown country code stays what it is; a line that is no number is left out.
    """
    doc = raw.select("raw_id", F.from_json("payload", PROPS).alias("d"))
    o = doc.select("raw_id", F.posexplode("d.over_under_lines").alias("i", "o")).filter(F.col("o.over_under.appearance_stat.stat") == PASS_PROP)
    o = o.select("raw_id", "i", F.col("o.over_under.appearance_stat.appearance_id").alias("appearance_id"), F.col("o.stat_value").try_cast("double").alias("line"))
    a = doc.select("raw_id", F.inline("d.appearances")).withColumnRenamed("id", "appearance_id").dropDuplicates(["raw_id", "appearance_id"])
    p = doc.select("raw_id", F.inline("d.players")).withColumnRenamed("id", "player_id").dropDuplicates(["raw_id", "player_id"])
    t = o.join(a, ["raw_id", "appearance_id"], "left").join(p, ["raw_id", "player_id"], "left").filter("line is not null")
    code = F.coalesce("country", F.lit(""))
    team = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in countries.items() for x in kv]), code), code) if countries else code
    return t.select(F.xxhash64("raw_id", "i").alias("row_id"), F.trim(F.concat_ws(" ", "first_name", "last_name")).alias("player"), team.alias("team"), "line", "match_id")


def unseen(new: DataFrame, built: DataFrame, key: str = "match_id") -> DataFrame:
    """Rows of matches that aren't materialised yet."""
    return new.join(built.select(key).distinct(), key, "left_anti")
