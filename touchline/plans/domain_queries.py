"""Registered queries of the as-of feature layer and the decision layer, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from touchline.functions import scalar as S
from touchline.models import decisions, minutes, rate, styles
from touchline.operators import asof, features, histograms, ratings, resolve, splits, timestamps
from touchline.plans import backtest
from touchline.session import cut, read

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(Q)


def oracle() -> dict[str, str]:
    return dict(SQL)


def nan_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def player_match(spark: SparkSession, d: str) -> DataFrame:
    """Canonical rows: one a (match, player), the last delivered; missing readings are NULL; names and teams present."""
    rows = nan_null(read(spark, d, "combined_player_match")).dropna(subset=["match_id", "player_id", "player", "team"])
    return asof.keep_last(rows, ["match_id", "player_id"], [F.col("ingested_at"), F.col("row_id")])


_D = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
PM = f"""pm AS (SELECT * FROM (SELECT row_id, match_id, match_date, competition, provider, team, opponent, player_id, player, position,
 {_D('minutes')} AS minutes, {_D('passes_attempted')} AS passes_attempted, {_D('depth')} AS depth, started, stage, is_friendly, is_qualifier,
 row_number() OVER (PARTITION BY match_id, player_id ORDER BY ingested_at DESC, row_id DESC) AS rn
 FROM combined_player_match WHERE match_id IS NOT NULL AND player_id IS NOT NULL AND player IS NOT NULL AND team IS NOT NULL) WHERE rn = 1)"""
PER90 = "passes_attempted / CASE WHEN minutes IS NULL THEN NULL ELSE greatest(minutes, 1) END * 90"
#: SQL frame of the rows of strictly earlier instants.
BEFORE = "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
r6 = lambda c, n=6: F.round(c, n)


@query(f"WITH {PM} SELECT row_id, match_id, player_id FROM pm")
def keep_last_player_match(spark, d):
    return player_match(spark, d).select("row_id", "match_id", "player_id")


@query(f"""SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts {BEFORE}), 6) AS mean_before FROM events""")
def asof_expanding_mean(spark, d):
    e = read(spark, d, "events")
    return asof.expanding_mean(e, ["user_id"], "ts", {"m": "value"}).select("event_id", "user_id", r6("m").alias("mean_before"))


@query("""WITH p AS (SELECT a.event_id, b.event_type AS c, sum(b.value) AS s, count(*) AS n, max(b.ts) AS m FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY m DESC, c DESC) AS k FROM p), s AS (SELECT event_id, sum(s) / sum(n) AS v FROM r WHERE k <= 2 GROUP BY event_id)
SELECT e.event_id, e.user_id, round(s.v, 6) AS recent_mean FROM events e LEFT JOIN s ON e.event_id = s.event_id""")
def last2_group_mean(spark, d):
    e = read(spark, d, "events")
    return asof.last_groups_mean(e, "user_id", "event_type", "ts", "value", 2, "m").select("event_id", "user_id", r6("m").alias("recent_mean"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT *, pow(2, rn / 3.0::DOUBLE) AS g FROM n) SELECT event_id, user_id, round(sum(g * value) OVER w / sum(g) OVER w, 6) AS decayed FROM g
WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)""")
def decay_mean_by_style(spark, d):
    e = read(spark, d, "events")
    return asof.decay_mean(e, ["user_id", "event_type"], "ts", ["event_id"], F.col("value"), 3.0, "m").select("event_id", "user_id", r6("m").alias("decayed"))


@query(f"""WITH {PM}, n AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY match_date, match_id) AS k FROM pm),
g AS (SELECT *, pow(2, k / 5.0::DOUBLE) AS g FROM n) SELECT row_id, round(coalesce(sum(g * CASE WHEN coalesce(started, false) THEN 1.0 ELSE 0.0 END) OVER w / sum(g) OVER w, 0.5), 6) AS p_start FROM g
WINDOW w AS (PARTITION BY player_id ORDER BY match_date {BEFORE})""")
def recent_start_prob(spark, d):
    return minutes.recent_start_prob(player_match(spark, d)).select("row_id", r6("p_start").alias("p_start"))


TM = f"""{PM}, tm0 AS (SELECT match_id, match_date, competition, team, opponent, coalesce(sum(passes_attempted), 0) AS team_passes FROM pm
 WHERE match_date IS NOT NULL AND competition IS NOT NULL AND opponent IS NOT NULL GROUP BY ALL),
tm AS (SELECT a.*, a.team_passes / nullif(sum(a.team_passes) OVER (PARTITION BY a.match_id), 0) AS possession_share, b.p AS opp_passes_allowed
 FROM tm0 a LEFT JOIN (SELECT match_id, team, max(team_passes) AS p FROM tm0 GROUP BY ALL) b ON a.match_id = b.match_id AND a.opponent = b.team)"""


@query(f"WITH {TM} SELECT match_id, team, opponent, team_passes, round(possession_share, 6) AS possession_share, opp_passes_allowed FROM tm")
def team_match_table(spark, d):
    return ratings.team_match(player_match(spark, d)).select("match_id", "team", "opponent", "team_passes", r6("possession_share").alias("possession_share"), "opp_passes_allowed")


@query(f"""WITH {TM} SELECT match_id, team, opponent, round(avg(possession_share) OVER w, 6) AS team_poss_asof, round(avg(opp_passes_allowed) OVER w, 6) AS opp_allowed_asof FROM tm
WINDOW w AS (PARTITION BY team ORDER BY match_date {BEFORE})""")
def team_asof_context(spark, d):
    t = asof.expanding_mean(ratings.team_match(player_match(spark, d)), ["team"], "match_date", {"p": "possession_share", "a": "opp_passes_allowed"})
    return t.select("match_id", "team", "opponent", r6("p").alias("team_poss_asof"), r6("a").alias("opp_allowed_asof"))


@query(f"""WITH {TM}, p AS (SELECT team, avg(possession_share) AS poss, avg(team_passes) AS vol, avg(opp_passes_allowed) AS allow FROM tm GROUP BY team),
q AS (SELECT * FROM p WHERE poss IS NOT NULL AND vol IS NOT NULL AND allow IS NOT NULL)
SELECT team, round((poss - avg(poss) OVER ()) / stddev_samp(poss) OVER (), 6) AS z_poss, round((vol - avg(vol) OVER ()) / stddev_samp(vol) OVER (), 6) AS z_vol, round((allow - avg(allow) OVER ()) / stddev_samp(allow) OVER (), 6) AS z_allow FROM q""")
def style_profile(spark, d):
    z = styles.profiles(ratings.team_match(player_match(spark, d)))
    return z.select("team", *[r6(c).alias(c) for c in ("z_poss", "z_vol", "z_allow")])


@query()
def style_clusters(spark, d):
    """Clusters of team styles, numbered by their centre's possession; one cluster if there are fewer teams than k."""
    return styles.clusters(styles.profiles(ratings.team_match(player_match(spark, d))))


ROLE = """CASE WHEN lower(position) LIKE '%back%' AND (lower(position) LIKE '%center%' OR lower(position) LIKE '%centre%') THEN 'CB' WHEN lower(position) LIKE '%back%' THEN 'FB'
 WHEN lower(position) LIKE '%defensive midfield%' OR lower(position) LIKE '%pivot%' THEN 'DM' WHEN lower(position) LIKE '%midfield%' THEN 'CM' WHEN lower(position) LIKE '%wing%' THEN 'W'
 WHEN lower(position) LIKE '%forward%' OR lower(position) LIKE '%striker%' THEN 'ST' WHEN lower(position) LIKE '%keeper%' THEN 'GK' ELSE 'UNK' END"""


@query(f"""SELECT row_id, {ROLE} AS role, CASE WHEN {_D('depth')} IS NULL THEN 'Center Midfield' WHEN depth <= 0.15 THEN 'Goalkeeper' WHEN depth <= 0.38 THEN 'Center Back' WHEN depth <= 0.62 THEN 'Center Midfield' ELSE 'Center Forward' END AS depth_position,
CAST(contains(lower(coalesce(competition, '')), 'qualif') AS INT) AS is_qualifier_name, round({PER90.replace('minutes', 'm').replace('passes_attempted', 'p')}, 6) AS per90
FROM (SELECT *, {_D('minutes')} AS m, {_D('passes_attempted')} AS p FROM combined_player_match)""")
def role_and_flags(spark, d):
    t = nan_null(read(spark, d, "combined_player_match"))
    return t.select("row_id", S.role_bucket(F.col("position")).alias("role"), S.position_from_depth(F.col("depth")).alias("depth_position"), S.competition_flags(F.col("competition"))[0].alias("is_qualifier_name"), r6(S.per90(F.col("passes_attempted"), F.col("minutes"))).alias("per90"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_flatten(spark, d):
    return read(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query(f"""WITH {PM}, c AS (SELECT player_id, position, count(*) AS n FROM pm WHERE position IS NOT NULL GROUP BY ALL)
SELECT player_id, position FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY n DESC, position) AS k FROM c) WHERE k = 1""")
def modal_position(spark, d):
    c = player_match(spark, d).dropna(subset=["position"]).groupBy("player_id", "position").agg(F.count("*").alias("n"))
    least = c.groupBy("player_id").agg(F.max("n").alias("most")).join(c, "player_id").filter("n = most")
    return least.groupBy("player_id").agg(F.min("position").alias("position"))


@query(f"""WITH {PM} SELECT round(median(minutes), 6) AS med_minutes, round(avg(minutes), 6) AS mean_minutes, round(stddev_samp(minutes), 6) AS std_minutes, round(median(passes_attempted), 6) AS med_passes,
round(avg(passes_attempted), 6) AS mean_passes, round(stddev_samp(passes_attempted), 6) AS std_passes FROM pm""")
def robust_scale(spark, d):
    pm = player_match(spark, d)
    cols = [(n, c) for n, c in (("minutes", "minutes"), ("passes", "passes_attempted"))]
    return pm.agg(*[x for n, c in cols for x in (r6(F.percentile(c, 0.5)).alias(f"med_{n}"), r6(F.avg(c)).alias(f"mean_{n}"), r6(F.stddev_samp(c)).alias(f"std_{n}"))])


def _rated(spark, d):
    pm = player_match(spark, d).filter("minutes > 0 and passes_attempted is not null")
    return pm.withColumn("per90", S.per90(F.col("passes_attempted"), F.col("minutes"))).withColumn("role", S.role_bucket(F.col("position")))


@query(f"""WITH {PM}, x AS (SELECT *, {PER90} AS per90, {ROLE} AS role FROM pm WHERE minutes > 0 AND passes_attempted IS NOT NULL),
l AS (SELECT player_id, competition, max(match_date) AS m, sum(per90) AS s, count(*) AS n FROM x GROUP BY ALL),
k AS (SELECT player_id, sum(s) AS s, sum(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY m DESC, competition DESC) AS rk FROM l) WHERE rk <= 2 GROUP BY 1),
ro AS (SELECT player_id, role FROM (SELECT player_id, role, row_number() OVER (PARTITION BY player_id ORDER BY count(*) DESC, role) AS rk FROM x GROUP BY player_id, role) WHERE rk = 1),
rm AS (SELECT role, avg(per90) AS mean FROM x GROUP BY role)
SELECT k.player_id, CAST(k.n AS BIGINT) AS n, round(k.n / (k.n + 2.0) * ln(greatest(k.s / k.n, 1) / greatest(rm.mean, 1)), 6) AS center FROM k JOIN ro USING (player_id) JOIN rm USING (role)""")
def prior_center(spark, d):
    return features.prior_center(_rated(spark, d)).select("player_id", "n", r6("prior").alias("center"))


@query(f"""WITH {PM}, x AS (SELECT *, {PER90} AS per90, {ROLE} AS role FROM pm),
h AS (SELECT row_id, role, avg(per90) OVER (PARTITION BY player_id ORDER BY match_date {BEFORE}) AS own FROM x),
rm AS (SELECT role, avg(per90) AS mean FROM x WHERE minutes > 0 GROUP BY role) SELECT h.row_id, round(coalesce(own, mean, (SELECT median(per90) FROM x)), 6) AS anchor FROM h LEFT JOIN rm ON h.role = rm.role""")
def anchor_fallback(spark, d):
    x = player_match(spark, d).withColumn("per90", S.per90(F.col("passes_attempted"), F.col("minutes"))).withColumn("role", S.role_bucket(F.col("position")))
    h = asof.expanding_mean(x, ["player_id"], "match_date", {"own": "per90"})
    means = x.filter("minutes > 0").groupBy("role").agg(F.avg("per90").alias("mean"))
    med = x.agg(F.percentile("per90", 0.5).alias("med"))
    out = h.join(F.broadcast(means), "role", "left").join(F.broadcast(med))  # a handful of roles; one row
    return out.select("row_id", r6(F.coalesce("own", "mean", "med")).alias("anchor"))


ESPN = f"""es AS (SELECT * FROM (SELECT row_id, competition, date, team, opponent, {_D('possession')} AS possession, {_D('goals_for')} AS goals_for, {_D('goals_against')} AS goals_against, {_D('margin')} AS margin, ingested_at,
 row_number() OVER (PARTITION BY competition, date, team, opponent ORDER BY ingested_at DESC, row_id DESC) AS rn FROM espn_team_match) WHERE rn = 1)"""


def _espn(spark, d):
    """The last delivered row of each side of a match, with its kick-off from the date as written (problem 3)."""
    raw = nan_null(read(spark, d, "espn_team_match"))
    at = timestamps.normalise_timestamps({"espn_team_match": (raw, "date", "competition")}, read(spark, d, "competition_zones"))
    at = at.filter(F.col("kickoff_utc").isNotNull()).select("row_id", F.to_timestamp_ntz(F.regexp_replace("kickoff_utc", "Z$", "")).alias("at"))
    return asof.keep_last(raw.join(at, "row_id"), ["competition", "at", "team", "opponent"], [F.col("ingested_at"), F.col("row_id")])


def _results(espn):
    """One row a match; no side is at home, so there is no home advantage: ``home`` is the lesser name only to have an order."""
    e = espn.dropna(subset=["goals_for", "goals_against", "team", "opponent"]).filter("team < opponent")
    return e.select(F.col("team").alias("home"), F.col("opponent").alias("away"), "at", F.col("goals_for").alias("home_goals"), F.col("goals_against").alias("away_goals"), F.lit(True).alias("neutral"))


@query()
def elo_timeline(spark, d):
    return ratings.elo(_results(cut(_espn(spark, d))), home=0.0).select("team", "at", r6("rating").alias("rating"))


LIST = "list_transform(range(1, len(r) + 1), lambda i: CASE WHEN i = h THEN r[i] + m WHEN i = a THEN r[i] - m ELSE r[i] END)"


@query(f"""WITH RECURSIVE l AS (SELECT date_trunc('month', l_shipdate) AS dt, CAST(l_suppkey % 7 AS BIGINT) AS s, CAST(l_partkey % 7 AS BIGINT) AS p, CAST(l_orderkey % 5 AS BIGINT) AS hg, CAST((l_orderkey + l_linenumber) % 4 AS BIGINT) AS ag, l_orderkey, l_linenumber FROM lineitem),
g0 AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY l_orderkey, l_linenumber, hg, ag, s, p) AS k FROM l WHERE s <> p),
g AS (SELECT dt, s + 1 AS h, p + 1 AS a, hg, ag, row_number() OVER (ORDER BY dt) AS n FROM g0 WHERE k = 1),
e(n, dt, h, a, r) AS (SELECT CAST(0 AS BIGINT), NULL::TIMESTAMP, CAST(0 AS BIGINT), CAST(0 AS BIGINT), list_transform(range(7), lambda i: 1500.0::DOUBLE)
UNION ALL SELECT n, dt, h, a, {LIST} FROM (SELECT g.n, CAST(g.dt AS TIMESTAMP) AS dt, g.h, g.a, e.r, 30 * CASE WHEN g.hg = g.ag THEN 1 ELSE ln(abs(g.hg - g.ag) + 1) END * ((CASE WHEN g.hg > g.ag THEN 1 WHEN g.hg = g.ag THEN 0.5 ELSE 0 END) - 1 / (1 + pow(10, (e.r[g.a] - e.r[g.h] - 55) / 400.0))) AS m FROM e JOIN g ON g.n = e.n + 1))
SELECT CAST(h - 1 AS BIGINT) AS team, dt AS "at", round(r[h], 4) AS rating FROM e WHERE n > 0 UNION ALL SELECT CAST(a - 1 AS BIGINT), dt, round(r[a], 4) FROM e WHERE n > 0""")
def elo_fold(spark, d):
    """The rating fold over one game a month between seven sides, with home advantage, draws and ties of goals."""
    t = read(spark, d, "lineitem").select(
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("at"), (F.col("l_suppkey") % 7).cast("long").alias("s"), (F.col("l_partkey") % 7).cast("long").alias("p"),
        (F.col("l_orderkey") % 5).cast("long").alias("hg"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 4).cast("long").alias("ag"), "l_orderkey", "l_linenumber",
    ).filter("s <> p")
    first = t.groupBy("at").agg(F.min(F.struct("l_orderkey", "l_linenumber", "hg", "ag", "s", "p")).alias("g"))
    games = first.select(F.col("g.s").alias("home"), F.col("g.p").alias("away"), "at", F.col("g.hg").alias("home_goals"), F.col("g.ag").alias("away_goals"))
    return ratings.elo(games).select(F.col("team").cast("long").alias("team"), "at", F.round("rating", 4).alias("rating"))


@query()
def elo_asof_join(spark, d):
    """Ratings and possession of both sides strictly before each match; 1500 and NULL where there is none."""
    espn = cut(_espn(spark, d))
    sides = cut(ratings.team_match(player_match(spark, d)).select("match_id", "team", "opponent", "match_date"))
    out = ratings.attach_ratings(sides, _results(espn), espn.select("team", "at", "possession"))
    return out.select("match_id", "team", "opponent", *[r6(c).alias(c) for c in ("team_elo", "opp_elo", "team_poss_espn", "opp_poss_espn")])


@query(f"""WITH {TM}, h AS (SELECT team, match_date AS seen, match_id, avg(possession_share) OVER (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS p FROM (SELECT team, match_date, match_id, max(possession_share) AS possession_share FROM tm GROUP BY ALL) WHERE possession_share IS NOT NULL),
h1 AS (SELECT team, seen, arg_max(p, match_id) AS p FROM h GROUP BY team, seen)
SELECT tm.match_id, tm.team, tm.opponent, round(h1.p, 6) AS poss10 FROM tm ASOF LEFT JOIN h1 ON tm.team = h1.team AND tm.match_date > h1.seen""")
def rolling10_asof(spark, d):
    t = ratings.team_match(player_match(spark, d)).select("match_id", "team", "opponent", "match_date", "possession_share")
    h = t.groupBy("team", "match_date", "match_id").agg(F.max("possession_share").alias("share")).filter("share is not null")
    h = asof.rolling_mean(h, "team", "match_date", ["match_id"], "share", 10, "p").groupBy("team", "match_date").agg(F.max_by("p", "match_id").alias("p"))
    return asof.asof_last(t, h, "team", "match_date", "p", "x").select("match_id", "team", "opponent", r6("x").alias("poss10"))


FEATURES = f"""{TM}, style AS (SELECT team, CASE WHEN avg(possession_share) >= 0.5 THEN 1 ELSE 0 END AS style FROM tm GROUP BY team HAVING avg(possession_share) IS NOT NULL),
sides AS (SELECT s.match_id, s.team, s.p, s.a, style.style FROM (SELECT match_id, team, max(p) AS p, max(a) AS a FROM (SELECT match_id, team, avg(possession_share) OVER w AS p, avg(opp_passes_allowed) OVER w AS a FROM tm WINDOW w AS (PARTITION BY team ORDER BY match_date {BEFORE})) GROUP BY ALL) s LEFT JOIN style ON s.team = style.team),
x AS (SELECT pm.*, {PER90} AS per90, {ROLE} AS role, own.p AS team_poss_asof, oth.a AS opp_allowed_asof, coalesce(oth.style, -1) AS opp_style FROM pm LEFT JOIN sides own ON pm.match_id = own.match_id AND pm.team = own.team LEFT JOIN sides oth ON pm.match_id = oth.match_id AND pm.opponent = oth.team),
seen AS (SELECT a.row_id, b.competition AS c, sum(b.per90) AS s, count(b.per90) AS n, max(b.match_date) AS m FROM x a JOIN x b ON a.player_id = b.player_id AND b.match_date < a.match_date GROUP BY ALL),
recent AS (SELECT row_id, sum(s) / nullif(sum(n), 0) AS recent_per90 FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY m DESC, c DESC NULLS LAST) AS k FROM seen) WHERE k <= 2 GROUP BY row_id),
ages AS (SELECT row_id, player_id, opp_style, match_date, per90, pow(2, row_number() OVER (PARTITION BY player_id, opp_style ORDER BY match_date, match_id, row_id) / 4.0::DOUBLE) AS g FROM x),
styled AS (SELECT row_id, sum(g * per90) OVER w / sum(CASE WHEN per90 IS NOT NULL THEN g END) OVER w AS style_per90 FROM ages WINDOW w AS (PARTITION BY player_id, opp_style ORDER BY match_date {BEFORE})),
roles AS (SELECT role, avg(per90) AS mean FROM x WHERE minutes > 0 GROUP BY role),
feats AS (SELECT x.row_id, x.role, x.opp_style, x.per90, x.team_poss_asof, x.opp_allowed_asof, r.recent_per90, st.style_per90, greatest(coalesce(r.recent_per90, roles.mean, (SELECT median(per90) FROM x)), 1) AS anchor_per90,
 coalesce(x.is_friendly, 0) AS is_friendly, coalesce(x.is_qualifier, 0) AS is_qualifier FROM x LEFT JOIN recent r ON x.row_id = r.row_id LEFT JOIN styled st ON x.row_id = st.row_id LEFT JOIN roles ON x.role = roles.role)"""


@query(f"""WITH {FEATURES} SELECT row_id, role, CAST(opp_style AS INT) AS opp_style, round(per90, 5) AS per90, round(team_poss_asof, 5) AS team_poss_asof, round(opp_allowed_asof, 5) AS opp_allowed_asof, round(recent_per90, 5) AS recent_per90,
round(style_per90, 5) AS style_per90, round(anchor_per90, 5) AS anchor_per90, CAST(is_friendly AS INT) AS is_friendly, CAST(is_qualifier AS INT) AS is_qualifier FROM feats""")
def feature_build(spark, d):
    """The feature table under a given style map: teams with half of their matches' passes or more, and the others."""
    pm = cut(player_match(spark, d))
    mean = ratings.team_match(pm).groupBy("team").agg(F.avg("possession_share").alias("p")).dropna()
    f = features.build(pm, mean.select("team", (F.col("p") >= 0.5).cast("int").alias("style")))
    cols = ("per90", "team_poss_asof", "opp_allowed_asof", "recent_per90", "style_per90", "anchor_per90")
    return f.select("row_id", "role", "opp_style", *[r6(c, 5).alias(c) for c in cols], F.col("is_friendly").cast("int").alias("is_friendly"), F.col("is_qualifier").cast("int").alias("is_qualifier"))


@query()
def feature_table(spark, d):
    """The feature table with fitted styles, ratings and possession."""
    return _features(spark, d)


def _features(spark, d, pm=None):
    pm = pm if pm is not None else cut(player_match(spark, d))
    espn = cut(_espn(spark, d))
    style = styles.clusters(styles.profiles(ratings.team_match(pm)))
    return features.build(pm, style, _results(espn), espn.select("team", "at", "possession"))


@query(f"""WITH {PM}, h AS (SELECT a.row_id, b.passes_attempted AS v, a.passes_attempted AS y FROM pm a JOIN pm b ON a.player_id = b.player_id AND b.match_date < TIMESTAMP '2025-06-01' AND b.minutes > 0 AND b.passes_attempted IS NOT NULL
 WHERE a.match_date >= TIMESTAMP '2025-06-01' AND a.started AND a.passes_attempted IS NOT NULL),
own AS (SELECT row_id FROM h GROUP BY row_id HAVING count(*) >= 3), t AS (SELECT *, {ROLE} AS role FROM pm WHERE match_date < TIMESTAMP '2025-06-01' AND minutes > 0 AND passes_attempted IS NOT NULL),
q AS (SELECT row_id, {ROLE} AS role, passes_attempted AS y FROM pm WHERE match_date >= TIMESTAMP '2025-06-01' AND started AND passes_attempted IS NOT NULL),
s AS (SELECT row_id, y, v, 'player' AS pool FROM h WHERE row_id IN (SELECT row_id FROM own) UNION ALL SELECT q.row_id, q.y, t.passes_attempted, 'role' FROM q JOIN t ON q.role = t.role WHERE q.row_id NOT IN (SELECT row_id FROM own)
 UNION ALL SELECT q.row_id, q.y, t.passes_attempted, 'all' FROM q, t WHERE q.row_id NOT IN (SELECT row_id FROM own) AND q.role NOT IN (SELECT role FROM t)),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY v) AS i, count(*) OVER (PARTITION BY row_id) AS n FROM s)
SELECT row_id, pool, round(avg(abs(v - y)) - sum((2 * i - n - 1) * v) / max(n) / max(n), 5) AS base_crps FROM r GROUP BY row_id, pool""")
def baseline_score(spark, d):
    """Score of the naive forecast for the starters after a cut, from the pools before it."""
    pm = player_match(spark, d)
    at = F.lit("2025-06-01").cast("timestamp_ntz")
    test = pm.filter((F.col("match_date") >= at) & F.col("started") & F.col("passes_attempted").isNotNull())
    return backtest.baseline(pm.filter(F.col("match_date") < at), test).select("row_id", "pool", F.round("base_crps", 5).alias("base_crps"))


@query()
def holdout_backtest(spark, d):
    """Scores of the last walk-forward fold: the final holdout."""
    rows = player_match(spark, d)
    pm = cut(rows.select(*[c for c in rows.columns if c in backtest.NEEDED]))
    espn = cut(_espn(spark, d))
    return backtest.run_fold(pm, splits.final_holdout(pm), _results(espn), espn.select("team", "at", "possession"))


@query()
def sos_ratings(spark, d):
    return ratings.schedule_strength(_espn(spark, d)).select("team", "games", F.round("rating", 3).alias("rating"), F.round("schedule", 3).alias("schedule"))


@query(f"""WITH t AS (SELECT team, {_D('possession')} AS possession, {_D('team_passes')} AS team_passes, {_D('opp_passes_allowed')} AS opp_passes_allowed FROM espn_team_match)
SELECT team, count(team_passes) AS games, round_even(avg(possession), 1) AS avg_possession, round_even(avg(team_passes), 1) AS avg_passes, round_even(avg(opp_passes_allowed), 1) AS avg_allowed FROM t GROUP BY team""")
def team_profiles(spark, d):
    return ratings.team_profiles(nan_null(read(spark, d, "espn_team_match")))


@query(f"""WITH {PM}, f AS (SELECT competition, min(match_date) AS cutoff FROM pm GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY cutoff, competition) - 1 AS fold FROM f)
SELECT k.competition, CAST(k.fold AS INT) AS fold, (SELECT count(*) FROM pm WHERE pm.match_date < k.cutoff) AS n_train, (SELECT count(*) FROM pm WHERE pm.competition = k.competition) AS n_test FROM k WHERE fold >= 2""")
def walk_forward_folds(spark, d):
    pm = player_match(spark, d)
    # rows a competition's first instant lies behind, from counts a day: one pass, no join of folds and rows
    at = pm.groupBy("match_date").agg(F.count("*").alias("n"))
    folds = splits.fold_table(pm)
    marks = at.select("match_date", "n", F.lit(None).cast("string").alias("competition")).unionByName(folds.select(F.col("cutoff").alias("match_date"), F.lit(0).cast("long").alias("n"), "competition"))
    w = W.orderBy("match_date").rangeBetween(W.unboundedPreceding, W.currentRow)
    upto = marks.withColumn("upto", F.sum("n").over(w)).filter("competition is not null").join(at.withColumnRenamed("n", "here"), "match_date", "left")
    tests = pm.groupBy("competition").agg(F.count("*").alias("n_test"))
    return folds.join(upto.select("competition", (F.col("upto") - F.coalesce("here", F.lit(0))).alias("n_train")), "competition").join(tests, "competition").select("competition", F.col("fold").cast("int").alias("fold"), "n_train", "n_test")


@query(f"""WITH {PM}, s AS (SELECT * FROM pm WHERE started), l AS (SELECT *, rank() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS k FROM s) SELECT DISTINCT team, match_id, player_id FROM l WHERE k = 1""")
def last_lineup(spark, d):
    s = player_match(spark, d).filter("started")
    last = s.groupBy("team").agg(F.max(F.struct("match_date", "match_id")).alias("m")).select("team", F.col("m.match_id").alias("match_id"))
    return s.join(last, ["team", "match_id"]).select("team", "match_id", "player_id").distinct()


@query("""WITH old AS (SELECT DISTINCT match_id FROM combined_player_match WHERE provider = 'statsbomb') SELECT row_id FROM sb_player_match f WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.match_id = f.match_id)
UNION ALL SELECT row_id + 1000000000 FROM sb_player_match f WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT match_id FROM combined_player_match WHERE provider = 'statsbomb' AND match_date < TIMESTAMP '2025-01-01') o WHERE o.match_id = f.match_id)""")
def incremental_anti(spark, d):
    """Rows of matches that aren't built yet: against all that is built, and against what was built by a date."""
    from touchline.sources.readers import unseen

    built, new = read(spark, d, "combined_player_match").filter("provider = 'statsbomb'"), read(spark, d, "sb_player_match")
    early = unseen(new, built.filter(F.col("match_date") < F.lit("2025-01-01").cast("timestamp_ntz"))).select((F.col("row_id") + 1_000_000_000).alias("row_id"))
    return unseen(new, built).select("row_id").unionByName(early)


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus <> 'F'),
u AS (SELECT *, 0 AS g FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL SELECT *, 1 FROM n)
SELECT o_custkey, o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM u) WHERE k = 1""")
def keep_last_upsert(spark, d):
    o = read(spark, d, "orders")
    last = lambda x: asof.keep_last(x.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    done = asof.upsert(last(o.filter("o_orderstatus = 'F'")), last(o.filter("o_orderstatus <> 'F'")), ["o_custkey"])
    return done.select("o_custkey", "o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("""SELECT 'sb' AS src, row_id, minutes_known, NULL::VARCHAR AS feed, season FROM (SELECT row_id, NOT isnan(minutes) AND minutes IS NOT NULL AS minutes_known, season FROM sb_player_match)
UNION ALL SELECT 'fm', row_id, NOT isnan(minutes) AND minutes IS NOT NULL, feed, NULL FROM fotmob_wc2026""")
def union_missing_columns(spark, d):
    known = F.coalesce(~F.isnan("minutes"), F.lit(False)) & F.col("minutes").isNotNull()
    a = read(spark, d, "sb_player_match").select(F.lit("sb").alias("src"), "row_id", known.alias("minutes_known"), "season")
    b = read(spark, d, "fotmob_wc2026").select(F.lit("fm").alias("src"), "row_id", known.alias("minutes_known"), "feed")
    return a.unionByName(b, allowMissingColumns=True).select("src", "row_id", "minutes_known", "feed", "season")


_FOLD = lambda c: f"trim(lower(strip_accents({c})))"


@query(f"""SELECT doc_id, {_FOLD('text')} AS folded FROM documents WHERE lang IN ('en', 'es', 'fr', 'de', 'pt', 'cs', 'pl', 'sv', 'tr')""")
def accent_fold(spark, d):
    t = read(spark, d, "documents").filter(F.col("lang").isin("en", "es", "fr", "de", "pt", "cs", "pl", "sv", "tr"))
    return t.select("doc_id", S.fold(F.col("text")).alias("folded"))


@query(f"""WITH k AS (SELECT DISTINCT player_id, {_FOLD('team')} AS team, {_FOLD('player')} AS name FROM combined_player_match WHERE provider = 'statsbomb' AND player IS NOT NULL AND team IS NOT NULL),
w AS (SELECT *, string_split_regex(name, '\\s+') AS p FROM k), e AS (SELECT team, name, max(player_id) AS id1 FROM k GROUP BY ALL),
f AS (SELECT team, p[1] AS a, p[-1] AS z, min(player_id) AS id2 FROM w WHERE len(p) >= 2 GROUP BY ALL), l AS (SELECT team, p[-1] AS z, min(player_id) AS id3 FROM w WHERE len(p) >= 2 GROUP BY ALL),
q AS (SELECT row_id, {_FOLD('team')} AS team, {_FOLD('player')} AS name, string_split_regex({_FOLD('player')}, '\\s+') AS p FROM combined_player_match WHERE provider = 'fotmob')
SELECT q.row_id, coalesce(id1, id2, id3) AS player_id, CASE WHEN id1 IS NOT NULL THEN 1 WHEN id2 IS NOT NULL THEN 2 WHEN id3 IS NOT NULL THEN 3 END AS step
FROM q LEFT JOIN e ON q.team = e.team AND q.name = e.name LEFT JOIN f ON len(q.p) >= 2 AND q.team = f.team AND q.p[1] = f.a AND q.p[-1] = f.z LEFT JOIN l ON len(q.p) >= 2 AND q.team = l.team AND q.p[-1] = l.z""")
def resolve_cascade(spark, d):
    t = read(spark, d, "combined_player_match")
    return resolve.resolve(t.filter("provider = 'fotmob'"), t.filter("provider = 'statsbomb'"))


@query("""WITH t AS (SELECT match_id, min(team) AS a, max(team) AS b FROM combined_player_match WHERE match_id IS NOT NULL AND team IS NOT NULL GROUP BY match_id HAVING count(DISTINCT team) = 2)
SELECT match_id, a AS team, b AS opponent FROM t UNION ALL SELECT match_id, b, a FROM t""")
def opponent_infer(spark, d):
    return resolve.infer_opponent(read(spark, d, "combined_player_match"))


@query(f"""WITH {PM}, s AS (SELECT team, match_id, player_id, passes_attempted AS p FROM pm WHERE minutes >= 45 AND passes_attempted IS NOT NULL)
SELECT a.player_id AS player_a, b.player_id AS player_b, count(*) AS n, round(CASE WHEN count(*) >= 5 AND stddev_pop(a.p) > 0 AND stddev_pop(b.p) > 0 THEN corr(a.p, b.p) ELSE 0.6 END, 5) AS corr
FROM s a JOIN s b ON a.match_id = b.match_id AND a.team = b.team AND a.player_id < b.player_id GROUP BY ALL""")
def pair_corr(spark, d):
    s = player_match(spark, d).filter("minutes >= 45 and passes_attempted is not null").select("team", "match_id", "player_id", F.col("passes_attempted").alias("p"))
    a, b = s.toDF("team", "match_id", "player_a", "pa"), s.toDF("team", "match_id", "player_b", "pb")
    # partners on one sheet: at most the squad of a match
    g = a.join(b, ["team", "match_id"]).filter("player_a < player_b").groupBy("player_a", "player_b")
    corr = F.try_divide(F.covar_pop("pa", "pb"), F.stddev_pop("pa") * F.stddev_pop("pb"))
    c = F.coalesce(F.when(F.count("*") >= 5, corr), F.lit(0.6))
    return g.agg(F.count("*").alias("n"), F.round(c, 5).alias("corr"))


@query(f"WITH {PM} SELECT row_id FROM pm WHERE NOT coalesce({PER90} > 150 OR (minutes < 5 AND passes_attempted > 8), false)")
def clean_corrupt(spark, d):
    return player_match(spark, d).filter(~S.corrupt(F.col("minutes"), F.col("passes_attempted"))).select("row_id")


@query(f"""WITH {PM} SELECT {ROLE} AS role, coalesce(started, false) AS started, count(*) AS n, round(avg(least(minutes, 98)), 6) AS mean_minutes, round(quantile_cont(least(minutes, 98), 0.1), 6) AS p10, round(quantile_cont(least(minutes, 98), 0.9), 6) AS p90
FROM pm WHERE minutes > 0 GROUP BY ALL""")
def minutes_pools(spark, d):
    m = S.bound(F.col("minutes"), high=98.0)
    pm = player_match(spark, d).filter("minutes > 0").withColumn("m", m)
    g = pm.groupBy(S.role_bucket(F.col("position")).alias("role"), F.coalesce("started", F.lit(False)).alias("started"))
    return g.agg(F.count("*").alias("n"), r6(F.avg("m")).alias("mean_minutes"), r6(F.percentile("m", 0.1)).alias("p10"), r6(F.percentile("m", 0.9)).alias("p90"))


@query("""SELECT o_orderkey, round(1 - coalesce((SELECT sum(exp(lgamma(k + 5.0) - lgamma(5.0) - lgamma(k + 1.0) + 5.0 * ln(5.0 / (5.0 + mu)) + k * ln(mu / (5.0 + mu)))) FROM (SELECT unnest(generate_series(0, 44)) AS k)), 0), 6) AS p_over
FROM (SELECT o_orderkey, 20 + o_orderkey % 40 AS mu FROM orders)""")
def nb_prob_over(spark, d):
    mu = (20 + F.col("o_orderkey") % 40).cast("double")
    return read(spark, d, "orders").select("o_orderkey", r6(S.nb_tail(mu, F.lit(5.0), F.lit(45))).alias("p_over"))


def _played(spark, d):
    return player_match(spark, d).filter("passes_attempted is not null").select("player_id", "row_id", "match_date", "match_id", "passes_attempted")


def _history(spark, d):
    """Rows with at least 3 strictly earlier ones, the mean of all of these and their share at or above 30."""
    x = _played(spark, d).withColumn("y", (F.col("passes_attempted") >= 30).cast("double"))
    found = asof.before(x, x, ["player_id"], "match_date", {"n": F.lit(1), "s": F.col("passes_attempted"), "o": F.col("y")})
    found = found.select("player_id", "match_date", "n", (F.col("s") / F.col("n")).alias("mean"), (F.col("o") / F.col("n")).alias("p"))
    return asof.attach(x, found, ["player_id", "match_date"]).filter("n >= 3")


#: A player's whole earlier history, as the operators take it.
HIST = f"""{PM}, o AS (SELECT player_id, row_id, passes_attempted AS y, match_date FROM pm WHERE passes_attempted IS NOT NULL),
hs0 AS (SELECT a.row_id, a.y, b.y AS x, count(*) OVER (PARTITION BY a.row_id) AS earlier FROM o a JOIN o b ON a.player_id = b.player_id AND b.match_date < a.match_date), hs AS (SELECT row_id, y, x FROM hs0 WHERE earlier >= 3)"""


@query(f"""WITH {HIST}, r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY x) AS i, count(*) OVER (PARTITION BY row_id) AS n FROM hs)
SELECT row_id, round(avg(abs(x - y)) - sum((2 * i - n - 1) * x) / max(n) / max(n), 6) AS crps FROM r GROUP BY row_id""")
def crps_empirical(spark, d):
    h = histograms.running(_played(spark, d), "player_id", "match_date", "row_id", "passes_attempted")
    return h.filter("n >= 3").select("row_id", r6("crps").alias("crps"))


@query(f"""WITH {HIST}, p AS (SELECT row_id, avg((x >= 30)::INT) AS p, max((y >= 30)::INT) AS y FROM hs GROUP BY row_id), q AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS c FROM p)
SELECT round(-avg(y * ln(c) + (1 - y) * ln(1 - c)), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, count(*) AS n FROM q""")
def log_loss_brier(spark, d):
    h = _probabilities(spark, d)
    return h.agg(r6(S.log_loss(F.col("p"), F.col("y"))).alias("log_loss"), r6(F.avg(F.pow(F.col("p") - F.col("y"), 2))).alias("brier"), F.count("*").alias("n"))


def _probabilities(spark, d):
    return _history(spark, d).select("row_id", "player_id", "passes_attempted", "p", "y")


@query(f"""WITH {HIST}, p AS (SELECT row_id, avg((x >= 30)::INT) AS p, max((y >= 30)::INT) AS y FROM hs GROUP BY row_id)
SELECT CAST(floor(p * 10 + 1e-9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS hit_rate FROM p WHERE p >= 0.5 GROUP BY 1""")
def reliability_bins(spark, d):
    h = _probabilities(spark, d).filter("p >= 0.5")
    return h.groupBy(F.floor(F.col("p") * 10 + 1e-9).cast("int").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("p")).alias("mean_p"), r6(F.avg("y")).alias("hit_rate"))


@query()
def isotonic_fit(spark, d):
    """Calibration over nine pairs a row: the share of earlier values above each of their quantiles, and whether the row's own is."""
    h = histograms.running(_played(spark, d), "player_id", "match_date", "row_id", "passes_attempted", histograms.QUANTILES)
    pairs = h.filter("n >= 3").select(F.explode(F.arrays_zip("p", "y")).alias("a")).select("a.p", "a.y")
    # equal p are pooled by the fit: their mean with their number as weight is the same fit
    return decisions.isotonic(pairs.groupBy("p").agg(F.avg("y").alias("y"), F.count("*").alias("n")), "p", "y", "n")


EDGE = f"""{HIST}, p AS (SELECT row_id, avg((x >= 30)::INT) AS p_over, max(y) AS actual FROM hs GROUP BY row_id),
e AS (SELECT *, CASE WHEN p_over >= 0.5 THEN 'MORE' ELSE 'LESS' END AS pick, greatest(p_over, 1 - p_over) AS p_pick FROM p)"""


def _edges(spark, d):
    return decisions.edge_table(_probabilities(spark, d).select("row_id", "player_id", F.col("p").alias("p_over"), F.col("passes_attempted").alias("actual"), F.lit(29.5).alias("line")))


@query(f"WITH {EDGE} SELECT row_id, pick, round(p_pick, 6) AS p_pick, round(p_pick - pow(1 / 20.0, 1 / 5.0), 6) AS edge FROM e")
def edge_table(spark, d):
    return _edges(spark, d).select("row_id", "pick", r6("p_pick").alias("p_pick"), r6("edge").alias("edge"))


@query(f"""WITH {EDGE}, g AS (SELECT count(*) AS plays, sum(((actual >= 30) = (pick = 'MORE'))::INT) AS hits FROM e) SELECT plays, CAST(hits AS BIGINT) AS hits, round(hits / plays, 6) AS hit_rate, round(hits / plays * 0.87 - (1 - hits / plays), 6) AS roi FROM g""")
def grade_picks(spark, d):
    return decisions.grade(_edges(spark, d)).select("plays", "hits", r6("hit_rate").alias("hit_rate"), r6("roi").alias("roi"))


def _picks(spark, d):
    teams = player_match(spark, d).select("row_id", "team", F.date_format("match_date", "yyyy-MM-dd").alias("slate"))
    return _edges(spark, d).join(teams, "row_id").select("slate", "row_id", "player_id", "team", "pick", F.col("p_pick").alias("p_hit"), (F.col("p_pick") - 0.5).alias("confidence"))


@query()
def greedy_parlays(spark, d):
    return decisions.greedy_parlays(_picks(spark, d), 3, 3)


@query()
def parlay_ev(spark, d):
    """Value of the built three-leg parlays."""
    picks = cut(_picks(spark, d))
    return decisions.parlay_ev(decisions.greedy_parlays(picks, 3, 3), picks).select("slate", "parlay", "legs", r6("p_all").alias("p_all"), F.round("ev", 5).alias("ev"))


@query(f"""WITH {EDGE}, h AS (SELECT player_id, avg(passes_attempted) AS hist FROM pm WHERE minutes >= 70 GROUP BY player_id), c AS (SELECT e.row_id, e.p_over, h.hist, h.hist IS NULL AS is_new FROM e JOIN pm ON e.row_id = pm.row_id LEFT JOIN h ON pm.player_id = h.player_id)
SELECT row_id, CASE WHEN p_over >= 0.5 THEN 'OVER' ELSE 'UNDER' END AS pick, round(greatest(p_over, 1 - p_over), 6) AS p_hit, hist IS NULL OR ((hist > 29.5) = (p_over >= 0.5)) AS agree,
round(CASE WHEN hist IS NULL OR ((hist > 29.5) = (p_over >= 0.5)) THEN abs(p_over - 0.5) * CASE WHEN is_new THEN 0.25 ELSE 1 END ELSE 0 END, 6) AS confidence FROM c""")
def confidence_score(spark, d):
    props = _edges(spark, d).join(decisions.history(player_match(spark, d)), "player_id", "left").withColumn("is_new", F.col("hist").isNull())
    return decisions.score(props).select("row_id", "pick", r6("p_hit").alias("p_hit"), "agree", r6("confidence").alias("confidence"))


@query(f"""WITH {PM}, x AS (SELECT *, {ROLE} AS role FROM pm WHERE passes_attempted IS NOT NULL), o AS (SELECT player_id, count(*) AS n, avg(passes_attempted) AS m FROM x GROUP BY 1), r AS (SELECT role, avg(passes_attempted) AS m FROM x GROUP BY 1)
SELECT x.row_id, CASE WHEN o.n >= 3 THEN 'player' ELSE 'role' END AS pool, round(CASE WHEN o.n >= 3 THEN o.m ELSE r.m END, 6) AS baseline FROM x JOIN o USING (player_id) JOIN r USING (role)""")
def baseline_pool_cascade(spark, d):
    x = player_match(spark, d).filter("passes_attempted is not null").withColumn("role", S.role_bucket(F.col("position"))).select("row_id", "player_id", "role", "passes_attempted")
    own = x.groupBy("player_id").agg(F.count("*").alias("n"), F.avg("passes_attempted").alias("own"))
    role = x.groupBy("role").agg(F.avg("passes_attempted").alias("of_role"))
    enough = F.col("n") >= 3
    return x.join(own, "player_id").join(role, "role").select("row_id", F.when(enough, "player").otherwise("role").alias("pool"), r6(F.when(enough, F.col("own")).otherwise(F.col("of_role"))).alias("baseline"))


@query(f"""WITH {HIST}, m AS (SELECT row_id, avg(x) - max(y) AS e FROM hs GROUP BY row_id), s AS (SELECT m.*, pm.provider, {ROLE} AS role FROM m JOIN pm USING (row_id))
SELECT provider, role, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias FROM s GROUP BY ALL""")
def grading_slices(spark, d):
    e = _history(spark, d).select("row_id", (F.col("mean") - F.col("passes_attempted")).alias("e"))
    s = e.join(player_match(spark, d).select("row_id", "provider", S.role_bucket(F.col("position")).alias("role")), "row_id")
    return s.groupBy("provider", "role").agg(F.count("*").alias("n"), r6(F.avg(F.abs("e"))).alias("mae"), r6(F.avg("e")).alias("bias"))


def _modelled(spark, d):
    """Rated rows with all that the rate model takes."""
    train = backtest.labelled(cut(_features(spark, d)))
    return rate.by_player(backtest.modelled(train, train).select(*backtest.KEEP))


@query()
def rate_model_levels(spark, d):
    return rate.fit(_modelled(spark, d))[0]


@query()
def predictive_summary(spark, d):
    x = _modelled(spark, d)
    levels, fitted = rate.fit(x)
    return rate.summarize(rate.predict(x, levels, fitted))


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""")
def stream_daily_counts(spark, d):
    from touchline.streaming.daily import daily_counts

    return daily_counts(spark, f"{d}/events.parquet")


@query("""SELECT competition, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT match_id) AS BIGINT) AS n_matches FROM combined_player_match GROUP BY competition""")
def ingest_report(spark, d):
    t = read(spark, d, "combined_player_match")
    return t.groupBy("competition").agg(F.count("*").alias("n_rows"), F.count_distinct("match_id").alias("n_matches"))


@query()
def box_scores(spark, d):
    from touchline.sources import readers

    return readers.box_scores(read(spark, d, "summary"))


@query()
def tuned_coefficients(spark, d):
    """Coefficients of the rate model by least absolute error over starters of an hour or more, beside the fitted ones."""
    x = _modelled(spark, d)
    levels, fitted = rate.fit(x)
    beta, before, after = rate.tune(x.filter("minutes >= 60"), levels, fitted, sweeps=1, rounds=2)
    mode = levels.filter("param = 'beta'").select(F.col("level").alias("feature"), F.round("mode", 4).alias("fitted"))
    tuned = spark.createDataFrame([(k, float(v), float(before), float(after)) for k, v in beta.items()], "feature string, tuned double, mae_fitted double, mae_tuned double")
    return mode.join(tuned, "feature")


@query("""SELECT team FROM espn_team_match WHERE team IS NOT NULL UNION SELECT opponent FROM espn_team_match WHERE opponent IS NOT NULL""")
def all_teams(spark, d):
    """Distinct teams of both columns."""
    t = read(spark, d, "espn_team_match")
    return t.select("team").union(t.select("opponent")).distinct().dropna()


@query()
def match_player_passes(spark, d):
    """Pass counts of players from match-detail records."""
    from touchline.sources import readers

    return readers.match_passes(read(spark, d, "matchdetails"))


@query()
def match_training_rows(spark, d):
    """Corpus rows from match-detail records of international football."""
    from touchline.sources import readers

    return readers.training_rows(read(spark, d, "matchdetails"))
