"""Walk-forward evaluation and prediction of rows to come: features, fit, samples, scores."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.functions import scalar as S
from touchline.models import decisions, minutes, rate, styles
from touchline.operators import features, ratings, splits
from touchline.session import cut

#: Fewer plays than this make a return noise.
FEW_PLAYS = 50
#: Columns of the corpus that a fold reads: its copies on disk hold no others.
NEEDED = ("row_id", "match_id", "match_date", "competition", "provider", "team", "opponent", "player_id", "position", "minutes", "passes_attempted", "started", "is_friendly", "is_qualifier", "is_test")
KEEP = ("row_id", *rate.GROUPS, "player_id", "opp_style", "prior", "minutes", "passes_attempted", *rate.FEATURES)


def modelled(feats: DataFrame, train: DataFrame) -> DataFrame:
    """What the rate model takes, the prior centres from the training rows."""
    return feats.join(features.prior_center(train).select("player_id", "prior"), "player_id", "left")


def labelled(feats: DataFrame) -> DataFrame:
    return feats.filter("minutes > 0 and passes_attempted is not null")


def fit(feats: DataFrame, sweeps: int = 12) -> tuple[DataFrame, dict]:
    train = labelled(feats)
    return rate.fit(rate.by_player(modelled(train, train).select(*KEEP)), sweeps)


def baseline(train: DataFrame, test: DataFrame, enough: int = 3) -> DataFrame:
    """(row_id, pool, base_crps): score of the naive forecast, the whole pool of earlier counts: the player's if there are enough,
    else the role's, else all. Pools are counts of different values; the score over them is exact, so nothing is drawn."""
    t = train.filter("minutes > 0 and passes_attempted is not null").withColumn("role", S.role_bucket(F.col("position")))

    def pool(keys: list[str]) -> DataFrame:
        each = t.groupBy(*keys, "passes_attempted").agg(F.count("*").cast("double").alias("c"))
        return each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("passes_attempted").alias("v"), "c"))).alias("h"), F.sum("c").alias("n"))

    x = test.select("row_id", "player_id", S.role_bucket(F.col("position")).alias("role"), F.col("passes_attempted").alias("y"))
    own = pool(["player_id"]).filter(F.col("n") >= enough).select("player_id", F.col("h").alias("h1"), F.col("n").alias("n1"))
    role, every = pool(["role"]).select("role", F.col("h").alias("h2"), F.col("n").alias("n2")), pool([]).select(F.col("h").alias("h3"), F.col("n").alias("n3"))
    x = x.join(own, "player_id", "left").join(F.broadcast(role), "role", "left").join(F.broadcast(every), how="left")  # a few roles; one row
    x = x.select("row_id", "y", F.coalesce("h1", "h2", "h3").alias("h"), F.coalesce("n1", "n2", "n3").alias("n"), F.when(F.col("n1").isNotNull(), "player").when(F.col("n2").isNotNull(), "role").otherwise("all").alias("pool"))
    near = F.aggregate("h", F.lit(0.0), lambda a, v: a + v["c"] * F.abs(v["v"] - F.col("y")))
    # sum over steps between neighbouring values of (below) x (above), twice: the mean distance within the pool
    step = F.aggregate(
        "h", F.struct(F.lit(0.0).alias("below"), F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("total")),
        lambda a, v: F.struct((a["below"] + v["c"]).alias("below"), v["v"].alias("last"), (a["total"] + F.coalesce(v["v"] - a["last"], F.lit(0.0)) * a["below"] * (F.col("n") - a["below"])).alias("total")),
        lambda a: a["total"],
    )
    return x.select("row_id", "pool", (F.try_divide(near, F.col("n")) - F.try_divide(step, F.col("n") * F.col("n"))).alias("base_crps"))


def run_fold(player_match: DataFrame, fold: splits.Fold, results: DataFrame | None = None, possession: DataFrame | None = None, lines: DataFrame | None = None, actual_minutes: bool = False, draws: int = 200, sweeps: int = 12) -> DataFrame:
    """One row of scores of a fold: fold, n_test, crps, mae, coverage, base_crps, skill, and with ``lines`` the betting columns.

    Styles, prior centres, minutes and rate model are fitted on the training rows; features of test rows are as-of over both.
    Scored are the starters whose count is known. ``lines``: match_id, player_id, line.
    """
    splits.assert_disjoint(fold.train, fold.test)
    style = styles.clusters(styles.profiles(ratings.team_match(fold.train)))
    both = fold.train.withColumn("is_test", F.lit(False)).unionByName(fold.test.withColumn("is_test", F.lit(True)))
    both = both.select(*[c for c in both.columns if c in NEEDED])
    feats = cut(features.build(both, style, results, possession))
    train = labelled(feats.filter("not is_test"))
    levels, fitted = rate.fit(rate.by_player(modelled(train, train).select(*KEEP)), sweeps)
    test = modelled(feats.filter("is_test and coalesce(started, false) and passes_attempted is not null"), train)
    test = cut(minutes.attach_start_prob(test, both))
    drawn = cut(rate.predict(test.select(*KEEP, "p_start"), levels, fitted, draws, minutes=None if actual_minutes else minutes.fit(fold.train)))
    scored = drawn.join(test.select("row_id", "match_id", "player_id", F.col("passes_attempted").alias("y")), "row_id")
    low, high = (F.expr(f"sort_array(samples)[cast(round({q} * (size(samples) - 1)) as int)]") for q in (0.1, 0.9))
    mean = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) / F.size("samples")
    scored = scored.join(baseline(fold.train, test), "row_id").select("*", S.crps(F.col("samples"), F.col("y")).alias("crps"), F.abs(mean - F.col("y")).alias("error"), F.col("y").between(low, high).cast("double").alias("inside"))
    out = scored.agg(F.count("*").alias("n_test"), F.avg("crps").alias("crps"), F.avg("error").alias("mae"), F.avg("inside").alias("coverage"), F.avg("base_crps").alias("base_crps"))
    out = out.select(F.lit(fold.name).alias("fold"), "*", (100 * (1 - F.try_divide(F.col("crps"), F.col("base_crps")))).alias("skill"))
    if lines is None:
        return out
    priced = scored.join(lines.select("match_id", "player_id", "line"), ["match_id", "player_id"])
    over = (F.col("y") >= F.ceil("line")).cast("double")
    priced = priced.select("row_id", "line", F.col("y").alias("actual"), S.prob_over(F.col("samples"), F.col("line")).alias("p_over"), over.alias("over"))
    loss = priced.agg(S.log_loss(F.col("p_over"), F.col("over")).alias("log_loss"))
    bets = decisions.grade(decisions.edge_table(priced)).select(F.col("plays").alias("bet_n_plays"), F.col("hit_rate").alias("bet_hit_rate"), F.col("roi").alias("bet_roi_singleleg"))
    warn = F.when(F.col("bet_n_plays") < FEW_PLAYS, F.lit(f"<{FEW_PLAYS} plays — ROI noisy")).alias("warn")
    return out.join(loss).join(bets).select("*", warn)  # one row each


def run(player_match: DataFrame, **options) -> DataFrame:
    """Scores of all walk-forward folds, one after the other; each fold's row is kept before the next begins."""
    rows, schema = [], None
    for fold in splits.walk_forward(player_match):
        got = run_fold(player_match, fold, **options)
        schema = got.schema
        rows += got.collect()  # one row a fold
    spark = player_match.sparkSession
    if schema is None:
        return spark.createDataFrame([], "fold string, n_test long, crps double, mae double, coverage double, base_crps double, skill double")
    return spark.createDataFrame(rows, schema)


def retrain(player_match: DataFrame, path: str, results: DataFrame | None = None, possession: DataFrame | None = None, sweeps: int = 12) -> None:
    """Features over all matches, one fit, written to ``path`` with the styles it was fitted under."""
    style = cut(styles.clusters(styles.profiles(ratings.team_match(player_match))))
    levels, fitted = fit(cut(features.build(player_match, style, results, possession)), sweeps)
    rate.save(levels, fitted, path)
    style.write.mode("overwrite").parquet(f"{path}/styles")


def predict(player_match: DataFrame, coming: DataFrame, path: str, results: DataFrame | None = None, possession: DataFrame | None = None, draws: int = 1000, calibration: DataFrame | None = None) -> DataFrame:
    """Predictions of ``coming`` (rows of the corpus's columns, optional line and p_start), keyed by row_id: pred, ci_low, ci_high, moe, p50,
    std, interval_80, and with lines p_over, pick, p_pick, breakeven and edge, best first. Rows that won't start are left out."""
    spark = player_match.sparkSession
    extra = [c for c in ("line", "p_start") if c in coming.columns]
    both = player_match.unionByName(coming.drop(*extra), allowMissingColumns=True)
    feats = features.build(cut(minutes.recent_start_prob(cut(both), out="p_recent")), spark.read.parquet(f"{path}/styles"), results, possession)
    feats = cut(feats)
    levels, fitted = rate.load(spark, path)
    rows = modelled(feats.join(coming.select("row_id", *extra), "row_id"), labelled(feats)).filter("coalesce(started, true)")
    rows = rows.withColumn("p_start", F.coalesce("p_start", "p_recent") if "p_start" in extra else F.col("p_recent"))
    drawn = cut(rate.predict(rows.select(*KEEP, "p_start"), levels, fitted, draws, minutes=minutes.fit(player_match)))
    out = rate.summarize(drawn).join(rows.select("row_id", "match_id", "player_id", "player", "team", "opponent", *[c for c in extra if c == "line"]), "row_id")
    out = out.withColumn("interval_80", S.interval_text(F.col("pred"), F.col("moe"), F.col("ci_low"), F.col("ci_high")))
    if "line" not in extra:
        return out
    priced = out.join(drawn, "row_id").withColumn("p_over", S.prob_over(F.col("samples"), F.col("line"))).drop("samples")
    return decisions.ranked(decisions.edge_table(decisions.calibrate(priced, calibration)), "row_id")


def dump(df: DataFrame) -> str:
    """Rows as JSON lines, for the command line."""
    return "\n".join(json.dumps(r.asDict(), default=str) for r in df.collect())


def load_corpus(spark: SparkSession, folder: str, events_too: bool = True) -> DataFrame:
    """The combined table where there is one, else the event-based one."""
    from touchline.sources.readers import exists

    for name in ("combined_player_match", "sb_player_match"):
        for at in (f"{folder}/{name}.parquet", f"{folder}/{name}"):
            if exists(spark, at):
                return spark.read.parquet(at)
    raise FileNotFoundError(f"no player table in {folder}")
