import datetime as dt

import numpy as np
import pytest

from touchline.models import minutes, rate
from touchline.operators import features, splits
from touchline.plans import backtest


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for c, start in enumerate((dt.datetime(2021, 6, 1), dt.datetime(2022, 6, 1), dt.datetime(2023, 6, 1))):
        for day in range(6):
            for pair in range(3):
                for team, opponent in ((2 * pair, 2 * pair + 1), (2 * pair + 1, 2 * pair)):
                    for p in range(11):
                        i += 1
                        m = 90.0 if p < 8 else float(rng.integers(10, 80))
                        rate_ = 0.5 * np.exp(0.3 * (p % 4) - 0.4 + rng.normal(0, 0.1))
                        rows.append((i, c * 1000 + day * 10 + pair, start + dt.timedelta(days=day, hours=pair), f"Cup {c}", "statsbomb", f"T{team}", f"T{opponent}", team * 100 + p, f"P {p}", ("Center Back", "Left Back", "Center Midfield", "Center Forward")[p % 4], m, bool(p < 8), float(rng.poisson(m * rate_))))
    schema = "row_id long, match_id long, match_date timestamp_ntz, competition string, provider string, team string, opponent string, player_id long, player string, position string, minutes double, started boolean, passes_attempted double"
    return spark.createDataFrame(rows, schema)


def test_a_fold_is_scored_against_the_naive_forecast(spark, corpus):
    lines = corpus.filter("competition = 'Cup 2' and player_id % 100 < 3").selectExpr("match_id", "player_id", "40.5D as line")
    fold = splits.final_holdout(corpus)
    assert fold.name == "Cup 2"
    r = backtest.run_fold(corpus, fold, lines=lines, draws=100, sweeps=6).first()
    assert r["n_test"] == 6 * 6 * 8 and 0 < r["crps"] < 2 * r["base_crps"] and 0.6 < r["coverage"] <= 1 and r["mae"] > 0
    assert abs(r["skill"] - 100 * (1 - r["crps"] / r["base_crps"])) < 1e-9
    assert r["bet_n_plays"] == 6 * 6 * 3 and r["warn"] is None and 0 <= r["bet_hit_rate"] <= 1 and r["log_loss"] > 0


def test_the_future_changes_nothing(spark, corpus):
    from pyspark.sql import functions as F

    style = spark.createDataFrame([(f"T{i}", i % 2) for i in range(6)], "team string, style int")
    cols = ["row_id", "recent_per90", "style_per90", "team_poss_asof", "opp_allowed_asof"]
    early = "competition < 'Cup 2'"
    poisoned = corpus.withColumn("passes_attempted", F.when(F.col("competition") == "Cup 2", 9999.0).otherwise(F.col("passes_attempted")))
    a, b = (sorted(map(tuple, features.build(x, style).filter(early).select(*cols).collect())) for x in (corpus, poisoned))
    assert a == b and any(r[1] is not None for r in a)
    first = [r for r in features.build(corpus.drop("provider"), style).filter("match_id = 0").collect()]
    assert all(r["recent_per90"] is None and r["team_poss_asof"] is None and r["anchor_per90"] >= 1 and r["is_friendly"] == 0 and r["team_elo"] == 1500 for r in first)
    assert features.build(corpus.limit(0), style).count() == 0


def test_retrain_then_predict(spark, corpus, tmp_path):
    path = str(tmp_path / "model")
    backtest.retrain(corpus, path, sweeps=6)
    levels, fitted = rate.load(spark, path)
    assert levels.count() > 60 and fitted["alpha"] > 0 and isinstance(fitted["theta"], np.ndarray)
    xi = corpus.filter("match_id = 2050").select("team", "player_id", "player", "position")
    coming = features.upcoming(spark.createDataFrame([("T0", "T1")], "home string, away string"), xi, "2024-01-01 18:00:00").withColumn("line", coming_line())
    got = backtest.predict(corpus, coming, path, draws=100).collect()
    assert len(got) == 22 and {r["match_id"] for r in got} == {9_100_000} and [r["edge"] for r in got] == sorted((r["edge"] for r in got), reverse=True)
    assert all(r["ci_low"] <= r["p50"] <= r["ci_high"] and "±" in r["interval_80"] and 0 <= r["p_over"] <= 1 for r in got)
    again = {r["row_id"]: r["pred"] for r in backtest.predict(corpus.repartition(3), coming.repartition(2), path, draws=100).collect()}
    assert again == {r["row_id"]: r["pred"] for r in got}


def coming_line():
    from pyspark.sql import functions as F

    return F.lit(40.5)


def test_minutes_come_from_the_right_pool(spark, corpus):
    m = minutes.fit(corpus)
    own = {r["player_id"]: r for r in m.own.collect()}
    rng = np.random.default_rng(0)
    assert set(minutes.sample(m, rng, 50, 0.0, own[1]["own_values"], own[1]["own_counts"])) == {90.0}
    assert set(minutes.sample(m, rng, 200, 1.0)) == {90.0} and max(minutes.sample(m, rng, 200, 0.0)) < 90
    none = minutes.fit(corpus.limit(0))
    assert set(minutes.sample(none, rng, 20, 1.0)) == {90.0} and set(minutes.sample(none, rng, 20, 0.0)) == {20.0}


def test_tuning_never_makes_the_error_greater(spark, corpus):
    style = spark.createDataFrame([("T0", 0)], "team string, style int")
    train = backtest.labelled(features.build(corpus, style))
    rows = rate.by_player(backtest.modelled(train, train).select(*backtest.KEEP))
    levels, fitted = rate.fit(rows, 4)
    beta, before, after = rate.tune(rows, levels, fitted, sweeps=1, rounds=1, grid=5)
    assert set(beta) == set(rate.FEATURES) and after <= before
