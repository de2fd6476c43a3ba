import datetime as dt
import random

import numpy as np
import pytest

from touchline.operators import anomalies as A
from touchline.operators.anomalies import flag_readings

SCHEMA = "row_id long, fm_player_id long, match_id long, team string, position string, minutes double, passes_attempted double, stage string, feed string, ingested_at timestamp_ntz"


def test_anomalies_of_planted_readings(spark):
    random.seed(4)
    rows, i = [], 0
    for m in range(40):
        for p in range(24):
            i += 1
            minutes = 90.0 if p % 12 < 8 else float(random.randint(15, 80))
            rows.append([i, p, m, "A" if p < 12 else "B", "Center Back", minutes, float(round(minutes * 0.6 * random.uniform(0.8, 1.2))), "group", "f", dt.datetime(2025, 1, 1) + dt.timedelta(days=m)])
    want = set()
    for r in rows:
        if r[1] == 3 and 10 <= r[2] < 17:
            r[5:7] = 61.0, 33.0
        elif r[2] == 20 and r[3] == "B":
            r[6] = 29.0
        elif r[0] in (5, 101):
            r[6] = 290.0
        elif r[0] in (50, 151):
            r[5] = [999.0, -4.0][r[0] == 50]
        elif r[0] == 330:
            r[5] = 1.0
        elif r[0] == 400:
            r[6] = None
            continue
        else:
            continue
        want.add(r[0])
    rows += [[9000, *rows[4][1:]]]
    df = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "match_id long, kickoff timestamp_ntz")
    assert {r["row_id"] for r in flag_readings(df, none).collect()} == want | {9000}
    assert flag_readings(df.limit(0), none).count() == 0


def planted(spark, rates):
    """One feed; ``rates`` (players x matches) of passes a minute over full matches."""
    rows, i = [], 0
    for p, course in enumerate(rates):
        for m, r in enumerate(course):
            i, minutes = i + 1, 90.0 if p % 12 else 75.0
            rows.append((i, p, 1000 * m + p // 12, f"T{p // 12}", "Center Back", minutes, float(round(minutes * r)), "group", "f", dt.datetime(2025, 1, 1) + dt.timedelta(days=m)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "match_id long, kickoff timestamp_ntz")


def course(rng, players, matches, phi, sd):
    out = np.zeros((players, matches))
    for m in range(1, matches):
        out[:, m] = phi * out[:, m - 1] + rng.normal(0, sd, players)
    return 0.5 * np.exp(out)


def test_only_the_autoregression_tells_a_spike_from_a_drift(spark, monkeypatch):
    rng = np.random.default_rng(8)
    # form comes and goes: up to five times the usual rate, never suddenly
    wave = np.sin(2 * np.pi * (np.arange(40)[None] / 13 + rng.uniform(0, 1, (60, 1))))
    rates = course(rng, 60, 40, 0.0, 0.1) * np.exp(1.6 * wave)
    m = 10 + int(np.argmax(wave[7, 10:30]))
    rates[7, m] *= 6.0
    df, none = planted(spark, rates)
    spike = 7 * 40 + m + 1
    got = {r["row_id"] for r in flag_readings(df, none).filter("spike").collect()}
    assert spike in got and len(got) <= 2
    clip = A.np.clip
    monkeypatch.setattr(A.np, "clip", lambda x, a, b: 0.0 if (a, b) == (-0.5, 0.95) else clip(x, a, b))
    without = {r["row_id"] for r in flag_readings(df, none).filter("spike").collect()}
    # without it the scale takes the drift for noise, in which the spike is lost
    assert without != got and spike not in without


def test_only_the_shift_test_tells_a_new_level_from_a_spike(spark):
    rng = np.random.default_rng(9)
    rates = course(rng, 60, 30, 0.1, 0.15)
    rates[5, 26:] *= 5.0  # a new role for the last matches
    rates[9, 12] *= 5.0
    df, none = planted(spark, rates)
    at = {5 * 30 + m + 1 for m in range(26, 30)}
    spike = 9 * 30 + 13
    assert {r["row_id"] for r in flag_readings(df, none).filter("spike").collect()} == {spike}
    without = {r["row_id"] for r in flag_readings(df, none, A.Limits(shift=1)).filter("spike").collect()}
    assert spike in without and at & without


def test_the_fit_is_iterative_and_knows_each_feeds_scale(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rates = np.concatenate([course(rng, 24, 40, 0.8, 0.1), course(rng, 24, 40, 0.0, 0.4)])
    hit = [(p, m) for p in range(24) for m in range(3, 38, 7)]
    for p, m in hit:
        rates[p, m] *= 8.0
    df, none = planted(spark, rates)
    df = df.withColumn("feed", (df.fm_player_id >= 24).cast("string"))
    fits = []
    real = A.fit_sources
    monkeypatch.setattr(A, "fit_sources", lambda *a: fits.append(real(*a)) or fits[-1])
    got = {r["row_id"] for r in flag_readings(df, none).filter("spike").collect()}
    assert {p * 40 + m + 1 for p, m in hit} <= got
    (fit,) = fits
    assert fit.outliers >= len(hit) and fit.phi["false"] > 0.4 and abs(fit.phi["true"]) < 0.2 and fit.scale["true"] > 2 * fit.scale["false"]


@pytest.mark.parametrize("parts", [1, 5])
def test_flags_do_not_depend_on_partitions(spark, parts):
    rng = np.random.default_rng(11)
    rates = course(rng, 12, 60, 0.3, 0.2)
    rates[0, 30] *= 7
    df, none = planted(spark, rates)
    df = df.unionByName(df.withColumn("fm_player_id", df.fm_player_id * 0).withColumn("row_id", df.row_id + 10_000).withColumn("match_id", df.match_id + 7))  # a player with half of all rows
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(r["row_id"] for r in flag_readings(df, none).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert 31 in got and got == SEEN.setdefault("flags", got)


SEEN: dict = {}
