import datetime as dt
import random

import numpy as np
import pytest

from touchline.operators import histograms


@pytest.fixture(scope="module")
def played():
    """Histories far longer than 20 matches, whose early part differs from the late one."""
    random.seed(5)
    rows = []
    for player, n in ((1, 70), (2, 25), (3, 4), (4, 3)):
        for k in range(n):
            passes = float(random.randint(40, 60) if k < n // 2 else random.randint(5, 35))
            rows.append((player * 1000 + k, player, dt.datetime(2020, 1, 1) + dt.timedelta(days=k), k, passes))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, player_id long, match_date timestamp_ntz, match_id long, passes_attempted double").repartition(3)


def wanted(rows):
    for player in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == player]
        for k in range(3, len(own)):
            yield own[k][0], np.array([r[4] for r in own[:k]]), own[k][4]


def test_whole_history_counts(spark, played, monkeypatch):
    from touchline.plans import domain_queries as Q

    rows = played
    monkeypatch.setattr(Q, "player_match", lambda *_: frame(spark, rows))
    got = {r["row_id"]: r["crps"] for r in Q.queries()["crps_empirical"](spark, "").collect()}
    want = {i: np.abs(x - y).mean() - np.abs(x[:, None] - x).mean() / 2 for i, x, y in wanted(rows)}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)
    h = {r["row_id"]: (r["p"], r["mean"]) for r in Q._history(spark, "").collect()}
    assert h.keys() == want.keys() and all(abs(h[i][0] - (x >= 30).mean()) < 1e-9 and abs(h[i][1] - x.mean()) < 1e-9 for i, x, _ in wanted(rows))


def test_running_histogram_in_small_blocks():
    x = np.random.default_rng(1).integers(0, 90, 300).astype(float)
    whole, small = histograms._State(), histograms._State()
    at = np.arange(300)
    a = whole.step(x, at, histograms.QUANTILES)
    parts = [small.step(x[i : i + 7], at[i : i + 7], histograms.QUANTILES) for i in range(0, 300, 7)]
    for one, many in zip(a, zip(*parts, strict=True), strict=True):
        assert np.allclose(one, np.concatenate(many))
    for k in (3, 40, 299):
        t = np.quantile(x[:k], histograms.QUANTILES)
        assert np.allclose(a[2][k], [(x[:k] > v).mean() for v in t]) and np.allclose(a[3][k], x[k] > t)


def test_calibration_takes_nine_pairs_a_row(spark, played, monkeypatch):
    from touchline.models import decisions
    from touchline.plans import domain_queries as Q

    monkeypatch.setattr(Q, "player_match", lambda *_: frame(spark, played))
    got = sorted(map(tuple, Q.queries()["isotonic_fit"](spark, "").collect()))
    pairs = [(float((x > t).mean()), float(y > t)) for _, x, y in wanted(played) for t in np.quantile(x, histograms.QUANTILES)]
    blocks = []  # pool adjacent violators: sum, number, first and last p
    for p in sorted({p for p, _ in pairs}):
        ys = [y for q, y in pairs if q == p]
        blocks.append([sum(ys), len(ys), p, p])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], last]
    want = sorted({(p, s / n) for s, n, a, b in blocks for p in (a, b)})
    assert len(pairs) == 9 * len(list(wanted(played))) and np.allclose(got, want)


def test_ties_and_a_key_over_many_partitions(spark):
    """A key with most rows, several rows an instant: each row sees strictly earlier instants only, whatever the partitions."""
    rng = np.random.default_rng(4)
    rows = [(i, 1 if i % 4 else None, dt.datetime(2020, 1, 1) + dt.timedelta(days=int(rng.integers(0, 150))), 0, float(rng.integers(0, 30))) for i in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["row_id"]: (r["n"], r["crps"]) for r in histograms.running(frame(spark, rows), "player_id", "match_date", "row_id", "passes_attempted").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 600
    for i, k, at, _, y in rows:
        x = np.array([r[4] for r in rows if r[1] == k and r[2] < at])
        assert got[i][0] == len(x)
        if len(x):
            assert abs(got[i][1] - (np.abs(x - y).mean() - np.abs(x[:, None] - x).mean() / 2)) < 1e-9
