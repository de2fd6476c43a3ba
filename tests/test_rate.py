import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from touchline.models import rate


def simulated(n=12_000, players=300, seed=3):
    rng = np.random.default_rng(seed)
    p, style = rng.integers(0, players, n), rng.integers(0, 4, n)
    role, position, competition, provider = p % 3, p % 6, rng.integers(0, 5, n), rng.integers(0, 2, n)
    x = rng.normal(size=(n, 9))
    minutes = rng.integers(20, 91, n).astype(float)
    own, prior, pos = rng.normal(0, 0.2, players), rng.normal(0, 0.4, players), np.array([0.3, -0.3, 0.0, -0.3, 0.3, 0.0])
    own = prior + own
    pstyle, comp, prov = rng.normal(0, 0.15, (players, 4)), np.array([-0.3, -0.1, 0.0, 0.1, 0.3]), np.array([-0.15, 0.15])
    beta = np.array([0.2, -0.2, 0.1, 0.0, -0.1, 0.05, 0.0, 0.15, -0.05])
    eta = np.log(minutes) - 1.0 + pos[position] + own[p] + pstyle[p, style] + comp[competition] + prov[provider] + x @ beta
    y = rng.poisson(rng.gamma(7.0, np.exp(eta) / 7.0)).astype(float)
    f = pd.DataFrame({"row_id": np.arange(n), "role": [f"r{i}" for i in role], "position": [f"p{i}" for i in position], "competition": [f"c{i}" for i in competition], "provider": [f"v{i}" for i in provider], "player_id": p, "opp_style": style, "prior": prior[p], "minutes": minutes, "passes_attempted": y})
    return pd.concat([f, pd.DataFrame(x, columns=list(rate.FEATURES))], axis=1), beta, comp, prov, eta


def test_all_effects_are_recovered(spark):
    f, beta, comp, prov, eta = simulated()
    df = rate.by_player(spark.createDataFrame(f))
    levels, fitted = rate.fit(df)
    got = {(r["param"], r["level"]): r["mode"] for r in levels.collect()}
    assert {k for k, _ in got} == {"intercept", "role", "position", "competition", "provider", "beta", "player", "pstyle"}
    sd = f[list(rate.FEATURES)].std().to_numpy()
    assert np.abs(np.array([got["beta", c] for c in rate.FEATURES]) / sd - beta).max() < 0.03
    assert np.abs(np.diff([got["competition", f"c{i}"] for i in range(5)]) - np.diff(comp)).max() < 0.06
    assert abs(got["provider", "v1"] - got["provider", "v0"] - (prov[1] - prov[0])) < 0.04
    assert 5.5 < fitted["alpha"] < 9.5
    s = rate.predict(df.limit(2000), levels, fitted).select("row_id", F.aggregate("samples", F.lit(0.0), lambda a, v: a + v).alias("t")).toPandas()
    assert np.corrcoef(np.log(s["t"] / 200 + 0.01), eta[s["row_id"]])[0, 1] > 0.95


def test_unseen_levels_keep_a_prediction(spark):
    f = simulated(2000, 50)[0]
    levels, fitted = rate.fit(rate.by_player(spark.createDataFrame(f)), sweeps=3)
    new = spark.createDataFrame(f[:2].assign(role="new", competition="new", player_id=10_000))
    assert [len(r["samples"]) for r in rate.predict(new, levels, fitted).collect()] == [200, 200]
