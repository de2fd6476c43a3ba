import numpy as np
from pyspark.sql import functions as F

from touchline.functions import scalar as S
from touchline.models import styles


def test_a_score_sorts_its_samples_once(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [None, *rng.poisson(20, 50).astype(float).tolist()], float(rng.poisson(20))) for i in range(20)] + [(20, [], 1.0), (21, [None], 1.0), (22, [3.0], None)]
    df = spark.createDataFrame(rows, "i int, samples array<double>, y double").withColumn("crps", S.crps(F.col("samples"), F.col("y")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # within a lambda it would be sorted again for every sample
    assert plan.count("sort_array(") == 1 and "array_sort(" not in plan
    got = {r["i"]: r["crps"] for r in df.collect()}
    for i, samples, y in rows[:20]:
        x = np.array(samples[1:])
        assert abs(got[i] - (np.abs(x - y).mean() - np.abs(x[:, None] - x).mean() / 2)) < 1e-9
    assert got[20] is None and got[21] is None and got[22] is None


def test_fits_of_styles_run_side_by_side(spark, monkeypatch):
    import threading

    fit, threads = styles.KMeans.fit, set()
    monkeypatch.setattr(styles.KMeans, "fit", lambda self, data: (threads.add(threading.get_ident()), fit(self, data))[1])
    z = spark.createDataFrame([(f"t{i}", i % 5 * 1.0, i % 3 * 1.0, i % 7 * 1.0) for i in range(20)], "team string, z_poss double, z_vol double, z_allow double")
    assert styles.clusters(z).count() == 20 and len(threads) > 1
