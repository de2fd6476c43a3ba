def test_clusters_are_the_best_of_ten_seeds(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans
    from touchline.models import styles

    z = spark.createDataFrame([(f"t{i}", i % 5 * 1.0, i % 3 * 1.0, i % 7 * 1.0) for i in range(20)], "team string, z_poss double, z_vol double, z_allow double")
    fit, seeds = KMeans.fit, set()
    monkeypatch.setattr(KMeans, "fit", lambda self, data: (seeds.add(self.getSeed()), fit(self, data))[1])
    got = styles.clusters(z).collect()
    assert len(got) == 20 and len(seeds) == 10 and {r["style"] for r in got} == {0, 1, 2, 3}
    assert {r["style"] for r in styles.clusters(z.limit(3)).collect()} == {0}
