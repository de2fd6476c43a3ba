import pandas as pd

from touchline.llm import mixing as M


def test_rake_meets_shares_and_caps():
    cells = pd.DataFrame([(s, lang, t, n) for s, n in (("a", 100), ("b", 1000)) for lang in "xy" for t in (0, 1)], columns=["source", "lang", "topic", "tokens"])
    r = M.rake(cells, {"a": 0.5, "b": 0.5, "none": 0.1}, {"a": 2, "b": 1, "none": 3}, None)
    got = (r["copies"] * r["tokens"]).groupby(r["source"]).sum()
    assert abs(got["a"] - got["b"]) < 1 and abs(got["a"] - 800) < 1
    assert (r["copies"] <= r["source"].map({"a": 2, "b": 1}) + 1e-9).all()


def test_mix(spark):
    rows = [(i, f"text number {i} of a source", "en" if i % 3 else None, "big", "t") for i in range(600)]
    rows += [(1000 + i, f"small text {i}", "de", "small", None) for i in range(40)] + [(2000 + i, "small text 1", "de", "small", None) for i in range(300)]
    rows += [(3000, None, "en", "big", None), (3001, "", "en", "big", None), (3002, "other", "en", None, None), (3003, "other", "en", "unlisted", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, team string")
    targets = spark.createDataFrame([("big", 0.9, 1), ("small", 0.1, 2), ("absent", 0.0, 2)], "source string, target_weight double, max_repeats int")
    mixed = M.mix(docs, targets)
    uses = {r["doc_id"]: r["copies"] for r in mixed.filter("copies > 0").collect()}
    assert max(uses.values()) <= 2 and not uses.keys() & set(range(2000, 2300)) and not uses.keys() & {3000, 3001, 3002, 3003}
    shares = {r["source"]: r for r in M.shares(mixed, targets).collect()}
    assert abs(shares["big"]["share"] - 0.9) < 0.02 and shares["absent"]["tokens"] == 0
    assert M.mix(docs.limit(0), targets).count() == 0
    for r in M.marginals(mixed).collect():
        assert r["kind"] in ("lang", "topic") and 0 <= r["share"] <= 1
    assert 0.9 < sum(r["corpus_share"] for r in M.marginals(mixed).filter("kind = 'topic'").collect()) < 1.0001
    assert shares["big"]["available_tokens"] > shares["big"]["tokens"] * 0.5 and 0 < shares["big"]["used_share"] <= 1


def test_topics_follow_the_form_of_texts(spark):
    rows = [(i, ("| 12 | 34 |\n" * 30, "A long report of what happened in the match that evening. " * 20, "lol!")[i % 3] + str(i), "en", "big") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_weight double, max_repeats int")
    topic = {r["doc_id"]: r["topic"] for r in M.sized_texts(docs, targets).collect()}
    kinds = [{topic[i] for i in range(120) if i % 3 == k} for k in range(3)]
    assert not kinds[0] & kinds[1] and not kinds[1] & kinds[2] and not kinds[0] & kinds[2]


def test_topics_are_fitted_on_all_texts(spark, monkeypatch):
    # a small sample misses the rare kind
    monkeypatch.setattr(M, "FITTED_ON", 20, raising=False)
    rows = [(i, ("| 12 | 34 |\n" * 30, "A long report of what happened in the match that evening. " * 20, "lol!")[i % 3] + str(i), "en", "big") for i in range(900)]
    rows += [(1000 + i, "0123456789" * 40 + str(i), "en", "big") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_weight double, max_repeats int")
    got = {r["doc_id"]: r["topic"] for r in M.sized_texts(docs, targets).collect()}
    rare, rest = ({t for i, t in got.items() if (i >= 1000) == x} for x in (True, False))
    assert len(got) == 904 and not rare & rest
    assert got == {r["doc_id"]: r["topic"] for r in M.sized_texts(docs.orderBy("text").repartition(7), targets).collect()}


def test_centres_are_the_means_of_their_rows(spark):
    import numpy as np

    from touchline.llm import clusters

    x = np.random.default_rng(0).normal(size=(500, 2)) + np.arange(500)[:, None] % 4 * 20
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, a double, b double")
    got = clusters.centres(clusters.packed(df, df["i"], ["a", "b"]), 2, 4)
    want = np.array([x[k::4].mean(0) for k in range(4)])
    assert np.abs(got - want).max() < 1e-8
    at = {r["i"]: r["k"] for r in df.select("i", clusters.nearest(["a", "b"], got).alias("k")).collect()}
    assert all(at[i] == i % 4 for i in range(500))
    same = df.select("i", (df["i"] * 0).alias("a"), (df["i"] % 2).alias("b"))
    assert {tuple(c) for c in clusters.centres(clusters.packed(same, same["i"], ["a", "b"]), 2, 4)} == {(0, 0), (0, 1)}
    assert clusters.centres(clusters.packed(df.limit(3), df["i"], ["a", "b"]), 2, 4) is None and clusters.centres(clusters.packed(df.limit(0), df["i"], ["a", "b"]), 2, 4) is None
