import pytest

from touchline.models import decisions as D


def test_confidence(spark):
    rows = [(1, 0.8, 40.5, 50.0, False), (2, 0.8, 40.5, 30.0, False), (3, 0.2, 40.5, None, True), (4, None, 40.5, 50.0, False), (5, 0.5, 40.5, 50.0, False)]
    got = {r["row_id"]: r for r in D.score(spark.createDataFrame(rows, "row_id int, p_over double, line double, hist double, is_new boolean")).collect()}
    assert got[1]["pick"] == "OVER" and abs(got[1]["confidence"] - 0.3) < 1e-9 and got[2]["confidence"] == 0 and not got[2]["agree"]
    assert got[3]["pick"] == "UNDER" and abs(got[3]["confidence"] - 0.075) < 1e-9 and got[4]["pick"] is None and got[5]["confidence"] == 0


def test_parlays_and_their_value(spark):
    picks = [("s", i, i % 7, f"t{i % 3}", "OVER" if i % 2 else "UNDER", (20 - i) / 100, 0.6) for i in range(12)] + [("s", 99, 99, "x", "OVER", 0.0, 0.5)]
    df = spark.createDataFrame(picks, "slate string, row_id long, player_id long, team string, pick string, confidence double, p_hit double")
    legs = D.greedy_parlays(df, 5, 3).collect()
    by = {p[1]: p for p in picks}
    players = [by[r["row_id"]][2] for r in legs]
    assert len(players) == len(set(players)) and 99 not in players and len(legs) % 3 == 0 and legs
    for n in {r["parlay"] for r in legs}:
        ways = {}
        for r in legs:
            if r["parlay"] == n:
                assert ways.setdefault(by[r["row_id"]][3], by[r["row_id"]][4]) == by[r["row_id"]][4]
    assert not {by[r["row_id"]][2] for r in D.greedy_parlays(df, 5, 3, used=(0, 1)).collect()} & {0, 1}
    ev = D.parlay_ev(D.greedy_parlays(df, 1, 3), df).first()
    assert ev["legs"] == 3 and abs(ev["p_all"] - 0.6**3) < 1e-9 and abs(ev["ev"] - (0.6**3 * 6 - 1)) < 1e-9
    assert D.greedy_parlays(df.limit(0), 2, 3).count() == 0


def test_calibration_is_applied_between_boundaries(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (2.0,), (None,)], "p_over double")
    fitted = spark.createDataFrame([(0.2, 0.3), (0.6, 0.5)], "boundary double, prediction double")
    got = [r[0] for r in D.calibrate(df, fitted).collect()]
    assert got[:4] == pytest.approx([0.3, 0.325, 0.45, 0.5]) and got[4] is None
    assert [r[0] for r in D.calibrate(df, None).collect()][:2] == [0.0, 0.25]


def test_edges_are_ranked(spark):
    e = D.edge_table(spark.createDataFrame([(1, 0.7), (2, 0.1), (3, None)], "row_id int, p_over double"))
    assert [r["row_id"] for r in D.ranked(e, "row_id").collect()] == [2, 1, 3] and D.ranked(e, top=1).count() == 1
