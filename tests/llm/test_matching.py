import datetime as dt
import random

from touchline.llm import matching as M


def test_folding():
    assert M.name_words("SITULINDZE, Hodei") == M.name_words("ситулиндзе ходеи")
    assert M.name_similarity(M.name_words("Plúpíar Diluriběle"), M.name_words("Plúp Diluriběle")) > 0.85
    assert M.name_similarity(M.name_words("J. Repimimba"), M.name_words("Jeteor de Repimimba")) > 0.8
    assert M.name_similarity(M.name_words("Ana Perez"), M.name_words("Bea Gomez")) < 0.3
    assert M.team_key("Republic of Cote X") == M.team_key("Côte X NT") and M.team_key("St. Y") == M.team_key("Saint Y")


def test_close_pairs_are_exact(spark):
    random.seed(2)
    base = [random.getrandbits(63) for _ in range(60)]
    left = [(i, "k", v) for i, v in enumerate(base)]
    right = []
    for i, v in enumerate(base):
        for _ in range(random.randint(0, 9)):
            v ^= 1 << random.randint(0, 62)
        right.append((i, "k", v))
    schema = "id long, block string, v long"
    got = {(r["a"], r["b"]) for r in M.close_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "block").collect()}
    assert got == {(a, b) for a, _, x in left for b, _, y in right if (x ^ y).bit_count() <= M.RADIUS}


def test_people(spark):
    names = ["Hodei Situlindze", "Kripis Cawalaides", "Stahuk Vlulolaenne", "Maduan Babavili", "Gagiar Pofom Gripumiyan", "Bikua Friwuriska"]
    other = ["Situlindze Hodei", "KRIPIS CAWALAIDES", "S. Vlulolaenne", "Babavili", "Gagiar Gripumiyan", "Someone Else"]
    rows = []
    for m in range(6):
        at = dt.datetime(2025, 1, 1 + m, 18)
        for i in range(6):
            rows.append(("statsbomb", 10 + i, names[i], "Aland", at, 20.0 + 10 * i))
            rows.append(("fotmob", 900 + i, other[i], "Republic of Aland", at if i < 5 else at + dt.timedelta(hours=1), 20.0 + 10 * i))
    rows += [("fotmob", 999, None, "Aland", dt.datetime(2025, 1, 1), 5.0), ("statsbomb", None, "X", "Aland", None, float("nan"))]
    t = spark.createDataFrame(rows, "provider string, player_id long, player string, team string, match_date timestamp_ntz, minutes double")
    got = {(r["player_id_a"], r["player_id_b"]) for r in M.match_people(t).filter("matched").collect()}
    assert got == {(10 + i, 900 + i) for i in range(5)}
    assert M.match_people(t.limit(0)).count() == 0


def test_names_of_very_short_words(spark):
    rows = [("statsbomb", 1, "Li Oh", "Aland"), ("fotmob", 901, "Li Oh", "Aland"), ("statsbomb", 2, "Wu", "Aland"), ("fotmob", 902, "Wu", "Aland"), ("statsbomb", 3, "Lee Yu", "Aland"), ("fotmob", 903, "Yu Lee", "Aland"), ("fotmob", 904, "Bo Ek", "Aland"), ("statsbomb", 5, "李", "Aland"), ("fotmob", 905, "李", "Aland")]
    rows = [(*r, dt.datetime(2025, 1, 1 + m, 18), 90.0) for r in rows for m in range(3)]
    t = spark.createDataFrame(rows, "p string, player_id long, player string, team string, match_date timestamp_ntz, minutes double").withColumnRenamed("p", "provider")
    got = {(r["player_id_a"], r["player_id_b"]) for r in M.match_people(t).filter("matched").collect()}
    assert got == {(1, 901), (2, 902), (3, 903), (5, 905)}
    renamed = t.replace({"statsbomb": "x", "fotmob": "y"}, subset=["provider"])
    assert {(r["player_id_a"], r["player_id_b"]) for r in M.match_people(renamed, "x", "y").filter("matched").collect()} == got


def test_each_close_pair_once(spark):
    random.seed(6)
    schema = "id long, block string, v long"
    x = spark.createDataFrame([(i, "k", random.getrandbits(8)) for i in range(40)], schema)
    got = [(r["a"], r["b"]) for r in M.close_in_blocks(x, x, "block").collect()]
    v = {r["id"]: r["v"] for r in x.collect()}
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in v for b in v if (v[a] ^ v[b]).bit_count() <= M.RADIUS}
