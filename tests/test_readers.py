import json

from touchline.sources import readers as R


def test_scoreboards(spark):
    def game(i, done, a, b):
        return {"id": i, "competitions": [{"date": "2024-06-30T19:00Z", "status": {"type": {"completed": done}}, "competitors": [
            {"homeAway": "home", "team": {"displayName": "A"}, "score": a}, {"homeAway": "away", "team": {"displayName": "B"}, "score": b}]}]}

    payloads = [json.dumps({"events": [game("1", True, "2", "1"), game("2", False, "0", "0"), game("3", True, "x", "1")]}), "{broken", None]
    raw = spark.createDataFrame([(p,) for p in payloads], "payload string")
    assert {r[0] for r in R.completed_ids(raw).collect()} == {"1", "3"}
    assert [tuple(r)[2:] for r in R.results(raw, "cup").collect()] == [("A", "B", 2, 1)]


def test_box_scores_need_two_teams(spark):
    def team(i, poss, passes):
        return {"team": {"id": i, "displayName": "T" + i}, "statistics": [{"name": "possessionPct", "displayValue": poss}, {"name": "totalPasses", "displayValue": passes}]}

    head = {"league": {"slug": "cup"}, "competitions": [{"date": "2024-06-30T19:00Z", "competitors": [{"team": {"displayName": "T1"}, "score": "2"}, {"team": {"displayName": "T2"}, "score": "x"}]}]}
    docs = [{"header": head, "boxscore": {"teams": [team("1", "54%", "500"), team("2", "46", "400")]}}, {"boxscore": {"teams": [team("1", "54", "500")]}}, {}, {"boxscore": {"teams": [team("1", "?", "500"), team("2", "46", "400")]}}]
    raw = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "raw_id long, payload string")
    got = sorted(tuple(r) for r in R.box_scores(raw).select("raw_id", "team", "opponent", "possession", "opp_passes_allowed", "goals_for", "margin", "date").collect())
    assert got == [(0, "T1", "T2", 54.0, 400.0, 2.0, None, "2024-06-30T19:00Z"), (0, "T2", "T1", 46.0, 500.0, None, None, "2024-06-30T19:00Z"), (3, "T2", "T1", 46.0, 500.0, None, None, None)]


EVENTS = [
    (1, "a", "Pass", 1, 10, "Ana", "X", "Center Back", None), (1, "b", "Pass", 5, 10, "Ana", "X", "Left Back", "Incomplete"), (1, "c", "Shot", 93, 10, "Ana", "X", "Left Back", None),
    (1, "d", "Pass", 9, 20, "Bea", "Y", "Goalkeeper", "Other"), (2, "e", "Pass", 9, 20, "Bea", "Y", None, None),
]
LINEUPS = [(1, "X", 10, [("00:00", "60:30", "Starting XI")]), (1, "X", 11, []), (1, "Y", 20, [("45:00", None, "Substitution")]), (2, "Y", 20, [("00:00", None, "Starting XI")])]


def test_player_table_from_events_is_built_once(spark, tmp_path):
    import datetime as dt

    events, lineups = spark.createDataFrame(EVENTS, R.EVENTS), spark.createDataFrame(LINEUPS, R.LINEUPS)
    matches = spark.createDataFrame([(m, dt.datetime(2024, 1, m), f"Cup {m}", "2024", "statsbomb", False) for m in (1, 2)], R.MATCHES)
    got = {(r["match_id"], r["player_id"]): r for r in R.player_labels(events, lineups, matches).collect()}
    assert len(got) == 4
    ana, unused, bea = got[1, 10], got[1, 11], got[1, 20]
    assert (ana["passes_attempted"], ana["passes_completed"], ana["position"], ana["minutes"], ana["started"], ana["opponent"]) == (2, 1, "Left Back", 60.0, True, "Y")
    assert (unused["minutes"], unused["started"], unused["team"], unused["player"], unused["passes_attempted"]) == (0.0, False, None, None, 0)
    assert (bea["minutes"], bea["started"], bea["passes_completed"], bea["opponent"]) == (48.0, False, 1, "X") and got[2, 20]["opponent"] is None
    at = str(tmp_path / "pm")
    assert R.build_player_match(events, lineups, matches.filter("match_id = 1"), at).count() == 3
    assert R.build_player_match(events, lineups, matches, at).count() == 4
    assert R.build_player_match(events, lineups, matches, at).count() == 4
    assert R.build_player_match(events, lineups, matches.filter("match_id = 2"), at, force=True).count() == 1


def test_match_details(spark):
    def player(i, team, attempted, minutes):
        stats = {"Minutes played": {"stat": {"value": minutes}}} | ({"Accurate passes": {"stat": {"value": attempted - 1, "total": attempted}}} if attempted else {})
        return {"id": i, "name": f"P{i}", "teamId": team, "stats": [{"stats": {"Accurate passes": {"stat": {"value": 0, "total": 1}}} if attempted else {}}, {"stats": stats}]}

    def doc(league, rnd):
        return {
            "general": {"leagueName": league, "leagueRoundName": rnd, "matchTimeUTCDate": "2026-06-14T19:00:00.000Z", "homeTeam": {"id": 1, "name": "X"}, "awayTeam": {"id": 2, "name": "Y"}},
            "content": {"lineup": {"homeTeam": {"id": 1, "name": "XX", "starters": [{"id": 7, "horizontalLayout": {"x": 0.1}}, [{"id": 8}]]}, "awayTeam": None}, "playerStats": {"7": player(7, 1, 30, 90), "8": player(8, 1, 0, 5), "9": player(9, 2, 12, 40)}},
        }

    raw = spark.createDataFrame([(0, 100, json.dumps(doc("World Cup Qualification", "3"))), (1, 101, json.dumps(doc("Club Friendlies", ""))), (2, 102, json.dumps(doc("World Cup", "Final"))), (3, 103, None), (4, 104, "{")], "raw_id long, match_id long, payload string")
    got = {(r["raw_id"], r["player_id"]): r for r in R.match_passes(raw).collect()}
    assert set(got) == {(i, p) for i in (0, 1, 2) for p in (7, 9)}
    assert (got[0, 7]["passes_attempted"], got[0, 7]["passes_completed"], got[0, 7]["minutes"], got[0, 7]["team"], got[0, 9]["team"]) == (30.0, 29.0, 90.0, "XX", "Y")
    rows = {(r["match_id"], r["fm_player_id"]): r for r in R.training_rows(raw).collect()}
    assert set(rows) == {(m, p) for m in (100, 102) for p in (7, 9)}
    a, b = rows[100, 7], rows[102, 9]
    assert (a["competition"], a["stage"], a["is_qualifier"], a["position"], a["opponent"], a["started"], str(a["match_date"])) == ("WC Qualifier", "group", 1, "Goalkeeper", "Y", True, "2026-06-14 19:00:00")
    assert (b["competition"], b["stage"], b["team"], b["position"], b["started"]) == ("World Cup 2026", "knockout", None, "Center Midfield", False)


def test_props_fixtures_and_lineups(spark):
    from touchline.operators import resolve

    doc = {
        "players": [{"id": "p1", "first_name": "Ana", "last_name": "Ruiz", "country": "ESP"}, {"id": "p2", "first_name": "Bo", "last_name": "Ek", "country": "SWE"}],
        "appearances": [{"id": "a1", "player_id": "p1", "match_id": 5}, {"id": "a2", "player_id": "p2", "match_id": 6}],
        "over_under_lines": [{"stat_value": "40.5", "over_under": {"appearance_stat": {"stat": R.PASS_PROP, "appearance_id": a}}} for a in ("a1", "a2")] + [{"stat_value": "1", "over_under": {"appearance_stat": {"stat": "goals", "appearance_id": "a1"}}}],
    }
    raw = spark.createDataFrame([(0, json.dumps(doc)), (1, None), (2, "{")], "raw_id long, payload string")
    props = R.props(raw, {"ESP": "Spain"})
    assert sorted((r["player"], r["team"], r["line"], r["match_id"]) for r in props.collect()) == [("Ana Ruiz", "Spain", 40.5, 5), ("Bo Ek", "SWE", 40.5, 6)]
    game = {"events": [{"id": "1", "status": {"type": {"description": "Scheduled"}}, "competitions": [{"date": "d", "competitors": [{"homeAway": "home", "team": {"displayName": "Spain"}}, {"homeAway": "away", "team": {"displayName": "USA"}}]}]}]}
    board = spark.createDataFrame([(json.dumps(game),)], "payload string")
    assert [tuple(r) for r in R.fixtures(board).collect()] == [("1", "d", "Scheduled", "Spain", "USA")]
    assert {tuple(r) for r in R.fixture_map(board).collect()} == {("Spain", "United States"), ("United States", "Spain")}
    assert {(r["team"], r["opponent"]) for r in resolve.opponents(props.select("match_id", "team"), R.fixture_map(board)).collect()} == {("Spain", "United States"), ("SWE", "_OPP_")}
    xi = {"rosters": [{"team": {"displayName": "Spain"}, "roster": [{"starter": True, "athlete": {"displayName": "A"}, "position": {"abbreviation": "G"}}, {"starter": False, "athlete": {"displayName": "B"}}]}, {"team": {"displayName": "USA"}, "roster": []}]}
    assert [tuple(r) for r in R.lineups(spark.createDataFrame([(1, json.dumps(xi))], "raw_id long, payload string")).collect()] == [("Spain", "A", "G")]


def test_names_within_a_team(spark):
    from touchline.operators import resolve

    known = spark.createDataFrame([(5, "Álvaro Díaz López", "X"), (3, "Iván Díaz", "X"), (9, "Rodrigo Cascante", "X"), (4, "Díaz", "Y")], "player_id long, player string, team string")
    names = spark.createDataFrame([(1, "A. Diaz", "X"), (2, "Rodri", "X"), (3, "New Cap", "X"), (4, "Diaz", "Z")], "row_id long, player string, team string")
    got = {r["row_id"]: (r["player_id"], r["is_new"]) for r in resolve.match_within_team(names, known, {("X", "Rodri"): "Rodrigo C"}).collect()}
    assert got[1] == (3, False) and got[2] == (9, False) and got[3][1] and got[3][0] < 0 and got[4][1]
    loose = {r["row_id"]: r["player_id"] for r in resolve.match_loosely(names, known).collect()}
    assert loose == {1: 3, 2: 9}


def test_command_line(spark, tmp_path, capsys):
    import datetime as dt

    from touchline import cli, config

    rows = [(i, m, dt.datetime(2020 + c, 1, 1 + d), f"Cup {c}", "statsbomb", f"T{t}", f"T{1 - t}", t * 10 + p, "P", "Center Back", 90.0, True, float(40 + p + m % 3)) for i, (c, d, t, p) in enumerate((c, d, t, p) for c in range(3) for d in range(4) for t in range(2) for p in range(4)) for m in [c * 10 + d]]
    schema = "row_id long, match_id long, match_date timestamp_ntz, competition string, provider string, team string, opponent string, player_id long, player string, position string, minutes double, started boolean, passes_attempted double"
    data, models = str(tmp_path / "data"), str(tmp_path / "models")
    spark.createDataFrame(rows, schema).write.parquet(f"{data}/combined_player_match.parquet")
    run = lambda *a: (cli.main([*a, "--data", data, "--models", models], spark), capsys.readouterr().out)[1]
    assert "96 player rows, 12 matches, 3 competitions" in run("ingest") and run("list-competitions").count("Cup") == 3
    assert "saved" in run("retrain")
    (tmp_path / "up.csv").write_text("match_id,match_date,competition,team,opponent,player_id,player,position,line\n99,2024-01-01 18:00:00,Cup 3,T0,T1,1,P,Center Back,40.5\n")
    out = run("predict", "--upcoming", str(tmp_path / "up.csv"))
    assert '"p_over"' in out and '"interval_80"' in out and out.count("player_id") == 1
    (tmp_path / "c.json").write_text('{"draws": 5}')
    assert config.load(str(tmp_path / "c.json"), data="x")["draws"] == 5
    assert R.read_lines(spark, str(tmp_path / "none.csv")).count() == 0 and R.months("2024-11", "2025-02") == ["202411", "202412", "202501", "202502"]


def test_upsert_sink_survives_a_replay(spark, tmp_path):
    from touchline.streaming import daily

    at, write = str(tmp_path / "log"), daily.upsert_batches(["k"], str(tmp_path / "log"))
    assert daily.read_upserted(spark, at) is None
    batch = lambda rows: spark.createDataFrame(rows, "k int, v int")
    write(batch([(1, 1), (2, 2)]), 0)
    write(batch([(2, 20), (3, 30)]), 1)
    write(batch([(2, 20), (3, 30)]), 1)
    write(batch([(3, 31)]), 2)
    assert sorted(map(tuple, daily.read_upserted(spark, at).collect())) == [(1, 1), (2, 20), (3, 31)]
