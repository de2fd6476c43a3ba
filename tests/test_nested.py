import json

from touchline.operators import nested as N


def raw(spark, payloads):
    return spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "raw_id long, payload string, label string")


GROUP = {"title": "Top", "stats": {"A": {"stat": {"value": 1}}, "B": None, "C": {"stat": {"value": 1, "total": 2}}}}
PLAIN = {"title": "All", "stats": {"A": {"stat": {"value": 1}}}}
DOC = {"content": {"playerStats": {
    "7": {"id": 7, "stats": [{"title": "x", "stats": []}, GROUP], "shotmap": [{"id": 1, "min": 3}]}, "8": {"stats": GROUP}, "9": {"stats": None}, "10": {},
    "11": {"stats": [PLAIN]}, "12": {"stats": [{"stats": {"N": None}}]}, "13": {"stats": [{"stats": {}}, {}]}, "14": "odd", "15": {"stats": {"title": "t"}},
    "16": {"stats": [{"stats": {"V": {"stat": {"type": "x"}}, "W": {"key": "w"}, "X": 5}}]}}}}


def test_states_pass_from_children_to_parents(spark):
    t = raw(spark, [json.dumps(DOC), None, "{broken", "[]", json.dumps({"content": {"playerStats": None}}), "", json.dumps(DOC)])
    got = sorted(tuple(r) for r in N.kept(t, "statistic").select("raw_id", "player_key", "group_pos", "label", "variant").collect())
    one = [("7", 1, "A", "number"), ("7", 1, "C", "ratio"), ("8", 0, "A", "number"), ("8", 0, "C", "ratio"), ("11", 0, "A", "number")]
    one += [("16", 0, "V", "valueless"), ("16", 0, "W", "bare"), ("16", 0, "X", "odd")]
    assert got == sorted((i, *x) for i in (0, 6) for x in one)
    groups = {(r["player_key"], r["group_pos"]): r["variant"] for r in N.kept(t, "group").filter("raw_id = 0").collect()}
    # the same shape of group differs by the states of its statistics
    assert groups == {("7", 0): "empty", ("7", 1): "mixed", ("8", 0): "mixed", ("11", 0): "measured", ("12", 0): "blank", ("13", 0): "empty", ("13", 1): "missing", ("15", 0): "missing", ("16", 0): "mixed"}
    players = {r["player_key"]: r["variant"] for r in N.kept(t, "player").filter("raw_id = 0").collect()}
    assert players == {"7": "grouped", "8": "lone_group", "9": "missing", "10": "missing", "11": "grouped", "12": "grouped", "13": "empty", "14": "odd", "15": "empty", "16": "grouped"}
    assert {r["raw_id"]: r["variant"] for r in N.records(t).collect()} == {0: "rated", 4: "empty", 6: "rated"}
    assert N.shots(t).count() == 2


def test_rows_come_from_the_typed_tables(spark, monkeypatch):
    """The supertype's keys are the union of the typed tables, and without a rule the rows change."""
    t, none = raw(spark, [json.dumps(DOC)]), raw(spark, [])
    for node, variants in N.SUBTYPES.items():
        if node.startswith("team"):
            continue
        keys = [tuple(r) for v in variants for r in N.subtype(t, node, v).select(*N.KEYS[node]).collect()]
        assert sorted(keys) == sorted(tuple(r) for r in N.kept(t, node).select(*N.KEYS[node]).collect()) and len(keys) == len(set(keys))
    assert N.subtype(t, "statistic", "ratio").columns == ["raw_id", "player_key", "group_pos", "label", "value", "total", "stat_type"]
    rows = lambda: {(r["owner_key"], r["label"]) for r in N.named_statistics(t, none).collect()}
    assert ("7", "B") not in rows() and ("12", "N") not in rows()
    monkeypatch.setitem(N.RULES, "statistic", tuple(r for r in N.RULES["statistic"] if r[0] != "null"))
    assert ("7", "B") in rows() and ("12", "N") in rows()
    monkeypatch.undo()
    monkeypatch.delitem(N.SUBTYPES["statistic"], "ratio")
    assert ("7", "C") not in rows() and ("7", "A") in rows()


def test_labels_of_team_statistics(spark):
    doc = {"boxscore": {"teams": [{"team": {"id": "1"}, "statistics": [{"name": "a", "label": "A", "displayValue": "54%"}, {"name": "b"}, {}, None, {"label": "L"}]}, {"team": {"id": "2"}}, {"team": {"id": "3"}, "statistics": {"name": "z"}}, 4]}}
    t = raw(spark, [json.dumps(doc), json.dumps({"boxscore": {"teams": None}}), json.dumps({})])
    got = sorted((r["team_id"], r["stat_pos"], r["label"], r["value"], r["variant"]) for r in N.kept(t, "team_statistic").collect())
    assert got == [("1", 0, "A", 54.0, "full"), ("1", 1, "b", None, "unlabelled"), ("1", 4, "L", None, "valueless"), ("3", 0, "z", None, "unlabelled")]
    assert {r["team_id"]: r["variant"] for r in N.kept(t, "team").collect()} == {"1": "filled", "2": "missing", "3": "lone_statistic"}


def test_empty(spark):
    assert N.named_statistics(raw(spark, []), raw(spark, [])).count() == 0
