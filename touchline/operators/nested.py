"""Deeply nested JSON -> related typed tables, by structural variants.

A bottom-up tree automaton reads every node: leaves get their state from their kind, inner nodes from their kind and the
*states of their children* (:data:`RULES`; children of one role have a name, those of a container count as a set). The states of
the nodes that become rows are their structural variants. :data:`SUBTYPES` registers a typed table for each variant whose
nodes are kept; a supertype table has the shared keys and the parent link of all of them. Nodes in a state without a
registered table, such as a statistic that is null, are in none. Everything runs in the JVM on VARIANT values: a payload is
parsed once a table, objects and arrays are opened by casts, children are read by higher-order functions.

Defined results: NULL, unreadable and non-object payloads give no rows; absent, null, empty and oddly shaped parts give no
children (their parent is still there, with the state ``missing``, ``empty`` or ``odd``); a lone object in place of an array
counts as an array of one (position 0); an object with a repeated key keeps the last value where the parser allows it and is
unreadable otherwise; repeated fetches are separate raw records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Transitions: node class -> ordered (state, conditions). A condition names what it looks at: ``kind`` (of the node itself), a
#: child by its role, or the set of a container's children by ``any`` (one of them is in these states) and ``all`` (there is one and
#: all are). The first rule whose conditions hold gives the state.
RULES: dict[str, tuple[tuple[str, dict[str, tuple[str, ...]]], ...]] = {
    "leaf": (("number", {"kind": ("number",)}), ("absent", {"kind": ("absent", "null")}), ("text", {"kind": ("scalar",)}), ("odd", {})),
    "measure": (
        ("ratio", {"kind": ("object",), "value": ("number",), "total": ("number",)}),
        ("number", {"kind": ("object",), "value": ("number",)}),
        ("valueless", {"kind": ("object",)}),
        ("absent", {"kind": ("absent", "null")}),
        ("odd", {}),
    ),
    "statistic": (
        ("null", {"kind": ("null",)}),
        ("ratio", {"kind": ("object",), "measure": ("ratio",)}),
        ("number", {"kind": ("object",), "measure": ("number",)}),
        ("valueless", {"kind": ("object",), "measure": ("valueless",)}),
        ("bare", {"kind": ("object",)}),
        ("odd", {}),
    ),
    "group": (
        ("measured", {"kind": ("object",), "all": ("ratio", "number")}),
        ("mixed", {"kind": ("object",), "any": ("ratio", "number", "valueless", "bare", "odd")}),
        ("blank", {"kind": ("object",), "any": ("null",)}),
        ("empty", {"kind": ("object",), "container": ("object", "array")}),
        ("missing", {"kind": ("object",), "container": ("absent", "null")}),
        ("odd", {}),
    ),
    "player": (
        ("grouped", {"kind": ("object",), "container": ("array",), "any": ("measured", "mixed", "blank")}),
        ("lone_group", {"kind": ("object",), "container": ("object",), "any": ("measured", "mixed", "blank", "empty")}),
        ("empty", {"kind": ("object",), "container": ("array", "object")}),
        ("missing", {"kind": ("object",), "container": ("absent", "null")}),
        ("odd", {}),
    ),
    "record": (("rated", {"any": ("grouped", "lone_group")}), ("unrated", {"any": ("empty", "missing", "odd")}), ("empty", {})),
    "team_statistic": (
        ("odd", {"kind": ("absent", "null", "array", "scalar")}),
        ("full", {"label": ("text", "number"), "shown": ("text", "number")}),
        ("unlabelled", {"label": ("absent",), "name": ("text", "number")}),
        ("valueless", {"label": ("text", "number")}),
        ("unnamed", {}),
    ),
    "team": (
        ("filled", {"kind": ("object",), "container": ("array",), "any": ("full", "unlabelled", "valueless")}),
        ("lone_statistic", {"kind": ("object",), "container": ("object",), "any": ("full", "unlabelled", "valueless")}),
        ("empty", {"kind": ("object",), "container": ("array", "object")}),
        ("missing", {"kind": ("object",), "container": ("absent", "null")}),
        ("odd", {}),
    ),
}

#: node class -> variant -> the columns that only this subtype has beside the supertype's keys.
SUBTYPES: dict[str, dict[str, tuple[str, ...]]] = {
    "statistic": {"ratio": ("value", "total", "stat_type"), "number": ("value", "stat_type"), "valueless": ("stat_type",), "bare": ("stat_key",), "odd": ()},
    "group": {"measured": ("title", "group_key"), "mixed": ("title", "group_key"), "blank": ("title", "group_key"), "empty": ("title",), "missing": ("title",), "odd": ()},
    "player": {"grouped": ("player_id", "player", "team_id", "is_goalkeeper"), "lone_group": ("player_id", "player", "team_id"), "empty": ("player_id", "player"), "missing": ("player_id", "player"), "odd": ()},
    "team_statistic": {"full": ("name", "display_value", "value"), "unlabelled": ("name", "display_value", "value"), "valueless": ("name",)},
    "team": {"filled": ("team", "abbreviation", "home_away"), "lone_statistic": ("team",), "empty": ("team",), "missing": ("team",), "odd": ()},
}
KEYS = {
    "statistic": ("raw_id", "player_key", "group_pos", "label"), "group": ("raw_id", "player_key", "group_pos"), "player": ("raw_id", "player_key"),
    "team_statistic": ("raw_id", "team_pos", "team_id", "stat_pos", "label"), "team": ("raw_id", "team_pos", "team_id"),
}


def state(node: str, kind: Column | None = None, children: Column | None = None, **roles: Column) -> Column:
    """The automaton's state of a node, from its kind and the states of its children: by role, or ``children`` as an array."""
    out = None
    for name, conditions in RULES[node]:
        holds = []
        for slot, allowed in conditions.items():
            if slot == "any":
                holds.append(F.exists(children, _within(allowed)))
            elif slot == "all":
                holds.append((F.size(children) > 0) & F.forall(children, _within(allowed)))
            else:
                holds.append((kind if slot == "kind" else roles[slot]).isin(*allowed))
        test = F.coalesce(reduce(lambda a, b: a & b, holds), F.lit(False)) if holds else F.lit(True)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def _within(states: tuple[str, ...]):
    return lambda s: s.isin(*states)


def get(v: Column, path: str, kind_: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind_)


def members(v: Column) -> Column:
    """Key and value of each member of an object; NULL for anything else."""
    return F.map_entries(get(v, "$", "map<string,variant>"))


def elements(v: Column) -> Column:
    """The elements of an array; a lone object is an array of one; empty for anything else."""
    return F.coalesce(get(v, "$", "array<variant>"), F.when(is_object(v), F.array(v)), F.array().cast("array<variant>"))


def is_object(v: Column) -> Column:
    return get(v, "$", "map<string,variant>").isNotNull()


def kind(v: Column) -> Column:
    """``absent``, ``null``, ``object``, ``array`` or ``scalar``: the alphabet of the automaton."""
    return F.when(v.isNull(), "absent").when(F.is_variant_null(v), "null").when(is_object(v), "object").when(get(v, "$", "array<variant>").isNotNull(), "array").otherwise("scalar")


def leaf(v: Column) -> Column:
    """State of a leaf; text that reads as a number counts as one."""
    return state("leaf", kind=_leaf_kind(v))


def _leaf_kind(v: Column) -> Column:
    return F.when(v.isNull(), "absent").when(get(v, "$", "double").isNotNull(), "number").otherwise(kind(v))


def parsed(raw: DataFrame) -> DataFrame:
    """(raw_id, doc): readable payloads only."""
    return raw.filter(F.ltrim("payload").startswith("{")).select("raw_id", F.try_parse_json("payload").alias("doc"))


def _statistics(members_: Column, slim: bool) -> Column:
    """The members of a group's statistics with their states: leaves first, then the measure, then the statistic.

    One pass a level, so that each state is found once however many rules look at it; ``slim`` leaves the nodes themselves behind.
    """
    none = F.lit(None).cast("variant")
    read = lambda e: F.struct(
        e["key"].alias("label"), e["value"].alias("node"), get(e["value"], "$.stat").alias("inner"),
        get(e["value"], "$.stat.value").alias("value"), get(e["value"], "$.stat.total").alias("total"),
    )
    # a node that has a member is an object
    leaves = lambda s: F.struct(
        s["label"].alias("label"), (none if slim else s["node"]).alias("node"), _leaf_kind(s["value"]).alias("value"), _leaf_kind(s["total"]).alias("total"),
        F.when(s["value"].isNotNull(), "object").otherwise(kind(s["inner"])).alias("inner"), F.when(s["inner"].isNotNull(), "object").otherwise(kind(s["node"])).alias("kind"),
    )
    states = lambda s: F.struct(s["label"].alias("label"), s["node"].alias("node"), s["inner"].alias("inner"), s["kind"].alias("kind"), state("leaf", kind=s["value"]).alias("value"), state("leaf", kind=s["total"]).alias("total"))
    measure = lambda s: F.struct(s["label"].alias("label"), s["node"].alias("node"), s["kind"].alias("kind"), state("measure", kind=s["inner"], value=s["value"], total=s["total"]).alias("measure"))
    whole = lambda s: F.struct(s["label"].alias("label"), s["node"].alias("node"), state("statistic", kind=s["kind"], measure=s["measure"]).alias("state"))
    out = members_
    for step in (read, leaves, states, measure, whole):
        out = F.transform(out, step)
    return out


def _players(raw: DataFrame, slim: bool = False) -> DataFrame:
    """One row a key of ``playerStats`` with its tree read from the leaves up: ``groups`` have ``stats``, each with its state."""
    held = parsed(raw).select("raw_id", F.explode(members(get(F.col("doc"), "$.content.playerStats"))).alias("e"))
    held = held.select("raw_id", F.col("e.key").alias("player_key"), F.col("e.value").alias("node"))
    held = held.withColumn("inner", get(F.col("node"), "$.stats"))
    held = held.withColumn("groups", F.transform(elements(F.col("inner")), lambda g: F.struct(g.alias("node"), get(g, "$.stats").alias("inner"))))
    none = F.array().cast("array<struct<key:string,value:variant>>")
    opened = lambda g: F.struct(g["node"].alias("node"), g["inner"].alias("inner"), members(g["inner"]).alias("members"))
    filled = lambda g: F.struct(
        g["node"].alias("node"), F.when(g["inner"].isNotNull(), "object").otherwise(kind(g["node"])).alias("kind"),
        F.when(g["members"].isNotNull(), "object").otherwise(kind(g["inner"])).alias("container"), _statistics(F.coalesce(g["members"], none), slim).alias("stats"),
    )
    children = lambda g: F.struct(g["node"].alias("node"), g["stats"].alias("stats"), g["kind"].alias("kind"), g["container"].alias("container"), F.array_distinct(F.transform(g["stats"], lambda s: s["state"])).alias("states"))
    judged = lambda g: F.struct(g["node"].alias("node"), g["stats"].alias("stats"), state("group", kind=g["kind"], container=g["container"], children=g["states"]).alias("state"))
    for step in (opened, filled, children, judged):
        held = held.withColumn("groups", F.transform("groups", step))
    of = state("player", kind=kind(F.col("node")), container=kind(F.col("inner")), children=F.transform("groups", lambda g: g["state"]))
    return held.select("raw_id", "player_key", "node", "groups", of.alias("variant"))


def players(raw: DataFrame) -> DataFrame:
    """Supertype table of players: one row a key of ``playerStats``, linked to its raw record."""
    node = F.col("node")
    return _players(raw).select(
        "raw_id", "player_key", "variant", get(node, "$.id", "string").alias("player_id"), get(node, "$.name", "string").alias("player"),
        get(node, "$.teamId", "string").alias("team_id"), get(node, "$.isGoalkeeper", "boolean").alias("is_goalkeeper"),
    )


def records(raw: DataFrame) -> DataFrame:
    """(raw_id, variant, players): the state of each readable record from those of its players."""
    of = _players(raw).groupBy("raw_id").agg(F.collect_set("variant").alias("states"), F.count("*").alias("players"))
    every = parsed(raw).filter("doc is not null").select("raw_id").join(of, "raw_id", "left").withColumn("states", F.coalesce("states", F.array().cast("array<string>")))
    return every.select("raw_id", state("record", children=F.col("states")).alias("variant"), F.coalesce("players", F.lit(0)).alias("players"))


def _groups(raw: DataFrame, slim: bool = False) -> DataFrame:
    return _players(raw, slim).select("raw_id", "player_key", F.posexplode("groups").alias("group_pos", "g"))


def groups(raw: DataFrame) -> DataFrame:
    """Supertype table of the groups of a player's statistics; ``group_pos`` links its statistics."""
    node = F.col("g.node")
    return _groups(raw).select("raw_id", "player_key", "group_pos", F.col("g.state").alias("variant"), get(node, "$.title", "string").alias("title"), get(node, "$.key", "string").alias("group_key"))


def statistics(raw: DataFrame, slim: bool = False) -> DataFrame:
    """All statistics of players in all states, null ones too, linked by (raw_id, player_key, group_pos); ``slim``: keys and variant only."""
    node = F.col("s.node")
    return _groups(raw, slim).select("raw_id", "player_key", "group_pos", F.explode("g.stats").alias("s")).select(
        "raw_id", "player_key", "group_pos", F.col("s.label").alias("label"), F.col("s.state").alias("variant"), get(node, "$.key", "string").alias("stat_key"),
        get(node, "$.stat.value", "double").alias("value"), get(node, "$.stat.total", "double").alias("total"),
        get(node, "$.stat.type", "string").alias("stat_type"), get(node, "$.hideInPopup", "boolean").alias("hidden"),
    )


def shots(raw: DataFrame) -> DataFrame:
    """One row a shot of a player, linked by (raw_id, player_key)."""
    each = _players(raw).select("raw_id", "player_key", F.posexplode(elements(get(F.col("node"), "$.shotmap"))).alias("shot_pos", "shot"))
    node = F.col("shot")
    return each.filter(is_object(node)).select(
        "raw_id", "player_key", "shot_pos", get(node, "$.id", "string").alias("shot_id"), get(node, "$.min", "int").alias("minute"),
        get(node, "$.situation", "string").alias("situation"), get(node, "$.onGoalShot.x", "double").alias("goal_x"), get(node, "$.onGoalShot.y", "double").alias("goal_y"),
    )


def _teams(raw: DataFrame) -> DataFrame:
    """One row a team of the box score, its statistics read from the leaves up."""
    held = parsed(raw).select("raw_id", F.posexplode(elements(get(F.col("doc"), "$.boxscore.teams"))).alias("team_pos", "node")).filter(is_object(F.col("node")))

    def judged(n: Column) -> Column:
        label, name, shown = (leaf(get(n, f"$.{k}")) for k in ("label", "name", "displayValue"))
        return F.struct(n.alias("node"), state("team_statistic", kind=kind(n), label=label, name=name, shown=shown).alias("state"))

    held = held.withColumn("inner", get(F.col("node"), "$.statistics")).withColumn("stats", F.transform(elements(F.col("inner")), judged))
    of = state("team", kind=kind(F.col("node")), container=kind(F.col("inner")), children=F.transform("stats", lambda s: s["state"]))
    return held.select("raw_id", "team_pos", get(F.col("node"), "$.team.id", "string").alias("team_id"), "node", "stats", of.alias("variant"))


def teams(raw: DataFrame) -> DataFrame:
    """Supertype table of the box score's teams."""
    node = F.col("node")
    return _teams(raw).select(
        "raw_id", "team_pos", "team_id", "variant", get(node, "$.team.displayName", "string").alias("team"),
        get(node, "$.team.abbreviation", "string").alias("abbreviation"), get(node, "$.homeAway", "string").alias("home_away"),
    )


def team_statistics(raw: DataFrame) -> DataFrame:
    """All statistics of teams in all states, unnamed ones too; ``label`` is the name where there is no label."""
    each = _teams(raw).select("raw_id", "team_pos", "team_id", F.posexplode("stats").alias("stat_pos", "s"))
    node = F.col("s.node")
    label, name, shown = (get(node, f"$.{k}", "string") for k in ("label", "name", "displayValue"))
    return each.select(
        "raw_id", "team_pos", "team_id", "stat_pos", F.coalesce(label, name).alias("label"), name.alias("name"), shown.alias("display_value"),
        F.try_element_at(F.split(shown, "%"), F.lit(1)).try_cast("double").alias("value"), F.col("s.state").alias("variant"),
    )


SUPERTYPES = {"statistic": statistics, "group": groups, "player": players, "team_statistic": team_statistics, "team": teams}


def kept(raw: DataFrame, node: str) -> DataFrame:
    """The supertype table of a class: nodes of all registered variants."""
    return SUPERTYPES[node](raw).filter(F.col("variant").isin(*SUBTYPES[node]))


def subtype(raw: DataFrame, node: str, variant: str) -> DataFrame:
    """The typed table of one structural variant; its keys are those of the supertype row."""
    return SUPERTYPES[node](raw).filter(F.col("variant") == variant).select(*KEYS[node], *SUBTYPES[node][variant])


def union_of_subtypes(raw: DataFrame, node: str) -> DataFrame:
    """The keys of all rows of a class's typed tables, with the table each is in: their union in one pass over the records.

    A node is routed to the one table whose variant is its state; without a table it goes nowhere.
    """
    t = statistics(raw, slim=True) if node == "statistic" else SUPERTYPES[node](raw)
    row = lambda v: F.struct(*KEYS[node], F.lit(v).alias("subtype"))
    routed = F.array_compact(F.array(*[F.when(F.col("variant") == v, row(v)) for v in SUBTYPES[node]]))
    return t.select(F.inline(routed))


def named_statistics(matchdetails: DataFrame, summary: DataFrame) -> DataFrame:
    """(raw_table, raw_id, owner_key, pos, label) of both raw tables, read from the typed tables of their statistics."""
    a = union_of_subtypes(matchdetails, "statistic").select(
        F.lit("matchdetails").alias("raw_table"), "raw_id", F.col("player_key").alias("owner_key"), F.col("group_pos").cast("long").alias("pos"), "label"
    )
    b = union_of_subtypes(summary, "team_statistic").select(
        F.lit("summary").alias("raw_table"), "raw_id", F.col("team_id").alias("owner_key"), F.col("stat_pos").cast("long").alias("pos"), "label"
    )
    return a.unionByName(b)
