"""Registered queries of the data-quality operators in the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.operators import anomalies, nested, timestamps
from touchline.session import cut, read

TIME_COLUMNS = {"sb_player_match": "match_date", "fotmob_wc2026": "match_date", "espn_team_match": "date"}


def _instants(spark: SparkSession, d: str, tables: tuple[str, ...], keep_canonical: bool) -> DataFrame:
    parts = {t: (read(spark, d, t), TIME_COLUMNS[t], "competition") for t in tables}
    return timestamps.normalise_timestamps(parts, read(spark, d, "competition_zones"), keep_canonical)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _instants(spark, d, tuple(TIME_COLUMNS), keep_canonical=False)
    return rows.filter(F.col("kickoff_utc").isNotNull() & (F.col("kickoff_utc") != F.col("raw"))).select("source_table", "row_id", "kickoff_utc")


def p3_instants(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the three tables: the instant, or NULL where there is none."""
    return _instants(spark, d, tuple(TIME_COLUMNS), keep_canonical=True)


def p2_flags(spark: SparkSession, d: str) -> DataFrame:
    table = read(spark, d, "fotmob_wc2026")
    # a match's dates are the same on all rows of its sheet: only different ones are parsed
    dates = cut(table.filter("match_id is not null").select(F.col("match_id").alias("row_id"), "match_date", "competition").distinct())
    at = timestamps.normalise_timestamps({"fotmob_wc2026": (dates, "match_date", "competition")}, read(spark, d, "competition_zones"))
    at = at.filter(F.col("kickoff_utc").isNotNull()).select(F.col("row_id").alias("match_id"), F.to_timestamp_ntz(F.regexp_replace("kickoff_utc", "Z$", "")).alias("kickoff"))
    return anomalies.flag_readings(table, at.groupBy("match_id").agg(F.min("kickoff").alias("kickoff")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_flags(spark, d).select("row_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.named_statistics(read(spark, d, "matchdetails"), read(spark, d, "summary"))


#: What DuckDB says about the named statistics: paths and kinds only, no states.
P5 = """WITH m AS (SELECT raw_id, TRY_CAST(payload AS JSON) AS j FROM matchdetails WHERE starts_with(ltrim(payload), '{') AND json_valid(payload)),
p AS (SELECT raw_id, unnest(json_keys(j, '$.content.playerStats')) AS k, json_extract(j, '$.content.playerStats') AS ps FROM m WHERE json_type(j, '$.content.playerStats') = 'OBJECT'),
s AS (SELECT raw_id, k, json_extract(ps, '$."' || k || '".stats') AS st FROM p),
g AS (SELECT raw_id, k, unnest(range(CAST(json_array_length(st) AS BIGINT))) AS pos, st FROM s WHERE json_type(st) = 'ARRAY'),
h AS (SELECT raw_id, k, pos, json_extract(st, '$[' || pos || '].stats') AS x FROM g UNION ALL SELECT raw_id, k, 0, json_extract(st, '$.stats') FROM s WHERE json_type(st) = 'OBJECT'),
l AS (SELECT raw_id, k, pos, unnest(json_keys(x)) AS label, x FROM h WHERE json_type(x) = 'OBJECT'),
n AS (SELECT raw_id, TRY_CAST(payload AS JSON) AS j FROM summary WHERE starts_with(ltrim(payload), '{') AND json_valid(payload)),
t0 AS (SELECT raw_id, json_extract(j, '$.boxscore.teams') AS ts FROM n),
t AS (SELECT raw_id, unnest(CAST(ts AS JSON[])) AS t FROM t0 WHERE json_type(ts) = 'ARRAY' UNION ALL SELECT raw_id, ts FROM t0 WHERE json_type(ts) = 'OBJECT'),
u AS (SELECT raw_id, json_extract_string(t, '$.team.id') AS k, json_extract(t, '$.statistics') AS x FROM t WHERE json_type(t) = 'OBJECT'),
v AS (SELECT raw_id, k, x, unnest(range(CAST(json_array_length(x) AS BIGINT))) AS pos FROM u WHERE json_type(x) = 'ARRAY'),
w AS (SELECT raw_id, k, pos, json_extract(x, '$[' || pos || ']') AS e FROM v UNION ALL SELECT raw_id, k, 0, x FROM u WHERE json_type(x) = 'OBJECT'),
y AS (SELECT raw_id, k, pos, coalesce(json_extract_string(e, '$.label'), json_extract_string(e, '$.name')) AS label FROM w WHERE json_type(e) = 'OBJECT')
SELECT 'matchdetails' AS raw_table, raw_id, k AS owner_key, CAST(pos AS BIGINT) AS pos, label FROM l WHERE json_type(x, '$."' || label || '"') <> 'NULL'
UNION ALL SELECT 'summary', raw_id, k, CAST(pos AS BIGINT), label FROM y WHERE label IS NOT NULL"""


def _table(build, raw: str):
    return lambda spark, d: build(read(spark, d, raw))


def queries() -> dict:
    raw = lambda node: "summary" if node.startswith("team") else "matchdetails"
    kept = {"player": "p5_players", "group": "p5_groups", "statistic": "p5_player_statistics", "team": "p5_teams", "team_statistic": "p5_team_statistics"}
    typed = {f"p5_{n}_{v}": _table(lambda r, n=n, v=v: nested.subtype(r, n, v), raw(n)) for n, variants in nested.SUBTYPES.items() for v in variants}
    return {
        "p2_found": p2_found, "p2_flags": p2_flags, "p3_found": p3_found, "p3_instants": p3_instants, "p5_found": p5_found,
        "p5_records": _table(nested.records, "matchdetails"), "p5_shots": _table(nested.shots, "matchdetails"),
        **{name: _table(lambda r, n=n: nested.kept(r, n), raw(n)) for n, name in kept.items()}, **typed,
    }


def oracle() -> dict[str, str]:
    return {"p5_found": P5}
