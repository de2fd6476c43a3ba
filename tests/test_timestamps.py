import datetime as dt
import zoneinfo

import numpy as np

from touchline.operators import timestamps as T


def found(spark, rows, zones):
    df = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(rows)], "row_id long, d string, competition string")
    z = spark.createDataFrame(zones or [("t", "-", "Nowhere/None")], "source_table string, competition string, zone_name string")
    return {r["row_id"]: r["kickoff_utc"] for r in T.normalise_timestamps({"t": (df.withColumnRenamed("d", "when"), "when", "competition")}, z).collect()}


def test_formats_zones_and_unknowns(spark):
    zones = [("t", "M", "Europe/Madrid"), ("t", "N", "America/New_York")]
    cases = [
        ("2024-06-14T19:00:00Z", None, "2024-06-14T19:00:00Z"), ("2024-06-14T19:00Z", None, "2024-06-14T19:00:00Z"),
        ("2024-06-14T19:00:00.250+02:00", None, "2024-06-14T17:00:00Z"), ("20240614T190000-0400", None, "2024-06-14T23:00:00Z"),
        ("1718391600", None, "2024-06-14T19:00:00Z"), ("1718391600000", None, "2024-06-14T19:00:00Z"), ("202406142100", "M", "2024-06-14T19:00:00Z"),
        ("Fri, 14 Jun 2024 21:00:00 +0200", None, "2024-06-14T19:00:00Z"), ("14 Jun 2024 15:00 EDT", None, "2024-06-14T19:00:00Z"),
        ("Jun 14, 2024 3:00 PM", "N", "2024-06-14T19:00:00Z"), ("31/12/2024 12:00", "M", "2024-12-31T11:00:00Z"), ("04/06/2024 12:00", "M", "2024-06-04T10:00:00Z"),
        ("2024-06-14T21:00+02:00[Europe/Madrid]", None, "2024-06-14T19:00:00Z"), ("2024-06-14", "M", None), ("2024-06-14 21:00", "X", None),
        ("2024-02-30T10:00:00Z", None, None), ("TBD", "M", None), ("", "M", None), (None, "M", None), ("13:00 PM", "M", None),
        ("2024-10-27 02:30:00", "M", "2024-10-27T00:30:00Z"),  # twice: the first
        ("2024-03-31 02:30:00", "M", "2024-03-31T01:30:00Z"),  # skipped
        ("1986-06-22 12:00", "M", "1986-06-22T10:00:00Z"), ("2050-07-01 12:00", "M", "2050-07-01T10:00:00Z"),
    ]
    got = found(spark, [(v, c) for v, c, _ in cases], zones)
    for i, (v, _, want) in enumerate(cases):
        assert got.get(i) == want, v


def test_order_without_evidence_is_unknown(spark):
    got = found(spark, [("04/06/2024 12:00 UTC", None), ("05/05/2024 12:00 UTC", None)], [])
    assert got == {0: None, 1: "2024-05-05T12:00:00Z"}


def test_empty_table(spark):
    assert found(spark, [(None, None)], []) == {}


def test_transitions_agree_with_the_zone_database_over_all_time():
    names = ["Australia/Sydney", "America/New_York", "Europe/Madrid", "Europe/Moscow", "Africa/Casablanca", "Etc/GMT+5", "Asia/Kolkata", "America/Sao_Paulo"]
    tables = T.zone_transitions(names)
    assert sorted(tables["zones"]) == sorted(names) and tables["version"]
    rng = np.random.default_rng(1)
    walls = [dt.datetime(1986, 6, 22, 12), dt.datetime(1990, 7, 8, 20), dt.datetime(2050, 7, 1, 12), dt.datetime(2051, 1, 1), dt.datetime(1900, 1, 1), dt.datetime(2437, 7, 1), dt.datetime(2837, 12, 1), dt.datetime(9990, 7, 1)]
    walls += [dt.datetime(1850, 1, 1) + dt.timedelta(seconds=int(x)) for x in rng.integers(0, 400 * 365 * 86400, 3000)]
    for name in names:
        z = zoneinfo.ZoneInfo(name)
        want = [int((w.replace(tzinfo=z) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)).total_seconds()) for w in walls]
        got = T.wall_to_utc(np.array([int((w - dt.datetime(1970, 1, 1)).total_seconds()) for w in walls]), tables["zones"][name])
        assert got.tolist() == want, name
