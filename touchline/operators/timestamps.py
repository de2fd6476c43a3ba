"""Mixed timestamp formats and zones -> one UTC instant.

Every string is reduced to a *shape mask* by the JVM (digits become ``9``, letters ``A``, the rest stays), each distinct
mask is compiled to a parser once per Python worker, and all rows of a mask are then sliced and converted as NumPy arrays.
Wall clock times pass through zone transition tables that are built once on the driver, carry the version of the time zone
database, and travel with the plan, so executors with another database can't disagree.

Defined results: NULL, blank, date-only, zone-less without a known zone, impossible calendar dates and unknown shapes give
NULL. A wall clock time that occurs twice means the first; one that is skipped is read with the offset before the change.
"""

from __future__ import annotations

import datetime as dt
import importlib.resources
import re
import struct
import zoneinfo
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"

# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "WAT": 60, "CAT": 120, "EAT": 180, "SAST": 120, "IST": 330, "PKT": 300, "JST": 540, "KST": 540,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "COT": -300, "PET": -300, "ART": -180, "BRT": -180, "CLT": -240, "CLST": -180,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_CLOCK = r"(?P<H>9{1,2}):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9{1,9}))?)?"
_OFFSET = r"(?P<off>[+-]99(?::?99)?)"
#: Shapes over masks. A group's place in the mask is its place in every string of that mask.
TEMPLATES = (
    ("iso", rf"(?P<Y>9999)-(?P<m>99)-(?P<d>99)(?P<t>[A ]){_CLOCK}(?: ?(?:{_OFFSET}|(?P<abbr>A{{1,5}})))?(?P<br>\[.*\])?"),
    ("compact", rf"(?P<Y>9999)(?P<m>99)(?P<d>99)(?P<t>A)(?P<H>99)(?P<M>99)(?P<S>99)?(?:{_OFFSET}|(?P<abbr>A))?"),
    ("digits14", r"(?P<Y>9999)(?P<m>99)(?P<d>99)(?P<H>99)(?P<M>99)(?P<S>99)"),
    ("digits12", r"(?P<Y>9999)(?P<m>99)(?P<d>99)(?P<H>99)(?P<M>99)"),
    ("epoch", r"(?P<e>9{9,10}|9{13}|9{16}|9{19})"),
    ("dayname", rf"(?:A+,? )?(?P<d>9{{1,2}}) (?P<mon>A+)\.? (?P<Y>9999),? {_CLOCK}(?: (?P<ap>AA)(?= |$))?(?: ?{_OFFSET}| (?P<abbr>A{{1,5}}))?"),
    ("monthname", rf"(?:A+, )?(?P<mon>A+)\.? (?P<d>9{{1,2}}), (?P<Y>9999),? {_CLOCK}(?: ?(?P<ap>AA)(?= |$))?(?: ?{_OFFSET}| (?P<abbr>A{{1,5}}))?"),
    ("parted", rf"(?P<p1>9{{1,2}})(?P<sep>[/.])(?P<p2>9{{1,2}})[/.](?P<Y>9999),? {_CLOCK}(?: ?(?P<ap>AA)(?= |$))?(?: ?{_OFFSET}| (?P<abbr>A{{1,5}}))?"),
)
_COMPILED = tuple((name, re.compile(pattern)) for name, pattern in TEMPLATES)
PARTED = r"^\s*(\d{1,2})[/.](\d{1,2})[/.]\d{4}\b"


def shape_mask(c: Column) -> Column:
    """Character-class mask, computed in the JVM without a regular expression."""
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    return F.translate(c, upper + upper.lower() + digits, "A" * 52 + "9" * 10)


def tzdata_version() -> str:
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        for root in zoneinfo.TZPATH:
            try:
                with open(f"{root}/tzdata.zi") as f:
                    return f.readline().split()[-1]
            except OSError:
                continue
    return "system"


#: Seconds of 400 years: after them days of the week, and so the closing rule of every zone, repeat.
CYCLE = 146_097 * 86_400


def _compiled(name: str) -> bytes | None:
    """A zone's compiled file, of the system or of the data package."""
    for root in zoneinfo.TZPATH:
        try:
            with open(f"{root}/{name}", "rb") as f:
                return f.read()
        except OSError:
            continue
    try:
        return importlib.resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()
    except (ImportError, OSError):
        return None


def _listed(data: bytes) -> list[int]:
    """The UTC seconds of the transitions a compiled file lists."""

    def header(at: int) -> tuple[int, ...]:
        return struct.unpack(">6I", data[at + 20 : at + 44])

    utc, std, leap, times, types, chars = header(0)
    if data[4:5] < b"2":
        return list(struct.unpack(f">{times}i", data[44 : 44 + 4 * times]))
    second = 44 + times * 5 + types * 6 + chars + leap * 8 + std + utc
    times = header(second)[3]
    return list(struct.unpack(f">{times}q", data[second + 44 : second + 44 + 8 * times]))


def zone_transitions(names: list[str]) -> dict:
    """``{"version": ..., "zones": {name: (starts, offsets, repeats)}}``: UTC second from which each offset holds, over all time.

    Listed transitions come from the zone's compiled file; the closing rule is unrolled over the 400 years after the last of
    them, after which it repeats (:func:`wall_to_utc`). Names the database doesn't have are left out; size is bounded by the
    database (about 600 zones of some 900 transitions).
    """
    zones, epoch = {}, dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
    for name in sorted(set(names)):
        try:
            z = zoneinfo.ZoneInfo(name)
        except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
            continue
        data = _compiled(name)
        if data is None:
            continue

        def offset(t: int, z=z) -> int:
            return int((epoch + dt.timedelta(seconds=t)).astimezone(z).utcoffset().total_seconds())

        first = int(dt.datetime(1, 1, 2, tzinfo=z).utcoffset().total_seconds())
        starts, offsets = [-(2**62)], [first]
        listed = [t for t in _listed(data) if t > -62_000_000_000]
        for t in listed:
            if (now := offset(t)) != offsets[-1]:
                starts.append(t)
                offsets.append(now)
        repeats = b"," in data.rstrip(b"\n").rsplit(b"\n", 1)[-1]
        if repeats:
            lo, month = (listed[-1] if listed else 0) + 1, 30 * 86_400
            for t in range(lo, lo + CYCLE + 366 * 86_400, month):
                now = offset(t + month)
                if now != offsets[-1]:
                    a, b = t, t + month
                    while b - a > 1:
                        mid = (a + b) // 2
                        a, b = (mid, b) if offset(mid) == offsets[-1] else (a, mid)
                    starts.append(b)
                    offsets.append(now)
        zones[name] = (np.array(starts, dtype=np.int64), np.array(offsets, dtype=np.int64), repeats)
    return {"version": tzdata_version(), "zones": zones}


def wall_to_utc(wall: np.ndarray, table: tuple[np.ndarray, np.ndarray, bool]) -> np.ndarray:
    """UTC seconds of wall clock seconds: the first of two, the earlier offset inside a gap."""
    starts, offsets, repeats = table
    # what lies beyond the unrolled years is read in the same years of an earlier cycle
    later = np.maximum(0, -(-(wall - starts[-1] - offsets[-1]) // CYCLE)) * repeats
    wall = wall - later * CYCLE
    ends = starts[1:] + offsets[:-1]
    i = np.searchsorted(ends, wall, side="right")
    gap = (i > 0) & (wall < starts[i] + offsets[i])
    return wall - np.where(gap, offsets[np.maximum(i - 1, 0)], offsets[i]) + later * CYCLE


@lru_cache(maxsize=20_000)
def compile_mask(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """The parser of a mask: its template and the slice of each part; None for a shape that gives no instant."""
    for name, pattern in _COMPILED:
        m = pattern.fullmatch(mask)
        if m:
            return name, {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


def _ints(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), dtype=np.int64)
    for j in range(*span):
        out = out * 10 + (chars[:, j].astype(np.int64) - 48)
    return out


def _words(values: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    return np.array([v[span[0] : span[1]] for v in values], dtype=object)


def _by_word(words: np.ndarray, table: dict, default: int) -> np.ndarray:
    codes, uniques = pd.factorize(words)
    return np.array([table.get(u, default) for u in uniques], dtype=np.int64)[codes]


def _convert(values: np.ndarray, mask: str, zones: np.ndarray, orders: np.ndarray, tables: dict) -> np.ndarray:
    """UTC seconds of all strings of one mask; the smallest int64 where there is no instant."""
    none = np.iinfo(np.int64).min
    out = np.full(len(values), none, dtype=np.int64)
    parser = compile_mask(mask)
    if parser is None:
        return out
    kind, at = parser
    chars = np.array(values, dtype=f"U{len(mask)}").view(np.uint32).reshape(len(values), len(mask))
    if kind == "epoch":
        width = at["e"][1] - at["e"][0]
        return _ints(chars, at["e"]) // 10 ** (0 if width <= 10 else width - 10)
    year = _ints(chars, at["Y"])
    good = np.ones(len(values), dtype=bool)
    if "t" in at:
        good &= np.isin(chars[:, at["t"][0]], [ord("T"), ord("t"), ord(" ")])
    if "mon" in at:
        names = {n: i + 1 for i, n in enumerate(MONTHS)}
        month = _by_word(np.array([w[:3].lower() for w in _words(values, at["mon"])], dtype=object), names, 0)
        day = _ints(chars, at["d"])
    elif "p1" in at:
        one, two = _ints(chars, at["p1"]), _ints(chars, at["p2"])
        dmy, mdy = orders == "dmy", orders == "mdy"
        good &= dmy | mdy | (one == two)
        month, day = np.where(dmy, two, one), np.where(dmy, one, two)
    else:
        month, day = _ints(chars, at["m"]), _ints(chars, at["d"])
    hour, minute = _ints(chars, at["H"]), _ints(chars, at["M"])
    second = _ints(chars, at["S"]) if "S" in at else np.zeros(len(values), dtype=np.int64)
    if "ap" in at:
        half = _by_word(np.array([w.upper() for w in _words(values, at["ap"])], dtype=object), {"AM": 0, "PM": 12}, -1)
        good &= (half >= 0) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + half
    good &= (month >= 1) & (month <= 12) & (day >= 1) & (hour < 24) & (minute < 60) & (second < 60) & (year >= 1)
    month, day = np.where(good, month, 1), np.where(good, day, 1)
    start = (year - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (month - 1)
    length = ((start + 1).astype("datetime64[D]") - start.astype("datetime64[D]")).astype(np.int64)
    good &= day <= length
    wall = (start.astype("datetime64[D]").astype(np.int64) + day - 1) * 86400 + hour * 3600 + minute * 60 + second
    unknown = np.int64(10**9)
    if "off" in at:
        a, b = at["off"]
        sign = np.where(chars[:, a] == ord("-"), -1, 1)
        minutes = _ints(chars, (b - 2, b)) if b - a > 3 else np.zeros(len(values), dtype=np.int64)
        offset = sign * (_ints(chars, (a + 1, a + 3)) * 60 + minutes)
    elif "abbr" in at:
        offset = _by_word(np.array([w.upper() for w in _words(values, at["abbr"])], dtype=object), ABBREVIATIONS, unknown)
    else:
        named = _words(values, (at["br"][0] + 1, at["br"][1] - 1)) if "br" in at else zones
        codes, uniques = pd.factorize(named)
        for i, zone in enumerate(uniques):
            rows = codes == i
            if zone in tables["zones"]:
                out[rows] = wall_to_utc(wall[rows], tables["zones"][zone])
        return np.where(good, out, none)
    return np.where(good & (offset != unknown), wall - np.where(offset == unknown, 0, offset) * 60, none)


def utc_text(tables: dict):
    """A pandas UDF (text, mask, zone, day-month order) -> ``yyyy-MM-ddTHH:mm:ssZ`` or NULL."""

    @F.pandas_udf("string")
    def convert(text: pd.Series, mask: pd.Series, zone: pd.Series, order: pd.Series) -> pd.Series:
        values, zones, orders = text.to_numpy(object), zone.to_numpy(object), order.to_numpy(object)
        codes, masks = pd.factorize(mask)
        seconds = np.full(len(values), np.iinfo(np.int64).min, dtype=np.int64)
        for i, m in enumerate(masks):
            rows = np.flatnonzero(codes == i)
            seconds[rows] = _convert(values[rows], m, zones[rows], orders[rows], tables)
        # years 1 to 9999 only: what the fixed-width result can hold
        good = (seconds >= -62135596800) & (seconds <= 253402300799)
        stamps = np.datetime_as_string(np.where(good, seconds, 0).astype("datetime64[s]"), unit="s").astype(object) + "Z"
        return pd.Series(np.where(good, stamps, None), dtype=object)

    return convert


def day_month_order(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, day_month): ``dmy`` or ``mdy`` for each table, from its own dates whose parts leave no choice; NULL without any.

    One map-side combined pass; one row a table.
    """
    first, second = F.try_to_number(F.regexp_extract(value, PARTED, 1), F.lit("99")), F.try_to_number(F.regexp_extract(value, PARTED, 2), F.lit("99"))
    votes = df.filter(F.col(value).rlike(PARTED)).groupBy(by).agg(F.count_if(first > 12).alias("d"), F.count_if(second > 12).alias("m"))
    return votes.select(by, F.when(F.col("d") > F.col("m"), "dmy").when(F.col("m") > F.col("d"), "mdy").alias("day_month"))


def normalise_timestamps(parts: dict[str, tuple[DataFrame, str, str]], zones: DataFrame, keep_canonical: bool = True) -> DataFrame:
    """Instants of several tables.

    ``parts``: table name -> (DataFrame with ``row_id`` and the two columns, time column, zone key column); ``zones``:
    (source_table, competition, zone_name), one row a key. Returns (source_table, row_id, raw, kickoff_utc).
    Repeated rows stay repeated. Without ``keep_canonical`` rows already written canonically are dropped before any Python.
    """
    shaped = [
        df.select(F.lit(name).alias("source_table"), "row_id", F.col(value).cast("string").alias("raw"), F.col(key).cast("string").alias("competition"))
        for name, (df, value, key) in parts.items()
    ]
    rows = reduce(DataFrame.unionByName, shaped).filter(F.col("raw").isNotNull())
    todo = rows.filter(~F.col("raw").rlike(CANONICAL))
    known = zones.groupBy("source_table", "competition").agg(F.min("zone_name").alias("zone_name"))
    # at most one row for each zone of the database
    names = [r[0] for r in zones.select("zone_name").distinct().filter(F.col("zone_name").isin(sorted(zoneinfo.available_timezones()))).collect()]
    extra = sorted(z for z in zoneinfo.available_timezones() if z.startswith(("Etc/", "UTC", "GMT")))
    tables = zone_transitions(names + extra)
    order = day_month_order(rows, "source_table", "raw")
    joined = todo.join(known, ["source_table", "competition"], "left").join(F.broadcast(order), "source_table", "left")
    text = F.trim("raw")
    done = joined.select("source_table", "row_id", "raw", utc_text(tables)(text, shape_mask(text), "zone_name", "day_month").alias("kickoff_utc"))
    if not keep_canonical:
        return done
    as_is = rows.filter(F.col("raw").rlike(CANONICAL))
    checked = F.try_to_timestamp(F.col("raw"), F.lit("yyyy-MM-dd'T'HH:mm:ssX")).isNotNull()
    return done.unionByName(as_is.select("source_table", "row_id", "raw", F.when(checked, F.col("raw")).alias("kickoff_utc")))
