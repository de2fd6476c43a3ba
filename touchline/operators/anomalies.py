"""Implausible spikes, stuck values and impossible readings, per source.

Source = the feed that delivered a match. A reading's log rate (passes a minute) is the level of its feed, of its position and of
the player around that match, plus a residual that follows a robust first-order autoregression with a coefficient and an
innovation scale a feed. The fit is iterative: in each round levels, coefficient and scale are estimated from the readings not
yet taken for outliers, every reading is tested as an *additive outlier* against a *level shift* (an outlier stands alone, after a
shift the neighbours stay displaced), and the outliers leave the next round's fit, until nothing changes. A spike is an additive
outlier that is also several times what feed, position, player and the autoregression lead to expect. Stuck runs, stuck sheets and
physical limits are separate tests.

A player's readings are sequences over range partitions with margins (:mod:`sequences`), so no task holds a whole player.

Defined results: NULL and NaN are missing and never flagged by themselves; a pass count without minutes is only flagged if no
match length explains it; double rows get the verdict of their reading; rows without a player id are sequences of one; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from touchline.operators import sequences


@dataclass(frozen=True)
class Limits:
    """Parameters of the tests; ``ratio`` is what "several times" means."""

    regular_minutes: float = 112.0  # a match with stoppage time
    extra_minutes: float = 145.0  # a match that went to extra time
    on_pitch: int = 11
    ratio: float = 3.0
    z: float = 5.0  # in units of the square-root scale's standard deviation, which is 1/2 for counts
    critical: float = 3.0  # in units of the innovation scale
    run: int = 6
    sheet: int = 5  # that fewer readings agree is no rarity
    fit_minutes: float = 15.0  # shorter appearances don't enter the levels
    reach: int = 10  # matches on either side that make a player's level
    shift: int = 3  # readings after (or before) a shift that are looked at; two of them at least
    margin: int = 64  # readings carried across a partition's edge: several times the reach, since some may be unusable
    rounds: int = 8  # the fit ends when nothing changes, at the latest here


def clean(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def impossible(minutes: Column, passes: Column, stage: Column, limits: Limits) -> Column:
    """Readings that no match and no count can give."""
    odd = lambda c: (c < 0) | (c != F.floor(c)) | (F.abs(c) == float("inf"))
    return F.coalesce(odd(minutes), F.lit(False)) | F.coalesce(odd(passes), F.lit(False)) | F.coalesce(minutes > _most(stage, limits), F.lit(False))


def _most(stage: Column, limits: Limits) -> Column:
    return F.when(stage == "group", limits.regular_minutes).otherwise(limits.extra_minutes)


def stuck_sheets(rows: DataFrame, limits: Limits) -> DataFrame:
    """(match_id, teams, ms, ps): matches with a sheet that shows one value of minutes or passes all over, and these values."""
    each = rows.filter("team is not null").groupBy("match_id", "team", "fm_player_id").agg(
        F.min("minutes").alias("m0"), F.max("minutes").alias("m1"), F.min("passes").alias("p0"), F.max("passes").alias("p1")
    )
    sheets = each.groupBy("match_id", "team").agg(
        F.count("*").alias("players"), F.count("m0").alias("nm"), F.count("p0").alias("np"),
        F.min("m0").alias("m0"), F.max("m1").alias("m1"), F.min("p0").alias("p0"), F.max("p1").alias("p1"),
    )
    # the full time of at most eleven who played on is no stuck value
    played_on = (F.col("m0") >= 90) & (F.col("players") <= limits.on_pitch)
    stuck = sheets.select(
        "match_id", "team",
        F.when((F.col("nm") >= limits.sheet) & (F.col("m0") == F.col("m1")) & ~played_on, F.col("m0")).alias("stuck_minutes"),
        F.when((F.col("np") >= limits.sheet) & (F.col("p0") == F.col("p1")), F.col("p0")).alias("stuck_passes"),
    ).filter("stuck_minutes is not null or stuck_passes is not null")
    return stuck.groupBy("match_id").agg(F.collect_set("team").alias("teams"), F.collect_set("stuck_minutes").alias("ms"), F.collect_set("stuck_passes").alias("ps"))


@dataclass
class Fit:
    """What the tests know of the sources: one entry a feed or position."""

    level: dict[str, float] = field(default_factory=dict)
    position: dict[str, float] = field(default_factory=dict)
    phi: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    outliers: int = -1


IDENT = ["fm_player_id", "match_id", "minutes", "passes"]
COLUMNS = ["fm_player_id", "kickoff", "match_id", "minutes", "passes", "feed", "position", "impossible", "bad_minutes", "stuck_sheet", "row_id"]


class Readings:
    """The readings of a partition with its margins, as arrays; ``head`` is each reading's first row, ``of`` each row's reading."""

    def __init__(self, f: pd.DataFrame, limits: Limits):
        first = sequences.starts(f, IDENT)
        first |= f["fm_player_id"].isna().to_numpy()
        self.head, self.of = np.flatnonzero(first), np.cumsum(first) - 1
        h = f.iloc[self.head]
        player = h["fm_player_id"].to_numpy()
        self.key = pd.factorize(player)[0]
        self.key = np.where(self.key < 0, -1 - np.arange(len(h)), self.key)
        self.own = h["_own"].to_numpy(bool)
        self.minutes, self.passes = h["minutes"].to_numpy(float), h["passes"].to_numpy(float)
        self.feed, self.feeds = pd.factorize(h["feed"].fillna("?"))
        self.position, self.positions = pd.factorize(h["position"])
        whole = ~np.isnan(self.minutes) & ~np.isnan(self.passes)
        self.stuck = np.zeros(len(h), dtype=bool)
        w = np.flatnonzero(whole)
        if len(w):
            k, a, p = self.key[w], self.minutes[w], self.passes[w]
            new = np.r_[True, (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (p[1:] != p[:-1])]
            run = np.cumsum(new) - 1
            self.stuck[w] = np.bincount(run)[run] >= limits.run
        bad, sheet, odd = (h[c].to_numpy(bool) for c in ("bad_minutes", "stuck_sheet", "impossible"))
        # full length stands in where the minutes are missing or wrong: only counts beyond any match are then outliers
        self.at = np.maximum(np.where(bad | np.isnan(self.minutes), 120.0, self.minutes), 0.5)
        self.tested = ~np.isnan(self.passes) & (self.passes >= 0) & np.isfinite(self.passes)
        with np.errstate(invalid="ignore"):
            self.rate = np.where(self.tested, np.log(np.where(self.tested, self.passes, 0.0) + 0.5) - np.log(self.at), np.nan)
            self.usable = whole & self.tested & ~odd & ~sheet & ~self.stuck & (self.minutes >= limits.fit_minutes)
        self.known = ~np.isnan(self.minutes) & ~bad & self.tested


def _of(values: dict[str, float], names, codes: np.ndarray, default: float = 0.0) -> np.ndarray:
    return np.array([values.get(n, default) for n in names] or [default])[codes] if len(codes) else np.zeros(0)


def _around(r: Readings, use: np.ndarray, x: np.ndarray, reach: int, block: int = 1 << 16) -> np.ndarray:
    """Median of ``x`` over the used readings within ``reach`` on either side, drawn to 0 where there are few."""
    u = np.flatnonzero(use)
    out = np.zeros(len(x))
    if not len(u):
        return out
    at, ux, uk = np.cumsum(use) - use, x[u], r.key[u]
    for i in range(0, len(x), block):
        s = slice(i, i + block)
        j = at[s, None] + np.arange(-reach, reach + 1)
        good = (j >= 0) & (j < len(u))
        j = np.clip(j, 0, len(u) - 1)
        good &= uk[j] == r.key[s, None]
        v = np.sort(np.where(good, ux[j], np.inf), axis=1)
        n = good.sum(1)
        rows, m = np.arange(len(v)), np.maximum(n, 1)
        middle = (v[rows, (m - 1) // 2] + v[rows, m // 2]) / 2
        out[s] = np.where(n > 0, middle, 0.0) * n / (n + 1)
    return out


def _beside(r: Readings, use: np.ndarray, values: np.ndarray, step: int) -> np.ndarray:
    """``values`` of the ``step``-th used reading after (before, if negative) each reading of the same player; NaN without."""
    u = np.flatnonzero(use)
    out = np.full(len(values), np.nan)
    if len(u):
        before = np.cumsum(use) - use
        j = before + use + step - 1 if step > 0 else before + step
        good = (j >= 0) & (j < len(u))
        j = np.clip(j, 0, len(u) - 1)
        good &= r.key[u[j]] == r.key
        out[good] = values[u[j]][good]
    return out


def detect(r: Readings, fit: Fit, limits: Limits, inner: int = 4) -> dict[str, np.ndarray]:
    """The tests under a fit: outliers are found, taken out of the players' levels and neighbours, and looked for again."""
    base = _of(fit.level, r.feeds, r.feed) + _of(fit.position, r.positions, r.position)
    phi, scale = _of(fit.phi, r.feeds, r.feed), _of(fit.scale, r.feeds, r.feed, 0.5)
    x = r.rate - base
    out = np.zeros(len(x), dtype=bool)
    for _ in range(inner):
        use = r.usable & ~out
        level = _around(r, use, np.where(use, x, 0.0), limits.reach)
        e = np.where(r.known, x - level, np.nan)
        before, after = (np.nan_to_num(_beside(r, use, e, k)) for k in (-1, 1))
        carried = np.where(np.isnan(_beside(r, use, e, -1)), phi * after, phi * before)
        expected = np.exp(np.minimum(base + level + carried, 20.0)) * r.at
        s = np.sqrt(scale**2 + 1 / (expected + 1))
        # innovations forwards and backwards; further readings count with what they really are, outliers or not
        one, two = e - phi * before, e - phi * after
        additive = np.abs(np.where(np.isnan(x - level), np.nan, x - level) - carried) / s
        both = (one - phi * np.nan_to_num(_beside(r, r.usable, e, 1) - phi * e)) / (s * np.sqrt(1 + phi**2))
        additive = np.fmax(additive, np.abs(both))
        shifted = np.zeros(len(x))
        for side, start in ((1, one), (-1, two)):
            # a shift keeps its size: what lies farther out counts no more than that
            total, h, last, most = start.copy(), np.zeros(len(x)), e, np.abs(start)
            for k in range(1, limits.shift + 1):
                here = _beside(r, r.usable, e, side * k)
                total = total + np.nan_to_num((1 - phi) * np.clip(here - phi * last, -most, most))
                h += ~np.isnan(here)
                last = np.where(np.isnan(here), last, here)
            lam = np.abs(total) / (s * np.sqrt(1 + h * (1 - phi) ** 2))
            shifted = np.fmax(shifted, np.where(r.usable & (h >= 2), lam, 0.0))
        found = (additive > limits.critical) & (additive >= shifted) & r.tested
        new = found & r.usable
        if (new == out).all():
            break
        out = new
    with np.errstate(invalid="ignore"):
        many = (2 * (np.sqrt(np.where(r.tested, r.passes, 0.0)) - np.sqrt(expected)) > limits.z) & (r.passes > limits.ratio * expected)
    return {"spike": found & many, "out": out, "residual": e, "before": np.where(use, _beside(r, use, e, -1), np.nan), "use": use, "base": base, "innovation": one}


def _histogram(name: str, keys, codes: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    bins = np.floor(values * 100).astype(np.int64)
    got = pd.DataFrame({"c": codes, "bin": bins}).value_counts().reset_index(name="n")
    return pd.DataFrame({"name": name, "of": np.asarray(keys, dtype=object)[got["c"].to_numpy(np.int64)] if len(got) else [], "bin": got["bin"], "n": got["n"].astype(float)})


def _rates(r: Readings, use: np.ndarray) -> pd.DataFrame:
    """Histogram of the log rates a feed and position."""
    both = r.feed * len(r.positions) + r.position
    names = [f"{f}{SEP}{p}" for f in r.feeds for p in r.positions]
    return _histogram("rate", names, both[use], r.rate[use])


SEP = "\x00"


def _sums(r: Readings, fit: Fit, limits: Limits) -> pd.DataFrame:
    """What a partition adds to the next fit: histograms and sums a feed and position, of its own readings only."""
    if not fit.level:
        return _rates(r, r.usable & r.own)
    d = detect(r, fit, limits, inner=2)  # the rounds go on with what is left
    use = d["use"] & r.own
    pair = use & ~np.isnan(d["before"])
    size = 3 * _of(fit.scale, r.feeds, r.feed, 0.5)
    a, b = np.clip(d["residual"], -size, size)[pair], np.clip(d["before"], -size, size)[pair]
    parts = [_rates(r, use), _histogram("scale", r.feeds, r.feed[pair], np.abs(d["innovation"][pair]))]
    for name, v in (("cross", a * b), ("square", b * b)):
        parts.append(pd.DataFrame({"name": name, "of": np.asarray(r.feeds, dtype=object), "bin": 0, "n": np.bincount(r.feed[pair], v, len(r.feeds))}))
    parts.append(pd.DataFrame({"name": ["out"], "of": ["?"], "bin": [0], "n": [float((d["out"] & r.own).sum())]}))
    return pd.concat(parts, ignore_index=True)


def _medians(rows: pd.DataFrame) -> dict[str, float]:
    out = {}
    for of, g in rows.groupby(["of", "bin"])["n"].sum().reset_index().groupby("of"):
        total = g["n"].cumsum()
        out[of] = (g["bin"].iloc[int(np.searchsorted(total, total.iloc[-1] / 2))] + 0.5) / 100
    return out


def _levels(rates: pd.DataFrame) -> Fit:
    """Medians of the feeds, and of the positions once the feed's is off."""
    split = rates["of"].str.split(SEP, n=1, expand=True)
    level = _medians(rates.assign(of=split[0]))
    shifted = rates.assign(of=split[1], bin=rates["bin"] - (split[0].map(level) * 100).round().astype("int64"))
    return Fit(level, _medians(shifted))


def fit_sources(seq: DataFrame, around: dict, limits: Limits) -> Fit:
    """Levels, coefficients and scales of all sources; every round is one pass whose sums are a few rows a feed and position."""
    fit = Fit()
    for _ in range(limits.rounds + 1):
        work = lambda f, fit=fit: _sums(Readings(f, limits), fit, limits)
        got = sequences.map_with_margins(seq, around, work, "name string, of string, bin long, n double")
        rows = got.groupBy("name", "of", "bin").agg(F.sum("n").alias("n")).toPandas()
        part = {n: g for n, g in rows.groupby("name")}
        if "rate" not in part:
            return fit
        new = _levels(part["rate"])
        if not fit.level:
            fit = new
            continue
        scale = {of: 1.4826 * m for of, m in _medians(part["scale"]).items()} if "scale" in part else {}
        cross, square = (part[k].groupby("of")["n"].sum() if k in part else {} for k in ("cross", "square"))
        new.phi = {of: float(np.clip(cross[of] / square[of], -0.5, 0.95)) for of in scale if square[of] > 0}
        new.scale, new.outliers = {k: max(v, 0.05) for k, v in scale.items()}, int(part["out"]["n"].sum())
        still = new.outliers == fit.outliers and all(abs(new.phi[k] - fit.phi.get(k, 9)) < 0.01 for k in new.phi)
        fit = new
        if still:
            break
    return fit


def flag_readings(df: DataFrame, kickoff: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(row_id, impossible, spike, stuck_run, stuck_sheet) of the rows with any flag.

    ``df``: row_id, fm_player_id, match_id, team, position, minutes, passes_attempted, stage, feed, ingested_at;
    ``kickoff``: (match_id, kickoff) with at most one row a match, what orders a player's matches; matches it lacks are
    placed by their first delivery.
    """
    limits = limits or Limits()
    rows = df.select(
        "row_id", "fm_player_id", "match_id", "team", F.coalesce("position", F.lit("?")).alias("position"), F.coalesce("feed", F.lit("?")).alias("feed"), "stage",
        clean(F.col("minutes")).alias("minutes"), clean(F.col("passes_attempted")).alias("passes"), "ingested_at",
    )
    delivered = rows.groupBy("match_id").agg(F.min("ingested_at").alias("delivered"))
    known = delivered.join(kickoff, "match_id", "left").join(stuck_sheets(rows, limits), "match_id", "left")
    known = known.select("match_id", F.coalesce("kickoff", "delivered").alias("kickoff"), "teams", "ms", "ps")
    s = rows.drop("ingested_at").join(known, "match_id", "left")
    # a row whose team is missing belongs to the match's stuck sheet if it holds the same value
    there = F.col("team").isNull() | F.array_contains("teams", F.col("team"))
    at = lambda v, values: F.coalesce(F.array_contains(values, F.col(v)), F.lit(False))
    bad = F.coalesce((F.col("minutes") < 0) | (F.col("minutes") > _most(F.col("stage"), limits)) | (F.col("minutes") != F.floor("minutes")), F.lit(False))
    s = s.withColumn("stuck_sheet", F.coalesce(there & (at("minutes", "ms") | at("passes", "ps")), F.lit(False))).withColumn("bad_minutes", bad)
    s = s.withColumn("impossible", impossible(F.col("minutes"), F.col("passes"), F.col("stage"), limits))
    s = s.select(*COLUMNS, (F.col("minutes").isNotNull() & F.col("passes").isNotNull()).alias("whole"))
    seq = sequences.ordered(s, "fm_player_id", ["kickoff", "match_id", "minutes", "passes", "feed", "row_id"])
    around = sequences.margins(seq, IDENT, limits.margin, "whole")
    fit = fit_sources(seq, around, limits)

    def verdicts(f: pd.DataFrame) -> pd.DataFrame:
        r = Readings(f, limits)
        spike = detect(r, fit, limits)["spike"]
        out = pd.DataFrame({"row_id": f["row_id"], "impossible": f["impossible"].astype(bool), "spike": spike[r.of], "stuck_run": r.stuck[r.of], "stuck_sheet": f["stuck_sheet"].astype(bool)})
        hit = f["_own"].to_numpy(bool) & out[["impossible", "spike", "stuck_run", "stuck_sheet"]].to_numpy(bool).any(axis=1)
        return out[hit]

    return sequences.map_with_margins(seq, around, verdicts, "row_id long, impossible boolean, spike boolean, stuck_run boolean, stuck_sheet boolean")
