"""Scalar derivations as column expressions; NULL in, NULL out unless said otherwise."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Role buckets by words of a position, in order; a bucket needs one word of each of its groups.
ROLES = (
    ("CB", (("back",), ("center", "centre"))), ("FB", (("back",),)), ("DM", (("defensive midfield", "pivot"),)), ("CM", (("midfield",),)),
    ("W", (("wing",),)), ("ST", (("forward", "striker"),)), ("GK", (("keeper",),)),
)
# Positions by the share of the pitch's depth.
DEPTHS = ((0.15, "Goalkeeper"), (0.38, "Center Back"), (0.62, "Center Midfield"))
# Position names of short labels.
POSITION_NAMES = {
    "GK": "Goalkeeper", "RB": "Right Back", "LB": "Left Back", "CB": "Center Back", "DM": "Center Defensive Midfield", "CM": "Center Midfield", "W": "Winger", "ST": "Center Forward",
}
# Payouts by number of legs; words that make a round a knockout one; leagues of international football.
MULTIPLIERS = {2: 3.0, 3: 6.0, 4: 10.0, 5: 20.0}
KNOCKOUT_WORDS = ("Final", "16", "32", "Quarter", "Semi", "Knockout")
LEAGUE_WORDS = ("World Cup", "Friendl", "Qualif")
# Team names that differ between the sources.
TEAM_NAMES = {
    "Cabo Verde": "Cape Verde", "South Korea": "Korea Republic", "Korea": "Korea Republic", "United States": "USA", "China PR": "China",
    "Ivory Coast": "Cote d'Ivoire", "Czech Republic": "Czechia", "IR Iran": "Iran", "Republic of Ireland": "Ireland",
}


def _accents() -> tuple[str, str]:
    """Translation by canonical decomposition: each letter with marks to its bare letter, each mark to nothing."""
    marked, bare, marks = [], [], []
    for o in range(0x80, 0x10000):
        c = chr(o)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif unicodedata.decomposition(c) and not 0xD800 <= o < 0xE000:
            rest = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if len(rest) == 1 and rest != c:
                marked.append(c)
                bare.append(rest)
    return "".join(marked + marks), "".join(bare)


_MARKED, _BARE = _accents()


def fold(c: Column) -> Column:
    """Accents off (canonical decomposition, marks dropped), lower case with one form of sigma, no outer spaces; in the JVM."""
    return F.trim(F.translate(F.lower(F.translate(c, _MARKED, _BARE)), "ς", "σ"))


def team_name(c: Column) -> Column:
    """The one folded name of a team that sources name differently."""
    table = F.create_map(*[F.lit(x) for kv in TEAM_NAMES.items() for x in kv])
    return fold(F.coalesce(F.try_element_at(table, c), c))


def bound(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip that keeps NULL: SQL's least and greatest skip it."""
    x = c if low is None else F.greatest(c, F.lit(low))
    return F.when(c.isNotNull(), x if high is None else F.least(x, F.lit(high)))


def per90(passes: Column, minutes: Column) -> Column:
    return passes / bound(minutes, low=1.0) * 90


def role_bucket(position: Column) -> Column:
    """First role whose words the position has, in any order; wing-backs are full-backs; NULL and others are UNK."""
    p = F.lower(position)
    any_of = lambda words: reduce(lambda a, b: a | b, [p.contains(w) for w in words])
    out = F
    for role, groups in ROLES:
        out = out.when(reduce(lambda a, b: a & b, [any_of(g) for g in groups]), role)
    return out.otherwise("UNK")


def position_groups(position: Column) -> list[Column]:
    """Multi-hot groups (is_def, is_wing, is_mid, is_attack): a position may be in several; NULL is in none."""
    p = F.lower(F.coalesce(position, F.lit("")))
    back = p.contains("back")
    groups = {
        "def": back | p.contains("defensive midfield"), "wing": back & ~p.contains("center back") | p.contains("wing"), "mid": p.contains("midfield"),
        "attack": p.contains("attacking midfield") | p.contains("wing") | p.contains("forward") | p.contains("striker"),
    }
    return [c.cast("int").alias(f"is_{k}") for k, c in groups.items()]


def position_from_depth(depth: Column) -> Column:
    out = F.when(depth.isNull(), "Center Midfield")
    for limit, name in DEPTHS:
        out = out.when(depth <= limit, name)
    return out.otherwise("Center Forward")


def position_name(role: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in POSITION_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, role), F.lit("Center Midfield"))


def stage(round_name: Column) -> Column:
    """knockout where a word of the round says so, or where it is neither a number nor a group or stage: so '' and NULL too."""
    r = F.coalesce(round_name, F.lit(""))
    said = reduce(lambda a, b: a | b, [r.contains(w) for w in KNOCKOUT_WORDS])
    plain = F.trim(r).rlike("^[0-9]+$") | r.contains("Group") | r.contains("Stage")
    return F.when(said | ~plain, "knockout").otherwise("group")


def is_international(league: Column) -> Column:
    n = F.coalesce(league, F.lit(""))
    return ~n.contains("Club") & reduce(lambda a, b: a | b, [n.contains(w) for w in LEAGUE_WORDS])


def competition_name(league: Column) -> Column:
    """Qualifiers are told before finals, whose name they have too."""
    return F.when(league.contains("Qualif"), "WC Qualifier").when(league.contains("World Cup"), "World Cup 2026").otherwise("Intl Friendly")


def competition_flags(name: Column) -> list[Column]:
    n = F.lower(F.coalesce(name, F.lit("")))
    return [n.contains("qualif").cast("int").alias("is_qualifier"), n.contains("friendl").cast("int").alias("is_friendly"), n.contains("club").cast("int").alias("is_club")]


def numeric_flag(df: DataFrame, name: str) -> Column:
    """A 0/1 column, 0 where it is missing, unreadable or not there at all."""
    return F.coalesce(F.col(name).cast("string").try_cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def interval_text(mid: Column, moe: Column, low: Column, high: Column) -> Column:
    return F.format_string("%s ± %s  [%s, %s]", mid, moe, low, high)


def clock_minutes(c: Column) -> Column:
    """``MM:SS`` to minutes; anything else is NULL."""
    at = F.split(c, ":")
    return F.when(F.size(at) == 2, F.try_element_at(at, F.lit(1)).try_cast("double") + F.try_element_at(at, F.lit(2)).try_cast("double") / 60)


def minutes_from_positions(positions: Column, match_end: Column) -> list[Column]:
    """(minutes, started) from an array of struct(from, to, start_reason): on at the first, off at the last; open ends run to
    the match's end (90 if unknown); an empty or NULL array is 0 minutes, not started."""
    end = F.coalesce(match_end, F.lit(90.0))
    on = F.coalesce(clock_minutes(F.try_element_at(positions, F.lit(1))["from"]), F.lit(0.0))
    off = F.coalesce(clock_minutes(F.try_element_at(positions, F.lit(-1))["to"]), end)
    played = F.bround(F.greatest(F.lit(0.0), F.least(off, end) - on), 0)
    there = F.coalesce(F.size(positions) > 0, F.lit(False))
    started = F.coalesce(F.exists(positions, lambda x: x["start_reason"] == "Starting XI"), F.lit(False))
    return [F.when(there, played).otherwise(0.0).alias("minutes"), started.alias("started")]


def corrupt(minutes: Column, passes: Column) -> Column:
    """Rates beyond reason; unknown minutes are kept."""
    return F.coalesce((per90(passes, minutes) > 150) | ((minutes < 5) & (passes > 8)), F.lit(False))


def percent(c: Column) -> Column:
    return F.regexp_replace(c, "%", "").try_cast("double")


def synthetic_id(name: Column, offset: int = 1_000_000_000) -> Column:
    """Stable negative id of a name that has none."""
    return -(F.pmod(F.xxhash64(name), F.lit(offset)) + 1)


def prob_over(samples: Column, line: Column) -> Column:
    """Share of samples at or above the line's next integer."""
    return F.try_divide(F.size(F.filter(samples, lambda x: x >= F.ceil(line))).cast("double"), F.when(F.size(samples) > 0, F.size(samples)))


def nb_tail(mu: Column, alpha: Column, threshold: Column) -> Column:
    """P(Y >= threshold) of a negative binomial by the mass recurrence, without special functions."""
    p = alpha / (alpha + mu)
    first = F.struct(F.exp(alpha * F.ln(p)).alias("mass"), F.lit(0.0).alias("total"))
    step = lambda acc, k: F.struct(
        (acc["mass"] * (k + alpha) / (k + 1) * (1 - p)).alias("mass"), (acc["total"] + acc["mass"]).alias("total")
    )
    below = F.aggregate(F.sequence(F.lit(0), F.greatest(threshold.cast("int") - 1, F.lit(0))), first, step, lambda acc: acc["total"])
    return F.when(threshold <= 0, 1.0).otherwise(1 - below)


def crps(samples: Column, y: Column) -> Column:
    """Energy form over a sorted array: mean |x - y| - sum((2i - n - 1) x_i) / n^2. One fold: the array is sorted once a row."""
    s = F.sort_array(F.filter(samples, lambda x: x.isNotNull()))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("near"), F.lit(0.0).alias("all"), F.lit(0.0).alias("placed"))

    def add(a: Column, x: Column) -> Column:
        n = a["n"] + 1
        return F.struct(n.alias("n"), (a["near"] + F.abs(x - y)).alias("near"), (a["all"] + x).alias("all"), (a["placed"] + 2 * n * x).alias("placed"))

    n = lambda a: a["n"]
    return F.aggregate(s, zero, add, lambda a: F.when(n(a) > 0, a["near"] / n(a) - (a["placed"] - (n(a) + 1) * a["all"]) / (n(a) * n(a))))


def log_loss(p: Column, y: Column, clip: float = 1e-6) -> Column:
    q = bound(p, clip, 1 - clip)
    return -F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def breakeven(legs: int, multiplier: float | None = None) -> float:
    return (1 / (multiplier or MULTIPLIERS[legs])) ** (1 / legs)
