"""The same people under unrelated ids: matched by name, team and appearances, with a calibrated confidence.

Names are folded (one script, no accents, phonetic classes) and each name word is encoded as a fixed bit vector of its
bigrams. Words that are close are found *exactly* within a Hamming radius by multi-index hashing: of ``RADIUS + 1`` slices of
a vector at least one is equal in any two vectors that differ in at most ``RADIUS`` bits, so an equi-join on (team, slice,
value) meets every such pair. Field-weighted Dice scores of names and appearances become confidences: the name score through a
monotone calibration against the appearances in matches that both providers cover, the appearances as evidence on top.

Defined results: rows without id, player or team take no part, ids without any such row don't come out; double rows count
once; ties go to the lower id; the output has one row a candidate pair, ``matched`` tells the verdict.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from touchline.llm.confusables import consistent
from touchline.session import cut

BITS, RADIUS = 64, 6
#: Weights of the fields in the raw score, and what a match in which only one of the two appears, or both, is worth.
NAME_WEIGHT, APPEARANCE_WEIGHT = 0.7, 0.3
BOTH, ONE, CLASH, THRESHOLD, BIN = 1.6, -1.1, -2.0, 0.5, 0.05
#: Letters of a word that is searched by itself; names of up to so many letters are searched whole too; least name score of a candidate.
WORD, SHORT_NAME, LEAST = 3, 7, 0.4

# Transliterations and particles of names.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґјљњћџѕ", "a b v g d e e zh z i j k l m n o p r s t u f h c ch sh sch  y  e yu ya i i e g j lj nj c dz s".split(" "), strict=True))
GREEK_PAIRS = (("γι", "j"), ("μπ", "b"), ("ντ", "nd"), ("γκ", "g"), ("ου", "u"), ("τζ", "dz"))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t u f h ps o".split(" "), strict=True))
LETTERS = {"ł": "l", "ø": "o", "đ": "d", "ð": "d", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ŋ": "n", "ħ": "h"}
PARTICLES = frozenset("de da di do dos das del della van von der den ten ter al el bin ibn la le y e".split(" "))
TEAM_SHORT = {"st": "saint", "n": "north", "s": "south"}
TEAM_WORDS = frozenset("republic of the national team nt dr fc".split(" "))


def to_latin(s: str) -> str:
    s = s.lower().replace("ό", "ο")
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c) or c == "̆")
    s = unicodedata.normalize("NFC", s)
    for a, b in GREEK_PAIRS:
        s = s.replace(a, b)
    s = "".join(CYRILLIC.get(c, GREEK.get(c, LETTERS.get(c, c))) for c in s)
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def sound(word: str) -> str:
    """Phonetic class of a folded word: spellings that transliterations and feeds exchange fall together."""
    w = word.replace("ks", "x").replace("kz", "x").replace("cz", "x").replace("ph", "f").replace("h", "")
    w = w.translate(str.maketrans("yjwqczx", "iivkkss"))
    return "".join(c for i, c in enumerate(w) if i == 0 or c != w[i - 1])


@lru_cache(maxsize=200_000)
def name_words(name: str) -> tuple[str, ...]:
    """Folded words of a name without particles, in order; an initial stays one letter."""
    s = to_latin(consistent(name) or "").replace("'", "")
    words = "".join(c if c.isalnum() else " " for c in s).split()
    kept = [w for w in words if w not in PARTICLES] or words
    # O'Name and Name are told apart by too few feeds
    kept = [w[1:] if len(w) > 4 and w[0] == "o" and ("o'" + w[1:3]) in name.lower().replace("’", "'") else w for w in kept]
    return tuple(sound(w) for w in kept if sound(w))


def team_key(team: str) -> str:
    words = "".join(c if c.isalnum() else " " for c in to_latin(consistent(team) or "")).split()
    return "".join(sound(TEAM_SHORT.get(w, w)) for w in ([w for w in words if w not in TEAM_WORDS] or words))


def bigrams(word: str) -> list[str]:
    return [a + b for a, b in zip(f"^{word}", f"{word}$", strict=True)]


@lru_cache(maxsize=100_000)
def vector(word: str) -> int:
    """The word's bigrams in a fixed bit vector, as a signed long."""
    out = 0
    for g in set(bigrams(word)):
        out |= 1 << (xxhash.xxh64_intdigest(g.encode()) % BITS)
    return out - (1 << 64) if out >> 63 else out


def _edits(a: str, b: str) -> int:
    """Edit distance with transpositions."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y)))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                now[j] = min(now[j], before[j - 2] + 1)
        before, row = row, now
    return row[-1]


@lru_cache(maxsize=500_000)
def word_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0 if len(a) > 1 else 0.6
    short, long = sorted((a, b), key=len)
    if len(short) == 1:
        return 0.6 if long[0] == short else 0.0
    if len(short) >= 3 and long.startswith(short):
        return 0.85
    d = _edits(a, b)
    if d <= 1 + (len(short) >= 7) and len(short) >= 4:
        return 0.95 - 0.08 * d
    x, y = Counter(bigrams(a)), Counter(bigrams(b))
    dice = 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))
    return 0.8 * dice if dice >= 0.6 else 0.0


def name_similarity(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Weighted Dice over the words of two names: words dropped from the longer one cost little, contradicting ones much."""
    if not a or not b:
        return 0.0
    if sorted(a) == sorted(b):
        return 1.0
    short, long = sorted((a, b), key=len)
    left, got, weight = list(long), 0.0, 0.0
    for w in sorted(short, key=len, reverse=True):
        best = max(left, key=lambda x: word_similarity(w, x))
        s = word_similarity(w, best)
        share = min(len(w), 6) if len(w) > 1 else 3
        got, weight = got + s * share, weight + share
        if s > 0:
            left.remove(best)
        if not left:
            break
    score = got / weight
    if len(short) == 1 and len(long) > 1:
        score *= 0.8  # a lone word leaves the rest open
    return score * (1 - 0.02 * len([x for x in left if len(x) > 1]))


@F.pandas_udf(T.ArrayType(T.StringType()))
def words_udf(names: pd.Series) -> pd.Series:
    return pd.Series([list(name_words(n)) for n in names])


@F.pandas_udf(T.StringType())
def team_udf(teams: pd.Series) -> pd.Series:
    codes, uniques = pd.factorize(teams)
    keys = np.array([team_key(u) for u in uniques], dtype=object)
    return pd.Series(keys[codes] if len(keys) else [], dtype=object)


@F.pandas_udf(T.LongType())
def vector_udf(words: pd.Series) -> pd.Series:
    return pd.Series([vector(w) for w in words], dtype="int64")


@F.pandas_udf(T.DoubleType())
def similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Best similarity of any two ways the two ids are written."""
    return pd.Series([max((name_similarity(tuple(x), tuple(y)) for x in p for y in q), default=0.0) for p, q in zip(a, b, strict=True)], dtype=float)


def slices(df: DataFrame, v: str) -> DataFrame:
    """One row a slice of the vector: ``slice`` numbers it, ``part`` is its value."""
    width = -(-BITS // (RADIUS + 1))
    parts = [F.expr(f"struct({i} AS slice, shiftrightunsigned({v}, {i * width}) & {(1 << width) - 1}L AS part)") for i in range(RADIUS + 1)]
    return df.select("*", F.explode(F.array(*parts)).alias("s")).select("*", "s.slice", "s.part").drop("s")


def close_pairs(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """(a, b): ids with vectors ``v`` within the radius, in the same ``block``. Every such pair once."""
    return close_in_blocks(left, right, block).select("a", "b").distinct()


def close_in_blocks(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """(block, a, b), each pair once: it comes out of the first of the slices in which the two agree."""
    x = slices(left.select(F.col("id").alias("a"), block, F.col("v").alias("va")), "va")
    y = slices(right.select(F.col("id").alias("b"), block, F.col("v").alias("vb")), "vb")
    apart = F.col("va").bitwiseXOR(F.col("vb"))
    width = -(-BITS // (RADIUS + 1))
    first = F.lit(RADIUS)
    for i in range(RADIUS - 1, -1, -1):
        first = F.when(F.expr(f"shiftrightunsigned(va ^ vb, {i * width}) & {(1 << width) - 1}L") == 0, i).otherwise(first)
    # narrow rows, much work a byte: a number of partitions that isn't merged again
    x = x.repartition(4 * left.sparkSession.sparkContext.defaultParallelism, block, "slice", "part")
    return x.join(y, [block, "slice", "part"]).filter((F.bit_count(apart) <= RADIUS) & (F.col("slice") == first)).select(block, "a", "b")


def search_words(forms: DataFrame) -> DataFrame:
    """(provider, id, key, word): what of each way an id is written is searched, once.

    Words of three letters or more; the whole name, its words in order of the alphabet and without spaces, where it has none or is
    short, so that names of very short words are found like any other.
    """
    whole = F.array_join(F.array_sort("words"), "")
    long = F.filter("words", lambda w: F.length(w) >= WORD)
    both = F.when((F.size(long) == 0) | (F.length(whole) <= SHORT_NAME), F.array_union(long, F.array(whole))).otherwise(long)
    return forms.select("provider", F.col("player_id").alias("id"), "key", F.explode(both).alias("word")).filter(F.length("word") > 0).distinct()


def candidates(forms: DataFrame, one: str, other: str) -> DataFrame:
    """(a, b): ids of the two providers with a close word in the same team. Different words of a team are searched, not people."""
    words = cut(search_words(forms))
    side = lambda p: words.filter(F.col("provider") == p).select("key", "word").distinct().select("key", F.col("word").alias("id"), vector_udf("word").alias("v"))
    close = close_in_blocks(side(one), side(other), "key")
    of = lambda p, i, w: words.filter(F.col("provider") == p).select("key", F.col("word").alias(w), F.col("id").alias(i))
    met = close.withColumnsRenamed({"a": "wa", "b": "wb"}).join(of(one, "a", "wa"), ["key", "wa"]).join(of(other, "b", "wb"), ["key", "wb"])
    return met.select("a", "b").distinct()


def canonical_teams(rows: DataFrame, one: str = "statsbomb") -> DataFrame:
    """(team, key): team names of either provider under one key; rare misspellings go to the frequent name next to them."""
    first = F.count_if(F.col("provider") == one)
    named = rows.groupBy("team").agg(F.count("*").alias("n"), first.alias("n1")).withColumn("key", team_udf("team"))
    keys = named.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).withColumn("v", vector_udf("key")).withColumn("block", F.lit(0))
    keys = cut(keys)
    ids = keys.select(F.col("key").alias("id"), "block", "v")
    # what both providers write is no misspelling
    rare = keys.filter("n1 = 0 or n1 = n").select(F.col("key").alias("id"), "block", "v")
    # a misspelling is rare beside the right name, or one provider knows only the one and the other only the other
    near = close_pairs(rare, ids, "block").filter("a <> b")
    n = lambda i: keys.select(F.col("key").alias(i), F.col("n").alias(f"n{i}"), F.col("n1").alias(f"first_{i}"))
    near = near.join(n("a"), "a").join(n("b"), "b")
    same_letters = F.array_sort(F.split("a", "")) == F.array_sort(F.split("b", ""))
    apart = (F.col("first_a") == 0) & (F.col("first_b") == F.col("nb"))
    typo = ((F.col("na") * 8 <= F.col("nb")) | apart) & ((F.levenshtein("a", "b") <= 1) | (same_letters & (F.levenshtein("a", "b") <= 2)))
    to = near.filter(typo).groupBy("a").agg(F.max_by("b", F.struct("nb", "b")).alias("right"))
    return named.join(to.withColumnRenamed("a", "key"), "key", "left").select("team", F.coalesce("right", "key").alias("key"))


def monotone(counts: pd.DataFrame) -> list[tuple[float, float]]:
    """Pool-adjacent-violators over (bin, yes, all): (lower edge, probability), never falling."""
    blocks: list[list[float]] = []
    for r in counts.sort_values("bin").itertuples():
        blocks.append([r.bin, r.yes + 0.5, r.all + 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2]:
            _, y, n = blocks.pop()
            blocks[-1][1] += y
            blocks[-1][2] += n
    return [(b[0] * BIN, b[1] / b[2]) for b in blocks]


def match_people(table: DataFrame, one: str = "statsbomb", other: str = "fotmob") -> DataFrame:
    """(player_id_a, player_id_b, name_score, covered_both, covered_one, clashes, confidence, matched) of candidate pairs.

    ``table``: provider (``one`` or ``other``), player_id, player, team, match_date, minutes. ``a`` is the first provider's id
    and the smaller one wherever its ids lie below the other provider's.
    """
    return _matched(table, one, other)[0]


def calibration(table: DataFrame, one: str = "statsbomb", other: str = "fotmob") -> DataFrame:
    """(bin, pairs, confidence, together): held-out reliability of the name score's confidence.

    The step function is fitted on the pairs of one half of the first provider's ids (by a hash) and judged on the other half:
    mean confidence and the share of pairs that also appear together, by tenths of the confidence.
    """
    seen = _matched(table, one, other)[1]
    half = F.pmod(F.xxhash64("a"), F.lit(2)) == 0
    p = _confidence_of_name(seen.filter(half))
    judged = seen.filter(~half).withColumn("p", p)
    return judged.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin")).agg(
        F.count("*").alias("pairs"), F.round(F.avg("p"), 4).alias("confidence"), F.round(F.avg((F.col("appearance_dice") >= 0.5).cast("double")), 4).alias("together")
    )


def _confidence_of_name(seen: DataFrame):
    """The monotone step function of the name score, as a column; at most 21 rows come to the driver."""
    counts = seen.groupBy(F.floor(F.col("name_score") / BIN).alias("bin")).agg(F.count_if(F.col("appearance_dice") >= 0.5).alias("yes"), F.count("*").alias("all"))
    steps = monotone(counts.toPandas()) or [(0.0, 0.02), (0.7, 0.6), (0.9, 0.95)]
    p = F.lit(steps[0][1])
    for edge, prob in steps:
        p = F.when(F.col("name_score") + 1e-9 >= edge, F.lit(float(prob))).otherwise(p)
    return F.greatest(F.least(p, F.lit(0.99)), F.lit(0.005))


def _matched(table: DataFrame, one: str, other: str) -> tuple[DataFrame, DataFrame]:
    """(all candidate pairs with verdicts, those with appearances to calibrate on)."""
    rows = table.filter("player is not null and team is not null and player_id is not null").select(
        "provider", "player_id", "player", "team", "match_date", F.when(~F.isnan("minutes"), F.col("minutes")).alias("minutes")
    )
    teams = cut(canonical_teams(rows, one))
    forms = rows.groupBy("provider", "player_id", "player", "team").agg(F.count("*").alias("n")).join(teams, "team")
    forms = cut(forms.withColumn("words", words_udf("player")).select("provider", "player_id", "key", "words", "n"))
    ways = forms.groupBy("provider", "player_id").agg(F.collect_set("words").alias("ways"))
    pairs = candidates(forms, one, other)
    of = lambda p, i, w: ways.filter(F.col("provider") == p).select(F.col("player_id").alias(i), F.col("ways").alias(w))
    # few bytes, much work a pair: a number of partitions that isn't merged again
    many = 4 * table.sparkSession.sparkContext.defaultParallelism
    pairs = pairs.join(of(one, "a", "wa"), "a").repartition(many, "b").join(of(other, "b", "wb"), "b")
    pairs = cut(pairs.withColumn("name_score", similarity_udf("wa", "wb")).filter(F.col("name_score") >= LEAST).select("a", "b", "name_score"))

    # appearances in matches that both providers have for the team
    played = rows.join(teams, "team").filter("minutes > 0").groupBy("provider", "player_id", "key", F.col("match_date").alias("at")).agg(F.max("minutes").alias("m"))
    both = played.groupBy("key", "at").agg(F.count_distinct("provider").alias("p")).filter("p = 2").select("key", "at")
    played = cut(played.join(both, ["key", "at"]).groupBy("provider", "player_id", "at").agg(F.max("m").alias("m")))
    total = played.groupBy("provider", "player_id").agg(F.count("*").alias("n"))
    tot = lambda p, i, n: total.filter(F.col("provider") == p).select(F.col("player_id").alias(i), F.col("n").alias(n))
    app = lambda p, i, m: played.filter(F.col("provider") == p).select(F.col("player_id").alias(i), "at", F.col("m").alias(m))
    met = pairs.join(app(one, "a", "ma"), "a").join(app(other, "b", "mb"), ["b", "at"])
    clash = F.abs(F.col("ma") - F.col("mb")) > 12
    met = met.groupBy("a", "b").agg(F.count("*").alias("covered_both"), F.count_if(clash).alias("clashes"))
    s = pairs.join(met, ["a", "b"], "left").join(tot(one, "a", "na"), "a", "left").join(tot(other, "b", "nb"), "b", "left")
    s = s.fillna(0, ["covered_both", "clashes", "na", "nb"])
    s = s.withColumn("covered_one", F.col("na") + F.col("nb") - 2 * F.col("covered_both"))
    dice = F.try_divide(2.0 * (F.col("covered_both") - F.col("clashes")), F.col("na") + F.col("nb"))
    s = cut(s.withColumn("appearance_dice", F.when((F.col("na") > 0) & (F.col("nb") > 0), dice)))

    # calibration: how often pairs of a name score also appear together
    seen = s.filter("na + nb >= 3 and appearance_dice is not null")
    p = _confidence_of_name(seen)
    evidence = BOTH * (F.col("covered_both") - F.col("clashes")) + ONE * F.col("covered_one") + CLASH * F.col("clashes")
    evidence = F.greatest(F.least(evidence, F.lit(6.0)), F.lit(-6.0))
    logit = F.ln(p / (1 - p)) + F.when((F.col("na") > 0) & (F.col("nb") > 0), evidence).otherwise(0.0)
    s = s.withColumn("confidence", F.round(1 / (1 + F.exp(-logit)), 6))
    raw = NAME_WEIGHT * F.col("name_score") + APPEARANCE_WEIGHT * F.coalesce("appearance_dice", F.lit(0.5))
    rank = F.struct(F.col("confidence"), raw, -F.col("a"), -F.col("b"))
    s = s.withColumn("of_a", F.max(rank).over(W.partitionBy("a"))).withColumn("of_b", F.max(rank).over(W.partitionBy("b")))
    s = s.withColumn("best_a", rank == F.col("of_a")).withColumn("best_b", rank == F.col("of_b"))
    s = cut(s.drop("of_a", "of_b"))
    # a person under two ids of one provider: the second is as sure of the same partner and never plays beside the first
    top = s.filter("best_b").select("b", F.col("a").alias("first"), F.col("name_score").alias("first_score"))
    second = s.filter(f"best_a and not best_b and confidence >= {THRESHOLD} and name_score >= 0.75").select("a", "b", "name_score").join(top, "b")
    second = second.filter("name_score >= 0.8 * first_score")
    when = rows.filter((F.col("provider") == one) & (F.col("minutes") > 0)).select("player_id", "match_date").distinct()
    beside = second.join(when.select(F.col("player_id").alias("a"), "match_date"), "a").join(when.select(F.col("player_id").alias("first"), "match_date"), ["first", "match_date"])
    second = second.select("a", "b").join(beside.select("a", "b"), ["a", "b"], "left_anti").withColumn("again", F.lit(True))
    s = s.join(second, ["a", "b"], "left")
    matched = F.coalesce((F.col("confidence") >= THRESHOLD) & F.col("best_a") & (F.col("best_b") | F.coalesce("again", F.lit(False))), F.lit(False))
    out = s.select(
        F.least("a", "b").alias("player_id_a"), F.greatest("a", "b").alias("player_id_b"), "name_score", "covered_both", "covered_one", "clashes",
        "confidence", matched.alias("matched"),
    )
    return out, seen
