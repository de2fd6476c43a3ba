"""Visually identical text with different characters -> one consistent spelling.

Every character has a *resolved script set* (common and inherited ones have all scripts); the sets are intersected over each
token. An empty intersection is a mixed-script token, a token of another script than its name that consists of look-alikes
only is a whole-script confusable; both take the spelling of the script that the name is written in. What remains is
normalised: invisible characters go, widths and ligatures are folded, letters are precomposed, spaces, hyphens and
apostrophes get one form each.

Defined results: NULL stays NULL; a text of nothing but spaces or invisible characters becomes ''; names wholly in another
script, case, accents and word order stay; a letter without counterpart in the chosen script stays as it is.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# Look-alike letters of each script and their Latin counterparts.
CYRILLIC_LATIN = dict(zip("АВЕЅІЈКМНОРСТХҮЗаесіјѕорхуһԁԛԝАӀвнкмтг", "ABESIJKMHOPCTXY3aecijsopxyhdqwAIвнкмтг", strict=True))
GREEK_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρυκϲϳ", "ABEZHIKMNOPTYXovaipukcj", strict=True))
CYRILLIC_LATIN["У"] = "Y"
CYRILLIC_LATIN = {k: v for k, v in CYRILLIC_LATIN.items() if v.isascii() and v.isalpha()}
ARMENIAN_LATIN = dict(zip("օսհոցյքՕՍՏԼ", "ouhngjpOUSL", strict=True))
CHEROKEE_LATIN = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPSTVWZ", strict=True))
GREEK_CYRILLIC = dict(zip("ΑΒΕΗΙΚΜΟΡΤΧο", "АВЕНІКМОРТХо", strict=True))
# Letters that only look alike in capitals or small type, used if the chosen script has nothing closer.
LATIN_CYRILLIC_EXTRA = {"Y": "У", "k": "к", "3": "З"}
LATIN_GREEK_EXTRA = {"y": "γ", "n": "η", "w": "ω", "t": "τ", "k": "κ"}

HYPHENS = "‐‑‒–—―−⁃﹘﹣－"
APOSTROPHES = "‘’‛ʼʹʻ′`´＇՚ꞌ"
_FOLD = str.maketrans(dict.fromkeys(HYPHENS, "-") | dict.fromkeys(APOSTROPHES, "'"))
_INVISIBLE = re.compile(
    "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U000e0000-\U000e0fff\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]"
)
_SPACES = re.compile(r"[\s   -   　⠀]+")
_TOKEN = re.compile(r"[^ \-]+")
ALL = frozenset({"*"})
#: what is certainly consistent already: one script of precomposed, ordinary letters, single plain separators
CLEAN = r"^[A-Za-z.,'À-ÖØ-öø-ıĴ-ľŁ-ňŊ-žẠ-ỹ]+(?:[ -][A-Za-z.,'À-ÖØ-öø-ıĴ-ľŁ-ňŊ-žẠ-ỹ]+)*$"
_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "HIRAGANA", "KATAKANA", "HANGUL", "CJK", "ARABIC", "HEBREW", "ARMENIAN", "GEORGIAN", "DEVANAGARI", "THAI")
# Writing systems that mix scripts.
_SYSTEMS = {"HIRAGANA": {"HIRAGANA", "JPAN"}, "KATAKANA": {"KATAKANA", "JPAN"}, "CJK": {"CJK", "JPAN", "KORE"}, "HANGUL": {"HANGUL", "KORE"}}


@lru_cache(maxsize=70_000)
def script_set(ch: str) -> frozenset:
    """The resolved script set of a character; :data:`ALL` for common and inherited ones."""
    if unicodedata.category(ch)[0] not in "L":
        return ALL
    name = unicodedata.name(ch, "").split(" ")[0]
    if ch == "ー" or name not in _SCRIPTS:
        return frozenset({name}) if name not in ("MODIFIER", "") and ch != "ー" else ALL
    return frozenset(_SYSTEMS.get(name, {name}))


def intersect(token: str) -> frozenset:
    """The script set of a token: empty if it is mixed, :data:`ALL` if it has no letters."""
    out = ALL
    for ch in token:
        s = script_set(ch)
        if s is not ALL:
            out = s if out is ALL else out & s
            if not out:
                break
    return out


def _pairs() -> dict[str, dict[str, str]]:
    """target script -> {look-alike of another script: letter of the target}."""
    to: dict[str, dict[str, str]] = {"LATIN": CYRILLIC_LATIN | GREEK_LATIN, "CYRILLIC": {}, "GREEK": {}}
    for c, latin in CYRILLIC_LATIN.items():
        to["CYRILLIC"].setdefault(latin, c)
    for g, latin in GREEK_LATIN.items():
        to["GREEK"].setdefault(latin, g)
    for g, c in GREEK_CYRILLIC.items():
        to["CYRILLIC"].setdefault(g, c)
        to["GREEK"].setdefault(c, g)
    for c, latin in CYRILLIC_LATIN.items():
        if latin in to["GREEK"]:
            to["GREEK"].setdefault(c, to["GREEK"][latin])
    for g, latin in GREEK_LATIN.items():
        if latin in to["CYRILLIC"]:
            to["CYRILLIC"].setdefault(g, to["CYRILLIC"][latin])
    for c, latin in (ARMENIAN_LATIN | CHEROKEE_LATIN).items():
        to["LATIN"][c] = latin
        for script in ("CYRILLIC", "GREEK"):
            if latin in to[script]:
                to[script].setdefault(c, to[script][latin])
    to["CYRILLIC"] = LATIN_CYRILLIC_EXTRA | to["CYRILLIC"]
    to["GREEK"] = LATIN_GREEK_EXTRA | to["GREEK"]
    return to


LOOKALIKES = _pairs()


def _foreign(token: str, script: str) -> list[str]:
    return [ch for ch in token if script_set(ch) is not ALL and script not in script_set(ch)]


def _cost(text: str, script: str) -> tuple[int, int] | None:
    """(letters without counterpart, letters to change) for spelling ``text`` in ``script``."""
    table, foreign = LOOKALIKES[script], _foreign(text, script)
    return sum(ch not in table for ch in foreign), len(foreign)


def _respell(token: str, script: str) -> str:
    table = LOOKALIKES[script]
    return "".join(table.get(ch, ch) if script_set(ch) is not ALL and script not in script_set(ch) else ch for ch in token)


#: Compatibility forms that are no way of writing a letter: they stay.
_KEPT_FORMS = ("<fraction>", "<super>", "<sub>", "<circle>", "<square>", "<vertical>")


@lru_cache(maxsize=70_000)
def _ordinary(ch: str) -> str:
    """A character of ordinary width and without ligature."""
    form = unicodedata.decomposition(ch)
    return ch if not form.startswith("<") or form.startswith(_KEPT_FORMS) else unicodedata.normalize("NFKC", ch)


def consistent(text: str | None) -> str | None:
    """The one consistent form of a name."""
    if text is None:
        return None
    t = unicodedata.normalize("NFC", "".join(map(_ordinary, _INVISIBLE.sub("", text)))).translate(_FOLD)
    t = _SPACES.sub(" ", _INVISIBLE.sub("", t)).strip(" ")
    if intersect(t):  # one script, or one writing system, throughout
        return t
    letters = {s for ch in t for s in script_set(ch) if s != "*"} & LOOKALIKES.keys()
    if not letters:
        return t
    # the script of the name: that which leaves fewest letters without counterpart, then changes fewest
    known = "".join(ch for ch in t if script_set(ch) & LOOKALIKES.keys())
    home = min(sorted(letters), key=lambda s: (_cost(known, s), s != "LATIN"))

    def token(m: re.Match) -> str:
        w = m.group()
        scripts = intersect(w)
        if scripts is ALL or home in scripts:
            return w
        if not scripts:  # mixed: within the token the name's script wins where it can spell it all, else the cheapest
            best = home if _cost(w, home)[0] == 0 else min(sorted(letters), key=lambda s: _cost(w, s))
            return _respell(w, best)
        # whole-script confusable
        return _respell(w, home) if _cost(w, home)[0] == 0 else w

    return unicodedata.normalize("NFC", _TOKEN.sub(token, t))


@F.pandas_udf(StringType())
def consistent_udf(names: pd.Series) -> pd.Series:
    """Each distinct spelling of a batch is resolved once."""
    codes, uniques = pd.factorize(names)
    forms = pd.Series([consistent(u) for u in uniques], dtype=object)
    return pd.Series([None if c < 0 else forms[c] for c in codes], dtype=object)


def consistent_column(c: Column) -> Column:
    return consistent_udf(c)


def inconsistent(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text differs from its consistent form, with ``consistent_form``. Certainly clean rows never leave the JVM."""
    rest = df.filter(F.col(column).isNotNull() & ~F.col(column).rlike(CLEAN))
    return rest.withColumn("consistent_form", consistent_udf(F.col(column))).filter(F.col("consistent_form") != F.col(column))
