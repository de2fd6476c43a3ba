"""Text garbled by a wrong character encoding: found and restored with mappings learned from clean near-twins.

A garbled record and its clean near-twin are equal once their non-ASCII characters are stripped. Two kinds of records are
joined on what is left: words with ASCII letters or digits on these and the places of the gaps; runs of words without any on
the lengths of the words (a garbled one has a character a byte). Each record meets the commonest one of its key only, so a key
with many records emits no pairs among them. The gaps are aligned, and each pair of aligned gaps says which transformations
("read as ... though written in ...") could have made the one from the other; those that explain all gaps of enough records,
and hardly ever the other way round, are *learned*. Codecs are looked at only here, as names of what the alignment shows.

What was learned is then applied to every word of the corpus:

* byte sequences that are strict UTF-8 under a learned reading are restored, as often as that goes (text garbled more than
  once), if no other letter beyond ASCII is in the word and the result is of one script and made of characters that words not
  garbled use, or else if it is a word of the corpus;
* readings of single bytes as other single bytes, and of two bytes as one character, are ambiguous: their result must be a
  word of the corpus, and for single bytes one that many more texts hold.

Defined results: NULL, empty and pure ASCII texts are clean; replacement characters and control characters of the C1 block
count as garbled but are not restorable; exact copies share the verdict of their text and count as one text; an ambiguous word
of one or two characters is restored beside longer ones of the same transformation, but by itself makes no document garbled.
"""

from __future__ import annotations

import encodings.aliases
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from touchline.llm.confusables import intersect
from touchline.session import cut

_WIDE = "\\x{80}-\\x{1FFF}\\x{200B}-\\x{2027}\\x{202A}-\\x{202E}\\x{2030}-\\x{2FFF}\\x{3001}-\\x{10FFFF}"
#: A word with something beyond ASCII; wide spaces part words, NBSP doesn't, since it is half of a garbled à.
WORD = f"(?<![A-Za-z0-9])[A-Za-z0-9]*+[{_WIDE}][A-Za-z0-9{_WIDE}]*+"
#: Words without ASCII letters or digits, and the single spaces between them.
SEQUENCE = f"(?<![A-Za-z0-9{_WIDE}])[{_WIDE}]++(?: [{_WIDE}]++)*+(?![A-Za-z0-9])"
_WORD = re.compile("[A-Za-z0-9\x80-῿​-‧‪-‮‰-⿿、-\U0010ffff]+")
_GAP = re.compile(r"[^\x00-\x7f]+")
NON_ASCII = r"[^\x{00}-\x{7F}]"
LOST = r"[\x{FFFD}\x{80}-\x{84}\x{86}-\x{9F}]"
#: Parameters: records that make a transformation learned, by kind; how many more texts must hold the clean twin of an ambiguous
#: word; how many records may speak for the opposite direction to each that speaks for it; texts that make a character usual.
UTF8_SUPPORT, SUPPORT, RATIO, AGAINST, USUAL = 2, 3, 8, 0.1, 3
#: Garbled words that may be broadcast (some 100 bytes each).
BROADCAST = 100_000
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


@lru_cache(maxsize=1)
def codecs_by_width() -> tuple[dict[str, dict[int, str]], tuple[str, ...]]:
    """(single-byte codecs with the characters of their upper half, multi-byte codecs): all the library has that keep ASCII."""
    ascii_bytes, single, multi, seen = bytes(range(32, 127)), {}, [], set()
    for name in sorted({v for v in encodings.aliases.aliases.values()} | {"iso8859_15", "koi8_u"}):
        try:
            if name.startswith(("utf", "raw", "unicode")) or ascii_bytes.decode(name) != ascii_bytes.decode("ascii"):
                continue
            upper = {}
            for b in range(128, 256):
                try:
                    upper[b] = bytes([b]).decode(name)
                except UnicodeDecodeError:
                    pass
            if len(upper) > 80 and all(len(c) == 1 for c in upper.values()):
                if tuple(upper.items()) not in seen:
                    seen.add(tuple(upper.items()))
                    single[name] = upper
            elif b"\xc3\xa9".decode(name, "replace") != b"\xc3\xa9".decode("ascii", "replace"):
                multi.append(name)
        except (LookupError, UnicodeError, ValueError):
            continue
    return single, tuple(multi)


@lru_cache(maxsize=1)
def _tables() -> tuple[dict, dict, dict]:
    """(codec -> character -> byte as read, (character, byte) -> codecs that read it so, character -> {byte: codecs that write it so})."""
    read: dict[str, dict[str, int]] = {}
    reads, writes = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for name, upper in codecs_by_width()[0].items():
        # bytes without a character come through as controls
        read[name] = {chr(b): b for b in range(128, 256) if b not in upper} | {c: b for b, c in upper.items()}
        for c, b in read[name].items():
            reads[c, b].add(name)
        for b, c in upper.items():
            writes[c][b].add(name)
    return read, {k: frozenset(v) for k, v in reads.items()}, writes


@lru_cache(maxsize=200_000)
def _swaps(garbled: str, clean: str) -> frozenset:
    """Single-byte transformations that turn one character into another."""
    _, reads, writes = _tables()
    return frozenset(f"{w}>{r}" for b, rs in writes.get(clean, {}).items() for w in reads.get((garbled, b), ()) for r in rs if w != r)


def explanations(garbled: str, clean: str) -> frozenset:
    """Transformations that turn the run ``clean`` into the run ``garbled``, by character alignment."""
    raw, found = clean.encode("utf-8", "surrogatepass"), set()
    if len(garbled) == len(raw):
        reads, some = _tables()[1], None
        for c, b in zip(garbled, raw, strict=True):
            one = reads.get((c, b), frozenset())
            some = one if some is None else some & one
            if not some:
                break
        found |= {f"{w}>utf-8" for w in some or ()}
    if len(clean) <= len(garbled) <= len(raw):
        found |= _multi(garbled, raw)
    if len(garbled) == len(clean):
        some = None
        for g, c in zip(garbled, clean, strict=True):
            if g != c:
                one = _swaps(g, c)
                some = one if some is None else some & one
                if not some:
                    break
            elif some is None and len(garbled) == 1:
                return frozenset(found)
        found |= some or set()
    return frozenset(found)


@lru_cache(maxsize=50_000)
def _multi(garbled: str, raw: bytes) -> frozenset:
    out = set()
    for w in codecs_by_width()[1]:
        try:
            if raw.decode(w) == garbled:
                out.add(f"{w}>utf-8")
        except UnicodeDecodeError:
            pass
    return frozenset(out)


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Gaps (non-ASCII runs) of twins, paired by their places between the same ASCII characters."""
    a, b = _GAP.findall(garbled), _GAP.findall(clean)
    return list(zip(a, b, strict=True)) if _GAP.sub("*", garbled) == _GAP.sub("*", clean) and len(a) == len(b) else []


def decode_sequences(word: str, w: str) -> tuple[str, bool] | None:
    """(the word with its strict UTF-8 sequences under the reading ``w`` decoded and all else kept, whether all its letters beyond
    ASCII are in such sequences); None without any."""
    if w in _tables()[0]:
        out, rest, last = [], [], 0
        for m in _UTF8.finditer(word.translate(_translation(w))):
            try:
                c = m.group().encode("latin-1").decode("utf-8")
            except UnicodeDecodeError:
                continue
            rest.append(word[last : m.start()])
            out += [rest[-1], c]
            last = m.end()
        rest.append(word[last:])
        return ("".join([*out, rest[-1]]), not any(c.isalpha() and ord(c) > 127 for part in rest for c in part)) if out else None

    def gap(m: re.Match) -> str:
        try:
            return m.group().encode(w).decode("utf-8")
        except UnicodeError:
            return m.group()

    s = _GAP.sub(gap, word)
    return (s, True) if s != word else None


@lru_cache(maxsize=200)
def _translation(w: str) -> dict[int, int]:
    """Characters beyond ASCII to the code points of their bytes under a reading; those it doesn't have to none of a byte."""
    have = {ord(c): b for c, b in _tables()[0][w].items()}
    return {o: 0x100 for o in range(128, 256) if o not in have} | have


@lru_cache(maxsize=4096)
def _swap_table(name: str) -> dict[int, str]:
    w, _, r = name.partition(">")
    upper = codecs_by_width()[0][r]
    return {ord(c): upper[b] for c, b in _tables()[0][w].items() if b in upper}


def transform(word: str, name: str) -> str | None:
    """The word under a transformation ``read>written``, or None if it has no such sequence or character."""
    w, _, r = name.partition(">")
    if r == "utf-8":
        found = decode_sequences(word, w)
        return found[0] if found else None
    table = _swap_table(name)
    if any(ord(c) > 127 and ord(c) not in table for c in word):
        return None
    s = word.translate(table)
    return s if s != word else None


def is_utf8(t: Column) -> Column:
    return t.endswith(">utf-8")


def _is_multi(t: Column) -> Column:
    return t.isin([f"{w}>utf-8" for w in codecs_by_width()[1]])


def text_key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def beyond_ascii(c: Column) -> Column:
    return F.length(c) != F.octet_length(c)


def marked(text: Column) -> Column:
    """The text with each pure ASCII stretch between spaces as a dot: what patterns over the rest have to read."""
    return F.array_join(F.transform(F.split(text, " "), lambda x: F.when(beyond_ascii(x), x).otherwise(".")), " ")


def words_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, words, runs): the different words beyond ASCII of each document that has any, and its different runs of
    words without ASCII letters or digits. The only pass of patterns over the texts; texts themselves don't move."""
    held = docs.filter(beyond_ascii(F.col("text"))).select("doc_id", text_key(F.col("text")).alias("text_key"), marked(F.col("text")).alias("m"))
    found = lambda pattern: F.array_distinct(F.regexp_extract_all("m", F.lit(pattern), F.lit(0)))
    return held.select("doc_id", "text_key", found(WORD).alias("words"), F.filter(found(SEQUENCE), lambda x: F.length(x) >= 4).alias("runs"))


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, texts): how many different texts hold a word; ``words`` as of :func:`words_of`."""
    first = words.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    one = words.select("doc_id", "words").join(first, "doc_id", "left_semi")
    return one.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("texts"))


def records(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(key, as_clean, as_garbled, item, texts): near-twin candidates under what is left of them without non-ASCII characters."""
    skeleton = F.regexp_replace("word", r"[^\x{00}-\x{7F}]+", "*")
    anchored = vocab.filter(F.col("word").rlike("[A-Za-z0-9]")).select(skeleton.alias("key"), F.lit(True).alias("as_clean"), F.lit(True).alias("as_garbled"), F.col("word").alias("item"), "texts")
    runs = words.select(F.explode("runs").alias("item")).groupBy("item").agg(F.count("*").alias("texts"))
    lengths = lambda size: F.array_join(F.transform(F.split("item", " "), lambda x: size(x).cast("string")), " ")
    chars, octets = lengths(F.length), lengths(F.octet_length)
    kind = F.array(
        F.struct(F.concat(F.lit("c "), chars).alias("key"), F.lit(True).alias("as_clean"), F.lit(True).alias("as_garbled")),
        F.struct(F.concat(F.lit("b "), octets).alias("key"), F.lit(True).alias("as_clean"), F.lit(False).alias("as_garbled")),
        F.struct(F.concat(F.lit("b "), chars).alias("key"), F.lit(False).alias("as_clean"), F.lit(True).alias("as_garbled")),
    )
    runs = runs.select("item", "texts", F.explode(kind).alias("k")).select("k.key", "k.as_clean", "k.as_garbled", "item", "texts")
    return anchored.unionByName(runs)


def twins(record: DataFrame) -> DataFrame:
    """(garbled, clean, texts, twin_texts): each record beside the commonest one of its key; one row a record."""
    best = F.max_by(F.struct("item", "texts"), F.struct("texts", "item"))
    hubs = record.filter("as_clean").groupBy("key").agg(best.alias("h")).select("key", F.col("h.item").alias("clean"), F.col("h.texts").alias("twin_texts"))
    members = record.filter("as_garbled").select("key", F.col("item").alias("garbled"), "texts")
    return members.join(hubs, "key").filter("garbled <> clean").select("garbled", "clean", "texts", "twin_texts")


_GAPS = T.ArrayType(T.StructType([T.StructField("garbled", T.StringType()), T.StructField("clean", T.StringType())]))


@F.pandas_udf(_GAPS)
def gaps_udf(garbled: pd.Series, clean: pd.Series) -> pd.Series:
    """The different pairs of aligned gaps in which two twins differ."""
    pairs = (sorted({(x, y) for x, y in align(a, b) if x != y}) for a, b in zip(garbled, clean, strict=True))
    return pd.Series([[{"garbled": x, "clean": y} for x, y in p] for p in pairs], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def explain_udf(gaps: pd.Series) -> pd.Series:
    out = []
    for pairs in gaps:
        sets = [explanations(p["garbled"], p["clean"]) for p in pairs]
        out.append(sorted(frozenset.intersection(*sets)) if sets else [])
    return pd.Series(out, dtype=object)


def evidence(twin: DataFrame) -> DataFrame:
    """(gaps, n, n_clear, ways): aligned gaps, the twins that show them with the rarer one garbled, those that do so by
    ``RATIO``, and the transformations that explain them. Gaps that are as usual the other way round, as spelling variants are, don't count."""
    seen = twin.filter("twin_texts > texts").select(gaps_udf("garbled", "clean").alias("gaps"), (F.col("twin_texts") >= RATIO * F.col("texts")).alias("clear"))
    counts = cut(seen.filter(F.size("gaps") > 0).groupBy("gaps").agg(F.count("*").alias("n"), F.count_if("clear").alias("n_clear")))
    back = F.array_sort(F.transform("gaps", lambda g: F.struct(g["clean"].alias("garbled"), g["garbled"].alias("clean"))))
    back = counts.select(back.alias("gaps"), F.col("n").alias("against"))
    pure = counts.join(back, "gaps", "left").filter(F.coalesce("against", F.lit(0)) <= AGAINST * F.col("n"))
    return pure.select("gaps", "n", "n_clear", explain_udf("gaps").alias("ways")).filter(F.size("ways") > 0)


def learned(found: DataFrame) -> dict[str, int]:
    """Transformation -> support. The one that explains most is taken first and what it explains is taken away, so a relative
    of it is learned only for what it alone explains; one gap alone teaches no ambiguous transformation.

    ``found`` comes to the driver by its different sets of transformations, not by records.
    """
    rows = [r.asDict() for r in found.groupBy("ways").agg(F.sum("n").alias("n"), F.sum("n_clear").alias("n_clear"), F.count_if(F.col("n_clear") > 0).alias("gaps")).collect()]
    out: dict[str, int] = {}
    while True:
        score: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for r in rows:
            for t in r["ways"]:
                utf8 = t.endswith(">utf-8")
                score[t][0] += r["n"] if utf8 else r["n_clear"]
                score[t][1] += r["gaps"]
        fit = {t: n for t, (n, gaps) in score.items() if (n >= UTF8_SUPPORT if t.endswith(">utf-8") else n >= SUPPORT and gaps >= 2)}
        if not fit:
            return out
        best = min(fit, key=lambda t: (-fit[t], not t.endswith(">utf-8"), len(codecs_by_width()[0].get(t.partition(">")[2], ())), t))
        out[best] = fit[best]
        rows = [r for r in rows if best not in r["ways"]]


def mappings(found: DataFrame, known: dict[str, int]) -> DataFrame:
    """(transformation, garbled, clean, support): the aligned gaps behind the learned transformations."""
    each = found.select(F.explode("ways").alias("transformation"), "gaps", "n").filter(F.col("transformation").isin(sorted(known)))
    each = each.select("transformation", F.explode("gaps").alias("m"), "n")
    return each.groupBy("transformation", "m.garbled", "m.clean").agg(F.sum("n").alias("support"))


def apply_learned(vocab: DataFrame, support: dict[str, int]) -> DataFrame:
    """(word, texts, transformation, support, restored, whole): each word under the learned transformations that fit; ``restored`` is
    NULL for none, ``whole`` says that no letter beyond ASCII is left as it was and that the result is of one script."""
    ranked = sorted(support, key=lambda t: (-support[t], t))
    utf8 = [t for t in ranked if t.endswith(">utf-8")]
    swaps = [t for t in ranked if not t.endswith(">utf-8")]
    schema = "word string, texts long, transformation string, support long, restored string, whole boolean"

    def deeper(s: str) -> str:
        while (more := next((x for t in utf8 if (x := transform(s, t)) is not None), None)) is not None:
            s = more
        return s

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for word, n in zip(f["word"], f["texts"], strict=True):
                forms: dict[str, tuple[str, bool]] = {}
                for t in utf8:
                    if (got := decode_sequences(word, t.partition(">")[0])) is not None:
                        s = deeper(got[0])
                        sure = got[1] and bool(intersect(s))  # a word of two scripts is no word restored
                        if s not in forms or sure and not forms[s][1]:
                            forms[s] = (t, sure)
                if not any(whole for _, whole in forms.values()):
                    for t in swaps:
                        if (s := transform(word, t)) is not None:
                            forms.setdefault(s, (t, True))
                out += [(word, n, t, support[t], s, whole) for s, (t, whole) in forms.items()] or [(word, n, None, 0, None, None)]
            yield pd.DataFrame(out, columns=["word", "texts", "transformation", "support", "restored", "whole"])

    return vocab.select("word", "texts").mapInPandas(run, schema)


def verdicts(vocab: DataFrame, support: dict[str, int]) -> DataFrame:
    """(word, restored, transformation): garbled words; ``restored`` is NULL where characters are lost."""
    tried = cut(apply_learned(vocab, support))
    t = F.col("transformation")
    # what words that no learned sequence fits are made of; at most Unicode's characters come to the driver
    plain = tried.groupBy("word", "texts").agg(F.max(F.coalesce(is_utf8(t) & F.col("whole"), F.lit(False))).alias("u")).filter("not u")
    usual = plain.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c"), "texts").filter(F.col("c").rlike(NON_ASCII))
    usual = [r["c"] for r in usual.groupBy("c").agg(F.sum("texts").alias("n")).filter(F.col("n") >= USUAL).collect()]
    alphabet = "".join(sorted(set(usual)))
    proposed = tried.filter(t.isNotNull())
    twin = vocab.select(F.col("word").alias("restored"), F.col("texts").alias("twin_texts"))
    scored = proposed.join(twin, "restored", "left").withColumn("twin_texts", F.coalesce("twin_texts", F.lit(0)))
    strange = F.length(F.translate(F.regexp_replace("restored", r"[\x{00}-\x{7F}]+", ""), alphabet, "")) > 0
    sure = is_utf8(t) & F.col("whole") & ~_is_multi(t) & ~strange
    fits = sure | F.when(is_utf8(t), F.col("twin_texts") > 0).otherwise(F.col("twin_texts") >= RATIO * F.col("texts"))
    best = F.max_by(F.struct("restored", "transformation"), F.struct(is_utf8(t), F.col("twin_texts"), "support", "transformation"))
    found = scored.filter(fits).groupBy("word").agg(best.alias("b")).select("word", "b.restored", "b.transformation")
    lost = vocab.filter(F.col("word").rlike(LOST)).select("word").join(found.select("word"), "word", "left_anti")
    return found.unionByName(lost.select("word", F.lit(None).cast("string").alias("restored"), F.lit("lost").alias("transformation")))


def learn(words: DataFrame, vocab: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The evidence in the corpus, and what it teaches: at most one entry a pair of codecs."""
    found = cut(evidence(twins(cut(records(words, vocab)))))
    return found, learned(found)


def garbled_words(docs: DataFrame) -> DataFrame:
    """(text_key, doc_id, word, restored, transformation, weak) of all garbled words of all documents."""
    words = cut(words_of(docs))
    vocab = cut(vocabulary(words))
    bad = cut(verdicts(vocab, learn(words, vocab)[1]))
    t = F.col("transformation")
    bad = bad.withColumn("weak", ~(is_utf8(t) | (t == "lost")) & (F.length("word") < 3))
    # a few bytes a word: sent to all tasks only where there are few enough, else both sides are shuffled by word
    bad = F.broadcast(bad) if bad.limit(BROADCAST + 1).count() <= BROADCAST else bad
    return words.select("doc_id", "text_key", F.explode("words").alias("word")).join(bad, "word")


def garbled_documents(docs: DataFrame) -> DataFrame:
    """(doc_id): documents with a garbled passage, restorable or not."""
    return garbled_words(docs).filter("not weak").select("doc_id").distinct()


def restore_text(text: str, table: dict[str, tuple[str | None, str]]) -> str:
    """The text with its garbled words replaced; in a line under a single-byte transformation its other words follow."""

    def line(s: str) -> str:
        found = [table[w] for w in _WORD.findall(s) if w in table]
        ways = [t for r, t in found if r is not None and not t.endswith(">utf-8")]
        way = max(set(ways), key=ways.count) if len(ways) >= 2 else None

        def word(m: re.Match) -> str:
            w = m.group()
            if w in table:
                return table[w][0] if table[w][0] is not None else w
            if way and not w.isascii():
                return transform(w, way) or w
            return w

        return _WORD.sub(word, s) if found else s

    return "\n".join(map(line, text.split("\n")))


def restored_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, restored, transformations, fully): garbled documents with their text as far as it can be restored."""
    hits = garbled_words(docs)
    # the words of one text, bounded by the text itself; weak ones only beside others of their transformation
    tables = hits.groupBy("doc_id").agg(F.collect_list(F.struct("word", "restored", "transformation", "weak")).alias("table"))
    strong = F.transform(F.filter("table", lambda x: ~x["weak"]), lambda x: x["transformation"])
    tables = tables.withColumn("table", F.filter("table", lambda x: ~x["weak"] | F.array_contains(strong, x["transformation"]))).filter(F.size("table") > 0)

    @F.pandas_udf("string")
    def apply(text: pd.Series, table: pd.Series) -> pd.Series:
        return pd.Series([restore_text(t, {x["word"]: (x["restored"], x["transformation"]) for x in rows}) for t, rows in zip(text, table, strict=True)])

    return docs.select("doc_id", "text").join(tables, "doc_id").select(
        "doc_id", apply("text", "table").alias("restored"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("table", lambda x: x["transformation"]))), ",").alias("transformations"),
        (~F.exists("table", lambda x: x["restored"].isNull())).alias("fully"),
    )
