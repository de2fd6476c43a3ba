"""Mixing sources to target token shares by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked to three marginals: the target shares of the sources, and the
corpus's own shares of languages and topics among the sources mixed. The ratio of a cell's raked to its available tokens is
the expected number of copies of its texts, capped by ``max_repeats``. Texts are then drawn by a hash of the text, calibrated
a source so that the tokens drawn meet the raked total.

The size of the mix is the largest at which every listed source that has tokens can meet its share within its cap, unless
``total_tokens`` is given; sources that can't meet theirs then give all they may, and the shares really reached say so.

Defined results: documents of unlisted or NULL sources, NULL and empty texts are not part of the mix; a NULL language
is a value of its own; copies are one text, owned by the source of its lowest document id, so no text is used more than its
``max_repeats`` times under several ids; a listed source without texts is reported with share 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from touchline.llm import clusters
from touchline.llm.tokens import count_tokens
from touchline.session import cut

#: Topics; bins of the draw; sweeps of the fit.
TOPICS, BINS, SWEEPS = 8, 2000, 200


def form_features(text: Column) -> list[Column]:
    """What a text looks like: length, share of digits, capitals, line ends, quotation and table marks, in the JVM."""
    n = F.length(text)
    share = lambda pattern, k: (k * F.regexp_count(text, F.lit(pattern)) / n).alias
    return [
        (F.ln(n.cast("double")) / 2).alias("f_length"), share("[0-9]", 20.0)("f_digits"), share("[A-Z]", 20.0)("f_capitals"), share("\\n", 60.0)("f_lines"),
        share("[\"“”«»„?!]", 60.0)("f_quotes"), share("[|│•\\[\\]=]", 60.0)("f_tables"),
    ]


FEATURES = ("f_length", "f_digits", "f_capitals", "f_lines", "f_quotes", "f_tables")


def fit_topics(texts: DataFrame) -> np.ndarray | None:
    """Kinds of text (reports, posts, tables, interviews, ...) as clusters of their form, fitted on all texts; None with fewer texts than kinds."""
    return clusters.centres(clusters.packed(texts, F.col("u"), list(FEATURES)), len(FEATURES), TOPICS)


def sized_texts(docs: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, u): one row a different text of the listed sources. Texts themselves aren't shuffled."""
    held = docs.filter(F.length("text") > 0).join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")  # a row a source
    sized = count_tokens(held.select("doc_id", "source", "lang", "text"), "text", path)
    narrow = sized.select("doc_id", "source", F.coalesce("lang", F.lit("?")).alias("lang"), "n_tokens", F.md5(F.col("text").cast("binary")).alias("text_key"), *form_features(F.col("text")))
    one = narrow.groupBy("text_key").agg(F.min_by(F.struct("doc_id", "source", "lang", "n_tokens", *FEATURES), "doc_id").alias("r"))
    one = cut(one.select("r.*", (F.pmod(F.xxhash64("text_key"), F.lit(1 << 40)) / float(1 << 40)).alias("u")))
    kinds = fit_topics(one)
    return one.withColumn("topic", F.lit(0) if kinds is None else clusters.nearest(list(FEATURES), kinds)).drop(*FEATURES)


def rake(cells: pd.DataFrame, shares: dict[str, float], caps: dict[str, int], total: float | None) -> pd.DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``copies``: the expected uses of each text of the cell."""
    c = cells[cells["tokens"] > 0].copy()
    have = c.groupby("source")["tokens"].sum()
    weights = {s: w for s, w in shares.items() if s in have.index and w > 0}
    if not weights:
        return c.assign(copies=0.0)
    scale = sum(weights.values())
    feasible = min(caps[s] * have[s] * scale / w for s, w in weights.items())
    size = feasible if total is None else total
    goal = {s: min(size * w / scale, caps[s] * have[s]) for s, w in weights.items()}
    c = c[c["source"].isin(weights)].copy()
    t = c["tokens"].to_numpy(float)
    most = t * c["source"].map(caps).to_numpy(float)
    s_codes, s_names = pd.factorize(c["source"])
    goals = np.array([goal[s] for s in s_names])
    x, free = t * (goals / np.bincount(s_codes, t))[s_codes], goals.sum() / t.sum()
    others = []
    for k in ("lang", "topic"):
        codes, names = pd.factorize(c[k])
        others.append((codes, np.bincount(codes, t, len(names)) * free))
    for _ in range(SWEEPS):
        before = x.copy()
        # the sources come last: their shares are the ones that must be met
        for codes, target in [*others, (s_codes, goals)]:
            now = np.bincount(codes, x, len(target))
            x = np.minimum(x * np.divide(target, now, out=np.zeros_like(target), where=now > 0)[codes], most)
        for _ in range(60):  # what caps cut off goes to the source's other cells
            lack = goals - np.bincount(s_codes, x, len(goals))
            room = most - x
            spare = np.bincount(s_codes, room, len(goals))
            if (lack <= 1e-9 * goals.sum()).all():
                break
            x = x + room * np.clip(np.divide(lack, spare, out=np.zeros_like(lack), where=spare > 0), 0, 1)[s_codes]
        if np.abs(x - before).max() <= 1e-7 * x.sum():
            break
    return c.assign(copies=x / t)


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, copies): the different texts of the listed sources and how often each is used, 0 for those
    that the mix leaves out."""
    texts = cut(sized_texts(docs, targets, path))
    # a row a listed source, language and topic
    cells = texts.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")).toPandas()
    listed = targets.groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("m")).collect()
    raked = rake(cells, {r["source"]: r["w"] for r in listed}, {r["source"]: r["m"] for r in listed}, total_tokens)
    spark = docs.sparkSession
    schema = "source string, lang string, topic int, copies double"
    rates = spark.createDataFrame(raked[["source", "lang", "topic", "copies"]], schema)
    rated = texts.join(F.broadcast(rates), ["source", "lang", "topic"], "left").fillna(0.0, ["copies"])
    whole, part = F.floor("copies"), F.col("copies") - F.floor("copies")
    # place of a text in the draw: it is used once more if this is at most the source's cut
    rated = rated.withColumn("whole", whole).withColumn("place", F.when(part > 1e-9, F.col("u") / part))
    bins = rated.filter("place < 4").groupBy("source", F.floor(F.col("place") * (BINS // 4)).alias("bin")).agg(F.sum("n_tokens").alias("n")).toPandas()
    base = rated.groupBy("source").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("n")).toPandas().set_index("source")["n"]
    goal = (raked["copies"] * raked["tokens"]).groupby(raked["source"]).sum()
    cuts = []
    for s, want in goal.items():
        b = bins[bins["source"] == s].sort_values("bin")
        sums = b["n"].cumsum().to_numpy(float) + float(base.get(s, 0))
        # the bin edge whose total is nearest to the goal
        best = int(np.argmin(np.abs(np.concatenate([[float(base.get(s, 0))], sums]) - want))) if len(b) else 0
        cuts.append((s, 0.0 if best == 0 else float(b["bin"].iloc[best - 1] + 1) / (BINS // 4)))
    cut_rows = spark.createDataFrame(pd.DataFrame(cuts, columns=["source", "cut"]), "source string, cut double")
    caps = targets.groupBy("source").agg(F.max("max_repeats").alias("cap"))
    drawn = rated.join(F.broadcast(cut_rows), "source", "left").join(F.broadcast(caps), "source")
    extra = F.coalesce(F.floor(F.col("place") * (BINS // 4)) / (BINS // 4) < F.col("cut"), F.lit(False)).cast("int")
    drawn = drawn.withColumn("copies", F.least(F.col("whole") + extra, F.col("cap")).cast("int"))
    return drawn.select("doc_id", "source", "lang", "topic", "n_tokens", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_weight, max_repeats, texts, copies, tokens, most_uses, available_tokens, used_share, share), one row a listed source: what
    the mix really reached, and what part of the source's tokens it uses at least once."""
    used = F.col("copies") > 0
    got = mixed.groupBy("source").agg(
        F.count_if(used).alias("texts"), F.sum("copies").cast("long").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).cast("long").alias("tokens"),
        F.max("copies").alias("most_uses"), F.sum("n_tokens").alias("available_tokens"), F.sum(F.when(used, F.col("n_tokens")).otherwise(0)).alias("once"),
    )
    out = targets.groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    out = out.join(got, "source", "left").fillna(0, ["texts", "copies", "tokens", "most_uses", "available_tokens", "once"])
    whole = out.agg(F.sum("tokens").alias("all"))
    out = out.join(F.broadcast(whole))  # one row
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.withColumn("used_share", part("once", "available_tokens")).withColumn("share", part("tokens", "all")).drop("all", "once")


def marginals(mixed: DataFrame) -> DataFrame:
    """(kind, value, corpus_share, share): the shares of languages and topics in the texts that could be mixed and in the mix."""
    each = F.array(F.struct(F.lit("lang").alias("kind"), F.col("lang").alias("value")), F.struct(F.lit("topic").alias("kind"), F.col("topic").cast("string").alias("value")))
    rows = mixed.select(F.inline(each), "n_tokens", "copies").groupBy("kind", "value").agg(F.sum("n_tokens").alias("have"), F.sum(F.col("copies") * F.col("n_tokens")).alias("took"))
    whole = rows.groupBy("kind").agg(F.sum("have").alias("h"), F.sum("took").alias("t"))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return rows.join(F.broadcast(whole), "kind").select("kind", "value", part("have", "h").alias("corpus_share"), part("took", "t").alias("share"))  # two rows
