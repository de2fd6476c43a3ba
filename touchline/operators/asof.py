"""Strictly as-of history features: nothing of a row's own instant or later enters its features.

Rows are first combined by (key, instant), so rows of one instant never see each other whatever their order. Histories are then
taken in two levels, within (key, day) and over the days of a key, so no task holds a whole key. Windows that need the last few
rows only run over blocks of a bounded number of rows (:func:`in_blocks`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F



def attach(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``found`` (one row a key), NULL keys meeting each other."""
    other = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in found.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [df[k].eqNullSafe(other[f"_{k}"]) for k in keys])
    return df.join(other, on, "left").drop(*[f"_{k}" for k in keys])


def before(facts: DataFrame, probes: DataFrame, by: list[str], at: str, sums: dict[str, Column], last: Column | None = None) -> DataFrame:
    """(by, at, sums, last): over the facts strictly before each different (key, instant) of ``probes``.

    ``sums``: name -> column of ``facts`` to add up, NULL if there was none; ``last``: a column whose latest value comes out, the
    greatest of one instant; NULL values of it are passed over. Rows of one instant are combined map-side. A table that is both is read once.
    """
    fact = F.struct(F.col(at).alias("at"), last.alias("v")) if last is not None else F.struct(F.col(at).alias("at"), F.lit(None).cast("int").alias("v"))
    fact = F.when(last.isNotNull(), fact) if last is not None else fact
    f = facts.select(*by, at, *[c.alias(f"_s_{n}") for n, c in sums.items()], fact.alias("_last"), F.lit(int(probes is facts)).alias("_probe"))
    none = [F.lit(None).cast(t).alias(c) for c, t in f.dtypes if c not in (*by, at, "_probe")]
    both = f if probes is facts else f.unionByName(probes.select(*by, at, *none, F.lit(1).alias("_probe")))
    names = [f"_s_{n}" for n in sums]
    each = both.groupBy(*by, at).agg(*[F.sum(n).alias(n) for n in names], F.max("_last").alias("_last"), F.max("_probe").alias("_probe"))
    each = each.withColumn("_day", F.to_date(at) if dict(each.dtypes)[at] != "date" else F.trunc(at, "month"))
    inside = W.partitionBy(*by, "_day").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    days = each.groupBy(*by, "_day").agg(*[F.sum(n).alias(f"{n}_d") for n in names], F.max("_last").alias("_last_d"))
    across = W.partitionBy(*by).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select(*by, "_day", *[F.sum(f"{n}_d").over(across).alias(f"{n}_d") for n in names], F.max("_last_d").over(across).alias("_last_d"))
    each = each.select(*by, at, "_day", "_probe", *[F.sum(n).over(inside).alias(n) for n in names], F.max("_last").over(inside).alias("_last"))
    out = attach(each.filter("_probe = 1"), days, [*by, "_day"])

    def total(n: str) -> Column:
        return F.when(F.col(n).isNotNull() | F.col(f"{n}_d").isNotNull(), F.coalesce(n, F.lit(0)) + F.coalesce(f"{n}_d", F.lit(0)))

    latest = F.greatest("_last", "_last_d")
    return out.select(*by, at, *[total(f"_s_{n}").alias(n) for n in sums], latest["at"].alias("last_at"), latest["v"].alias("last"))


def expanding_means(df: DataFrame, by: list[str], at: str, values: dict[str, str]) -> DataFrame:
    """(by, at, means): over the rows of the key strictly before the row's instant, ``values``: new column -> averaged one; NULL without any."""
    sums = {f"s{i}": F.col(v).cast("double") for i, v in enumerate(values.values())}
    counts = {f"n{i}": F.when(F.col(v).isNotNull(), 1).otherwise(0) for i, v in enumerate(values.values())}
    found = before(df, df, by, at, sums | counts)
    means = [F.try_divide(F.col(f"s{i}"), F.col(f"n{i}")).alias(out) for i, out in enumerate(values)]
    return found.select(*by, at, *means)


def expanding_mean(df: DataFrame, by: list[str], at: str, values: dict[str, str]) -> DataFrame:
    """``df`` with :func:`expanding_means`."""
    return attach(df, expanding_means(df, by, at, values), [*by, at])


def in_blocks(df: DataFrame, place: str, size: int, margin: int) -> DataFrame:
    """Rows with ``_block`` = place / size and ``_own``; the last ``margin`` places of a block come again, not own, in the next.

    A window over (key, ``_block``) that looks back at most ``margin`` rows then sees all it needs in a bounded group.
    """
    block = F.floor(F.col(place) / size).cast("long")
    late = F.col(place) % size >= size - margin
    copies = F.array_compact(F.array(F.struct(block.alias("_block"), F.lit(True).alias("_own")), F.when(late, F.struct((block + 1).alias("_block"), F.lit(False).alias("_own")))))
    return df.select("*", F.explode(copies).alias("_b")).select(*df.columns, "_b._block", "_b._own")


def decay_means(df: DataFrame, by: list[str], at: str, tie: list[str], value: Column, half_life: float, out: str) -> DataFrame:
    """(by, at, out): mean of the rows strictly before the row's instant, weighted 0.5^(age / half_life), age in rows (``tie`` orders an instant's).

    Rows more than a hundred half-lives back weigh less than 2^-100 and are left out where a block of 500 half-lives ends.
    """
    inner = W.partitionBy(*by, at)
    rows = df.select(*by, at, *[c for c in tie if c not in (*by, at)], value.cast("double").alias("_v"))
    rows = rows.withColumn("_age", F.count("*").over(inner) - F.row_number().over(inner.orderBy(*(tie or [at]))))
    g = F.pow(F.lit(2.0), -F.col("_age") / half_life)
    each = rows.groupBy(*by, at).agg(F.sum(g * F.col("_v")).alias("_s"), F.sum(F.when(F.col("_v").isNotNull(), g)).alias("_w"), F.count("*").alias("_n"))
    each = attach(each, before(each, each, by, at, {"_c": F.col("_n")}).select(*by, at, "_c"), [*by, at])
    each = each.withColumn("_c", F.coalesce("_c", F.lit(0)) + F.col("_n"))
    size, margin = int(500 * half_life), int(100 * half_life)
    placed = in_blocks(each, "_c", size, margin)
    weight = F.pow(F.lit(2.0), (F.col("_c") - F.col("_block") * size) / half_life)
    past = W.partitionBy(*by, "_block").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    done = placed.select(*by, at, "_own", F.sum(weight * F.col("_s")).over(past).alias("_ss"), F.sum(weight * F.col("_w")).over(past).alias("_ww")).filter("_own")
    return done.select(*by, at, F.try_divide(F.col("_ss"), F.col("_ww")).alias(out))


def decay_mean(df: DataFrame, by: list[str], at: str, tie: list[str], value: Column, half_life: float, out: str) -> DataFrame:
    """``df`` with :func:`decay_means`."""
    return attach(df, decay_means(df, by, at, tie, value, half_life, out), [*by, at])


def last_groups_means(df: DataFrame, key: str, group: str, at: str, value: str, k: int, out: str) -> DataFrame:
    """(key, at, out): mean over the key's rows strictly before the row's instant in the ``k`` groups it was last seen in (greater name first on ties).

    Expanded by the key's groups and solved as histories a group: no array of a key's rows is ever built.
    """
    groups = df.select(F.col(key).alias("_k"), F.col(group).alias("_c")).distinct()
    probes = df.select(F.col(key).alias("_k"), at).distinct().join(groups.withColumnRenamed("_k", "_k2"), F.col("_k").eqNullSafe(F.col("_k2"))).select("_k", "_c", at)
    facts = df.select(F.col(key).alias("_k"), F.col(group).alias("_c"), at, F.col(value).cast("double").alias("_v"))
    found = before(facts, probes, ["_k", "_c"], at, {"s": F.col("_v"), "n": F.when(F.col("_v").isNotNull(), 1).otherwise(0)})
    ranked = W.partitionBy("_k", at).orderBy(F.desc("last_at"), F.desc("_c"))
    top = found.filter("last_at is not null").withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= k)
    return top.groupBy(F.col("_k").alias(key), at).agg(F.try_divide(F.sum("s"), F.sum("n")).alias(out))


def last_groups_mean(df: DataFrame, key: str, group: str, at: str, value: str, k: int, out: str) -> DataFrame:
    """``df`` with :func:`last_groups_means`."""
    return attach(df, last_groups_means(df, key, group, at, value, k, out), [key, at])


def asof_last(probes: DataFrame, facts: DataFrame, by: str, at: str, value: str, out: str) -> DataFrame:
    """The last fact strictly before each probe, NULL if there is none; the greatest of facts of one instant. No range join."""
    found = before(facts, probes, [by], at, {}, F.col(value)).select(by, at, F.col("last").alias(out))
    return attach(probes, found, [by, at])


def rolling_mean(df: DataFrame, by: str, at: str, tie: list[str], value: str, rows: int, out: str) -> DataFrame:
    """Mean of the last ``rows`` rows up to and with the row, in the order of ``at`` and ``tie``; bounded groups whatever the key's size."""
    here = W.partitionBy(by, at).orderBy(*tie)
    placed = attach(df, before(df, df, [by], at, {"_c": F.lit(1)}).select(by, at, "_c"), [by, at])
    placed = placed.withColumn("_c", F.coalesce("_c", F.lit(0)) + F.row_number().over(here))
    w = W.partitionBy(by, "_block").orderBy("_c").rowsBetween(-(rows - 1), 0)
    done = in_blocks(placed, "_c", 1000 + rows, rows).withColumn(out, F.avg(value).over(w))
    return done.filter("_own").select(*df.columns, out)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the last by ``order``. Combines map-side, so hot keys cost nothing."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
