"""Picks, parlays, calibration and grading."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from touchline.functions.scalar import MULTIPLIERS, breakeven


def edge_table(df: DataFrame, legs: int = 5) -> DataFrame:
    """``df`` (with p_over) and pick, p_pick, breakeven, edge."""
    more = F.col("p_over") >= 0.5
    d = df.withColumn("pick", F.when(more, "MORE").when(F.col("p_over").isNotNull(), "LESS")).withColumn("p_pick", F.when(more, F.col("p_over")).otherwise(1 - F.col("p_over")))
    bar = F.lit(breakeven(legs))
    return d.withColumn("breakeven", bar).withColumn("edge", F.col("p_pick") - bar)


def ranked(edges: DataFrame, *ties: str, top: int | None = None) -> DataFrame:
    """Edges from the best down, NULL last, ties in the order of the columns given; ``top`` keeps so many."""
    out = edges.orderBy(F.desc_nulls_last("edge"), *ties)
    return out if top is None else out.limit(top)


def grade(df: DataFrame, win: float = 0.87) -> DataFrame:
    """(plays, hits, hit_rate, roi) of graded picks: pick, line, actual; an integer line's tie is MORE."""
    over = F.col("actual") >= F.ceil("line")
    hit = (over == (F.col("pick") == "MORE")).cast("int")
    g = df.dropna(subset=["pick", "line", "actual"]).agg(F.count("*").alias("plays"), F.sum(hit).cast("long").alias("hits"))
    rate = F.try_divide(F.col("hits").cast("double"), F.when(F.col("plays") > 0, F.col("plays")))
    return g.select("plays", "hits", rate.alias("hit_rate"), (rate * win - (1 - rate)).alias("roi"))


def history(player_match: DataFrame, least_minutes: float = 70.0) -> DataFrame:
    """(player_id, hist): mean pass count over matches of at least so many minutes."""
    return player_match.filter(F.col("minutes") >= least_minutes).groupBy("player_id").agg(F.avg("passes_attempted").alias("hist"))


def score(props: DataFrame) -> DataFrame:
    """``props`` (p_over, line, hist, is_new) with pick, p_hit, agree and confidence, most confident first.

    Confidence is the distance of p_over from one half; it is 0 where the history lies on the other side of the line, and a quarter for
    new players. An unknown history agrees with either side; an unknown p_over has no pick and no confidence.
    """
    over = F.col("p_over") >= 0.5
    agree = F.col("hist").isNull() | ((F.col("hist") > F.col("line")) == over)
    sure = F.abs(F.col("p_over") - 0.5) * F.when(agree, 1.0).otherwise(0.0) * F.when(F.col("is_new"), 0.25).otherwise(1.0)
    out = props.withColumn("pick", F.when(over, "OVER").when(F.col("p_over").isNotNull(), "UNDER")).withColumn("p_hit", F.when(over, F.col("p_over")).otherwise(1 - F.col("p_over")))
    return out.withColumn("agree", agree).withColumn("confidence", sure).orderBy(F.desc("confidence"))


def greedy_parlays(picks: DataFrame, n: int, legs: int, used: tuple[int, ...] = ()) -> DataFrame:
    """(slate, parlay, leg, row_id): a slate's picks by confidence, no player twice or of ``used``, no opposite picks of one team in a parlay.

    ``picks``: slate, row_id, player_id, team, pick, confidence; those without confidence stay out, the lower row_id goes first on
    ties. One group a slate: its open picks, hundreds at most.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = list(pdf.sort_values(["confidence", "row_id"], ascending=[False, True]).itertuples())
        taken, out = set(used), []
        for p in range(n):
            chosen, ways = [], {}
            for r in pool:
                if len(chosen) < legs and r.player_id not in taken and ways.get(r.team, r.pick) == r.pick and r.player_id not in {c.player_id for c in chosen}:
                    chosen.append(r)
                    ways[r.team] = r.pick
            if len(chosen) < legs:
                break
            taken |= {c.player_id for c in chosen}
            out += [(c.slate, p, i, c.row_id) for i, c in enumerate(chosen)]
        return pd.DataFrame(out, columns=["slate", "parlay", "leg", "row_id"])

    return picks.filter("confidence > 0").groupBy("slate").applyInPandas(build, "slate string, parlay int, leg int, row_id long")


def parlay_ev(parlays: DataFrame, picks: DataFrame) -> DataFrame:
    """(slate, parlay, legs, p_all, ev) of built parlays under independence; ``picks``: row_id, p_hit. NULL for a payout that isn't listed."""
    table = F.create_map(*[F.lit(x) for kv in MULTIPLIERS.items() for x in kv])
    g = parlays.join(picks.select("row_id", "p_hit"), "row_id").groupBy("slate", "parlay").agg(F.count("*").cast("int").alias("legs"), F.exp(F.sum(F.ln(F.greatest("p_hit", F.lit(1e-9))))).alias("p_all"))
    return g.withColumn("ev", F.col("p_all") * F.try_element_at(table, F.col("legs")) - 1)


def isotonic(df: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """(boundary, prediction) of the calibration of ``y`` on ``x``; rows count ``weight`` times."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    data = VectorAssembler(inputCols=[x], outputCol="features").transform(df.select(F.col(x).cast("double"), F.col(y).cast("double").alias("label"), w.alias("w")).dropna())
    m = IsotonicRegression(weightCol="w").fit(data)
    rows = [(float(a), float(b)) for a, b in zip(m.boundaries, m.predictions, strict=True)]
    return df.sparkSession.createDataFrame(rows, "boundary double, prediction double")


def calibrate(df: DataFrame, fitted: DataFrame | None, p: str = "p_over", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``df`` with ``p`` mapped through (boundary, prediction), linear between boundaries, flat beyond; unchanged without a fit.

    The boundaries are at most as many as different probabilities were fitted on; they travel with the plan as one array.
    """
    rows = [] if fitted is None else sorted((r["boundary"], r["prediction"]) for r in fitted.collect())
    if not rows:
        return df

    @F.pandas_udf("double")
    def mapped(v: pd.Series) -> pd.Series:
        x, y = zip(*rows, strict=True)
        return pd.Series(np.where(v.isna(), np.nan, np.clip(np.interp(v.clip(0, 1), x, y), low, high)))

    return df.withColumn(p, F.nanvl(mapped(F.col(p)), F.lit(None).cast("double")))
