"""Styles of play: clusters of standardised team profiles."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from touchline.session import cut

#: Fits that run at a time: each is a chain of dozens of jobs over one row a team, which take longer to start than to run.
AT_ONCE = 5

PARTS = (("poss", "possession_share"), ("vol", "team_passes"), ("allow", "opp_passes_allowed"))


def profiles(team_match: DataFrame) -> DataFrame:
    """(team, z_poss, z_vol, z_allow): standardised means of a team's matches; teams without one of them are left out."""
    t = team_match.groupBy("team").agg(*[F.avg(c).alias(n) for n, c in PARTS]).dropna()
    stats = t.agg(*[f(n).alias(f"{k}_{n}") for n, _ in PARTS for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    t = t.join(F.broadcast(stats))  # one row
    return t.select("team", *[F.try_divide(F.col(n) - F.col(f"m_{n}"), F.col(f"s_{n}")).alias(f"z_{n}") for n, _ in PARTS])


def clusters(profile: DataFrame, k: int = 4, seeds: int = 10) -> DataFrame:
    """(team, style): best of several KMeans fits, numbered in the order of the centres; style 0 for all if there are fewer teams than k."""
    z = profile.fillna(0.0)
    data = cut(VectorAssembler(inputCols=[f"z_{n}" for n, _ in PARTS], outputCol="features").transform(z))
    if data.limit(k).count() < k:
        return data.select("team", F.lit(0).alias("style"))
    with ThreadPool(min(seeds, AT_ONCE)) as pool:
        models = pool.map(inheritable_thread_target(data.sparkSession)(lambda s: KMeans(k=k, seed=s).fit(data)), range(seeds))
    best = min(models, key=lambda m: m.summary.trainingCost)
    order = sorted(range(k), key=lambda i: tuple(best.clusterCenters()[i]))
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)])
    return best.transform(data).select("team", rank[F.col("prediction")].alias("style"))
