"""Hierarchical negative-binomial rate model, fitted approximately, and its seeded predictive samples.

log mu = ln(minutes) + intercept + role + position + competition + provider + X beta + player + player x opponent's style. The
player's effect has a Student-t prior around the centre of recent rates, the others Gaussian ones; variances by EM with
half-normal penalties, the dispersion by Newton steps. The fit is an approximation of a full posterior: draws are Gaussian
around the mode, dense over the small blocks, diagonal over players and styles.

Rows are shuffled by player once. A sweep is then one pass without shuffle: a partition finds its players' and styles' modes
under the small blocks' values and returns the sums of their joint Newton step, with the players eliminated from it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.models.minutes import MinutesModel, sample
from touchline.session import cut

FEATURES = ("style_per90", "team_poss_asof", "opp_allowed_asof", "team_elo", "opp_elo", "team_poss_espn", "opp_poss_espn", "is_friendly", "is_qualifier")
GROUPS = ("role", "position", "competition", "provider")
#: Prior deviations: half-normal scales of the learned ones, fixed ones of the rest.
LEARNED = {"role": 0.5, "position": 0.4, "player": 0.5, "pstyle": 0.3}
FIXED = {"competition": 0.3, "provider": 0.3, "beta": 0.5}
INTERCEPT, NU = (3.5, 1.0), 4.0
#: Rows whose dense design is held at a time.
BLOCK = 20_000


def scaling(df: DataFrame) -> dict[str, tuple[float, float, float]]:
    """(median, mean, deviation) of each feature; medians to a rank error of 1e-4, mean and deviation after filling with them."""
    med = df.agg(*[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in FEATURES]).first()
    fill = {c: float(med[c] or 0.0) for c in FEATURES}
    s = df.agg(*[f(F.coalesce(c, F.lit(fill[c]))).alias(f"{n}_{c}") for c in FEATURES for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return {c: (fill[c], float(s[f"m_{c}"] or 0.0), float(s[f"s_{c}"] or 0.0) + 1e-9) for c in FEATURES}


def design(df: DataFrame, levels: dict[str, list[str]], scale: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Codes of the small groups (-1: unseen), scaled features within 8 deviations, player, style and prior centre."""
    code = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(v) for v in levels[c]]).cast("array<string>"), F.col(c)) - 1, F.lit(-1)).cast("int")
    x = lambda c: F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.coalesce(F.col(c).cast("double"), F.lit(scale[c][0])) - scale[c][1]) / scale[c][2]))
    keep = [c for c in ("row_id", "minutes") if c in df.columns]
    return df.select(*keep, *[code(c).alias(f"c_{c}") for c in GROUPS], *[x(c).alias(f"x_{c}") for c in FEATURES], F.col("player_id").cast("string").alias("player"),
        F.concat_ws("|", F.col("player_id").cast("string"), F.coalesce("opp_style", F.lit(-1)).cast("string")).alias("pstyle"), F.coalesce("prior", F.lit(0.0)).alias("prior"), *([F.col("passes_attempted").alias("y")] if "passes_attempted" in df.columns else []))


def _dense(f: pd.DataFrame, sizes: list[int]) -> np.ndarray:
    """Rows of the small blocks' design: intercept, indicators of each group, features."""
    z, at = np.zeros((len(f), 1 + sum(sizes) + len(FEATURES))), 1
    z[:, 0] = 1.0
    for c, n in zip(GROUPS, sizes, strict=True):
        code = f[f"c_{c}"].to_numpy()
        seen = np.flatnonzero(code >= 0)
        z[seen, at + code[seen]] = 1.0
        at += n
    z[:, at:] = f[[f"x_{c}" for c in FEATURES]].to_numpy()
    return z


def _mu(eta: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(eta, -8.0, 8.0))


def _local(f: pd.DataFrame, theta: np.ndarray, sizes: list[int], var: dict[str, float], alpha: float, inner: int = 10):
    """(fixed part, player ids and codes, style ids and codes, modes and precisions of both) under the small blocks' values."""
    base = np.log(np.maximum(f["minutes"].to_numpy(), 1.0)) + np.concatenate([_dense(f[i : i + BLOCK], sizes) @ theta for i in range(0, len(f), BLOCK)])
    y = f["y"].to_numpy()
    pc, pl = pd.factorize(f["player"])
    sc, st = pd.factorize(f["pstyle"])
    center = np.zeros(len(pl))
    center[pc] = f["prior"].to_numpy()
    a, s = center.copy(), np.zeros(len(st))
    for _ in range(inner):
        mu = _mu(base + a[pc] + s[sc])
        prec = (NU + 1) / (NU + (a - center) ** 2 / var["player"]) / var["player"]
        ha = np.bincount(pc, alpha * mu / (alpha + mu), len(pl)) + prec
        a = a + np.clip((np.bincount(pc, alpha * (y - mu) / (alpha + mu), len(pl)) - prec * (a - center)) / ha, -1, 1)
        mu = _mu(base + a[pc] + s[sc])
        hs = np.bincount(sc, alpha * mu / (alpha + mu), len(st)) + 1 / var["pstyle"]
        s = s + np.clip((np.bincount(sc, alpha * (y - mu) / (alpha + mu), len(st)) - s / var["pstyle"]) / hs, -1, 1)
    return base, y, pc, pl, sc, st, center, a, ha, s, hs


def _partition(frames: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    fs = [f for f in frames if len(f)]
    return pd.concat(fs, ignore_index=True) if fs else None


def by_player(df: DataFrame) -> DataFrame:
    """``df`` materialised with all rows of a player in one partition, as :func:`fit` needs it."""
    return cut(df.repartition("player_id"))


def fit(df: DataFrame, sweeps: int = 12) -> tuple[DataFrame, dict]:
    """(levels (param, level, mode, sd), what :func:`predict` needs).

    ``df``, from :func:`by_player`: the columns of GROUPS and FEATURES, player_id, opp_style, prior (centre of the player's
    effect), minutes, passes_attempted.
    """
    df = df.filter("minutes > 0 and passes_attempted >= 0")
    # fixed vocabularies: dozens of levels
    names = {c: sorted(r[0] for r in df.select(F.col(c).cast("string")).distinct().dropna().collect()) for c in GROUPS}
    scale = scaling(df)
    d = design(df, names, scale).drop("row_id")
    sizes = [len(names[c]) for c in GROUPS]
    owner = np.array(["intercept"] + [c for c in GROUPS for _ in names[c]] + ["beta"] * len(FEATURES))
    k = len(owner)
    total = d.agg(F.sum("y"), F.sum("minutes")).first()
    theta, alpha = np.zeros(k), 5.0
    theta[0] = np.log((total[0] or 0) + 0.5) - np.log((total[1] or 0) + 1.0)
    var = {"role": 0.25, "position": 0.05, "player": 0.05, "pstyle": 0.02}
    cov = np.eye(k)

    for _ in range(sweeps):

        def sums(frames: Iterator[pd.DataFrame], theta=theta, alpha=alpha, var=dict(var)) -> Iterator[pd.DataFrame]:
            f = _partition(frames)
            if f is None:
                return
            base, y, pc, pl, sc, st, center, a, ha, s, hs = _local(f, theta, sizes, var, alpha)
            mu = _mu(base + a[pc] + s[sc])
            r, w = alpha * (y - mu) / (alpha + mu), alpha * mu / (alpha + mu)
            g, h, b = np.zeros(k), np.zeros((k, k)), np.zeros((len(pl), k))
            for i in range(0, len(f), BLOCK):
                z = _dense(f[i : i + BLOCK], sizes)
                zw = z * w[i : i + BLOCK, None]
                g += r[i : i + BLOCK] @ z
                h += z.T @ zw
                at = np.argsort(pc[i : i + BLOCK], kind="stable")
                own = pc[i : i + BLOCK][at]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                b[own[first]] += np.add.reduceat(zw[at], first)
            h -= b.T @ (b / ha[:, None])
            dev = (a - center) ** 2
            t = (NU + 1) / (NU + dev / var["player"]) * (dev + 1 / ha)
            j = np.arange(int(y.max()) + 1) + alpha
            one, two = np.r_[0, np.cumsum(1 / j)][y.astype(int)], np.r_[0, np.cumsum(1 / j**2)][y.astype(int)]
            da = one + np.log(alpha / (alpha + mu)) + 1 - (y + alpha) / (alpha + mu)
            db = -two + 1 / alpha - 1 / (alpha + mu) - (mu - y) / (alpha + mu) ** 2
            flat = np.concatenate([g, h.ravel(), [t.sum(), len(pl), (s**2 + 1 / hs).sum(), len(st), da.sum(), db.sum()]])
            yield pd.DataFrame({"sums": [flat]})

        parts = [np.array(x[0]) for x in d.mapInPandas(sums, "sums array<double>").collect()]
        if not parts:
            break
        got = np.sum(parts, 0)
        prec = np.array([1 / INTERCEPT[1] ** 2 if o == "intercept" else 1 / (var[o] if o in var else FIXED[o] ** 2) for o in owner])
        cov = np.linalg.inv(got[k : k + k * k].reshape(k, k) + np.diag(prec))
        theta = theta + np.clip(cov @ (got[:k] - prec * (theta - np.where(owner == "intercept", INTERCEPT[0], 0.0))), -1, 1)
        sp, n_p, ss, n_s, da, db = got[-6:]
        moments = {"player": (sp, n_p), "pstyle": (ss, n_s)} | {c: ((theta[owner == c] ** 2 + np.diag(cov)[owner == c]).sum(), (owner == c).sum()) for c in ("role", "position")}
        for c, (x, n) in moments.items():
            v = LEARNED[c] ** 2
            var[c] = float(np.clip(v / 2 * (np.sqrt(n * n + 4 * x / v) - n), 1e-4, 4.0))
        step = -(da - 1) / db if db < 0 else np.sign(da - 1) * alpha
        alpha = float(np.clip(alpha + np.clip(step, -alpha / 2, alpha), 0.05, 500.0))

    def modes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = _partition(frames)
        if f is not None:
            _, _, _, pl, _, st, _, a, ha, s, hs = _local(f, theta, sizes, var, alpha)
            yield pd.DataFrame({"param": "player", "level": pl, "mode": a, "sd": ha**-0.5})
            yield pd.DataFrame({"param": "pstyle", "level": st, "mode": s, "sd": hs**-0.5})

    schema = "param string, level string, mode double, sd double"
    level = ["", *[v for c in GROUPS for v in names[c]], *FEATURES]
    small = [(str(o), v, float(m), float(x)) for o, v, m, x in zip(owner, level, theta, np.sqrt(np.diag(cov)), strict=True)]
    levels = cut(d.mapInPandas(modes, schema)).unionByName(d.sparkSession.createDataFrame(small, schema))
    return levels, {"alpha": alpha, "theta": theta, "cov": cov, "names": names, "scale": scale} | {f"var_{c}": v for c, v in var.items()}


def predict(rows: DataFrame, levels: DataFrame, fitted: dict, draws: int = 200, seed: int = 7, minutes: MinutesModel | None = None) -> DataFrame:
    """``rows`` (row_id and the columns of :func:`fit` but passes_attempted) with ``samples``; a row's samples depend on its key and the seed only.

    With ``minutes`` the minutes are drawn too, from the player's own or by ``p_start`` (0.5 where there is none); else they are
    those of the row. Levels that the fit hasn't seen have effect 0 (players: their prior centre) and the prior's spread.
    """
    of = lambda k: levels.filter(F.col("param") == k).select(F.col("level").alias(k), F.col("mode").alias(f"u_{k}"), F.col("sd").alias(f"s_{k}"))
    if minutes is None:
        rows = rows.filter("minutes is not null")
    x = design(rows.drop("passes_attempted"), fitted["names"], fitted["scale"]).join(of("player"), "player", "left").join(of("pstyle"), "pstyle", "left")
    x = x.withColumn("u_player", F.coalesce("u_player", "prior")).fillna(0.0, ["u_pstyle"])
    x = x.fillna(fitted["var_player"] ** 0.5, ["s_player"]).fillna(fitted["var_pstyle"] ** 0.5, ["s_pstyle"])
    x = x.withColumn("key", F.xxhash64(F.lit(seed), "row_id"))
    pools = None
    if minutes is not None:
        chance = F.coalesce("p_start", F.lit(0.5)) if "p_start" in rows.columns else F.lit(0.5)
        x = x.join(rows.select("row_id", chance.alias("p_start")), "row_id").join(minutes.own.withColumn("player", F.col("player_id").cast("string")).drop("player_id"), "player", "left")
        pools = minutes._replace(own=None)
    alpha, theta, cov, sizes = fitted["alpha"], fitted["theta"], fitted["cov"], [len(fitted["names"][c]) for c in GROUPS]
    spread = {c: fitted[f"var_{c}"] if c in LEARNED else FIXED[c] ** 2 for c in GROUPS}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            z = _dense(f, sizes)
            eta = (z @ theta + f["u_player"] + f["u_pstyle"]).to_numpy()
            v = ((z @ cov) * z).sum(1) + f["s_player"] ** 2 + f["s_pstyle"] ** 2 + sum((f[f"c_{c}"] < 0) * spread[c] for c in GROUPS)
            out, sd = [], np.sqrt(v).to_numpy()
            for i, key in enumerate(f["key"].to_numpy()):
                rng = np.random.default_rng(int(key) & (2**63 - 1))
                e = eta[i] + rng.normal(size=draws) * sd[i]
                m = f["minutes"].iat[i] if pools is None else sample(pools, rng, draws, f["p_start"].iat[i], f["own_values"].iat[i], f["own_counts"].iat[i])
                mu = _mu(e + np.log(np.maximum(m, 1.0)))
                out.append(rng.poisson(rng.gamma(alpha, mu / alpha)).astype(float))
            yield pd.DataFrame({"row_id": f["row_id"], "samples": out})

    return x.mapInPandas(run, "row_id long, samples array<double>")


def save(levels: DataFrame, fitted: dict, path: str) -> None:
    """Writes a fit as two tables under ``path``, any file system that Spark knows; an earlier fit there is replaced."""
    plain = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in fitted.items()}
    spark = levels.sparkSession
    levels.write.mode("overwrite").parquet(f"{path}/levels")
    spark.createDataFrame([(json.dumps(plain),)], "fit string").coalesce(1).write.mode("overwrite").parquet(f"{path}/fit")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    fitted = json.loads(spark.read.parquet(f"{path}/fit").first()[0])
    fitted |= {"theta": np.array(fitted["theta"]), "cov": np.array(fitted["cov"]), "scale": {k: tuple(v) for k, v in fitted["scale"].items()}}
    return spark.read.parquet(f"{path}/levels"), fitted


def tune(rows: DataFrame, levels: DataFrame, fitted: dict, sweeps: int = 4, span: float = 0.4, grid: int = 17, rounds: int = 3) -> tuple[dict[str, float], float, float]:
    """(coefficients, error before, error after): coordinate search for the coefficients of FEATURES with the least absolute error.

    Each coordinate is searched on a grid within ``span`` of the fitted value, which narrows ``rounds`` times; all points of a grid
    are judged in one pass over the rows, whose sums are one number a point. The other effects stay at their modes.
    """
    of = lambda k: levels.filter(F.col("param") == k).select(F.col("level").alias(k), F.col("mode").alias(f"u_{k}"))
    x = design(rows.filter("minutes > 0 and passes_attempted >= 0"), fitted["names"], fitted["scale"]).join(of("player"), "player", "left").join(of("pstyle"), "pstyle", "left")
    x = cut(x.withColumn("u_player", F.coalesce("u_player", "prior")).fillna(0.0, ["u_pstyle"]))
    sizes, theta = [len(fitted["names"][c]) for c in GROUPS], fitted["theta"]
    first = len(theta) - len(FEATURES)

    def errors(points: np.ndarray) -> np.ndarray:
        """Mean absolute error of each row of ``points`` (coefficients)."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros(len(points)), 0
            for f in frames:
                z = _dense(f, sizes)
                eta = np.log(np.maximum(f["minutes"].to_numpy(), 1.0)) + z[:, :first] @ theta[:first] + f["u_player"].to_numpy() + f["u_pstyle"].to_numpy()
                total += np.abs(_mu(eta[:, None] + z[:, first:] @ points.T) - f["y"].to_numpy()[:, None]).sum(0)
                n += len(f)
            yield pd.DataFrame({"sums": [np.r_[total, n]]})

        got = np.sum([np.array(r[0]) for r in x.mapInPandas(run, "sums array<double>").collect()], 0)
        return got[:-1] / max(got[-1], 1)

    beta, start = theta[first:].copy(), theta[first:].copy()
    initial = best = float(errors(beta[None])[0])
    for _ in range(sweeps):
        before = best
        for j in range(len(beta)):
            low, high = start[j] - span, start[j] + span
            for _ in range(rounds):
                values = np.linspace(low, high, grid)
                points = np.repeat(beta[None], grid, 0)
                points[:, j] = values
                e = errors(points)
                i = int(np.argmin(e))
                if e[i] < best:
                    best, beta[j] = float(e[i]), float(values[i])
                low, high = values[max(i - 1, 0)], values[min(i + 1, grid - 1)]
        if before - best < 1e-9:
            break
    return dict(zip(FEATURES, beta.tolist(), strict=True)), initial, best


def summarize(samples: DataFrame, ci: float = 0.8) -> DataFrame:
    """(row_id, pred, ci_low, ci_high, moe, p50, std) with linear interpolation and the population deviation."""
    s, n = F.array_sort("samples"), F.size("samples")
    mean = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) / n
    std = F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / n)

    def quantile(q: float):
        at = (n - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        return F.col("s")[low] + (at - low) * (F.col("s")[F.least(low + 1, n - 1)] - F.col("s")[low])

    t = samples.withColumn("s", s).withColumn("mean", mean)
    low, high = quantile((1 - ci) / 2), quantile((1 + ci) / 2)
    r = lambda c: F.bround(c, 1)
    return t.select("row_id", r("mean").alias("pred"), r(low).alias("ci_low"), r(high).alias("ci_high"), r((high - low) / 2).alias("moe"), r(quantile(0.5)).alias("p50"), r(std).alias("std"))
