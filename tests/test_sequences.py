import numpy as np
import pandas as pd

from touchline.operators import sequences as S


def test_margins_against_the_whole_table(spark):
    """A hot key over many partitions: each row sees the same neighbours as in one sorted frame, copies count once."""
    rng = np.random.default_rng(5)
    rows = [(None if i % 97 == 0 else 1 if i % 3 else int(rng.integers(2, 60)), int(i // 2), float(rng.integers(0, 3)), i, i % 11 != 0) for i in range(3000)]
    rows += [(1, 700, 9.0, 10_000 + i, True) for i in range(1000)]  # copies of one reading
    df = spark.createDataFrame(rows, "k int, t int, v double, row int, keep boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seq = S.ordered(df.repartition(7), "k", ["t", "v", "row"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert seq.rdd.getNumPartitions() > 1
    size, ident = 5, ["k", "t", "v"]
    around = S.margins(seq, ident, size, "keep")

    def work(f: pd.DataFrame) -> pd.DataFrame:
        kept = f[f["keep"].to_numpy(bool)]
        h = kept[S.starts(kept, ident)].reset_index(drop=True)
        near = {tuple(r): (tuple(h["t"].iloc[max(0, i - 3) : i]), tuple(h["t"].iloc[i + 1 : i + 4])) for i, r in enumerate(h[ident].fillna(-1).itertuples(index=False))}
        own = f[f["_own"].to_numpy(bool) & f["keep"].to_numpy(bool)]
        return pd.DataFrame({"row": own["row"], "near": [str(near[tuple(r)]) for r in own[ident].fillna(-1).itertuples(index=False)]})

    got = {r["row"]: r["near"] for r in S.map_with_margins(seq, around, work, "row int, near string").collect()}
    whole = df.toPandas().sort_values(["k", "t", "v", "row"], na_position="first").reset_index(drop=True)
    want = work(whole.assign(_own=True))
    assert got == dict(zip(want["row"], want["near"], strict=True)) and len(got) == df.filter("keep").count()


def test_empty(spark):
    df = spark.createDataFrame([], "k int, t int, keep boolean")
    seq = S.ordered(df, "k", ["t"])
    assert all(not len(a) and not len(b) for a, b in S.margins(seq, ["k", "t"], 3, "keep").values())
