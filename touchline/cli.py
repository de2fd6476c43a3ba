"""Command line: python -m touchline.cli {list-competitions,ingest,retrain,backtest,predict} [--config FILE] [--data DIR] [--models DIR]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline import config
from touchline.operators import asof
from touchline.plans import backtest
from touchline.session import cut, session
from touchline.sources import readers


def corpus(spark: SparkSession, data: str) -> DataFrame:
    """The player table, one row a (match, player); missing readings are NULL."""
    t = backtest.load_corpus(spark, data)
    t = t.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes])
    if "row_id" not in t.columns:
        t = t.withColumn("row_id", F.xxhash64("match_id", "player_id"))
    t = t.dropna(subset=["match_id", "player_id"])
    at = [F.col(c) for c in ("ingested_at", "row_id") if c in t.columns]
    return cut(asof.keep_last(t, ["match_id", "player_id"], at))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    ap = argparse.ArgumentParser(prog="touchline")
    ap.add_argument("command", choices=["list-competitions", "ingest", "retrain", "backtest", "predict"])
    ap.add_argument("--config")
    ap.add_argument("--data")
    ap.add_argument("--models")
    ap.add_argument("--upcoming", help="CSV of rows to come (predict)")
    ap.add_argument("--actual-minutes", action="store_true", help="score with the minutes really played (backtest)")
    a = ap.parse_args(argv)
    if a.command == "predict" and not a.upcoming:
        ap.error("predict needs --upcoming")
    cfg = config.load(a.config, data=a.data, models=a.models)
    spark = spark or session("touchline")
    pm, model = corpus(spark, cfg["data"]), f"{cfg['models']}/rate"
    if a.command == "list-competitions":
        print(backtest.dump(readers.competitions(pm)))
    elif a.command == "ingest":
        r = pm.agg(F.count("*").alias("rows"), F.count_distinct("match_id").alias("matches"), F.count_distinct("competition").alias("competitions")).first()
        print(f"{r['rows']} player rows, {r['matches']} matches, {r['competitions']} competitions")
    elif a.command == "retrain":
        backtest.retrain(pm, model, sweeps=cfg["sweeps"])
        print(f"saved to {model}")
    elif a.command == "backtest":
        lines = readers.attach_lines(readers.read_lines(spark, cfg["lines_csv"], cfg["stat_name"]), pm)[0] if cfg["lines_csv"] else None
        got = backtest.run(pm, lines=lines, actual_minutes=a.actual_minutes, sweeps=cfg["sweeps"])
        print(backtest.dump(got))
        print("mean CRPS:", got.agg(F.round(F.avg("crps"), 3)).first()[0])
    else:
        print(backtest.dump(backtest.predict(pm, readers.read_upcoming(spark, a.upcoming), model, draws=cfg["draws"])))
    return 0


if __name__ == "__main__":
    sys.exit(main())
