"""Streaming variants: watermarked daily counts and an idempotent upsert sink. All paths are those of a file system that Spark knows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.operators.asof import keep_last
from touchline.session import ensure_checkpoint_dir
from touchline.sources.readers import exists


def daily_counts(spark: SparkSession, path: str, late: str = "1 day", base: str | None = None) -> DataFrame:
    """(day, event_type, n, total) of the days that are closed: a file stream with a watermark, append mode, run until it has
    seen all files there are. Rows later than ``late`` are counted if their day is still open. State and output lie under ``base``,
    a folder of their own in the shared checkpoint folder unless given."""
    schema = spark.read.parquet(path).schema
    base = base or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(folder).isFile()
    source, glob = (folder.getParent().toString(), folder.getName()) if single else (path, "*.parquet")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source)
    stream = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    agg = stream.groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    flat = agg.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")
    run = flat.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("day timestamp_ntz, event_type string, n long, total double").parquet(f"{base}/out")


def upsert_batches(keys: list[str], target: str):
    """A foreachBatch function that keeps the last row a key under ``target``; replays of a batch change nothing.

    Each batch writes a whole new version (``target/v=<epoch>``); a version counts once its ``_SUCCESS`` is there, so readers always
    find a complete one. The version before stays for readers in flight, older ones are deleted.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        past = [v for v in _versions(spark, target) if v < epoch]
        new = batch.withColumn("_epoch", F.lit(epoch).cast("long"))
        both = spark.read.parquet(f"{target}/v={past[-1]}").unionByName(new, allowMissingColumns=True) if past else new
        keep_last(both, keys, [F.col("_epoch")]).write.mode("overwrite").parquet(f"{target}/v={epoch}")
        for v in past[:-1]:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={v}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    return write


def _versions(spark: SparkSession, target: str) -> list[int]:
    """The complete versions under ``target``, in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    found = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
    return [v for v in found if exists(spark, f"{target}/v={v}/_SUCCESS")]


def read_upserted(spark: SparkSession, target: str) -> DataFrame | None:
    """The latest complete version; None before the first."""
    versions = _versions(spark, target)
    return spark.read.parquet(f"{target}/v={versions[-1]}").drop("_epoch") if versions else None
