"""An extension: whole analyses from a stream of result captures, each micro-batch's runs written once however often it is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from serploom.plans import analyze as plans

ITEM = ["run_id", "rank", "url", "domain", "title", "snippet", "displayed_url"]


def unique_items(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per run, rank and url within the watermark of ts; captures that are delivered again go."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "rank", "url"])


def save_batch(items: DataFrame, batch_id: int, requests: DataFrame, pages: DataFrame, out: str, names: tuple[str, ...] = ("gates", "overall", "actions"), **layers: DataFrame) -> None:
    """The named tables of a batch's runs under ``out``/name/batch=batch_id, in place of what an earlier try of the batch left there. Runs come whole in a batch; requests: run_id, keyword, target_url."""
    listed = items.select(*ITEM)
    asked = requests.join(listed.select("run_id").distinct(), "run_id", "left_semi")
    found = plans.analyze(asked, listed, pages, **layers)
    for name in names:
        found[name].write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")


def analysis_stream(stream: DataFrame, requests: DataFrame, pages: DataFrame, out: str, delay: str = "1 day", **layers: DataFrame) -> DataStreamWriter:
    """A writer to be started with a checkpoint location. stream: the columns of ITEM and ts."""
    return unique_items(stream, delay).writeStream.foreachBatch(lambda df, k: save_batch(df, k, requests, pages, out, **layers)).outputMode("append")


def latest(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table's rows of each run's last batch."""
    rows = spark.read.parquet(f"{out}/{name}")
    last = rows.groupBy("run_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["run_id", "batch"])
