"""Tables written once and read by everything behind them, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    place = "file://" + tempfile.mkdtemp(prefix="serploom-")
    spark.conf.set("spark.checkpoint.dir", place)
    return place


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet: what it took to make it is done once, however many plans read it, and survives lost executors."""
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one for each run that are broadcast: with 150 words each some 20 MB.
MOST_SENT = 10_000


def sent(df: DataFrame, name: str, most: int = MOST_SENT) -> DataFrame:
    """``df``, one row a run, written, and broadcast where it is joined unless it has more than ``most`` rows: then no run is large enough to be many tasks' work."""
    held = written(df, name)
    return F.broadcast(held) if held.limit(most + 1).count() <= most else held
