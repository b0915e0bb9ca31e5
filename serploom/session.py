"""A session with the settings that this engine is tuned for; any other session works, too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "serploom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",  # rows hold whole documents
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: An option of the session, unset by default: the number of tasks that a query's scan of documents, pages or parts is dealt out to. For trying queries on one small file, which is one task
#: otherwise however many cores there are. At scale it stays unset: files give tasks enough, and nothing is shuffled.
SCAN_PARTITIONS = "spark.serploom.scanPartitions"


def scan(spark: SparkSession, path: str, wide: bool) -> DataFrame:
    """A table as its files lie, or dealt out as the session's option says if its rows are much work each."""
    found, n = spark.read.parquet(path), spark.conf.get(SCAN_PARTITIONS, None)
    return found.repartition(int(n)) if n and wide else found
