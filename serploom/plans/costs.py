"""What runs cost, and what the stages of a plan did: one row for each run, and one for each stage, counted while the stage's own rows go by."""

from __future__ import annotations

import functools
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from serploom.shared import written

#: Dollars for a model call, a fetched page that had to be escalated, and a search whose payload names no cost.
CALL_USD, PAGE_USD, SEARCH_USD = 0.0012, 0.0001, 0.002
PARTS = ["search_usd", "link_usd", "model_usd", "page_usd"]


def run_costs(requests: DataFrame, searches: DataFrame | None = None, links: DataFrame | None = None, calls: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """run_id, search_usd, link_usd, model_usd, page_usd, cost_usd (to four decimals) of every request; what a run did nothing of cost nothing.

    searches: run_id, cost, null where the payload names none (``captured.dated_items`` gives what it names); links: run_id, cost; calls: run_id, one row a model call, tries included; pages: run_id, via, of which only those that
    weren't got by plain HTTP cost anything.
    """
    each = []
    if searches is not None:
        each.append(searches.select("run_id", F.lit("search_usd").alias("part"), F.coalesce(F.col("cost").cast("double"), F.lit(SEARCH_USD)).alias("usd")))
    if links is not None:
        each.append(links.select("run_id", F.lit("link_usd"), F.coalesce(F.col("cost").cast("double"), F.lit(0.0))))
    if calls is not None:
        each.append(calls.select("run_id", F.lit("model_usd"), F.lit(CALL_USD)))
    if pages is not None:
        each.append(pages.filter("via <> 'http'").select("run_id", F.lit("page_usd"), F.lit(PAGE_USD)))
    none = requests.sparkSession.createDataFrame([], f"run_id {dict(requests.dtypes)['run_id']}, part string, usd double")
    spent = functools.reduce(DataFrame.union, each, none).groupBy("run_id").pivot("part", PARTS).agg(F.sum("usd"))
    out = requests.select("run_id").distinct().join(spent, "run_id", "left").select("run_id", *[F.round(F.coalesce(p, F.lit(0.0)), 4).alias(p) for p in PARTS])
    return out.withColumn("cost_usd", F.round(functools.reduce(lambda a, b: a + b, [F.col(p) for p in PARTS]), 4))


class Stages:
    """Writes stages and keeps what they did: rows, runs (about) and seconds, told by the tasks that made the rows, so that nothing is read again for it."""

    def __init__(self) -> None:
        self.done: list[tuple[str, Observation, float]] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        seen, began = Observation(), time.time()
        runs = F.approx_count_distinct("run_id") if "run_id" in df.columns else F.lit(None).cast("long")
        out = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), (runs if "run_id" in df.columns else F.max(runs)).alias("runs")), name)
        self.done.append((name, seen, time.time() - began))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """ord, stage, rows, runs, seconds."""
        rows = [(k, name, seen.get["rows"], seen.get["runs"], round(took, 3)) for k, (name, seen, took) in enumerate(self.done)]
        return spark.createDataFrame(rows, "ord int, stage string, rows long, runs long, seconds double")
