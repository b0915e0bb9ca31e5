"""spark-submit entry: analyze, compare, topical, and topic (from a topic alone) over captured Parquet tables; report writes a run's page out of analyze's results."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from serploom.operators import topical
from serploom.plans import analyze as plans
from serploom.plans import report, topics
from serploom.session import session


#: Layers that a verb can have.
OPTIONAL = {"analyze": ("more", "sims", "quality", "votes", "satisfaction", "types", "cells", "intents", "embeddings", "entities", "triples", "aliases", "stats", "links", "keywords", "crux"), "compare": ("authority", "requests"), "topic": ("replies", "searches")}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="serploom")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, inputs in (("analyze", ("requests", "items", "pages")), ("compare", ("before", "after")), ("topical", ("sitemap", "terms", "hits")), ("topic", ("requests", "robots", "documents")), ("report", ("results",))):
        v = verbs.add_parser(verb)
        for name in inputs:
            v.add_argument(f"--{name}", required=True)
        for name in OPTIONAL.get(verb, ()):
            v.add_argument(f"--{name}", help="a table of the layer; without it the layer is off")
        v.add_argument("--out", required=True)
        if verb == "report":
            v.add_argument("--run", required=True)
        if verb == "analyze":
            v.add_argument("--salient", action="store_true", help="salient-term coverage of the run's own pages")
            v.add_argument("--meaning", action="store_true", help="passages against keyword and intents, by embeddings where a run has them all, else by TF-IDF")
    a = p.parse_args(args)
    spark = spark or session()
    read = lambda n: spark.read.parquet(getattr(a, n))
    layers = {n: read(n) for n in OPTIONAL.get(a.verb, ()) if getattr(a, n)}
    if a.verb == "analyze":
        out = plans.analyze(read("requests"), read("items"), read("pages"), **layers, salient=a.salient, meaning=a.meaning)
    elif a.verb == "compare":
        asked = layers.pop("requests", None)
        out = plans.compare(read("before"), read("after"), **layers)
        if asked is not None:
            out["prompts"] = report.compare_prompts(asked, out["moves"], out["churn"])
    elif a.verb == "topic":
        terms = topics.run_terms(read("requests"), layers.get("replies"))
        found = layers.get("searches")
        # without the searches of its terms a topic is judged by the sitemaps alone
        searches = terms.select("run_id", F.lit(0).alias("pos"), F.col("query").alias("url"), F.lit("").alias("title")).limit(0) if found is None else found
        out = {"terms": terms} | topics.topics(terms, topical.inventory(read("robots"), read("documents")), searches)
    elif a.verb == "report":
        names = {name for _, name, _, _ in report.SECTIONS} | {"brief_texts"}
        there = {n: spark.read.parquet(f"{a.results}/{n}") for n in names if Path(f"{a.results}/{n}").exists()}
        Path(a.out).write_text(report.run_page(there, a.run, f"Run {a.run}"), encoding="utf-8")
        return
    else:
        out = plans.topic(read("sitemap"), read("terms"), read("hits"))
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{a.out}/{name}")


if __name__ == "__main__":
    main()
