"""Model calls that may come back empty: prompts within a budget, and a table of attempts, each hotter than the one before, until a reply says something.

An attempt asks only for prompts that no earlier attempt answered, found by an anti join; its replies are written before the next begins, so a lost executor asks its own prompts again and no others. A captured table of
replies (prompt_hash, temperature, reply) in place of a chat function replays a run without any call.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serploom.functions import replies as R
from serploom.functions import text as T
from serploom.shared import written
from serploom.shipping import ship
from serploom.sources.providers import prompt_hash

#: Characters of a page that are sent, temperatures in turn, names that one call aligns, and how many there must be.
PAGE_CHARS, TEMPERATURES, MOST_NAMES, LEAST_NAMES = 12_000, (0.0, 0.35, 0.7), 160, 2
ATTEMPTS = "prompt_hash string, attempt int, temperature double, reply string"

Chat = Callable[[str, float], str]
Useful = Callable[[DataFrame], DataFrame]


def extraction_prompts(requests: DataFrame, bodies: DataFrame) -> DataFrame:
    """run_id, rank, prompt, prompt_hash of pages with text: the keyword and the first PAGE_CHARS characters."""
    ask = "List what this page is about, one item a line: E;name;type;salience for an entity, T;entity;attribute;value for a fact, R;entity;relation;other entity for a relation."
    text = F.substring("body", 1, PAGE_CHARS)
    rows = bodies.filter(T.strip(F.coalesce("body", F.lit(""))) != "").join(requests.select("run_id", "keyword"), "run_id")
    return hashed(rows.select("run_id", "rank", F.concat(F.lit(f"{ask}\nKeyword: "), "keyword", F.lit("\n\nPage text:\n"), text).alias("prompt")))


def alignment_prompts(requests: DataFrame, triples: DataFrame) -> DataFrame:
    """run_id, prompt, prompt_hash, names: each run's attribute names, first seen first and MOST_NAMES at most, of runs with LEAST_NAMES or more."""
    name = T.norm_attr("attribute")
    first = F.min(F.struct((F.col("rank") == 0).alias("target"), "rank", "ord")).alias("first")
    seen = triples.withColumn("name", name).filter("name <> ''").groupBy("run_id", "name").agg(first)
    kept = seen.withColumn("__n", F.row_number().over(Window.partitionBy("run_id").orderBy("first", "name"))).filter(F.col("__n") <= MOST_NAMES)
    lists = kept.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "name"))), lambda x: x["name"]).alias("names")).filter(F.size("names") >= LEAST_NAMES)
    ask = "These attribute names come from pages about one search. Where two say the same, write: name => the one to use. One a line, nothing else."
    prompt = F.concat(F.lit(f"{ask}\nKeyword: "), "keyword", F.lit("\n\nAttributes:\n"), F.array_join("names", "\n"))
    return hashed(lists.join(requests.select("run_id", "keyword"), "run_id").select("run_id", prompt.alias("prompt"), "names"))


def hashed(prompts: DataFrame) -> DataFrame:
    return prompts.withColumn("prompt_hash", F.sha2("prompt", 256))


def _asked(prompts: DataFrame, chat: Chat, attempt: int, temperature: float, at_once: int) -> DataFrame:
    ship(prompts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["prompt"]:
                try:
                    reply = chat(p, temperature)
                except Exception as e:  # noqa: BLE001  a call that fails is an empty attempt
                    reply = f"[error] {e}"
                rows.append((prompt_hash(p), attempt, temperature, reply))
            yield pd.DataFrame(rows, columns=["prompt_hash", "attempt", "temperature", "reply"]).astype({"reply": object})

    return prompts.select("prompt").repartition(at_once, "prompt").mapInPandas(run, ATTEMPTS)


def attempts(prompts: DataFrame, chat: Chat | DataFrame, useful: Useful, temperatures: tuple[float, ...] = TEMPERATURES, at_once: int = 6) -> DataFrame:
    """prompt_hash, attempt (from 0), temperature, reply: every call made for distinct prompts (prompt, prompt_hash).

    useful: of replies (prompt_hash, reply) the prompt_hash of those that say something. ``[error]`` replies never do. chat: a function of prompt and temperature, or replies as captured; what was not captured is no attempt.
    """
    open_ = prompts.select("prompt", "prompt_hash").dropDuplicates(["prompt_hash"])
    done: list[DataFrame] = []
    for k, temperature in enumerate(temperatures):
        if isinstance(chat, DataFrame):
            held = chat.filter(F.col("temperature") == temperature).groupBy("prompt_hash").agg(F.min("reply").alias("reply"))
            now = open_.join(held, "prompt_hash").select("prompt_hash", F.lit(k).alias("attempt"), F.lit(temperature).alias("temperature"), "reply")
        else:
            now = _asked(open_, chat, k, temperature, at_once)
        done.append(written(now, "attempts"))
        said = useful(done[-1].filter(F.col("reply").isNotNull() & ~F.startswith("reply", F.lit("[error]"))).select("prompt_hash", "reply"))
        open_ = written(open_.join(said.select("prompt_hash").distinct(), "prompt_hash", "left_anti"), "unanswered")
        if open_.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, done)


def answers(tried: DataFrame, useful: Useful) -> DataFrame:
    """prompt_hash, reply, attempt: of each prompt the first reply that says something."""
    good = tried.filter(~F.startswith("reply", F.lit("[error]")))
    each = good.withColumn("prompt_hash", F.concat_ws("/", "prompt_hash", "attempt"))  # so that attempts are judged one by one
    kept = good.join(useful(each.select("prompt_hash", "reply")).select(F.split_part("prompt_hash", F.lit("/"), F.lit(1)).alias("prompt_hash"), F.split_part("prompt_hash", F.lit("/"), F.lit(2)).cast("int").alias("attempt")).distinct(), ["prompt_hash", "attempt"], "left_semi")
    return kept.groupBy("prompt_hash").agg(F.min_by("reply", "attempt").alias("reply"), F.min("attempt").alias("attempt"))


def _lines(replies: DataFrame) -> DataFrame:
    entities, triples = R.tagged_lines(replies, ["prompt_hash"])
    return entities.select("prompt_hash").union(triples.select("prompt_hash"))


def extracted(requests: DataFrame, bodies: DataFrame, chat: Chat | DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, triples, attempts): entities and triples as ``layers.entity_table`` takes them, 40 entities a page at most."""
    prompts = written(extraction_prompts(requests, bodies), "prompts")
    tried = attempts(prompts, chat, _lines)
    said = prompts.join(answers(tried, _lines), "prompt_hash").select("run_id", "rank", "reply")
    entities, triples = R.tagged_lines(said, ["run_id", "rank"])
    return entities, triples, tried


def aligned(requests: DataFrame, triples: DataFrame, chat: Chat | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases: run_id, raw, canonical; attempts) of one call a run, whose failure renames nothing."""
    prompts = written(alignment_prompts(requests, triples), "prompts")
    tried = attempts(prompts, chat, lambda replies: replies, temperatures=(0.0,))
    said = prompts.join(tried.filter(~F.startswith("reply", F.lit("[error]"))), "prompt_hash").select("run_id", "reply", "names")
    known = prompts.select("run_id", F.explode("names").alias("raw"))
    named = R.mapping_lines(said.select("run_id", "reply"), known.select(F.col("raw").alias("attribute")), ["run_id"])
    return named.join(known, ["run_id", "raw"], "left_semi"), tried
