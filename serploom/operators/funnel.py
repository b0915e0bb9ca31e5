"""Judgement panels, gate scores, the staged funnel verdict and competitor cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serploom.functions import text as T
from serploom.operators.correlate import pearson, percentile, ranked

# Gates in order, the click curve, cut-offs, intent scores.
GATES = ["access", "lexical", "semantic", "intent", "entities", "quality", "authority", "engagement"]
CLICK_CURVE, CLICK_REST = [0.28, 0.15, 0.11, 0.08, 0.07, 0.05, 0.04, 0.04, 0.03, 0.03], 0.02
PASS, WEAK = 55, 30
PAGE_TYPES = ["listicle", "guide", "product", "category", "service", "tool", "forum", "news", "comparison", "other"]
LEXICAL_GROUPS = ["Title", "Headings", "Content"]
ACCESS_GROUPS = ["Experience", "Technical"]


def gate_of(factor: Column, group: Column) -> Column:
    """The gate that a factor counts for; null for none."""
    return (
        F.when(factor == "SALIENT_TERM_COVERAGE", "lexical").when(factor.isin("BEST_PASSAGE_SIM", "SUBINTENT_COVERAGE", "CONTENT_FOCUS"), "semantic")
        .when(factor == "EAV_COMPLETENESS", "entities").when(factor.isin("CONTENT_EFFORT", "HELPFULNESS") | factor.startswith("TRUST_"), "quality").when(group == "Authority", "authority")
        .when(group.isin(ACCESS_GROUPS), "access").when(group.isin(LEXICAL_GROUPS), "lexical")
    )


def median_judgement(samples: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """by, median, n, note: NaN and values outside 0..100 are cleaned first; the last note counts."""
    raw = F.col(value).cast("double")
    v = F.when(raw.isNull() | F.isnan(raw), None).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)))
    return samples.withColumn("__v", v).groupBy(*by).agg(F.median("__v").alias("median"), F.count("__v").alias("n"), F.max_by("note", "ord").alias("note"))


def allowed_types(replies: DataFrame, requested: DataFrame) -> DataFrame:
    """run_id, rank, page_type of a panel's replies: known types, of ranks that were asked for; the last reply on a rank counts. replies: run_id, rank, page_type, ord; requested: run_id, rank."""
    clean = replies.withColumns({"rank": F.col("rank").cast("string").try_cast("int"), "page_type": F.lower(F.trim("page_type"))}).filter(F.col("page_type").isin(PAGE_TYPES))
    return clean.join(requested.select("run_id", "rank").distinct(), ["run_id", "rank"], "left_semi").groupBy("run_id", "rank").agg(F.max_by("page_type", "ord").alias("page_type"))


def dominant(pages: DataFrame, by: list[str], kind: str = "page_type", rank: str = "rank") -> DataFrame:
    """by, dominant, share: the most frequent kind, the one on the best rank on ties."""
    counted = pages.groupBy(*by, kind).agg(F.count("*").alias("c"), F.min(rank).alias("r"))
    return counted.groupBy(*by).agg(F.max_by(kind, F.struct("c", -F.col("r"))).alias("dominant"), (F.max("c") / F.sum("c")).alias("share"))


def intent_fit(target: Column, dominant_: Column, share: Column) -> Column:
    return F.when((target == dominant_) & (share >= 0.4), "match").when((target != dominant_) & (share >= 0.5), "mismatch").otherwise("partial")


def intent_score(fit: Column) -> Column:
    return F.when(fit == "match", 90.0).when(fit == "partial", 55.0).when(fit == "mismatch", 15.0)


def vote_share(votes: DataFrame, by: list[str]) -> DataFrame:
    """by, id, share: per panel count / total, mean over all panels (no vote is 0), scaled to sum 1. votes: by, panel, id, count."""
    clean = votes.filter(F.col("count") > 0).groupBy(*by, "panel", "id").agg(F.sum("count").alias("c"))
    total = Window.partitionBy(*by, "panel")
    part = clean.withColumn("s", F.col("c") / F.sum("c").over(total))
    panels = clean.groupBy(*by).agg(F.count_distinct("panel").alias("k"))
    mean = part.groupBy(*by, "id").agg(F.sum("s").alias("s")).join(panels, by).withColumn("m", F.col("s") / F.col("k"))
    return mean.withColumn("share", F.col("m") / F.sum("m").over(Window.partitionBy(*by))).select(*by, "id", "share")


def panel_order(items: DataFrame, by: list[str], keyword: Column, key: str = "url", ties: Sequence[str] = ()) -> DataFrame:
    """A neutral order of results that depends on keyword and url alone; ties: columns that decide between rows of the same url."""
    return items.withColumn("neutral_id", F.row_number().over(Window.partitionBy(*by).orderBy(F.sha2(F.concat(keyword, F.lit("|"), F.col(key)), 256), key, *ties)))


def expected_clicks(rank: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, CLICK_CURVE)), F.when(rank >= 1, rank.cast("int"))), F.lit(CLICK_REST))


def engagement_score(share: Column, rank: Column) -> Column:
    """Share against the share expected at the rank, in percent, at most 100."""
    return F.least(share / expected_clicks(rank) * 100, F.lit(100.0))


def gate_scores(values: DataFrame, definitions: DataFrame, run: str = "run_id") -> DataFrame:
    """run, rank, gate, score: mean of the factors' percentiles among ranked pages; less_is_better ones are turned."""
    d = definitions.select("factor_id", F.col("group").alias("__g"), "direction")
    v = values.join(d, "factor_id", "left").withColumn("gate", gate_of(F.col("factor_id"), F.col("__g"))).filter("gate is not null")
    p = percentile(v, [run, "factor_id"])
    turned = F.when(F.col("direction") == "less_is_better", F.lit(100.0) - F.col("percentile")).otherwise(F.col("percentile"))
    return p.withColumn("x", turned).groupBy(run, "rank", "gate").agg(F.avg("x").alias("score"))


def located(items: DataFrame, requests: DataFrame) -> DataFrame:
    """run_id, target_rank: the best rank of the target's domain in its own result list; no row where it isn't there. items: run_id, rank, domain; requests: run_id, target_url."""
    own = requests.filter("target_url is not null").select("run_id", T.host_of("target_url").alias("domain"))
    return items.join(own, ["run_id", "domain"]).groupBy("run_id").agg(F.min("rank").alias("target_rank"))


def intent_gate(types: DataFrame) -> DataFrame:
    """run_id, rank, score: of the target (rank 0) its fit, of ranked pages 90 for the dominant type and 40 for another. types: run_id, rank, page_type."""
    wanted = dominant(types.filter("rank > 0 and page_type is not null"), ["run_id"])
    fit = intent_score(intent_fit(F.col("page_type"), F.col("dominant"), F.col("share")))
    return types.filter("page_type is not null").join(wanted, "run_id").select("run_id", "rank", F.when(F.col("rank") == 0, fit).otherwise(F.when(F.col("page_type") == F.col("dominant"), 90.0).otherwise(40.0)).alias("score"))


def engagement_gate(values: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """run_id, rank, score: mean of the click share against what its position may expect, and of the satisfaction. targets: run_id, target_rank."""
    v = values.filter(F.col("factor_id").isin("CLICK_SHARE", "SATISFACTION"))
    v = v.join(targets, "run_id", "left") if targets is not None else v.withColumn("target_rank", F.lit(None).cast("int"))
    at = F.when(F.col("rank") == 0, F.col("target_rank")).otherwise(F.col("rank"))
    raw = F.when(F.col("factor_id") == "CLICK_SHARE", F.col("value") / 100 / expected_clicks(at) * 100).otherwise(F.col("value"))
    return v.groupBy("run_id", "rank").agg(F.avg(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))).alias("score"))


def access_gate(scores: DataFrame, fetched: DataFrame, values: DataFrame) -> DataFrame:
    """run_id, rank, score: access scores averaged with 100 for a fetched page and 0 for another; a target with factors counts as fetched. fetched: run_id, rank, ok."""
    target = values.filter("rank = 0").select("run_id", "rank").distinct().join(fetched.select("run_id", "rank"), ["run_id", "rank"], "left_anti")
    got = fetched.select("run_id", "rank", F.when(F.col("ok"), 100.0).otherwise(0.0).alias("f")).union(target.withColumn("f", F.lit(100.0)))
    both = scores.select("run_id", "rank", "score").join(got, ["run_id", "rank"], "full_outer")
    return both.select("run_id", "rank", F.coalesce((F.col("score") + F.col("f")) / 2, "f", "score").alias("score"))


def all_gates(values: DataFrame, definitions: DataFrame, fetched: DataFrame | None = None, cells: DataFrame | None = None, types: DataFrame | None = None, targets: DataFrame | None = None, unread: DataFrame | None = None, fits: DataFrame | None = None) -> DataFrame:
    """run_id, rank, gate, score of all eight gates, as far as there is something to judge them by. cells: run_id, rank, canon, present of the entity table's coverage rows.

    unread: run_id of runs whose target wasn't read for entities; they have no entity gate. fits: run_id, fit of the intent panel, which then decides the targets' intent scores: a target without a type of its own has one, too.
    """
    scores = gate_scores(values, definitions)
    parts = [scores.filter(~F.col("gate").isin("access", "entities"))]
    named = lambda df, g: df.select("run_id", "rank", F.lit(g).alias("gate"), "score")
    access = scores.filter("gate = 'access'")
    parts.append(named(access_gate(access, fetched, values) if fetched is not None else access, "access"))
    entity = scores.filter("gate = 'entities'").select("run_id", "rank", "score")
    if cells is not None:
        entity = entity.union(cells.groupBy("run_id", "rank").agg((F.avg(F.col("present").cast("double")) * 100).alias("score"))).groupBy("run_id", "rank").agg(F.avg("score").alias("score"))
    parts.append(named(entity if unread is None else entity.join(unread.select("run_id"), "run_id", "left_anti"), "entities"))
    if types is not None:
        of_types = intent_gate(types)
        if fits is not None:
            of_types = of_types.filter("rank > 0").unionByName(fits.select("run_id", F.lit(0).alias("rank"), intent_score(F.col("fit")).alias("score")))
        parts.append(named(of_types, "intent"))
    parts.append(named(engagement_gate(values, targets), "engagement"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gate_weights(pages: DataFrame, run: str = "run_id") -> DataFrame:
    """run, gate, weight: max(0.25, |Spearman| of score and rank); 0.5 under three pages or without variance."""
    rows = pages.filter("rank > 0 and score is not null")
    g = ranked(rows, [run, "gate"], {"score": "rv", "rank": "rr"}).groupBy(run, "gate").agg(F.count("*").alias("n"), pearson("rv", "rr").alias("s"))
    return g.select(run, "gate", F.when((F.col("n") < 3) | F.col("s").isNull(), 0.5).otherwise(F.greatest(F.abs("s"), F.lit(0.25))).alias("weight"))


def verdict(score: Column) -> Column:
    return F.when(score.isNull(), "n/a").when(score >= PASS, "pass").when(score >= WEAK, "weak").otherwise("fail")


def funnel(pages: DataFrame, run: str = "run_id", unread: DataFrame | None = None) -> DataFrame:
    """run, gate, ord, score, weight, verdict of the target: its percentile among the ranked pages of each gate; the entity gate of an unread target (run) is n/a."""
    p = percentile(pages, [run, "gate"], "score", "pct").filter("rank = 0").select(run, "gate", F.col("pct").alias("score"))
    if unread is not None:
        p = p.unionByName(unread.select(run, F.lit("entities").alias("gate"), F.lit(None).cast("double").alias("score")).distinct())
    out = p.join(gate_weights(pages, run), [run, "gate"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.5)))
    return out.withColumn("verdict", verdict(F.col("score"))).withColumn("ord", F.array_position(F.array(*map(F.lit, GATES)), F.col("gate")))


def overall(gates: DataFrame, run: str = "run_id") -> DataFrame:
    """run, overall, bottleneck: weighted mean times sqrt(max(worst weak or failed gate, 5) / 100); the first failed gate, else the first weak one."""
    s = gates.filter("score is not null")
    worst = F.min(F.when(F.col("score") < PASS, F.col("score")))
    factor = F.when(worst.isNull(), 1.0).otherwise(F.sqrt(F.greatest(worst, F.lit(5.0)) / 100))
    first = lambda v: F.min_by("gate", F.when(F.col("verdict") == v, F.col("ord")))
    return s.groupBy(run).agg((F.sum(F.col("weight") * F.col("score")) / F.sum("weight") * factor).alias("overall"), F.coalesce(first("fail"), first("weak")).alias("bottleneck"))


def advantages(pages: DataFrame, run: str = "run_id", margin: float = 2.0, most_pages: int = 5, most: int = 3) -> DataFrame:
    """run, rank, gate, lead, place: where the best ranked pages beat the target by more than ``margin`` points. A self join by run and gate."""
    own = pages.filter("rank = 0").select(run, "gate", F.col("score").alias("own"))
    top = pages.filter("rank > 0").withColumn("__k", F.dense_rank().over(Window.partitionBy(run).orderBy("rank"))).filter(F.col("__k") <= most_pages)
    led = top.join(own, [run, "gate"]).withColumn("lead", F.col("score") - F.col("own")).filter(F.col("lead") > margin)
    return led.withColumn("place", F.row_number().over(Window.partitionBy(run, "rank").orderBy(F.desc("lead"), "gate"))).filter(F.col("place") <= most).select(run, "rank", "gate", "lead", "place")
