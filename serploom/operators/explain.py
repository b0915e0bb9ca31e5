"""Why a page ranks where it does, in words: the intent panel with its note, the gate report, and cards of those who rank above the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serploom.operators import funnel

# gates' names, the factors that a gate shows in this order, gates whose evidence is estimated, caps of details and cards.
GATE_NAMES = {
    "access": "Access & Experience", "lexical": "Lexical Topicality", "semantic": "Semantic Relevance", "intent": "Intent & Format Fit",
    "entities": "Entity & Topical Completeness", "quality": "Quality, Effort & Trust", "authority": "Authority", "engagement": "Engagement",
}
SHOWN = {
    "access": ["CRUX_LCP_MS", "CRUX_INP_MS", "CRUX_CLS"], "lexical": ["SALIENT_TERM_COVERAGE", "TITLE_VARS", "BODY_VARS"],
    "semantic": ["BEST_PASSAGE_SIM", "SUBINTENT_COVERAGE", "CONTENT_FOCUS"], "entities": ["EAV_COMPLETENESS"], "quality": ["CONTENT_EFFORT", "HELPFULNESS"],
    "authority": ["AUTHORITY_SCORE", "PAGE_AUTHORITY", "REF_DOMAINS"], "engagement": ["CLICK_SHARE", "SATISFACTION"],
}
ESTIMATED = ["intent", "quality", "engagement"]
CARDS, REASONS, MARGIN = 5, 3, 2.0
FITS = {"match": "the formats match", "partial": "the fit is partial", "mismatch": "the formats differ"}


def _lookup(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def intent_panel(types: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """run_id, dominant, n, of, share, target_type, fit, note of every run with a typed ranked page.

    types: run_id, rank, page_type; the target's own has rank 0, else that of its place in the list counts. targets: run_id, target_rank.
    A target without a type fits in part.
    """
    known = types.filter("page_type is not null")
    ranked_ = known.filter("rank > 0")
    want = funnel.dominant(ranked_, ["run_id"])
    n = ranked_.join(want, "run_id").groupBy("run_id").agg(F.count_if(F.col("page_type") == F.col("dominant")).alias("n"), F.count("*").alias("of"))
    place = targets.select("run_id", "target_rank") if targets is not None else known.select("run_id", F.lit(None).cast("int").alias("target_rank")).limit(0)
    own = known.join(place, "run_id", "left").filter((F.col("rank") == 0) | (F.col("rank") == F.col("target_rank"))).groupBy("run_id").agg(F.min_by("page_type", "rank").alias("target_type"))
    out = want.join(n, "run_id").join(own, "run_id", "left")
    out = out.withColumn("fit", F.when(F.col("target_type").isNull(), "partial").otherwise(funnel.intent_fit(F.col("target_type"), F.col("dominant"), F.col("share"))))
    say = F.concat(F.col("n"), F.lit(" of "), F.col("of"), F.lit(" typed results are of type "), F.col("dominant"), F.lit("; "), F.coalesce(F.concat(F.lit("yours is of type "), F.col("target_type"), F.lit(": ")), F.lit("yours has no type: ")), _lookup(F.col("fit"), FITS), F.lit("."))
    return out.select("run_id", "dominant", "n", "of", "share", "target_type", "fit", say.alias("note"))


def gate_report(gates: DataFrame, verdicts: DataFrame, values: DataFrame, definitions: DataFrame, panel: DataFrame | None = None) -> DataFrame:
    """run_id, gate, ord, name, score, verdict, weight, tier, details: all eight gates of every run, n/a where there is nothing to judge the target by.

    gates: run_id, rank, gate, score of pages; verdicts: ``funnel.funnel``'s; values: run_id, rank, factor_id, value. The tier says what stands behind a gate: field data makes access measured, panels estimate, the rest is computed.
    Details are the target's own numbers, by the factors' names, at most three; of the intent gate the panel's note.
    """
    runs = values.select("run_id").distinct()
    every = runs.select("run_id", F.posexplode(F.array(*map(F.lit, funnel.GATES))).alias("k", "gate")).withColumn("ord", F.col("k") + 1).drop("k")
    field = values.filter(F.col("factor_id").startswith("CRUX_")).select("run_id", F.lit(True).alias("field")).distinct()
    order = {f: k for names in SHOWN.values() for k, f in enumerate(names)}
    gate_of = {f: g for g, names in SHOWN.items() for f in names}
    own = values.filter((F.col("rank") == 0) & F.col("factor_id").isin(list(order)) & F.col("value").isNotNull()).join(definitions.select("factor_id", "name"), "factor_id")
    line = F.concat("name", F.lit(": "), F.format_string("%.1f", F.round("value", 6)))
    lines = own.groupBy("run_id", _lookup(F.col("factor_id"), gate_of).alias("gate")).agg(F.array_sort(F.collect_list(F.struct(_lookup(F.col("factor_id"), order).alias("k"), line.alias("l")))).alias("ls"))  # three at most
    details = lines.select("run_id", "gate", F.transform("ls", lambda x: x["l"]).alias("shown"))
    if panel is not None:
        details = details.unionByName(panel.select("run_id", F.lit("intent").alias("gate"), F.array("note").alias("shown")))
    out = every.join(verdicts.select("run_id", "gate", "score", "verdict"), ["run_id", "gate"], "left").join(funnel.gate_weights(gates), ["run_id", "gate"], "left").join(details, ["run_id", "gate"], "left").join(field, "run_id", "left")
    tier = F.when((F.col("gate") == "access") & F.col("field"), "measured").when(F.col("gate").isin(ESTIMATED), "estimated").otherwise("computed")
    return out.select(
        "run_id", "gate", "ord", _lookup(F.col("gate"), GATE_NAMES).alias("name"), "score", F.coalesce("verdict", F.lit("n/a")).alias("verdict"), F.coalesce("weight", F.lit(0.5)).alias("weight"), tier.alias("tier"),
        F.coalesce("shown", F.array().cast("array<string>")).alias("details"),
    )


def summary(overall: DataFrame) -> DataFrame:
    """run_id, overall, bottleneck, summary."""
    say = F.coalesce(F.concat(F.lit("What holds your page back first is "), _lookup(F.col("bottleneck"), GATE_NAMES), F.lit(".")), F.lit("No gate that can be judged is weak."))
    return overall.withColumn("summary", say)


def cards(gates: DataFrame, pages: DataFrame, report: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """run_id, rank, url, domain, place, gate, theirs, yours, lead, reason, evidence: why each of the first five pages above the target is there, three reasons at most.

    gates: run_id, rank, gate, score; pages: run_id, rank, url, domain; report: ``gate_report``'s; targets: run_id, target_rank. Without a place of the target all pages count as above it. A gate is a reason where it leads by over
    two points, the largest lead first, ties in the order of gates; a page that leads nowhere has one row that says so, without a gate.
    """
    place = targets.select("run_id", "target_rank") if targets is not None else pages.select("run_id", F.lit(None).cast("int").alias("target_rank")).limit(0)
    above = pages.filter("rank > 0").join(place, "run_id", "left").filter(F.col("target_rank").isNull() | (F.col("rank") < F.col("target_rank")))
    first = above.withColumn("__k", F.row_number().over(Window.partitionBy("run_id").orderBy("rank", "url"))).filter(F.col("__k") <= CARDS).select("run_id", "rank", "url", "domain")
    yours = gates.filter("rank = 0").select("run_id", "gate", F.col("score").alias("yours"))
    led = gates.filter("rank > 0").withColumnRenamed("score", "theirs").join(yours, ["run_id", "gate"]).withColumn("lead", F.round(F.col("theirs") - F.col("yours"), 6)).filter(F.col("lead") > MARGIN)
    out = first.join(led, ["run_id", "rank"], "left").join(report.select("run_id", "gate", "ord", "name", "tier"), ["run_id", "gate"], "left")
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("run_id", "rank", "url").orderBy(F.desc("lead"), "ord"))).filter(F.col("place") <= REASONS)
    n = lambda c: F.format_string("%.0f", F.round(c, 6))
    reason = F.when(F.col("gate").isNull(), "No gate that was measured explains this rank: authority, a known brand or past behaviour may.").otherwise(F.concat("name", F.lit(": "), n("theirs"), F.lit(" against your "), n("yours"), F.lit(", "), n("lead"), F.lit(" points ahead.")))
    evidence = F.when(F.col("gate").isNull(), "all measured gates").otherwise(F.concat("name", F.lit(", "), "tier"))
    return out.select("run_id", "rank", "url", "domain", "place", "gate", "theirs", "yours", "lead", reason.alias("reason"), evidence.alias("evidence"))
