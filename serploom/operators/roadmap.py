"""From correlations and a target's values to a prioritised list of actions, and the target's scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serploom.operators.registry import IMPORTANT_GROUPS

#: Actions per run and per group, and the relaxed evidence bound.
LIMIT, PER_GROUP, RELAXED = 10, 3, 0.15


def goal(is_bool: Column, unit: Column, average: Column) -> Column:
    """1 for booleans; whole for countable units and from 10 up; one decimal below. Half to even."""
    a = F.coalesce(average, F.lit(0.0))
    return F.when(is_bool, 1.0).when(~unit.isin("Other", "Percent") | (a >= 10), F.bround(a, 0)).otherwise(F.bround(a, 1))


def impact(group: Column, top200: Column, difficulty: Column, best: Column, deficit: Column, goal_: Column, significant: Column) -> Column:
    base = F.when(group.isin("Authority", "Brand"), 1.6).when(group == "Entity", 1.5).when(top200, 1.2).otherwise(1.0)
    ease = F.when(F.lower(difficulty) == "easy", 1.15).otherwise(0.9)
    evidence = F.least(F.abs(F.coalesce(best, F.lit(0.0))), F.lit(1.0)) + 0.4
    gap = F.least(deficit / F.greatest(goal_, F.lit(1.0)), F.lit(1.0)) + 1.0
    return base * ease * evidence * gap * F.when(significant, 1.15).otherwise(1.0)


def candidates(correlations: DataFrame, definitions: DataFrame, targets: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per factor that passes the direction and opposing-sign gates, with goal, current, deficit, met and eligible.

    targets: run, factor_id, value. A run without any target row has no current values.
    """
    d = definitions.select("factor_id", "name", "group", "phase", "unit", "top200", "is_bool", "difficulty", F.col("direction").alias("registered"), "ordinal")
    # both right sides are a registry and one row per run and factor: sized, not assumed, by the planner
    has = targets.select(run).distinct().withColumn("has_target", F.lit(True))
    t = targets.select(run, "factor_id", F.col("value").alias("target_value"))
    c = correlations.join(d, "factor_id", "left").join(t, [run, "factor_id"], "left").join(has, run, "left")
    c = c.withColumns({"group": F.coalesce("group", F.lit("Other")), "top200": F.coalesce("top200", F.lit(False)), "is_bool": F.coalesce("is_bool", F.lit(False)), "unit": F.coalesce("unit", F.lit("Count")), "difficulty": F.coalesce("difficulty", F.lit("Easy"))})
    strong = F.coalesce(F.col("significant"), F.lit(False))
    r = F.round("best", 12)  # a rank correlation can be 0.15 itself; its last bit mustn't decide
    opposing = F.coalesce((r > 0) & (strong | (r >= RELAXED)), F.lit(False))
    c = c.filter((F.coalesce("registered", "direction") == "more_is_better") & (~opposing | F.col("group").isin(IMPORTANT_GROUPS)))
    c = c.withColumn("goal", goal(F.col("is_bool"), F.col("unit"), F.col("page1_avg")))
    c = c.withColumn("current", F.when(F.coalesce("has_target", F.lit(False)), F.coalesce("target_value", F.lit(0.0))))
    c = c.withColumn("deficit", F.coalesce(F.greatest(F.col("goal") - F.col("current"), F.lit(0.0)), F.col("goal")))
    enough = F.when(F.col("is_bool"), F.col("deficit") > 0).otherwise(F.bround("deficit", 0) >= 1)
    evidence = F.col("top200") | F.col("group").isin(IMPORTANT_GROUPS) | (F.abs(F.coalesce(r, F.lit(0.0))) >= RELAXED) | strong
    return c.withColumns({
        "met": F.col("deficit") <= 0,
        "eligible": (F.col("deficit") > 0) & enough & evidence,
        "score": impact(F.col("group"), F.col("top200"), F.col("difficulty"), F.col("best"), F.col("deficit"), F.col("goal"), strong),
    })


def top_actions(scored: DataFrame, run: str = "run_id", limit: int = LIMIT, per_group: int = PER_GROUP) -> DataFrame:
    """The best ``limit`` per run, at most ``per_group`` of a group first, then backfilled by score; with ``place``."""
    order = [F.desc("score"), F.col("ordinal").asc_nulls_last(), "factor_id"]
    capped = F.row_number().over(Window.partitionBy(run, "group").orderBy(*order)) <= per_group
    first = scored.filter("eligible").withColumn("capped", capped)
    place = F.row_number().over(Window.partitionBy(run).orderBy(F.desc("capped"), *order))
    chosen = first.withColumn("__p", place).filter(F.col("__p") <= limit)
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy(*order))).drop("__p")


def scorecard(scored: DataFrame, run: str = "run_id") -> DataFrame:
    """Optimisation score and quick wins per run."""
    s = F.coalesce(F.col("significant"), F.lit(False))
    easy = F.col("eligible") & (F.col("difficulty") == "Easy")
    return scored.groupBy(run).agg(
        F.count_if(s).alias("n_significant"),
        F.count_if(s & F.col("met")).alias("n_met"),
        (F.lit(100.0) * F.count_if(s & F.col("met")) / F.greatest(F.count_if(s), F.lit(1))).alias("score"),
        F.count_if(easy).alias("quick_wins"),
    )


def status(current: Column, goal_: Column, less: Column, tolerance: float = 0.12) -> Column:
    """Badge of a row: met, under, over or off."""
    low, high = goal_ * (1 - tolerance), goal_ * (1 + tolerance)
    return F.when(current.isNull() | goal_.isNull(), "off").when((current >= low) & (current <= high), "met").when(current < low, F.when(less, "met").otherwise("under")).otherwise(F.when(less, "over").otherwise("met"))
