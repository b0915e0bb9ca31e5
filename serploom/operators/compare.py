"""Result lists: deduplication, as-of snapshots, rank moves between two lists, churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serploom.functions import text as T

# Sites whose moves say nothing about others.
MEGA_PLATFORMS = (
    "youtube.com reddit.com facebook.com instagram.com quora.com twitter.com x.com tiktok.com amazon.com ebay.com walmart.com wikipedia.org wikihow.com fandom.com "
    "trustpilot.com scribd.com discord.com pinterest.com linkedin.com medium.com"
).split()
STATUSES = ["entered", "up", "same", "down", "dropped"]


def valid_items(items: DataFrame) -> DataFrame:
    """http urls with a host and a rank; rank is organic_rank, else position."""
    out = items.withColumn("rank", F.coalesce(F.col("organic_rank").try_cast("int"), F.col("position").try_cast("int"))).withColumn("domain", T.host_of("url"))
    return out.filter(F.lower("url").startswith("http") & (F.coalesce("domain", F.lit("")) != "") & F.col("rank").isNotNull())


def best_per_domain(items: DataFrame, by: list[str], tie: str = "url") -> DataFrame:
    """The best ranked row of each domain, the first on ties. A struct minimum: partial aggregation, no sort."""
    rest = [c for c in items.columns if c not in (*by, "domain", "rank", tie)]
    return items.groupBy(*by, "domain").agg(F.min_by(F.struct("rank", tie, *rest), F.struct("rank", tie)).alias("r")).select(*by, "domain", "r.*")


def as_of(snapshots: DataFrame, cutoffs: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """by, cutoff, ts, value: the latest snapshot strictly before the cutoff, else the earliest of all."""
    before = F.col(ts) < F.col("cutoff")
    joined = snapshots.join(cutoffs, by)
    row = F.struct(ts, "value")
    picked = joined.groupBy(*by, "cutoff").agg(F.coalesce(F.max(F.when(before, row)), F.min(row)).alias("s"))
    return picked.select(*by, "cutoff", F.col(f"s.{ts}").alias(ts), F.col("s.value").alias("value"))


def status(before: Column, after: Column) -> Column:
    return F.when(before.isNull(), "entered").when(after.isNull(), "dropped").when(after < before, "up").when(after > before, "down").otherwise("same")


def moves(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """by, domain, before_rank, after_rank, delta, status, is_mega, place. Inputs: by, domain, rank, one row per domain."""
    b, a = before.select(*by, "domain", F.col("rank").alias("before_rank")), after.select(*by, "domain", F.col("rank").alias("after_rank"))
    out = b.join(a, [*by, "domain"], "full_outer").withColumn("delta", F.col("before_rank") - F.col("after_rank"))
    out = out.withColumn("status", status(F.col("before_rank"), F.col("after_rank"))).withColumn("is_mega", T.registrable_compare("domain").isin(MEGA_PLATFORMS))
    order = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order, F.desc(F.coalesce("delta", F.lit(0))), "domain")))


def with_authority(moved: DataFrame, authority: DataFrame) -> DataFrame:
    """Authority columns of the exact domain, else of the registrable one, as a whole row."""
    names = [c for c in authority.columns if c != "domain"]
    row = authority.select("domain", F.struct(*names).alias("row"))
    exact = row.select(F.col("domain").alias("__e"), F.col("row").alias("__exact"))
    wide = row.select(F.col("domain").alias("__w"), F.col("row").alias("__wide"))
    out = moved.withColumn("__r", T.registrable_compare("domain"))
    out = out.join(exact, F.col("domain") == F.col("__e"), "left").join(wide, F.col("__r") == F.col("__w"), "left")
    return out.withColumn("row", F.coalesce("__exact", "__wide")).select(*moved.columns, "row.*")


def churn(moved: DataFrame, by: list[str]) -> DataFrame:
    """by, entered, dropped, churn_pct, n1_before, n1_after, n1_flip, mega_entered, mega_dropped."""
    at = lambda c: F.min_by("domain", F.when(F.col(c) == 1, F.col(c)))
    return moved.groupBy(*by).agg(
        F.count_if(F.col("status") == "entered").alias("entered"),
        F.count_if(F.col("status") == "dropped").alias("dropped"),
        F.try_divide(F.count_if(F.col("status") == "entered") * F.lit(100.0), F.count("after_rank")).alias("churn_pct"),
        at("before_rank").alias("n1_before"),
        at("after_rank").alias("n1_after"),
        F.count_if((F.col("status") == "entered") & F.col("is_mega")).alias("mega_entered"),
        F.count_if((F.col("status") == "dropped") & F.col("is_mega")).alias("mega_dropped"),
    ).withColumn("n1_flip", F.coalesce(F.col("n1_before") != F.col("n1_after"), F.lit(False)))


def by_change(moved: DataFrame, by: list[str]) -> DataFrame:
    """moved with report_place: the largest change first, entered and dropped ones as the largest, then by the rank after."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.coalesce(F.abs("delta"), F.lit(999))), F.coalesce("after_rank", F.lit(999)), "domain")
    return moved.withColumn("report_place", F.row_number().over(order))
