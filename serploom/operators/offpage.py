"""Backlinks, authority and brand demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serploom.functions import text as T

# Sites that are no rivals, top-level domains that are hidden.
NON_COMPETITORS = (
    "facebook instagram youtube twitter x linkedin tiktok pinterest reddit yelp tripadvisor wikipedia google bing yahoo amazon ebay quora medium threads snapchat whatsapp "
    "glassdoor indeed nextdoor angi thumbtack groupon foursquare mapquest bbb healthgrades zocdoc webmd vitals ratemds wellness yellowpages"
).split()
SPAM_TLDS = r"[.](store|top|app)$"
CORE_LETTERS = 5


def join_stats(pages: DataFrame, stats: DataFrame) -> DataFrame:
    """Backlink factors by three lookups into one table (target, authority_score, referring_domains, total_backlinks, follow, nofollow): url, domain, home page."""

    def side(p: str) -> DataFrame:
        return stats.select(F.col("target").alias(f"{p}_t"), *[F.col(c).alias(f"{p}_{c}") for c in ("authority_score", "referring_domains", "total_backlinks", "follow", "nofollow")])

    home = F.concat(F.lit("https://"), F.col("domain"), F.lit("/"))
    out = pages.join(side("u"), F.col("url") == F.col("u_t"), "left").join(side("d"), F.col("domain") == F.col("d_t"), "left").join(side("h"), home == F.col("h_t"), "left")
    return out.select(
        *pages.columns, F.col("d_referring_domains").alias("REF_DOMAINS"), F.col("d_total_backlinks").alias("BACKLINKS"), F.col("d_authority_score").alias("AUTHORITY_SCORE"),
        F.col("u_authority_score").alias("PAGE_AUTHORITY"), F.col("u_referring_domains").alias("PAGE_REF_DOMAINS"), F.col("u_total_backlinks").alias("PAGE_BACKLINKS"),
        (T.dofollow_ratio("u_follow", "u_nofollow") * 100).alias("PAGE_FOLLOW_RATIO"), F.col("h_authority_score").alias("HOMEPAGE_AUTHORITY"),
    )


def not_spam(links: DataFrame) -> DataFrame:
    return links.filter(~F.lower("source_domain").rlike(SPAM_TLDS) & ~F.coalesce(F.col("source_authority") <= 3, F.lit(False)))


def link_quality(links: DataFrame, by: list[str]) -> DataFrame:
    """by, quality (0..1): 0.4 authority / 100, 0.3 relevance, 0.3 dofollow share, over the weights of what is known."""
    parts = links.groupBy(*by).agg(F.avg(T.number("source_authority") / 100).alias("a"), F.avg(T.number("relevance")).alias("r"), F.avg(F.col("dofollow").cast("double")).alias("f"))
    weight = lambda c, w: F.when(F.col(c).isNotNull(), w).otherwise(0.0)
    total = weight("a", 0.4) + weight("r", 0.3) + weight("f", 0.3)
    some = F.coalesce(F.col("a") * 0.4, F.lit(0.0)) + F.coalesce(F.col("r") * 0.3, F.lit(0.0)) + F.coalesce(F.col("f") * 0.3, F.lit(0.0))
    return parts.select(*by, F.try_divide(some, F.nullif(total, F.lit(0.0))).alias("quality"), F.col("a").alias("authority"), F.col("r").alias("relevance"), F.col("f").alias("dofollow_share"))


def strongest_links(links: DataFrame, by: list[str]) -> DataFrame:
    """One link per (by, destination, source_domain): by authority, dofollow, relevance; a struct maximum, no sort."""
    rest = [c for c in links.columns if c not in (*by, "destination", "source_domain")]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce("source_authority", F.lit(-1.0)), "dofollow", F.coalesce("relevance", F.lit(-1.0)), "source_url"))
    return links.groupBy(*by, "destination", "source_domain").agg(best.alias("r")).select(*by, "destination", "source_domain", "r.*")


def branded(phrase: Column, domain: Column, core: Column) -> Column:
    """The phrase contains the domain's label run together, or begins with the recovered core word."""
    return F.contains(T.alnum(phrase), T.alnum(T.sld_label(domain))) | F.coalesce(F.split(F.trim(F.lower(phrase)), r"\s+")[0] == core, F.lit(False))


def brand_core(keywords: DataFrame) -> DataFrame:
    """domain, core: the shortest single-word phrase of 5 letters or more that begins the label; the first on ties. keywords: domain, phrase, volume, ord."""
    word = T.alnum("phrase")
    fit = ~F.trim("phrase").contains(" ") & (F.length(word) >= CORE_LETTERS) & F.startswith(T.alnum(T.sld_label("domain")), word) & (F.length(word) < F.length(T.alnum(T.sld_label("domain"))))
    return keywords.filter(fit).groupBy("domain").agg(F.min_by(word, F.struct(F.length(word), "ord")).alias("core"))


def branded_volume(keywords: DataFrame) -> DataFrame:
    """domain, BRAND_VOLUME, n_phrases: the highest volume of each branded phrase, summed."""
    cored = keywords.join(brand_core(keywords), "domain", "left")
    own = cored.filter(branded(F.col("phrase"), F.col("domain"), F.col("core")))
    each = own.groupBy("domain", F.lower("phrase").alias("p")).agg(F.max("volume").alias("v"))
    return each.groupBy("domain").agg(F.sum("v").alias("BRAND_VOLUME"), F.count("*").alias("n_phrases"))


def leaderboard(volumes: DataFrame, by: list[str], rivals: int = 5) -> DataFrame:
    """by, domain, volume, rank, position, shown: position by volume among competitors; shown are the best ranked rivals and the target (is_target)."""
    kept = volumes.filter(F.col("is_target") | ~T.sld_label("domain").isin(NON_COMPETITORS))
    position = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("volume"), "domain"))
    rival = F.row_number().over(Window.partitionBy(*by, "is_target").orderBy(F.coalesce("rank", F.lit(10_000)), F.desc_nulls_last("volume"), "domain"))
    return kept.withColumn("position", position).withColumn("shown", F.col("is_target") | (rival <= rivals))


def page_one_average(rows: DataFrame, by: list[str], value: str, decimals: int = 1) -> DataFrame:
    """Mean over distinct competitor domains among the ten best ranked rows with data."""
    ten = F.row_number().over(Window.partitionBy(*by).orderBy("rank", "domain")) <= 10
    top = rows.filter(F.col(value).isNotNull() & ~F.col("is_target") & ~T.sld_label("domain").isin(NON_COMPETITORS)).withColumn("__t", ten).filter("__t")
    each = top.groupBy(*by, "domain").agg(F.min_by(value, "rank").alias("v"))
    return each.groupBy(*by).agg(F.bround(F.avg("v"), decimals).alias("page1_avg"))


def backlink_order(links: DataFrame) -> DataFrame:
    """links with place within the run: by the rank that they lead to, unranked ones last, the strongest source first, then by url and destination."""
    order = Window.partitionBy("run_id").orderBy(F.coalesce("rank", F.lit(999)), F.desc(F.coalesce("source_authority", F.lit(0.0))), "source_url", "destination")
    return links.withColumn("place", F.row_number().over(order))
