"""The topical flow from a topic alone: terms, the search that finds the domain's pages on it, the cluster, score, verdict on the target page, and the prompt of a narrative. Many runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serploom.functions import text as T
from serploom.functions.replies import reply_object
from serploom.operators import topical
from serploom.shared import written

# Terms of the domain's search, pages that support a target, pages that a prompt lists.
SEARCH_TERMS, SUPPORT, LISTED = 12, 3, 12
REPLY = "core string, variations array<string>, adjacent array<string>"


def topic_prompts(requests: DataFrame) -> DataFrame:
    """run_id, prompt: asks a model for the terms of each run's topic. requests: as ``run_terms`` takes them."""
    ask = "Name the terms of one search topic. Answer with a JSON object alone: core, the topic in one to three words; variations, 8 to 15 other ways to say the same; adjacent, 3 to 6 topics beside it that support it. No places, no brands.\nTopic: "
    return _named(requests).select("run_id", F.concat(F.lit(ask), "topic").alias("prompt"))


def _named(requests: DataFrame) -> DataFrame:
    """requests with a host as domain and a topic: the given one, else the words of the target's address, else the domain's first label."""
    host = T.host_of(F.when(F.col("domain").contains("://"), F.col("domain")).otherwise(F.concat(F.lit("https://"), F.col("domain"))))
    named = requests.withColumn("domain", F.coalesce(F.nullif(host, F.lit("")), F.lower(F.trim("domain"))))
    words = lambda c: F.nullif(F.trim(c), F.lit(""))
    return named.withColumn("topic", F.coalesce(words(F.col("topic")), words(T.topic_from_url("target_url")), F.split("domain", r"\.")[0]))


def _clean(names: Column) -> Column:
    return F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def run_terms(requests: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """run_id, domain, topic, target_url, core, variations, adjacent, query: what each run looks for, and the search within its domain.

    requests: run_id, domain, topic, target_url, the last two nullable. replies: run_id, reply, a model's answer to ``topic_prompts`` (see ``sources.attempts`` for how one is got), one of a run counts. Without an object with
    terms in it, the topic's own words do: as a phrase, and the last of them.
    """
    named = _named(requests.select("run_id", "domain", "topic", "target_url"))
    if replies is None:
        said = named.withColumn("r", F.lit(None).cast(f"struct<{REPLY.replace(' array', ':array').replace(' string', ':string')}>"))
    else:
        one = replies.groupBy("run_id").agg(F.max("reply").alias("reply")).select("run_id", F.from_json(reply_object("reply"), REPLY).alias("r"))
        said = named.join(one, "run_id", "left")
    core = F.coalesce(F.nullif(F.trim(F.col("r.core")), F.lit("")), F.trim("topic"))
    given = _clean(F.col("r.variations"))
    known = F.exists(given, lambda v: F.lower(v) == F.lower(core))
    full = F.when(known, given).otherwise(F.concat(F.array(core), given))
    own = topical.expand_topic(F.col("topic"))
    out = said.select(
        "run_id", "domain", "topic", "target_url", F.when(F.col("r").isNotNull(), core).otherwise(F.get(own, 0)).alias("core"), F.when(F.col("r").isNotNull(), full).otherwise(own).alias("variations"),
        F.when(F.col("r").isNotNull(), _clean(F.col("r.adjacent"))).otherwise(F.array().cast("array<string>")).alias("adjacent"),
    )
    either = F.array_join(F.transform(F.slice("variations", 1, SEARCH_TERMS), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " | ")
    return out.withColumn("query", F.concat(F.lit("site:"), "domain", F.lit(" "), either))


def _key(url: str) -> Column:
    return F.lower(T.norm_url(url))


def topics(terms: DataFrame, inventory: DataFrame, searches: DataFrame) -> dict[str, DataFrame]:
    """pages (the cluster in its order), summary and prompts of every run.

    terms: ``run_terms``'s. inventory: domain, url, the pages of sitemaps (``operators.topical.inventory``). searches: run_id, pos, url, title, what each run's query found. A page of the sitemap is in the cluster by the words of its
    address, a core term before an adjacent one; a search result by those of its title and address, and only if it matches a core term. Both are one page where they differ in scheme, www., case, query or a closing slash.
    """
    terms = written(terms, "topic-terms")
    each = lambda c, kind: terms.select("run_id", F.explode(c).alias("term"), F.lit(kind).alias("kind"))
    sought = each("variations", "core").unionByName(each("adjacent", "adjacent"))
    pages = terms.select("run_id", "domain").join(inventory.select("domain", "url").distinct(), "domain").select("run_id", "url", _key("url").alias("key"), T.slug_text("url").alias("slug"))
    none = F.array().cast("array<string>")
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("term"))))
    hits = topical.term_hits(pages, sought, "key", "slug", by=("run_id",)).groupBy("run_id", "key").agg(of("core").alias("core_terms"), of("adjacent").alias("near_terms"))
    listed = hits.join(pages.groupBy("run_id", "key").agg(F.min("url").alias("url")), ["run_id", "key"])

    shown = searches.withColumns({"key": _key("url"), "text": F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), T.slug_text("url")))})
    on = topical.term_hits(shown.select("run_id", F.struct("pos", "key").alias("at"), "text"), each("variations", "core"), "at", "text", by=("run_id",))
    relevant = on.groupBy("run_id", "at").agg(F.collect_set("term").alias("terms")).join(shown.select("run_id", F.struct("pos", "key").alias("at"), "url", "title"), ["run_id", "at"])
    found = relevant.groupBy("run_id", F.col("at.key").alias("key")).agg(
        F.min_by("url", "at.pos").alias("found_url"), F.max_by("title", "at.pos").alias("title"), F.array_distinct(F.flatten(F.collect_list("terms"))).alias("found_terms"), F.count("*").alias("results"), F.min("at.pos").alias("pos"),
    )
    both = listed.join(found, ["run_id", "key"], "full_outer")
    core = F.size(F.coalesce("core_terms", none)) > 0
    own = F.when(core, F.col("core_terms")).otherwise(F.coalesce("near_terms", none))
    cluster = both.select(
        "run_id", "key", F.coalesce("url", "found_url").alias("url"), "title", F.col("url").isNotNull().alias("in_sitemap"), core.alias("slug_match"), F.col("found_url").isNotNull().alias("serp_hit"),
        (F.col("url").isNotNull() & ~core).alias("is_adjacent"), F.array_sort(F.array_union(own, F.coalesce("found_terms", none))).alias("matched_terms"), F.coalesce("results", F.lit(0)).alias("results"), "pos",
    )
    kind = F.when(F.col("slug_match") & F.col("serp_hit"), 0).when(F.col("serp_hit"), 1).when(F.col("slug_match"), 2).otherwise(3)
    cluster = written(cluster.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(kind, "url"))), "topic-cluster")

    inside, near = F.col("slug_match") | F.col("serp_hit"), ~(F.col("slug_match") | F.col("serp_hit"))
    counted = cluster.groupBy("run_id").agg(F.count_if(inside).alias("cluster_size"), F.count_if(near).alias("adjacent_pages"), F.sum("results").alias("serp_hits"), F.min_by("key", "pos").alias("canonical"))
    covered = cluster.filter(near).select("run_id", F.explode("matched_terms").alias("t")).groupBy("run_id").agg(F.count_distinct("t").alias("adjacent_covered"))
    total = pages.groupBy("run_id").agg(F.count("*").alias("sitemap_total"))
    target = terms.filter("target_url is not null").select("run_id", _key("target_url").alias("key")).join(cluster.select("run_id", "key"), ["run_id", "key"]).select("run_id", F.lit(True).alias("in_cluster"))
    s = terms.join(counted, "run_id", "left").join(covered, "run_id", "left").join(total, "run_id", "left").join(target, "run_id", "left")
    numbers = ["cluster_size", "adjacent_pages", "serp_hits", "adjacent_covered", "sitemap_total"]
    s = s.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers}).withColumns({
        "n_adjacent": F.size("adjacent"), "target_in_cluster": F.coalesce("in_cluster", F.lit(False)), "target_is_canonical": F.coalesce(_key("target_url") == F.col("canonical"), F.lit(False)),
        "focus_ratio": F.coalesce(F.bround(F.try_divide("cluster_size", F.nullif("sitemap_total", F.lit(0))), 4), F.lit(0.0)),
        "score": topical.score(F.col("cluster_size"), F.col("sitemap_total"), F.col("adjacent_covered"), F.size("adjacent"), F.col("serp_hits")),
    })
    s = s.withColumn("band", F.when((F.col("sitemap_total") == 0) & (F.col("serp_hits") == 0), "unknown").otherwise(topical.band(F.col("score"))))
    s = s.withColumn("supports_target", (F.col("cluster_size") >= SUPPORT) & (F.col("target_url").isNull() | F.col("target_in_cluster")))
    say = F.format_string("%d of %d pages on the topic, %d of %d adjacent topics covered, %d relevant results: %.1f of 100 (%s)", "cluster_size", "sitemap_total", "adjacent_covered", "n_adjacent", "serp_hits", "score", "band")
    summary = s.select("run_id", "domain", "topic", "target_url", "core", *numbers, "n_adjacent", "focus_ratio", "score", "band", "target_in_cluster", "target_is_canonical", "supports_target", say.alias("summary"))
    lines = cluster.filter(F.col("place") <= LISTED).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("place", "url"))).alias("ls"))
    urls = F.coalesce(F.array_join(F.transform("ls", lambda x: F.concat(F.lit("- "), x["url"])), "\n"), F.lit("- none"))
    ask = "Does this domain have the content to rank for the topic, or does the page stand alone? Two to four sentences, from these numbers only; if it is thin, name the one gap to fill first."
    prompt = F.concat(F.lit(f"{ask}\nDomain: "), "domain", F.lit("\nTopic: "), "topic", F.lit("\nTarget page: "), F.coalesce("target_url", F.lit("none")), F.when(F.col("target_in_cluster"), " (in the cluster)").otherwise(""), F.lit("\n"), "summary", F.lit("\nPages on it:\n"), urls)
    return {"pages": cluster.drop("pos", "results"), "summary": summary, "prompts": summary.join(lines, "run_id", "left").select("run_id", prompt.alias("prompt"))}
