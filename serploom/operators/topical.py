"""Sitemaps, topic clusters and their score; the writing brief."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serploom.functions import text as T

# Sitemap bounds, cluster targets, score weights and bands, caps of the brief.
MOST_DEPTH, MOST_DOCUMENTS = 4, 60
CLUSTER, FOCUS, INDEXED = 8, 0.15, 3
BANDS = [("strong", 70.0), ("moderate", 40.0)]
GUESSES = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/wp-sitemap.xml", "/sitemap/sitemap.xml", "/sitemaps.xml"]
CAPS = {"entities_to_add": 12, "topics_to_expand": 12, "facts_to_state": 15, "values_to_review": 8, "relationships_to_make": 8, "style_targets": 6, "your_edge": 8, "information_gain": 8}
WRITING = ["Content", "Title & Headings", "Entity"]


LOC = r"(?s)<loc>\s*(.*?)\s*</loc>"


def robots_sitemaps(robots: DataFrame, body: str = "body", domain: str = "domain", documents: DataFrame | None = None) -> DataFrame:
    """domain, url: the sitemaps that robots.txt names, else the usual places; with documents (url, body) only those of the usual places that answered with XML."""
    named = F.regexp_extract_all(F.col(body), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    guessed = F.transform(F.array(*map(F.lit, GUESSES)), lambda p: F.concat(F.lit("https://"), F.col(domain), p))
    out = robots.select(domain, (F.size(named) > 0).alias("__named"), F.explode(F.when(F.size(named) > 0, named).otherwise(guessed)).alias("url"))
    if documents is not None:
        answered = documents.filter(T.looks_xml("body")).select("url").distinct()
        out = out.filter("__named").unionByName(out.filter("not __named").join(answered, "url", "left_semi").select(*out.columns))
    return out.select(domain, "url")


def sitemap_urls(documents: DataFrame) -> DataFrame:
    """url, child: the loc entries of captured sitemap documents."""
    return documents.select("url", F.explode(F.regexp_extract_all("body", F.lit(LOC), F.lit(1))).alias("child"))


def expand_sitemaps(documents: DataFrame, roots: DataFrame, most_depth: int = MOST_DEPTH, most: int = MOST_DOCUMENTS) -> DataFrame:
    """root, url: the pages that the sitemaps of ``roots`` (root, url) list. documents: url, body, as captured.

    Only entries of indexes are followed, to ``most_depth``, and ``most`` documents are read for each root: the shallower first, then by url. What bounds
    documents never bounds pages: every page of a document that is read is there. Cycles end, since no document is read twice.
    """
    front = roots.select("root", "url").distinct()
    seen, pages = None, None
    for _ in range(most_depth + 1):
        if seen is not None:
            taken = seen.groupBy("root").agg(F.count("*").alias("taken"))
            front = front.join(seen, ["root", "url"], "left_anti").join(taken, "root", "left")
        else:
            front = front.withColumn("taken", F.lit(0))
        place = F.row_number().over(Window.partitionBy("root").orderBy("url"))
        front = front.withColumn("__n", place).filter(F.col("__n") <= most - F.coalesce("taken", F.lit(0))).select("root", "url")
        seen = front if seen is None else seen.union(front)
        read = front.join(documents.select("url", "body"), "url").filter(T.looks_xml("body"))
        locs = lambda d: d.select("root", F.explode(F.regexp_extract_all("body", F.lit(LOC), F.lit(1))).alias("url")).distinct()
        found = locs(read.filter(~T.is_sitemap_index("body")))
        pages = found if pages is None else pages.union(found)
        front = locs(read.filter(T.is_sitemap_index("body")))
    return pages.distinct()


def inventory(robots: DataFrame, documents: DataFrame, **bounds: int) -> DataFrame:
    """domain, url: the pages of each domain's sitemaps. robots: domain, body; documents: url, body of whatever sitemaps were captured."""
    return expand_sitemaps(documents, robots_sitemaps(robots, documents=documents).withColumnRenamed("domain", "root"), **bounds).withColumnRenamed("root", "domain")


def reachable(edges: DataFrame, roots: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """root, node, depth: nodes within ``most_depth`` steps, at their first depth; cycles end by the anti join. edges: parent, child; roots: root."""
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for d in range(1, most_depth + 1):
        step = front.join(edges, front["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct()
        front = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.union(front)
    return seen


def expand_topic(topic: Column) -> Column:
    """Variations without a model: the content words as a phrase, and the last one alone."""
    toks = T.content_tokens(topic)
    core = F.coalesce(F.nullif(F.array_join(toks, " "), F.lit("")), F.trim(F.lower(topic)))
    return F.array_distinct(F.filter(F.array(core, F.try_element_at(toks, F.lit(-1))), lambda x: x.isNotNull()))


def term_hits(texts: DataFrame, terms: DataFrame, key: str, text: str, by: tuple[str, ...] = ()) -> DataFrame:
    """key, term and what else terms have: which terms a text matches, see ``term_pattern``; once for each distinct text and term. by: columns that text and term must share, such as the run.

    A match starts at the beginning of a word, so a term's first content word is a prefix of one of the text's words: words' prefixes, of lengths that first words have, are what texts and terms are
    joined by. Any number of terms goes through in one pass, and the pattern runs on those pairs alone.
    """
    first = F.element_at(T.content_tokens("term"), 1)
    sought = terms.distinct().withColumns({"__pat": T.term_pattern("term"), "__w": F.when(F.size(T.content_tokens("term")) > 0, first)}).filter("__pat is not null")
    sizes = [r[0] for r in sought.select(F.length("__w")).distinct().collect()]  # lengths of words: a few dozen
    words = F.array_distinct(F.regexp_extract_all(F.lower("__text"), F.lit(r"([A-Za-z0-9_']+)"), F.lit(1)))
    # a word begins behind an apostrophe, too, while terms may hold one
    ends = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.array_join(F.slice(p, k, F.size(p)), "'"))
    starts = F.flatten(F.transform(words, lambda w: F.flatten(F.transform(ends(F.split(w, "'")), lambda e: F.array(e, F.concat(F.lit("'"), e))))))
    heads = F.flatten(F.transform(starts, lambda w: F.array(*[F.when(F.length(w) >= n, F.substring(w, 1, n)) for n in sorted(sizes)]).cast("array<string>")))
    shown = texts.select(*by, key, F.col(text).alias("__text")).distinct()
    of = shown.select(*by, key, "__text", F.explode(F.array_distinct(F.array_compact(heads))).alias("__w"))
    return of.join(sought, [*by, "__w"]).filter(F.regexp_count("__text", F.col("__pat")) > 0).drop("__w", "__pat", "__text").distinct()


def match_terms(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """pages and core_terms, adjacent_terms: which terms (term, kind) their slug matches."""
    hits = term_hits(pages.select("url", T.slug_text("url").alias("__slug")), terms.select("term", "kind"), "url", "__slug")
    grouped = hits.groupBy("url").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("term")))).alias(f"{k}_terms") for k in ("core", "adjacent")])
    empty = F.array().cast("array<string>")
    return pages.join(grouped, "url", "left").withColumns({f"{k}_terms": F.coalesce(f"{k}_terms", empty) for k in ("core", "adjacent")})


def merge_hits(matched: DataFrame, hits: DataFrame) -> DataFrame:
    """Sitemap pages and search hits (domain, url, terms) by normalised url: a full outer join, terms united."""
    m = matched.withColumn("key", T.norm_url("url")).withColumn("in_sitemap", F.lit(True))
    h = hits.withColumn("key", T.norm_url("url")).groupBy("domain", "key").agg(F.min("url").alias("h_url"), F.array_distinct(F.flatten(F.collect_list("terms"))).alias("h_terms"), F.lit(True).alias("in_serp"))
    j = m.join(h, ["domain", "key"], "full_outer")
    empty = F.array().cast("array<string>")
    return j.select("domain", F.coalesce("url", "h_url").alias("url"), F.array_sort(F.array_union(F.coalesce("core_terms", empty), F.coalesce("h_terms", empty))).alias("core_terms"), F.coalesce("adjacent_terms", empty).alias("adjacent_terms"), F.coalesce("in_sitemap", F.lit(False)).alias("in_sitemap"), F.coalesce("in_serp", F.lit(False)).alias("in_serp"))


def relevant_hits(results: DataFrame, terms: DataFrame) -> DataFrame:
    """domain, url, terms: search results (domain, url, title) whose title or slug matches a core term (term); others are noise of the search."""
    text = results.select("domain", "url", F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), T.slug_text("url"))).alias("text"))
    keyed = text.select(F.struct("domain", "url").alias("at"), "text")
    return term_hits(keyed, terms.select("term"), "at", "text").groupBy("at").agg(F.array_sort(F.collect_set("term")).alias("terms")).select("at.domain", "at.url", "terms")


def cluster_order(pages: DataFrame, by: str = "domain", ties: Sequence[str] = ()) -> DataFrame:
    """pages of the cluster with place: core slug and search hit, search hit, core slug, adjacent; by url within each. ties: columns that decide between rows of the same url."""
    core = F.size("core_terms") > 0
    kind = F.when(core & F.col("in_serp"), 0).when(F.col("in_serp"), 1).when(core, 2).otherwise(3)
    inside = pages.filter(core | F.col("in_serp") | (F.size("adjacent_terms") > 0))
    return inside.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(kind, "url", *ties)))


def score(cluster: Column, total: Column, adjacent: Column, n_adjacent: Column, hits: Column) -> Column:
    """45 breadth, 20 focus, 20 adjacent coverage, 15 indexation; one decimal."""
    one = F.lit(1.0)
    breadth = F.least(one, cluster / CLUSTER)
    focus = F.least(one, F.coalesce(F.try_divide(cluster, F.nullif(total, F.lit(0))), F.lit(0.0)) / FOCUS)  # least() passes over nulls
    near = F.coalesce(F.try_divide(adjacent, F.nullif(n_adjacent, F.lit(0))), F.lit(0.0))
    return F.bround((breadth * 0.45 + focus * 0.20 + near * 0.20 + F.least(one, hits / INDEXED) * 0.15) * 100, 1)


def band(x: Column) -> Column:
    return F.when(x >= BANDS[0][1], BANDS[0][0]).when(x >= BANDS[1][1], BANDS[1][0]).otherwise("thin")


def cluster_summary(pages: DataFrame, n_adjacent: int, by: str = "domain") -> DataFrame:
    """by, cluster_size, sitemap_total, adjacent_covered, serp_hits, canonical, score, band."""
    core = F.size("core_terms") > 0
    order = F.when(core & F.col("in_serp"), 0).when(F.col("in_serp"), 1).when(core, 2).otherwise(3)
    adjacent = pages.select(by, F.explode("adjacent_terms").alias("t")).groupBy(by).agg(F.count_distinct("t").alias("adjacent_covered"))
    g = pages.groupBy(by).agg(F.count_if(core).alias("cluster_size"), F.count_if("in_sitemap").alias("sitemap_total"), F.count_if("in_serp").alias("serp_hits"), F.min_by("url", F.when(core, F.struct(order, "url"))).alias("canonical"))
    out = g.join(adjacent, by, "left").withColumn("adjacent_covered", F.coalesce("adjacent_covered", F.lit(0)))
    out = out.withColumn("score", score(F.col("cluster_size"), F.col("sitemap_total"), F.col("adjacent_covered"), F.lit(n_adjacent), F.col("serp_hits")))
    return out.withColumn("band", band(F.col("score")))


def brief(coverage: DataFrame, eav: DataFrame, actions: DataFrame | None, gaps: DataFrame | None, must: DataFrame, brands: int | DataFrame, unread: DataFrame | None = None) -> DataFrame:
    """run_id, section, ord, text, evidence, entity, attribute: one filter per section, united, then capped in one window.

    brands: how many ranked pages were compared, or that for each run (run_id, n). unread: run_id of runs whose target wasn't read for entities; they get no advice on its entity numbers. gaps may carry name, what a gap is called.
    """
    if isinstance(brands, int):
        seen = lambda df: df.withColumn("__b", F.lit(brands))
    else:
        seen = lambda df: df.join(brands.select("run_id", F.col("n").alias("__b")), "run_id", "left").withColumn("__b", F.coalesce("__b", F.lit(0)))
    pages = lambda n, say: F.concat(n.cast("string"), F.lit(" of "), F.col("__b").cast("string"), F.lit(f" top pages {say}"))
    none = F.lit(None).cast("string")
    missing = F.col("gap").isin("missing_entity", "missing_attribute", "missing_value")

    def part(df: DataFrame, section: str, text: Column, evidence: Column, entity: Column = none, attribute: Column = none) -> DataFrame:
        return df.select("run_id", F.lit(section).alias("section"), F.row_number().over(Window.partitionBy("run_id").orderBy("__n")).alias("ord"), text.alias("text"), evidence.alias("evidence"), entity.alias("entity"), attribute.alias("attribute"))

    name, attr = F.col("name"), F.col("attribute")
    facts, coverage, must = seen(eav.filter("graded")), seen(coverage), seen(must)
    by_fact = [F.desc("consensus"), F.col("canon"), attr]
    number = lambda df: df.withColumn("__n", F.row_number().over(Window.partitionBy("run_id").orderBy(*by_fact)))
    sections = [
        part(must.withColumn("__n", F.col("add_place")), "entities_to_add", F.concat(F.lit("Cover "), name), pages(F.col("consensus"), "cover it"), entity=name),
        part(coverage.filter((F.col("consensus") >= 2) & ~F.col("target_present")).join(must.select("run_id", "canon"), ["run_id", "canon"], "left_anti").withColumn("__n", F.col("place")), "topics_to_expand", F.concat(F.lit("Consider "), name), pages(F.col("consensus"), "mention it"), entity=name),
        part(number(facts.filter(missing & ~F.col("is_edge"))), "facts_to_state", F.concat(F.lit("State "), attr, F.lit(" of "), F.col("canon")), pages(F.col("consensus"), "state it"), entity=F.col("canon"), attribute=attr),
        part(number(facts.filter(F.col("gap") == "off_consensus")), "values_to_review", F.concat(F.lit("Check "), attr, F.lit(": "), F.col("target_value"), F.lit(" against "), F.col("consensus_value")), pages(F.col("consensus"), "assert it"), entity=F.col("canon"), attribute=attr),
        part(number(facts.filter(missing & F.col("is_edge"))), "relationships_to_make", F.concat(F.lit("Connect "), F.col("canon"), F.lit(" and "), F.col("consensus_value")), pages(F.col("consensus"), "make it"), entity=F.col("canon"), attribute=attr),
        part(number(facts.filter((F.col("gap") == "") & F.col("target_value").isNotNull() & (F.col("consensus") * 2 < F.col("__b")))), "your_edge", F.concat(F.lit("Keep "), attr, F.lit(": "), F.col("target_value")), pages(F.col("consensus"), "state this"), entity=F.col("canon"), attribute=attr),
    ]
    if actions is not None:
        if unread is not None:
            ours = (F.col("group") == "Entity") | (F.col("phase") == "Entities")
            actions = actions.filter(~ours).unionByName(actions.filter(ours).join(unread.select("run_id").distinct(), "run_id", "left_anti"))
        sections.append(part(actions.filter(F.col("group").isin(WRITING) | F.col("phase").isin(WRITING)).withColumn("__n", F.col("place")), "style_targets", F.concat(F.col("name"), F.lit(": aim for "), T.shown("goal")), F.concat_ws(", ", "phase", "difficulty")))
    if gaps is not None:
        sections.append(part(gaps.withColumn("__n", F.row_number().over(Window.partitionBy("run_id").orderBy("best", "query_id"))), "information_gain", F.concat(F.lit("Cover "), F.col("name") if "name" in gaps.columns else F.col("query_id").cast("string")), F.lit("no top page covers it well")))
    every = sections[0]
    for s in sections[1:]:
        every = every.unionByName(s)
    cap = F.create_map(*[F.lit(x) for pair in CAPS.items() for x in pair])
    return every.filter(F.col("ord") <= cap[F.col("section")])


def markdown(items: DataFrame) -> DataFrame:
    """run_id, markdown: sections in the order of CAPS, one bullet an item."""
    titles = F.array(*map(F.lit, CAPS))
    line = F.concat(F.lit("- "), F.col("text"), F.lit(" ("), F.col("evidence"), F.lit(")"))
    each = items.groupBy("run_id", "section").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))).alias("ls"))  # capped above
    body = F.concat(F.lit("## "), F.initcap(F.translate("section", "_", " ")), F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"))
    return each.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.array_position(titles, F.col("section")).alias("o"), body.alias("b")))), lambda x: x["b"]), "\n\n").alias("markdown"))


#: What a section asks of a writer, in the order of CAPS.
ASKS = {
    "entities_to_add": "Add these entities, each where it belongs in a sentence that says something", "topics_to_expand": "Cover these topics where they fit the business", "facts_to_state": "State these facts with the business's own values",
    "values_to_review": "Check these values, which differ from what others state", "relationships_to_make": "Say how these belong together", "style_targets": "Bring the page to these measures",
    "your_edge": "Keep these, which only this page says", "information_gain": "Add what no page that ranks answers",
}
RULES = ["Invent nothing about the business: ask for every price, address or credential that is missing.", "Write for readers; repeat no keyword for its own sake.", "Contradict nothing that the page says elsewhere.", "Give the new text, then a short list of changes with reasons."]


def brief_texts(items: DataFrame, requests: DataFrame) -> DataFrame:
    """run_id, total, summary, markdown, prompt of every run with advice: the brief to read, and one to paste into a model. items: ``brief``'s, capped; requests: run_id, keyword, target_url."""
    line = F.concat(F.lit("- "), F.col("text"), F.lit(" ["), F.col("evidence"), F.lit("]"))
    each = items.groupBy("run_id", "section").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))).alias("ls"), F.count("*").alias("n"))  # capped by brief
    ask = F.create_map(*[F.lit(x) for pair in ASKS.items() for x in pair])[F.col("section")]
    block = F.concat(ask, F.lit(":\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"))
    place = F.array_position(F.array(*map(F.lit, ASKS)), F.col("section"))
    blocks = each.groupBy("run_id").agg(F.sum("n").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("o"), block.alias("b")))), lambda x: x["b"]), "\n\n").alias("asked"))
    j = blocks.join(markdown(items), "run_id").join(requests.select("run_id", "keyword", "target_url"), "run_id")
    own = F.col("target_url").isNotNull()
    summary = F.concat(F.col("total").cast("string"), F.when(F.col("total") == 1, " recommendation for ").otherwise(" recommendations for "), F.when(own, F.col("target_url")).otherwise("a new page"), F.lit(" on \""), "keyword", F.lit('".'))
    task = F.when(own, F.concat(F.lit("Edit the page "), "target_url", F.lit(" so that it serves the search \""), "keyword", F.lit('". Its text is at the end. Keep its voice and order where you can.'))).otherwise(F.concat(F.lit('Write a page that serves the search "'), "keyword", F.lit('".')))
    rules = "\n\nRules:\n" + "\n".join(f"- {r}" for r in RULES)
    prompt = F.concat(task, F.lit("\n\n"), "asked", F.lit(rules), F.when(own, "\n\nText of the page:\n<paste it here>").otherwise(""))
    text = F.concat(F.lit("# Writing brief: "), "keyword", F.lit("\n\n"), summary, F.lit("\n\n"), "markdown", F.lit("\n\n---\nFrom what the pages that rank agree on. Check every fact about your own business before you publish it."))
    return j.select("run_id", "total", summary.alias("summary"), text.alias("markdown"), prompt.alias("prompt"))
