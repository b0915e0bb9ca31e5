"""Entities and triples of pages: normalising, deduplicating, entity factors, and matrices of who states what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serploom.functions import text as T
from serploom.shared import sent

# Page furniture that is no entity, and metadata that is no fact.
NAV_ENTITIES = [
    "home", "menu", "search", "next", "previous", "back", "article", "blog", "blog post", "category", "tag", "page", "web page", "webpage", "website", "breadcrumb",
    "navigation", "footer", "header", "sidebar", "comment", "login", "sign in", "cart", "checkout", "account", "faq", "buying guide", "table of content", "newsletter",
    "subscribe", "share",
]
META_ATTRIBUTES = (
    "datepublished datemodified datecreated uploaddate inlanguage language url headline wordcount articlesection position item nextitem previousitem previtem identifier "
    "mainentityofpage ispartof potentialaction thumbnailurl thumbnail contenturl embedurl commentcount articlebody publisher author slug permalink canonical robots image logo sameas"
).split()
# Words of a keyword that name no topic, and words that never tell entities apart.
KEYWORD_MODIFIERS = "best top cheap cheapest affordable good great near me review reviews buy vs versus how what the a an of for in on to and or with".split()
GENERIC = "the a an and or of for with in on at to".split()
#: A target's page of so many characters has entities or facts if it was read.
READABLE = 300
#: Caps of the three views, graded consensus, families whose subject value is a range.
MOST_COVERAGE, MOST_EAV, MOST_ADD, GRADED = 60, 400, 25, 2
RANGE_FAMILIES = ["price", "rating", "experience", "warranty"]
CONTACT_FAMILIES = ["address", "phone", "email", "hours"]
SUBJECT = "__subject__"
#: Surface forms that are broadcast: some 20 MB. With more, both sides are shuffled.
MOST_FORMS = 200_000


def clean_entities(raw: DataFrame, keyed: bool = False) -> DataFrame:
    """run_id, rank, canon, name, type, salience, ord: the most salient mention per key and page, the first on ties. keyed: raw has its canon already."""
    keyed = (raw if keyed else raw.withColumn("canon", T.canon("name"))).filter((F.col("canon") != "") & ~F.col("canon").isin(NAV_ENTITIES))
    best = F.max_by(F.struct("name", "type", "salience", "ord"), F.struct("salience", -F.col("ord")))
    return keyed.groupBy("run_id", "rank", "canon").agg(best.alias("r")).select("run_id", "rank", "canon", "r.*")


def clean_triples(raw: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """run_id, rank, canon, attribute, value, is_edge, ord: the first per entity and attribute on a page.

    aliases: raw, canonical attribute names, of all runs or each of its run_id; names they lack stay.
    """
    t = raw.withColumns({"canon": T.canon("entity"), "attribute": T.norm_attr("attribute")})
    if aliases is not None:
        keys = [c for c in ("run_id",) if c in aliases.columns]
        t = t.join(aliases.select(*keys, F.col("raw").alias("attribute"), F.col("canonical").alias("__to")), [*keys, "attribute"], "left").withColumn("attribute", F.coalesce("__to", "attribute")).drop("__to")
    t = t.filter((F.col("canon") != "") & (F.col("attribute") != "") & (T.strip(F.coalesce("value", F.lit(""))) != "") & (F.col("is_edge") | ~F.regexp_replace("attribute", "_", "").isin(META_ATTRIBUTES)))
    return t.groupBy("run_id", "rank", "canon", "attribute").agg(F.min_by(F.struct("value", "is_edge", "ord"), "ord").alias("r")).select("run_id", "rank", "canon", "attribute", "r.*")


def entity_factors(entities: DataFrame, surfaces: DataFrame) -> DataFrame:
    """run_id, rank and the eight per-page entity factors; surfaces: run_id, rank, title, h1, h2, h3, body."""
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "h1", "h2", "h3", "body")}
    s = surfaces.select("run_id", "rank", *[v.alias(k) for k, v in low.items()], F.transform(T.sentences("body"), F.lower).alias("sentences"))
    j = entities.join(s, ["run_id", "rank"])
    inside = lambda t: F.contains(t, F.lower("name")) | F.contains(t, F.col("canon"))
    return j.groupBy("run_id", "rank").agg(
        *[F.count_if(inside(F.col(c))).alias(n) for c, n in (("title", "ENTITIES_TITLE"), ("h1", "ENTITIES_H1"), ("h2", "ENTITIES_H2"), ("h3", "ENTITIES_H3"), ("body", "ENTITIES_BODY"))],
        F.sum(F.size(F.filter("sentences", inside))).alias("ENTITIES_SENTENCES"),
        F.count_distinct("canon").alias("DISTINCT_ENTITIES"),
        F.sum("salience").alias("ENTITY_SALIENCE_SUM"),
    )


def presence_pattern(name: Column) -> Column:
    """Whole-word pattern of a surface form."""
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.lower(name), F.lit(r"\E(?![\p{L}\p{N}_])"))


def _of_run(rows: DataFrame, keyword: str | DataFrame) -> DataFrame:
    """rows with __keyword: the same for all, or that of the row's run (run_id, keyword)."""
    return rows.withColumn("__keyword", F.lit(keyword)) if isinstance(keyword, str) else rows.join(keyword.select("run_id", F.col("keyword").alias("__keyword")), "run_id")


def keyword_stems(keyword: Column | str) -> Column:
    """Stems of a keyword's words, its modifiers left out."""
    return F.array_distinct(F.transform(F.filter(T.tokens(keyword), lambda w: ~w.isin(KEYWORD_MODIFIERS)), T.stem))


def _place(rank: str = "rank", ord_: str = "ord") -> Column:
    """The order in which a run's mentions are seen: ranked pages, then the target's."""
    return F.struct((F.col(rank) == 0).alias("target"), F.col(rank).alias("rank"), F.col(ord_).alias("ord"))


def alias_map(entities: DataFrame, keyword: str | DataFrame) -> DataFrame:
    """run_id, canon, winner: keys with the same distinctive core count as one.

    The core is the set of word stems less the keyword's stems, the words of the run's organisations and stop words, so that a maker's name makes no difference. Those words are gathered once for each
    run and travel with its entities; cores meet as sets. Persons and locations never merge, an entity's class being that of its most frequent type. A word that is a number keeps its entity apart, as does a
    distinctive one of one or two letters. The winner is on most pages, then longest, then seen first.
    """
    kinds = entities.groupBy("run_id", "canon", "type").agg(F.count("*").alias("c"), F.min(_place()).alias("first"))
    usual = F.min_by("type", F.when(F.coalesce("type", F.lit("")) != "", F.struct(-F.col("c"), "first")))
    seen = kinds.groupBy("run_id", "canon").agg(T.type_class(usual).alias("cls"), F.min("first").alias("first"))
    pages = entities.groupBy("run_id", "canon").agg(F.count_distinct("rank").alias("pages")).join(seen, ["run_id", "canon"]).withColumn("words", F.split("canon", " "))
    brands = pages.filter("cls = 'org'").select("run_id", F.explode("words").alias("w")).groupBy("run_id").agg(F.collect_set("w").alias("brand"))
    all_ = _of_run(pages.join(brands, "run_id", "left"), keyword).withColumns({"brand": F.coalesce("brand", F.array().cast("array<string>")), "key": keyword_stems("__keyword")})
    own = F.filter("words", lambda w: ~(F.array_contains("key", T.stem(w)) | w.isin(GENERIC) | F.array_contains("brand", w)))
    cored = all_.filter(~F.col("cls").isin("person", "loc") & ~F.exists("words", lambda w: w.rlike(r"^\d+$"))).withColumn("own", own).filter((F.size("own") > 0) & ~F.exists("own", lambda w: F.length(w) <= 2))
    cored = cored.withColumn("core", F.array_sort(F.array_distinct(F.transform("own", T.stem))))
    won = cored.groupBy("run_id", "core").agg(F.min_by("canon", F.struct(-F.col("pages"), -F.length("canon"), "first")).alias("winner"), F.count("*").alias("k")).filter("k > 1")
    return cored.join(won, ["run_id", "core"]).select("run_id", "canon", "winner")


def topic_canons(entities: DataFrame, keyword: str | DataFrame) -> DataFrame:
    """run_id, canon of entities that are the topic: their stems are the keyword's, or two or more of them."""
    own = F.array_distinct(F.transform(F.split("canon", " "), T.stem))
    rows = _of_run(entities.select("run_id", "canon").distinct(), keyword).withColumns({"own": own, "key": keyword_stems("__keyword")})
    return rows.filter((F.size(F.array_except("own", "key")) == 0) & ((F.size("own") == F.size("key")) | (F.size("own") >= 2))).select("run_id", "canon")


def site_label(domain: Column | str) -> Column:
    """The first label of a domain, www. apart."""
    return F.split(F.regexp_replace(F.lower(T.strip(F.coalesce(T.col(domain), F.lit("")))), r"^www\.", ""), r"\.")[0]


def site_brand(canon: Column, label: Column) -> Column:
    """Whether an entity's name is a site's own: run together (4 letters or more) it and the label contain each other, its initials (3 or more) begin the label, or two of its words of 4 letters or more are in it."""
    words = F.split(canon, " ")
    glued, initials = F.replace(canon, F.lit(" "), F.lit("")), F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    held = (F.length(glued) >= 4) & (F.contains(label, glued) | F.contains(glued, label))
    return (label != "") & (held | ((F.length(initials) >= 3) & F.startswith(label, initials)) | (F.size(F.filter(words, lambda w: (F.length(w) >= 4) & F.contains(label, w))) >= 2))


def provider_canons(entities: DataFrame, triples: DataFrame, sites: DataFrame) -> DataFrame:
    """run_id, rank, canon of entities that are a page's own business rather than a thing that pages write about. sites: run_id, rank, domain.

    By name, see site_brand: an entity against the site of the page that mentions it. Or by facts: two contact facts on the page, while on few ranked pages, at most one or 15 percent. Never locations.
    """
    own = entities.select("run_id", "rank", "canon", T.type_class("type").alias("cls")).filter("cls <> 'loc'").distinct()
    label = sites.select("run_id", "rank", site_label("domain").alias("label"))
    n = sites.filter("rank > 0").groupBy("run_id").agg(F.count_distinct("rank").alias("n"))
    spread = entities.filter("rank > 0").groupBy("run_id", "canon").agg(F.count_distinct("rank").alias("pages"))
    contact = triples.filter(~F.col("is_edge") & T.attr_family("attribute").isin(CONTACT_FAMILIES)).groupBy("run_id", "rank", "canon").agg(F.count("*").alias("k"))
    all_ = own.join(label, ["run_id", "rank"], "left").join(contact, ["run_id", "rank", "canon"], "left").join(spread, ["run_id", "canon"], "left").join(n, "run_id", "left")
    few = F.coalesce("pages", F.lit(0)) <= F.greatest(F.lit(1), F.bround(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)) * 0.15, 0))
    return all_.filter(site_brand(F.col("canon"), F.coalesce("label", F.lit(""))) | ((F.coalesce("k", F.lit(0)) >= 2) & few)).select("run_id", "rank", "canon").distinct()


def to_subject(triples: DataFrame, subjects: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Triples of topic entities (run_id, canon), and on their own pages those of providers (own: run_id, rank, canon), become facts about the page's own subject."""
    out = triples.join(subjects.select("run_id", "canon", F.lit(True).alias("__topic")).distinct(), ["run_id", "canon"], "left")
    out = out.withColumn("__own", F.lit(None).cast("boolean")) if own is None else out.join(own.select("run_id", "rank", "canon", F.lit(True).alias("__own")).distinct(), ["run_id", "rank", "canon"], "left")
    return out.withColumn("canon", F.when(F.coalesce("__topic", "__own"), SUBJECT).otherwise(F.col("canon"))).drop("__topic", "__own")


def unread_targets(bodies: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """run_id of targets whose page has text (READABLE characters or more) but neither an entity nor a fact: they weren't read, so nothing about them is graded."""
    found = entities.filter("rank = 0").select("run_id").union(triples.filter("rank = 0").select("run_id"))
    return bodies.filter((F.col("rank") == 0) & (F.length("body") >= READABLE)).select("run_id").distinct().join(found, "run_id", "left_anti")


def consensus(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, consensus, modal_value, modal_count, backing, lo, hi, n_numbers, n_values of brand pages (rank > 0).

    cells: keys, rank, value. The modal value is the most frequent one, then the one on the best rank.
    """
    number = T.first_number(value)
    each = cells.filter("rank > 0").groupBy(*keys, T.squeeze(value).alias("norm")).agg(
        F.count("*").alias("cells"), F.collect_set("rank").alias("ranks"), F.min("rank").alias("r"), F.min_by(value, "rank").alias("v"),
        F.min(number).alias("lo"), F.max(number).alias("hi"), F.count(number).alias("n"), F.bool_or(F.col(value).contains("$")).alias("dollar"),
    )
    # a fact's different values are at most as many as its run's pages
    best = F.max(F.when(F.col("norm") != "", F.struct(F.size("ranks").alias("c"), (-F.col("r")).alias("r"), "v")))
    facts = each.groupBy(*keys).agg(
        F.collect_list(F.struct("cells", "v")).alias("values"), F.size(F.array_distinct(F.flatten(F.collect_list("ranks")))).cast("long").alias("consensus"), best.alias("m"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n_numbers"), F.bool_or("dollar").alias("dollar"), F.nullif(F.count_if(F.col("norm") != ""), F.lit(0)).alias("n_values"),
    )
    backing = F.aggregate("values", F.lit(0).cast("long"), lambda n, x: n + F.when(T.values_match(x["v"], F.col("m.v")), x["cells"]).otherwise(0))
    return facts.select(*keys, "consensus", "lo", "hi", "n_numbers", "dollar", "n_values", F.col("m.v").alias("modal_value"), F.col("m.c").cast("long").alias("modal_count"), backing.alias("backing"))


def range_display(lo: Column, hi: Column, n: Column, dollar: Column) -> Column:
    """lo-hi where there are two numbers at least and hi / lo is at most 50; null otherwise."""
    ok = (n >= 2) & (lo < hi) & ((lo <= 0) | (hi / lo <= 50))
    sign = F.when(F.coalesce(dollar, F.lit(False)), "$").otherwise("")
    return F.when(ok, F.concat(sign, T.shown(lo), F.lit("-"), sign, T.shown(hi)))


def gap(graded: Column, entity_present: Column, present: Column, value: Column, wanted: Column, subject: Column, backing: Column) -> Column:
    """none (''), off_consensus, missing_entity, missing_attribute or missing_value, in the order of the rules."""
    v = T.strip(F.coalesce(value, F.lit("")))
    off = F.when(subject | (F.coalesce(backing, F.lit(0)) < 2), "").otherwise("off_consensus")
    return F.when(~graded, "").when(present & (v != ""), F.when(T.values_match(value, wanted), "").otherwise(off)).when(~entity_present, "missing_entity").when(~present, "missing_attribute").otherwise("missing_value")


def eav_rows(triples: DataFrame, entities: DataFrame, unread: DataFrame | None = None) -> DataFrame:
    """run_id, canon, attribute, is_edge, consensus, consensus_value, target_value, graded, gap: facts of brands against the target's (rank 0).

    triples carry SUBJECT as canon where the page's own topic or provider is meant. Facts count by attribute family, relations by their own name. A fact about the subject that the target states of any of its entities
    is stated. Contact facts of others are never graded, nor is anything of an unread target (run_id), see unread_targets.
    """
    family = F.when(F.col("is_edge"), F.col("attribute")).otherwise(T.attr_family("attribute"))
    t = triples.withColumn("attribute", family).groupBy("run_id", "rank", "canon", "attribute").agg(F.min_by("value", "ord").alias("value"), F.min_by("is_edge", "ord").alias("is_edge"), F.min("ord").alias("ord"))
    keys = ["run_id", "canon", "attribute"]
    ranked = t.filter("rank > 0").groupBy(*keys).agg(F.bool_or("is_edge").alias("is_edge"))
    c = consensus(t, keys).join(ranked, keys)
    target = t.filter("rank = 0")
    own = target.select(*keys, F.col("value").alias("own_value"), F.lit(True).alias("own"))
    any_ = target.filter("not is_edge").groupBy("run_id", "attribute").agg(F.min_by("value", "ord").alias("any_value")).withColumn("canon", F.lit(SUBJECT))
    there = entities.filter("rank = 0").select("run_id", "canon", F.lit(True).alias("entity_present")).distinct()
    has = entities.filter("rank = 0").select("run_id").union(triples.filter("rank = 0").select("run_id")).distinct().withColumn("has_target", F.lit(True))
    out = c.join(own, keys, "left").join(any_, keys, "left").join(there, ["run_id", "canon"], "left").join(has, "run_id", "left")
    out = out.withColumn("unread", F.lit(False)) if unread is None else out.join(unread.select("run_id", F.lit(True).alias("unread")).distinct(), "run_id", "left")
    subject, no = F.col("canon") == SUBJECT, F.lit(False)
    out = out.withColumns({"target_value": F.coalesce("own_value", "any_value"), "present": F.coalesce("own", no) | F.col("any_value").isNotNull()})
    ranged = range_display(F.col("lo"), F.col("hi"), F.col("n_numbers"), F.col("dollar"))
    each = F.when(F.col("n_values") >= 2, "each page states its own").otherwise(F.col("modal_value"))
    of_subject = F.when(F.col("attribute").isin(RANGE_FAMILIES), F.coalesce(ranged, each)).otherwise(each)
    wanted = F.when(subject & ~F.col("is_edge"), of_subject).otherwise(F.col("modal_value"))
    contact = ~subject & ~F.col("is_edge") & F.col("attribute").isin(CONTACT_FAMILIES)
    graded = F.coalesce("has_target", no) & ~F.coalesce("unread", no) & (F.col("consensus") >= GRADED) & ~contact
    out = out.withColumns({"consensus_value": wanted, "graded": graded})
    entity_there = F.coalesce("entity_present", no) | subject
    return out.withColumn("gap", gap(F.col("graded"), entity_there, F.col("present"), F.col("target_value"), F.col("modal_value"), subject, F.col("backing"))).select(*keys, "is_edge", "consensus", "backing", "consensus_value", "target_value", "graded", "gap")


def eav_order(rows: DataFrame, most: int = MOST_EAV) -> DataFrame:
    """rows with place, the first ``most`` of a run's facts and of its relations: graded gaps, then graded, then the rest; by consensus within each."""
    band = F.when(F.col("graded") & (F.col("gap") != ""), 0).when(F.col("graded"), 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("run_id", "is_edge").orderBy(band, F.desc("consensus"), "canon", "attribute"))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def matrix(rows: DataFrame, pages: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Every row (run_id, keys) against every page (run_id, rank) of its run, with its cell's columns where there is one."""
    return rows.select("run_id", *keys).distinct().join(pages.select("run_id", "rank").distinct(), "run_id").join(cells, ["run_id", "rank", *keys], "left")


def said_in(forms: DataFrame, bodies: DataFrame) -> DataFrame:
    """run_id, rank, canon: whose forms (run_id, canon, form) stand in a page's body (run_id, rank, body) as whole words; forms of under 3 letters don't count.

    A form's first word is a word of the page, so words are what they are joined by. A form that is a single word is found by that; with longer ones a page's candidates come back to its body once, and only they are
    looked for.
    """
    word = r"([\p{L}\p{N}_]+)"
    listed = forms.select("run_id", "canon", F.lower("form").alias("form")).filter(F.length("form") >= 3).distinct().withColumn("w", F.regexp_extract("form", word, 1)).filter("w <> ''")
    listed = sent(listed, "forms", MOST_FORMS)
    own = F.regexp_extract_all(F.lower("body"), F.lit(word), F.lit(1))
    if listed.filter("form <> w").isEmpty():
        rows = bodies.select("run_id", "rank", F.monotonically_increasing_id().alias("__row"), "body")  # numbered before they are taken apart
        words = rows.select("run_id", "rank", "__row", F.explode(F.array_distinct(own)).alias("w"))
        return words.join(listed, ["run_id", "w"]).select("__row", "run_id", "rank", "canon").distinct().drop("__row")
    words = bodies.select("run_id", "rank", F.explode(F.array_distinct(own)).alias("w"))
    maybe = words.join(listed, ["run_id", "w"]).groupBy("run_id", "rank").agg(F.collect_set(F.struct("canon", "form")).alias("maybe"))  # a page's, of its run's entities
    at = bodies.select("run_id", "rank", F.lower("body").alias("__low")).join(maybe, ["run_id", "rank"])
    held = F.filter("maybe", lambda m: F.contains(F.col("__low"), m["form"]) & (F.regexp_count(F.col("__low"), presence_pattern(m["form"])) > 0))
    return at.select("run_id", "rank", F.explode(F.array_distinct(F.transform(held, lambda m: m["canon"]))).alias("canon"))


def coverage_cells(entities: DataFrame, bodies: DataFrame) -> DataFrame:
    """run_id, rank, canon, name, max_salience, present: every entity of a run against every page of it, by mention or by a whole-word match of any form of 3 letters or more."""
    names = entities.groupBy("run_id", "canon").agg(F.max_by("name", F.struct("salience", -F.col("rank"))).alias("name"), F.max("salience").alias("max_salience"))
    forms = entities.select("run_id", "canon", F.explode(F.array("name", "canon")).alias("form"))
    found = entities.select("run_id", "rank", "canon").union(said_in(forms, bodies)).distinct().withColumn("said", F.lit(True))
    cells = names.join(bodies.select("run_id", "rank"), "run_id").join(found, ["run_id", "rank", "canon"], "left")
    return cells.select("run_id", "rank", "canon", "name", "max_salience", F.coalesce("said", F.lit(False)).alias("present"))


def coverage(entities: DataFrame, bodies: DataFrame, most: int = MOST_COVERAGE) -> DataFrame:
    """run_id, canon, name, consensus, target_present, max_salience, place: the first ``most`` entities of a run by consensus, then salience."""
    return covered(coverage_cells(entities, bodies), most)


def covered(cells: DataFrame, most: int = MOST_COVERAGE) -> DataFrame:
    """The rows of ``coverage`` from its cells."""
    rows = cells.groupBy("run_id", "canon", "name", "max_salience").agg(F.count_if(F.col("present") & (F.col("rank") > 0)).alias("consensus"), F.bool_or(F.col("present") & (F.col("rank") == 0)).alias("target_present"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("consensus"), F.desc("max_salience"), "canon"))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def must_add(covered: DataFrame, pages: DataFrame, sites: DataFrame | None = None, most: int = MOST_ADD) -> DataFrame:
    """Entities the target lacks that max(3, half of the pages with entities) cover; pages: run_id, n.

    Rivals' own brands are no advice: with sites (run_id, domain) an entity goes that has the name of one, see site_brand.
    """
    need = F.greatest(F.lit(3), F.bround(F.col("n") * 0.5, 0))
    short = covered.join(pages, "run_id").filter(~F.col("target_present") & (F.col("consensus") >= need))
    if sites is not None:
        labels = sites.select("run_id", site_label("domain").alias("__label")).filter("__label <> ''").distinct()
        rivals = short.select("run_id", "canon").join(labels, "run_id").filter(site_brand(F.col("canon"), F.col("__label"))).select("run_id", "canon").distinct()
        short = short.join(rivals, ["run_id", "canon"], "left_anti")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("place"))
    return short.withColumn("add_place", place).filter(F.col("add_place") <= most)


def completeness(cells: DataFrame, graded: DataFrame, keys: list[str]) -> DataFrame:
    """run_id, rank, EAV_COMPLETENESS: percent of graded facts that a page states; pages that state none have no row."""
    total = graded.filter("graded").groupBy("run_id").agg(F.count("*").alias("n"))
    hit = cells.join(graded.filter("graded").select(*keys), keys).groupBy("run_id", "rank").agg(F.countDistinct(*[k for k in keys if k != "run_id"]).alias("c"))
    return hit.join(total, "run_id").select("run_id", "rank", (F.col("c") * 100.0 / F.col("n")).alias("EAV_COMPLETENESS"))
