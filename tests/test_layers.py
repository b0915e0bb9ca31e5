"""The layers inside analyze, entity alignment, meaning and field data by hand cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from serploom import cli
from serploom.operators import correlate, entities, funnel, panels, semantic, topical
from serploom.plans import layers

ENTITY = "run_id string, rank int, canon string, name string, type string, salience double, ord int"
TRIPLE = "run_id string, rank int, canon string, attribute string, value string, is_edge boolean, ord int"


def mentions(spark, rows):
    return spark.createDataFrame([("r", rank, c, c, t, 1.0, k) for k, (rank, c, t) in enumerate(rows)], ENTITY)


def test_brand_words_make_no_difference(spark):
    e = mentions(spark, [(1, "aeron chair", "product"), (2, "herman miller aeron", "product"), (3, "herman miller aeron chair", "model"), (2, "herman miller", "company"), (1, "branch ergonomic chair", "product"), (1, "branch ergonomic chair pro", "product"),
                         (1, "series 1", "product"), (2, "herman series 1", "product"), (1, "bank of perth", "product"), (2, "perth bank", "product"), (1, "aeron", "person")])
    got = {r.canon: r.winner for r in entities.alias_map(e, "best ergonomic chair").collect()}
    assert got == dict.fromkeys(("aeron chair", "herman miller aeron", "herman miller aeron chair"), "herman miller aeron chair") | dict.fromkeys(("bank of perth", "perth bank"), "bank of perth")


def test_class_is_that_of_the_usual_type(spark):
    e = mentions(spark, [(1, "acme", "product"), (2, "acme", "brand"), (3, "acme", "brand"), (1, "acme desk", "product"), (2, "desk", "product"), (1, "x1 desk", "product"), (2, "jo desk", "product")])
    assert {r.canon: r.winner for r in entities.alias_map(e, "office").collect()} == dict.fromkeys(("acme desk", "desk"), "acme desk")  # x1 and jo are too short to tell apart


def test_modifiers_are_no_topic_but_tell_entities_apart(spark):
    e = mentions(spark, [(1, "top foam mat", "product"), (2, "foam mat", "product"), (1, "personal training", "service"), (1, "perth", "thing"), (2, "personal trainer perth", "service")])
    assert entities.alias_map(e, "bed").count() == 0
    assert {r.canon for r in entities.topic_canons(e, "best personal trainer perth").collect()} == {"personal training", "personal trainer perth"}


def test_a_business_is_first_party_on_its_own_page_only(spark):
    e = mentions(spark, [(1, "roar active", "gym"), (2, "roar active", "gym"), (3, "chris", "person"), (3, "sydney", "city")])
    t = spark.createDataFrame([("r", 1, "roar active", "phone", "1", False, 0), ("r", 2, "roar active", "phone", "1", False, 1), ("r", 3, "chris", "phone", "2", False, 2), ("r", 3, "chris", "telephone", "3", False, 3), ("r", 2, "sydney", "phone", "2", False, 4), ("r", 2, "sydney", "email", "2", False, 5)], TRIPLE)
    sites = spark.createDataFrame([("r", 1, "www.roar.com.au"), ("r", 2, "directory.com"), ("r", 3, "x.com")], "run_id string, rank int, domain string")
    own = entities.provider_canons(e, t, sites)
    assert {(r["rank"], r.canon) for r in own.collect()} == {(1, "roar active"), (3, "chris")}
    none = spark.createDataFrame([], "run_id string, canon string")
    assert sorted((r["rank"], r.canon) for r in entities.to_subject(t, none, own).collect()) == [(1, "__subject__"), (2, "roar active"), (2, "sydney"), (2, "sydney"), (3, "__subject__"), (3, "__subject__")]


def test_what_is_graded(spark):
    facts = [(1, "gym", "phone", "1", False), (2, "gym", "phone", "1", False), (1, "gym", "phone_call", "2", True), (2, "gym", "phone_call", "2", True), (1, "__subject__", "address", "a", False), (2, "__subject__", "address", "b", False),
             (1, "__subject__", "price", "$10", False), (2, "__subject__", "price", "$20", False), (0, "coaching", "hourly_rate", "$15", False), (1, "mat", "colour", "red", False), (2, "mat", "colour", "red", False)]
    t = spark.createDataFrame([("r", k, c, a, v, g, i) for i, (k, c, a, v, g) in enumerate(facts)], TRIPLE)
    e = mentions(spark, [(0, "coaching", "service")])
    got = {(r.canon, r.attribute): (r.graded, r.gap, r.target_value) for r in entities.eav_rows(t, e).collect()}
    assert got == {
        ("gym", "phone"): (False, "", None),  # contact facts of others are nobody's gap
        ("gym", "phone_call"): (True, "missing_entity", None),  # a relation keeps its name and is graded
        ("__subject__", "address"): (True, "missing_attribute", None),
        ("__subject__", "price"): (True, "", "$15"),  # stated of one of the page's own things
        ("mat", "colour"): (True, "missing_entity", None),
    }
    unread = spark.createDataFrame([("r",)], "run_id string")
    assert not any(r.graded or r.gap for r in entities.eav_rows(t, e, unread).collect())


def test_unread_target_has_no_entity_gate(spark):
    bodies = spark.createDataFrame([("r", 0, "x" * 840), ("s", 0, "x" * 299), ("t", 0, "x" * 840), ("r", 1, "x" * 840)], "run_id string, rank int, body string")
    e = mentions(spark, [(1, "mat", "product")]).union(mentions(spark, [(0, "mat", "product")]).withColumn("run_id", F.lit("t")))
    unread = entities.unread_targets(bodies, e, spark.createDataFrame([], TRIPLE))
    assert [r.run_id for r in unread.collect()] == ["r"]
    cells = spark.createDataFrame([(run, k, "mat", k > 0) for run in "rt" for k in range(4)], "run_id string, rank int, canon string, present boolean")
    values = spark.createDataFrame([(run, k, "HELPFULNESS", float(k)) for run in "rt" for k in range(4)], "run_id string, rank int, factor_id string, value double")
    definitions = spark.createDataFrame([("HELPFULNESS", "Content", "more_is_better")], "factor_id string, group string, direction string")
    out = funnel.funnel(funnel.all_gates(values, definitions, cells=cells, unread=unread), unread=unread)
    got = {(r.run_id, r.gate): (r.score, r.verdict) for r in out.collect()}
    assert got["r", "entities"] == (None, "n/a") and got["t", "entities"] == (0.0, "fail")
    assert {r.run_id: r.bottleneck for r in funnel.overall(out).collect()} == {"r": "quality", "t": "entities"}


def test_forms_in_bodies(spark):
    forms = spark.createDataFrame([("r", "a", "Foam mat"), ("r", "b", "(mat) x"), ("r", "c", "at"), ("r", "d", "oam"), ("r", "e", "café crème"), ("s", "f", "foam")], "run_id string, canon string, form string")
    bodies = spark.createDataFrame([("r", 1, "A FOAM mat. Café Crème"), ("r", 2, "foam-mat foamy at"), ("r", 3, "a (mat) x"), ("s", 1, "")], "run_id string, rank int, body string")
    assert sorted((r["rank"], r.canon) for r in entities.said_in(forms, bodies).collect()) == [(1, "a"), (1, "e"), (3, "b")]


# --- meaning


def plain_tfidf(texts):
    import math
    import re
    from collections import Counter

    from serploom.operators.corpus import SEMANTIC_STOP

    docs = []
    for t in texts:
        ws = [w for w in re.findall(r"[a-z][a-z0-9']*", t.lower()) if w not in SEMANTIC_STOP]
        docs.append(Counter(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]))
    df = Counter(f for d in docs for f in d)
    names = sorted(df)
    m = np.array([[(1 + math.log(d[f])) * (math.log((1 + len(docs)) / (1 + df[f])) + 1) if d[f] else 0.0 for f in names] for d in docs])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n != 0)


def test_meaning_by_both_ways(spark):
    bodies = {("t", 0): "foam mats for yoga. " * 40, ("t", 1): "steel racks and weights. " * 50 + "yoga mats. " * 30, ("t", 2): "the of and", ("t", 3): None, ("e", 0): "one page about cats", ("e", 1): "another about dogs"}
    requests = spark.createDataFrame([("t", "yoga mat"), ("e", "cats"), ("n", " ")], "run_id string, keyword string")
    df = spark.createDataFrame([(*k, v) for k, v in bodies.items()], "run_id string, rank int, body string")
    intents = spark.createDataFrame([("t", 0, "Yoga", "foam yoga"), ("t", 1, "yoga", "twice"), ("t", 2, "Racks", None), ("t", 3, " ", "no name"), ("t", 4, "Boats", "sails")], "run_id string, ord int, name string, description string")
    vectors = {"cats": [1.0, 0.0], f"cats. {semantic.ALONE}": [3.0, 4.0], "one page about cats": [2.0, 0.0], "another about dogs": [0.0, -1.0]}
    given = spark.createDataFrame(list(vectors.items()), "text string, vector array<double>")
    out = layers.meaning(requests, df, intents, given)
    assert {r.run_id: r.method for r in out["methods"].collect()} == {"t": "tfidf", "e": "embeddings"}
    got = {(r.run_id, r["rank"], r.factor_id): r.value for r in out["factors"].collect()}
    assert got["e", 0, "BEST_PASSAGE_SIM"] == 100 and got["e", 0, "SUBINTENT_COVERAGE"] == 100 and got["e", 1, "BEST_PASSAGE_SIM"] == 0 and got["e", 1, "SUBINTENT_COVERAGE"] == 0
    assert ("t", 3, "BEST_PASSAGE_SIM") not in got and ("t", 3, "SALIENT_TERM_COVERAGE") not in got and got["t", 2, "CONTENT_FOCUS"] == 0
    found = sorted((r["rank"], r.pos, r.passage) for r in semantic.passages(df.filter("run_id = 't'"), ["run_id", "rank"], "body").collect())
    queries = ["yoga mat", "Yoga. foam yoga", "Racks.", "Boats. sails"]
    m = plain_tfidf(queries + [p for *_, p in found])
    sims = np.clip(m[4:] @ m[:4].T, 0, 1)
    for rank in (0, 1, 2):
        own = sims[[k for k, f in enumerate(found) if f[0] == rank]]
        assert got["t", rank, "BEST_PASSAGE_SIM"] == pytest.approx(own[:, 0].max() * 100, abs=1e-4) and got["t", rank, "CONTENT_FOCUS"] == pytest.approx(own[:, 0].mean() * 100, abs=1e-4)
        assert got["t", rank, "SUBINTENT_COVERAGE"] == pytest.approx((own[:, 1:].max(0) >= 0.15).mean() * 100, abs=1e-4)
    assert {(r.run_id, r.name) for r in out["gaps"].collect()} == {("t", "Boats")}
    best = {r.run_id: r.passage for r in out["best"].collect()}
    assert best["e"] == "one page about cats" and best["t"].startswith("foam mats for yoga.") and len(best["t"]) == 300


def test_a_missing_or_odd_vector_means_tfidf(spark):
    requests = spark.createDataFrame([(k, "cats") for k in "abcd"], "run_id string, keyword string")
    df = spark.createDataFrame([(k, 1, f"page {k}") for k in "abcd"], "run_id string, rank int, body string")
    base = [("cats", [1.0, 0.0]), (f"cats. {semantic.ALONE}", [1.0, 1.0]), ("page a", [1.0, 2.0])]
    odd = [("page b", [1.0]), ("page c", [float("nan"), 1.0]), ("page a", [1.0, 2.0])]
    given = spark.createDataFrame(base + odd, "text string, vector array<double>")
    assert {r.run_id: r.method for r in layers.meaning(requests, df, None, given)["methods"].collect()} == {"a": "embeddings", "b": "tfidf", "c": "tfidf", "d": "tfidf"}


def test_tiles_of_pages(spark):
    rng = np.random.default_rng(2)
    v, q = rng.normal(size=(200, 5)), rng.normal(size=(9, 5))
    v[3] = 0
    page = [int(x) for x in rng.integers(0, 4, 200)]
    vectors = spark.createDataFrame([(p, k, [float(x) for x in r]) for k, (p, r) in enumerate(zip(page, v, strict=True))], "page int, pos int, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(q)], "query_id int, query array<double>")
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) != 0)
    sims = np.clip(unit(v) @ unit(q).T, 0, 1)
    for r in semantic.page_similarities(vectors, queries, at_once=4).collect():
        own = [k for k in range(200) if page[k] == r.page]
        assert r.m == pytest.approx(sims[own, r.query_id].max()) and r.s / r.n == pytest.approx(sims[own, r.query_id].mean()) and r.best_pos == own[int(sims[own, r.query_id].argmax())]


# --- field data, and all layers out of analyze


def test_field_data(spark):
    pages = spark.createDataFrame([("r", 0, "HTTPS://a.com/x?y"), ("r", 1, "https://a.com"), ("r", 2, "https://b.com:8/"), ("r", 3, "https://c.com/"), ("r", 4, "no url"), ("r", 5, None)], "run_id string, rank int, url string")
    body = '{"record":{"metrics":{"largest_contentful_paint":{"percentiles":{"p75":1200}},"cumulative_layout_shift":{"percentiles":{"p75":"0.05"}}}}}'
    got = {(r["rank"], r.factor_id): r.value for r in layers.field_data(pages, spark.createDataFrame([("https://a.com", body), ("https://b.com:8", None), ("https://z.com", body)], "origin string, payload string")).collect()}
    assert got == {(k, f): v for k in (0, 1) for f, v in (("CRUX_LCP_MS", 1200.0), ("CRUX_CLS", 5.0), ("CRUX_HAS_DATA", 1.0))} | {(2, "CRUX_HAS_DATA"): 0.0}


def test_all_layers_out_of_analyze(spark, tmp_path):
    n = 8
    tables = {
        "requests": ([("r", "car seat", "https://d3.com/x")], "run_id string, keyword string, target_url string"),
        "items": ([("r", k, f"https://d{k}.com/x", f"d{k}.com", "car seat", "", "") for k in range(1, n + 1)], "run_id string, rank int, url string, domain string, title string, snippet string, displayed_url string"),
        "pages": ([(f"https://d{k}.com/x", f"<html><title>t</title><body><h1>Seat {k}</h1><p>" + "car seat comfort " * (n - k + 1) + ". safety belts.</p></body></html>", 5.0, True) for k in range(1, n + 1)], "url string, html string, load_ms double, ok boolean"),
        "intents": ([("r", 0, "Comfort", "seat comfort"), ("r", 1, "Safety", "safety belts")], "run_id string, ord int, name string, description string"),
        "entities": ([("r", k, "Safety belt", "product", 0.5, k) for k in range(1, n)] + [("r", 0, "Comfort", "topic", 0.5, 0)], "run_id string, rank int, name string, type string, salience double, ord int"),
        "triples": ([("r", k, "safety belt", "price", "$5", False, k) for k in range(3)], "run_id string, rank int, entity string, attribute string, value string, is_edge boolean, ord int"),
        "stats": ([(f"d{k}.com", 10.0 * k, k, k, 3, 1) for k in range(1, n + 1)], "target string, authority_score double, referring_domains int, total_backlinks int, follow int, nofollow int"),
        "keywords": ([(f"d{k}.com", f"d{k} com", 10.0 * k, 1) for k in range(1, n + 1)], "domain string, phrase string, volume double, ord int"),
        "crux": ([(f"https://d{k}.com", '{"record":{"metrics":{"largest_contentful_paint":{"percentiles":{"p75":%d}}}}}' % (100 * k)) for k in range(1, n)], "origin string, payload string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    cli.main(["analyze", *[x for name in tables for x in (f"--{name}", f"{tmp_path}/{name}")], "--out", f"{tmp_path}/out"], spark)
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    rows = read("factor_values").collect()
    got = {(r["rank"], r.factor_id): r for r in rows}
    assert len(rows) == len(got)
    want = ["BEST_PASSAGE_SIM", "SUBINTENT_COVERAGE", "CONTENT_FOCUS", "SALIENT_TERM_COVERAGE", "DISTINCT_ENTITIES", "EAV_COMPLETENESS", "AUTHORITY_SCORE", "BRAND_VOLUME", "CRUX_LCP_MS", "CRUX_HAS_DATA", "TF"]
    assert [f for f in want if (1, f) not in got] == [] and got[1, "CRUX_LCP_MS"].value == 100 and got[1, "AUTHORITY_SCORE"].url == "https://d1.com/x" and (8, "CRUX_LCP_MS") not in got
    assert {r.gate for r in read("gates").collect()} == {"access", "lexical", "semantic", "entities", "quality", "authority"}  # trust is read off the pages
    assert read("entities_eav").count() == 1 and read("meaning_coverage").count() == 2 * (n + 1) and read("brand_leaderboard").count() > 0


# --- ranks of groups that no task should hold


def test_ranks_in_ranges_are_the_windows(spark):
    rng = np.random.default_rng(4)
    rows = [("big", f, int(k), float(v)) for f in ("A", "B") for k, v in enumerate(rng.choice([-1.5, 0.0, 0.0, 2.0, 7.0, *rng.normal(size=300)], 3000))] + [("small", "A", k, float(k % 3)) for k in range(20)]
    df = spark.createDataFrame(rows, "run_id string, factor_id string, rank int, value double").repartition(5)
    key = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    assert key(correlate.ranked(df, ["run_id", "factor_id"], {"value": "rv", "rank": "rr"}, most=100)) == key(correlate.ranked(df, ["run_id", "factor_id"], {"value": "rv", "rank": "rr"}))
    assert key(correlate.percentile(df, ["run_id", "factor_id"], most=100)) == key(correlate.percentile(df, ["run_id", "factor_id"]))
    assert key(correlate.correlate(df, most=100)) == key(correlate.correlate(df))


def test_no_task_holds_a_group(spark):
    n = 40_000
    df = spark.range(n).select(F.lit("r").alias("run_id"), F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("value"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        out = correlate.below(df, ["run_id"], "value")
        sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == n and max(sizes) < n / 8


# --- topics


def test_terms_meet_slugs_by_prefix(spark):
    import random
    import re

    pick = random.Random(7)
    parts = ["dental", "implant", "implants", "bone", "graft", "superimplant", "the", "of", "a1", "x", "women's", "womens"]
    texts = [" ".join(pick.choices(parts, k=pick.randint(0, 6))) for _ in range(150)] + ["dentalimplant", "'women's dental", None]
    terms = ["dental implant", "bone graft", "implant", "the of", "women's", "graft dental implant", "a1", "den"]
    got = topical.term_hits(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), spark.createDataFrame([(t,) for t in terms], "term string"), "k", "t")
    gap, want = r"(?:\W+\w*?){0,2}?", set()
    for t in terms:
        ws = [w for w in re.findall("[a-z0-9']+", t) if len(w) > 2 and w not in ("the", "of")]
        want |= {(k, t) for k, x in enumerate(texts) if ws and re.search(r"\b" + gap.join(w + r"\w*" for w in ws), x or "", re.A)}
    assert {(r.k, r.term) for r in got.collect()} == want and len(want) > 100


def test_guesses_that_gave_nothing_cost_nothing(spark):
    xml = "<?xml version='1.0'?>"
    docs = [("https://a.com/sitemap_index.xml", xml + "<sitemapindex>" + "".join(f"<loc>s{k:02}</loc>" for k in range(59)) + "</sitemapindex>"), ("https://a.com/sitemap.xml", "<html>no such page</html>")]
    docs += [(f"s{k:02}", f"{xml}<urlset><loc>p{k}</loc></urlset>") for k in range(59)]
    robots = spark.createDataFrame([("a.com", "User-agent: *")], "domain string, body string")
    got = topical.inventory(robots, spark.createDataFrame(docs, "url string, body string")).collect()
    assert {r.url for r in got} == {f"p{k}" for k in range(59)}
