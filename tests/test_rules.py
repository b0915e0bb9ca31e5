"""Rules by hand: kernels, HTML, correlation, roadmap, moves, entities, links, panels, clusters, sources, store."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from serploom import cli
from serploom.functions import replies
from serploom.functions import text as T
from serploom.operators import compare, correlate, entities, factors, funnel, offpage, page, registry, roadmap, semantic, topical
from serploom.plans import analyze, layers, report
from serploom.sources import captured, providers, store
from serploom.streaming import moves as stream


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: T.variations(F.lit("Best Car Seats")), ["best car seats", "car seats", "best car", "seats", "car"]),
        (lambda: T.variations(F.lit("the")), ["the"]),
        (lambda: T.vcount(F.lit("Car seats, car. scar"), F.array(F.lit("car"), F.lit("car seats"))), 3),
        (lambda: T.vcount(F.lit("écar car"), F.array(F.lit("car"))), 1),
        (lambda: T.first_offset(F.lit("a car"), F.array(F.lit("car"), F.lit("zoo"))), 2),
        (lambda: T.first_offset(F.lit("none"), F.array(F.lit("car"))), None),
        (lambda: F.size(T.sentences(F.lit(" One. Two!  Three? "))), 3),
        (lambda: T.registrable_label(F.lit("www.shop.co.uk")), "shop"),
        (lambda: T.registrable_domain(F.lit("a.b.shop.com")), "shop.com"),
        (lambda: T.registrable_trust(F.lit("www.shop.com:8080")), "shop.com"),
        (lambda: T.registrable_compare(F.lit("a.shop.co.uk")), "co.uk"),
        (lambda: T.registrable_compare(F.lit("localhost")), "localhost"),
        (lambda: T.sld_label(F.lit("my.clinic.com.au")), "clinic"),
        (lambda: T.host_of(F.lit("HTTPS://WWW.Shop.com:80/x")), "shop.com"),
        (lambda: T.norm_url(F.lit("https://www.a.com/b/?q=1")), "a.com/b"),
        (lambda: T.slug_text(F.lit("https://a.com/Dental-Implants/sydney.html")), "dental implants sydney"),
        (lambda: T.topic_from_url(F.lit("https://a.com/x/red-shoes/42")), "red shoes"),
        (lambda: T.canon(F.lit("Dental Implants!")), "dental implant"),
        (lambda: T.canon(F.lit("Glass")), "glass"),
        (lambda: T.norm_attr(F.lit("Opening-Hours")), "hours"),
        (lambda: T.attr_family(F.lit("star_rating_price")), "rating"),
        (lambda: T.type_class(F.lit("Local Business")), "org"),
        (lambda: T.stem(F.lit("trainings")), "train"),
        (lambda: T.first_number(F.lit("about $1,200.50 or so")), 1200.5),
        (lambda: T.values_match(F.lit("$1,200"), F.lit("1300")), True),
        (lambda: T.values_match(F.lit("10%"), F.lit("8")), False),
        (lambda: T.values_match(F.lit("Open daily"), F.lit("daily")), True),
        (lambda: T.values_match(F.lit(""), F.lit("daily")), False),
        (lambda: T.number(F.lit("nan")), None),
        (lambda: T.clamp(F.lit("120"), 0.0, 100.0), 100.0),
        (lambda: T.trend_percent(F.lit(150.0), F.lit(100.0)), 50.0),
        (lambda: T.dofollow_ratio(F.lit(0), F.lit(0)), None),
        (lambda: T.looks_blocked(F.lit("x" * 600 + "Just a moment")), True),
        (lambda: T.is_sitemap_index(F.lit("<?xml?><SitemapIndex>")), True),
        (lambda: F.regexp_count(F.lit("dental-implantology"), T.term_pattern(F.lit("dental implant"))), 1),
        (lambda: captured.location_code(F.lit("AU")), 2036),
        (lambda: topical.expand_topic(F.lit("dental implants")), ["dental implants", "implants"]),
        (lambda: topical.score(F.lit(8), F.lit(8), F.lit(1), F.lit(2), F.lit(3)), 90.0),
        (lambda: topical.band(F.lit(40.0)), "moderate"),
        (lambda: correlate.critical(F.lit(2)), 1.0),
        (lambda: roadmap.goal(F.lit(False), F.lit("Words"), F.lit(2.5)), 2.0),
        (lambda: roadmap.goal(F.lit(False), F.lit("Percent"), F.lit(2.34)), 2.3),
        (lambda: funnel.verdict(F.lit(55.0)), "pass"),
        (lambda: funnel.expected_clicks(F.lit(11)), 0.02),
        (lambda: funnel.intent_fit(F.lit("a"), F.lit("b"), F.lit(0.5)), "mismatch"),
        (lambda: entities.range_display(F.lit(10.0), F.lit(1200.0), F.lit(2), F.lit(True)), None),
        (lambda: entities.range_display(F.lit(100.0), F.lit(1200.0), F.lit(2), F.lit(True)), "$100-$1,200"),
    ],
)
def test_kernels(spark, column, want):
    assert value(spark, column()) == want


HTML = """<!DOCTYPE html><html><head><title>Best Car Seat</title><title>second</title><meta property="OG:title" content="car seat">
<meta name=description content="d e"><script type="application/ld+json">{"@graph":[{"@type":["Product"],"offers":{"price":3},"sameAs":["https://twitter.com/a"]}]}</script>
<script type="application/ld+json">{broken</script></head><body><nav><a href="/n">nav</a></nav><div role="navigation"><a href="/m">m</a></div>
<h1>How to car?</h1><h2></h2><p>car seat one. Two by John Smith!<p>three <a href="https://o.com/c" rel="nofollow">car</a><a href="mailto:a@b.co">m</a>
<a href="/about">About</a><img src=a alt="car"><img alt=" "><time datetime="2024"></time></body>"""


def test_html_factors(spark):
    df = spark.createDataFrame([(1, "https://www.shop-car.com/x", HTML, "shop-car.com"), (2, None, None, None)], "id int, url string, html string, domain string")
    p = page.surfaces(df).withColumns({"phrase": F.lit("car seat"), "vars": T.variations(F.lit("car seat")), "load_ms": F.lit(None).cast("double")})
    got = {(r.id, r.factor_id): r.value for r in factors.page_factors(p, ["id"]).collect()}
    want = {"TITLE_LEN": 13, "TITLE_VARS": 3, "OG_TITLE_VARS": 3, "HEADING_COUNT": 1, "QUESTIONS_H1": 1, "P_TAGS": 2, "LINKS": 3, "INTERNAL_LINKS": 1, "EXTERNAL_LINKS": 2, "NOFOLLOW_LINKS": 1, "IMAGES": 2, "IMAGES_ALT": 1,
            "HAS_JSONLD": 1, "SCHEMA_TYPES": 1, "USES_PRODUCT_OFFER": 1, "USES_FAQ": 0, "CLAIMED_BRANDS": 1, "META_DESC_WORDS": 2, "HAS_DOCTYPE": 1, "HAS_EMAIL": 1, "TRUST_BYLINE": 1, "TRUST_SAMEAS": 1, "TRUST_CONTACT_LINK": 1, "TRUST_VISIBLE_DATE": 1}
    assert {k: got[1, k] for k in want} == want
    assert got[2, "WORD_COUNT"] == 0


def test_registry():
    ids = [f.id for f in registry.REGISTRY]
    assert len(ids) == len(set(ids)) == 113 and set(factors.HTML) | set(factors.TRUST) | set(factors.SERP) <= set(ids)
    sources = {s: sum(f.source == s for f in registry.REGISTRY) for s in {f.source for f in registry.REGISTRY}}
    assert sources == {"html": 63, "backlinks": 9, "entity": 9, "serp": 8, "trust": 8, "corpus": 4, "semantic": 4, "crux": 4, "quality": 2, "engagement": 2}
    assert sum(f.is_bool for f in registry.REGISTRY) == 23 and sum(f.direction == "less_is_better" for f in registry.REGISTRY) == 6


def test_correlation_edges(spark):
    def run(name, pairs):
        return [(name, rank, "F", float(v)) for rank, v in pairs]

    rows = run("up", [(k, k) for k in range(1, 7)]) + run("down", [(k, 9 - k) for k in range(1, 7)]) + run("few", [(k, k) for k in range(1, 5)]) + run("zeros", [(k, max(0, k - 2)) for k in range(1, 7)]) + run("flat", [(k, 3) for k in range(1, 7)]) + run("one", [(3, k) for k in range(1, 7)])
    got = {r.run_id: r for r in correlate.correlate(spark.createDataFrame(rows + [("up", 0, "F", 99.0)], "run_id string, rank int, factor_id string, value double")).collect()}
    assert got["up"].n == 6 and got["up"].best == pytest.approx(1) and got["up"].direction == "less_is_better" and got["up"].significant
    assert got["down"].best == pytest.approx(-1) and got["down"].direction == "more_is_better"
    assert all(got[k].best is None and not got[k].significant for k in ("few", "zeros", "flat", "one"))


def test_roadmap_cap_and_backfill(spark):
    rows = [("r", f"f{k}", "G" if k < 6 else "H", float(9 - k), k, True) for k in range(9)]
    df = spark.createDataFrame(rows, "run_id string, factor_id string, group string, score double, ordinal int, eligible boolean")
    got = [r.factor_id for r in roadmap.top_actions(df, limit=7).orderBy("place").collect()]
    assert got == ["f0", "f1", "f2", "f3", "f6", "f7", "f8"]


def test_moves(spark):
    b = spark.createDataFrame([("r", "a.com", 1), ("r", "youtube.com", 2), ("r", "c.com", 3)], "run_id string, domain string, rank int")
    a = spark.createDataFrame([("r", "a.com", 3), ("r", "d.com", 1), ("r", "c.com", 2)], "run_id string, domain string, rank int")
    got = compare.moves(b, a, ["run_id"])
    assert [(r.domain, r.status, r.delta) for r in got.orderBy("place").collect()] == [("d.com", "entered", None), ("c.com", "up", 1), ("a.com", "down", -2), ("youtube.com", "dropped", None)]
    c = compare.churn(got, ["run_id"]).first()
    assert (c.entered, c.mega_dropped, c.n1_flip, round(c.churn_pct, 2)) == (1, 1, True, 33.33)
    none = compare.churn(compare.moves(b, a.filter("false"), ["run_id"]), ["run_id"]).first()
    assert none.churn_pct is None and none.dropped == 3


def test_as_of(spark):
    s = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-05", 2), ("b", "2024-02-01", 3)], "k string, ts string, value int")
    c = spark.createDataFrame([("a", "2024-01-05"), ("b", "2024-01-05"), ("z", "2024-01-05")], "k string, cutoff string")
    assert {r.k: r.value for r in compare.as_of(s, c, ["k"]).collect()} == {"a": 1, "b": 3}


def test_percentile_outside_and_empty(spark):
    df = spark.createDataFrame([("g", 0, 9.0), ("g", 1, 1.0), ("g", 2, 1.0), ("e", 0, 1.0)], "g string, rank int, value double")
    got = {(r.g, r.rank): r.percentile for r in correlate.percentile(df, ["g"]).collect()}
    assert got == {("g", 0): 100.0, ("g", 1): 50.0, ("g", 2): 50.0, ("e", 0): None}


def test_entities_rules(spark):
    raw = spark.createDataFrame([("r", 1, "Dental Implants", "service", 0.5, 1), ("r", 1, "dental implant", "service", 0.9, 2), ("r", 1, "Menu", "x", 1.0, 3), ("r", 2, "dental implant", "service", 0.2, 1)], "run_id string, rank int, name string, type string, salience double, ord int")
    e = entities.clean_entities(raw)
    assert sorted((r.rank, r.canon, r.salience) for r in e.collect()) == [(1, "dental implant", 0.9), (2, "dental implant", 0.2)]
    t = spark.createDataFrame([("r", k, "dental implant", "price", v, False, 1) for k, v in ((1, "$100"), (2, "$105"), (3, "$500"), (0, "$300"))] + [("r", 1, "dental implant", "url", "x", False, 2)], "run_id string, rank int, entity string, attribute string, value string, is_edge boolean, ord int")
    clean = entities.clean_triples(t)
    assert clean.filter("attribute = 'url'").count() == 0
    got = entities.eav_rows(clean, e.unionByName(spark.createDataFrame([("r", 0, "dental implant", "Dental implant", "service", 1.0, 1)], e.schema))).first()
    assert (got.consensus, got.backing, got.gap, got.graded) == (3, 2, "off_consensus", True)
    alias = entities.alias_map(spark.createDataFrame([("r", 1, "acme seat", "a", "product", 1.0, 1), ("r", 2, "acme seats", "a", "product", 1.0, 1), ("r", 2, "acme 2", "a", "product", 1.0, 2)], e.schema), "car seat")
    assert sorted((r.canon, r.winner) for r in alias.collect()) == [("acme seat", "acme seats"), ("acme seats", "acme seats")]


def test_links_and_brand(spark):
    k = spark.createDataFrame([("brightsmileclinic.com", "bright smile clinic", 100.0, 1), ("brightsmileclinic.com", "Bright Smile Clinic", 150.0, 2), ("brightsmileclinic.com", "bright", 10.0, 3), ("brightsmileclinic.com", "bright dentist", 5.0, 4), ("brightsmileclinic.com", "dentist", 999.0, 5)], "domain string, phrase string, volume double, ord int")
    r = offpage.branded_volume(k).first()
    assert r.BRAND_VOLUME == 165.0 and r.n_phrases == 3
    links = spark.createDataFrame([("r", "d", "s.com", 50.0, 0.5, True, "u1"), ("r", "d", "s.com", 50.0, 0.5, False, "u2"), ("r", "d", "x.top", 90.0, 0.5, True, "u3"), ("r", "d", "y.com", 2.0, None, True, "u4")], "run_id string, destination string, source_domain string, source_authority double, relevance double, dofollow boolean, source_url string")
    assert [r.source_url for r in offpage.strongest_links(offpage.not_spam(links), ["run_id"]).collect()] == ["u1"]


def test_passages(spark):
    pack = lambda t: [p.text for p in spark.createDataFrame([(t,)], "t string").select(semantic.packed_passages("t")).first()[0]]
    words = lambda n: " ".join(["w"] * n)
    size = lambda t: [len(p.split()) for p in pack(t)]
    assert size(words(59)) == [59] and size(words(119)) == [119] and size(words(120)) == [120] and size(words(181)) == [180, 1]
    assert size(" ".join([words(100) + ".", words(90) + ".", words(40) + "."])) == [100, 130]
    assert size(" ".join([words(125) + ".", words(50) + "."])) == [175] and size(" ".join([words(125) + ".", words(59) + "."])) == [125, 59]
    assert size(words(130) + ".\n\n" + words(20) + ".") == [130, 20] and size("") == [] and len(pack(" ".join(words(130) + "." for _ in range(80)))) == 60
    assert pack("a b\n\nc d") == ["a b\n\nc d"] and size(words(10) + "\n\n" + " ".join(words(100) + "." for _ in range(2))) == [110, 100]


def test_panels(spark):
    v = spark.createDataFrame([("r", 1, "a", 3.0), ("r", 1, "b", 1.0), ("r", 2, "a", 2.0), ("r", 2, "c", -5.0)], "run_id string, panel int, id string, count double")
    assert {r.id: r.share for r in funnel.vote_share(v, ["run_id"]).collect()} == pytest.approx({"a": 0.875, "b": 0.125})
    m = spark.createDataFrame([(1, 50.0, "x", 1), (1, float("nan"), "y", 2), (1, 900.0, "z", 3)], "rank int, score double, note string, ord int")
    r = funnel.median_judgement(m, ["rank"]).first()
    assert (r["median"], r.n, r.note) == (75.0, 2, "z")


def test_sitemaps(spark):
    robots = spark.createDataFrame([("a.com", "User-agent: *\nSitemap: https://a.com/s.xml"), ("b.com", "")], "domain string, body string")
    got = topical.robots_sitemaps(robots).groupBy("domain").count().collect()
    assert {r.domain: r["count"] for r in got} == {"a.com": 1, "b.com": 6}
    docs = spark.createDataFrame([("s1", "<sitemapindex><loc> s2 </loc><loc>s1</loc></sitemapindex>"), ("s2", "<urlset><loc>s1</loc><loc>p</loc></urlset>")], "url string, body string")
    edges = topical.sitemap_urls(docs).select(F.col("url").alias("parent"), "child")
    assert {(r.node, r.depth) for r in topical.reachable(edges, spark.createDataFrame([("s1",)], "root string")).collect()} == {("s1", 0), ("s2", 1), ("p", 2)}


def test_topic_plan(spark):
    sitemap = spark.createDataFrame([("a.com", "https://a.com/dental-implants"), ("a.com", "https://a.com/bone-graft")], "domain string, url string")
    terms = spark.createDataFrame([("dental implant", "core"), ("bone graft", "adjacent"), ("the", "core")], "term string, kind string")
    hits = spark.createDataFrame([("a.com", "https://www.a.com/dental-implants/", ["dental implant"]), ("a.com", "https://a.com/new", ["dental implant"])], "domain string, url string, terms array<string>")
    r = analyze.topic(sitemap, terms, hits)["summary"].first()
    assert (r.cluster_size, r.sitemap_total, r.serp_hits, r.adjacent_covered, r.canonical) == (2, 2, 2, 1, "https://a.com/dental-implants")


def test_analyze_plan(spark):
    req = spark.createDataFrame([("r", "car seat", "https://t.com/x")], "run_id string, keyword string, target_url string")
    n = 8
    items = spark.createDataFrame([("r", k, f"https://s{k}.com/car", f"s{k}.com", "car seat " * k, "snippet", "") for k in range(1, n)], "run_id string, rank int, url string, domain string, title string, snippet string, displayed_url string")
    pages_ = spark.createDataFrame([(f"https://s{k}.com/car", HTML + "<p>car seat word.</p>" * (20 - k), 5.0, True) for k in range(1, n)] + [("https://t.com/x", "<title>t</title><p>car</p>", 1.0, True), ("https://s3.com/zzz", "", None, False)], "url string, html string, load_ms double, ok boolean")
    out = analyze.analyze(req, items, pages_)
    c = {r.factor_id: r for r in out["correlations"].collect()}
    assert c["P_TAGS"].best == pytest.approx(-1) and c["P_TAGS"].significant and c["SR_TITLE_VARS"].best == pytest.approx(1)
    acts = out["actions"].orderBy("place").collect()
    assert 0 < len(acts) <= 10 and {a.run_id for a in acts} == {"r"}
    assert out["overall"].first().bottleneck is not None and out["scorecard"].first().n_significant > 0


def test_replies(spark):
    assert replies.first_balanced('x ```json {"a": "}", "b": {"c": 1}} y') == '{"a": "}", "b": {"c": 1}}'
    assert replies.salvage_array('[{"a": 1}, {"b": 2}, {"c":') == '[{"a": 1}, {"b": 2}]' and replies.salvage_array("none") is None
    both = spark.createDataFrame([('x {"a": 1} y [1, 2] z',), (None,)], "r string").select(replies.reply_object("r").alias("o"), replies.reply_array("r").alias("a")).collect()
    assert [tuple(r) for r in both] == [('{"a": 1}', "[1, 2]"), (None, None)]
    df = spark.createDataFrame([(1, "<think>E;no;x;1</think>E;Acme;company;0.7\nT;Acme;price;$5|R;Acme;owner;Bob\nE;;x;1\nnoise")], "page int, reply string")
    e, t = replies.tagged_lines(df, ["page"])
    assert [(r.name, r.salience) for r in e.collect()] == [("Acme", 0.7)] and sorted((r.attribute, r.is_edge) for r in t.collect()) == [("owner", True), ("price", False)]
    known = spark.createDataFrame([("unit_cost",), ("same",)], "attribute string")
    m = replies.mapping_lines(spark.createDataFrame([(1, "unit cost => price\nsame => same\nunknown => price")], "run int, reply string"), known, ["run"])
    assert [(r.raw, r.canonical) for r in m.collect()] == [("unit_cost", "price")]


def test_sources(spark):
    raw = spark.createDataFrame([("r", '{"results":[{"url":"https://www.A.com/1","organic_rank":2},{"url":"https://a.com/2","position":1},{"url":"ftp://x","position":1},{"url":"https://b.com","organic_rank":"x"}]}')], "run_id string, payload string")
    got = captured.serp_items(raw, ["run_id"]).collect()
    assert [(r.domain, r.rank, r.url) for r in got] == [("a.com", 1, "https://a.com/2")]
    auth = spark.createDataFrame([('[{"domain":"www.a.com","authority_score":5,"traffic":{"visits":20,"prev_visits":10}}]',), ('{"b.com":{"authority_score":7}}',)], "payload string")
    assert {r.domain: (r.authority_score, r.trend_pct) for r in captured.domain_authority(auth).collect()} == {"a.com": (5.0, 100.0), "b.com": (7.0, None)}
    bulk = spark.createDataFrame([(["x", "y"], '{"results":[{"target":"x","authority_score":1},{"authority_score":2}]}')], "targets array<string>, payload string")
    assert {r.target: r.authority_score for r in captured.bulk_stats(bulk).collect()} == {"x": 1.0, "y": 2.0}
    c = captured.crux(spark.createDataFrame([(1, '{"record":{"metrics":{"cumulative_layout_shift":{"percentiles":{"p75":"0.25"}}}}}'), (2, "{}")], "id int, payload string"), ["id"]).orderBy("id").collect()
    assert (c[0].CRUX_CLS, c[0].CRUX_HAS_DATA, c[1].CRUX_HAS_DATA) == (25.0, 1.0, 0.0)
    e = captured.embeddings(spark.createDataFrame([(1, '{"data":[{"index":0,"embedding":[1,2]}]}'), (2, '{"data":[{"index":0,"embedding":[1]},{"index":1,"embedding":[1,2]}]}')], "id int, payload string"), ["id"])
    assert [r.id for r in e.collect()] == [1]
    d, cost = captured.dated_items(spark.createDataFrame([("r", '{"tasks":[{"cost":0.5,"result":[{"datetime":"2024-01-02 x","items":[{"type":"organic","url":"https://a.com/","rank_group":1},{"type":"paid","url":"https://b.com/","rank_group":2}]}]}]}')], "run_id string, payload string"), ["run_id"])
    assert [(r.domain, r.snapshot_date) for r in d.collect()] == [("a.com", "2024-01-02")] and cost.first().cost == 0.5


def test_store(spark, tmp_path):
    row = ("1", "analyze", "running", "l", "2024-01-01", "2024-01-01", "o", '{"api_key": "S3CRET", "keyword": "k"}', None, "failed with S3CRET")
    rows = [row, (*row[:2], "done", "l2", "2030-01-01", "2024-02-01", "other", row[7], '{"x": 1}', None)]
    df = spark.createDataFrame(rows, store.RUN.replace("timestamp", "string")).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at")})
    store.append(df, str(tmp_path / "runs"), ["S3CRET"])
    saved = store.read(spark, str(tmp_path / "runs"))
    assert not any("S3CRET" in str(r) for r in saved.collect())
    r = store.run_by_id(saved, "1").first()
    assert (r.status, r.label, r.owner_id, r.created_at.year) == ("done", "l2", "o", 2024)
    assert store.interrupted(saved).count() == 0 and "<td>done</td>" in store.html_table(store.newest(saved, "o"), "Runs")


def test_stream_of_moves(spark, tmp_path):
    rows = [("k", "a.com", f"2024-01-0{d} 00:00:00", r) for d, r in ((1, 5), (2, 3), (3, 3), (4, 9))] + [("k", "a.com", "2024-01-02 00:00:00", 3)]
    df = spark.createDataFrame(rows, "keyword string, domain string, ts string, rank int").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.move_stream(s).writeStream.format("memory").queryName("moves_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = spark.sql("select * from moves_out order by ts").collect()
    finally:
        q.stop()
    assert [(r.before_rank, r.after_rank, r.status) for r in got] == [(None, 5, "entered"), (5, 3, "up"), (3, 3, "same"), (3, 9, "down")]


def test_markdown():
    got = report.markdown_to_html("# A <b>\n\n- one **x**\n- two\n\n1. a\n\ntext $a \\geq b$ costs $5 and $6 `c`\n---")
    assert got == "<h1>A &lt;b&gt;</h1>\n<ul><li>one <strong>x</strong></li><li>two</li></ul>\n<ol><li>a</li></ol>\n<p>text a ≥ b costs $5 and $6 <code>c</code></p>\n<hr>"
    assert report.plain_math(r"$$x_{1} \\text{is} \\unknown y$$".replace("\\\\", "\\")) == "x_1 is y"


def test_schema_triples(spark):
    got = page.schema_triples(spark.createDataFrame([(1, '<script type="application/ld+json">[{"@type":"Thing","name":"A","price":3,"x":{"name":"B"}}]</script>'), (2, None)], "id int, html string"), ["id"]).collect()
    assert sorted((r.entity, r.type, r.attribute, r.value) for r in got) == [("A", "Thing", "price", "3"), ("B", "", None, None)] or {r.entity for r in got} == {"A", "B"}


def test_providers(spark):
    def page_of(url):
        if "bad" in url:
            raise RuntimeError("no")
        return {"url": url, "html": "x", "ok": True, "status_code": 200, "via": "t"}

    got = {r.url: r for r in providers.fetch_pages(spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "url string"), page_of, 2).collect()}
    assert set(got) == {"a", "bad"} and got["a"].ok and got["bad"].error == "no"
    fetch = providers.escalating(lambda u: {"html": "blocked"}, lambda u: {"html": "fine"}, blocked=lambda h: h == "blocked")
    assert fetch("x") == {"html": "fine", "ok": True}
    waits, answers = [], iter([(429, ""), (200, "<think>no</think> yes KEY")])
    chat = providers.retrying(lambda p: next(answers), providers.Settings(credentials={"k": "KEY"}), waits.append)
    assert chat("p") == "yes [redacted]" and waits == [4.0]
    assert providers.first_good(["a", "b"], lambda e, b: (200, "[]") if e == "a" else (200, "{}"), {}) == {}
    asked = providers.ask_all(spark.createDataFrame([("p",), ("p",)], "prompt string"), lambda p: p + "!", 1)
    assert [r.reply for r in providers.captured_replies(spark.createDataFrame([("p",), ("q",)], "prompt string"), asked).orderBy("prompt").collect()] == ["p!", None]
    vec = providers.embed_all(spark.createDataFrame([("t",)], "text string"), lambda ts: [[1.0, 2.0] for _ in ts], at_once=1).first()
    assert vec.embedding == [1.0, 2.0]


def test_prompt_and_phases(spark):
    c = spark.createDataFrame([("r", "A", -0.9, 9, True), ("r", "B", 0.1, 9, False)], "run_id string, factor_id string, best double, n int, significant boolean")
    a = spark.createDataFrame([("r", "H1_COUNT", "H1", 1, 2.0, None, 1.0), ("r", "REF_DOMAINS", "Refs", 2, 9.0, 3.0, 5.0)], "run_id string, factor_id string, name string, place int, goal double, current double, score double")
    assert report.narrative_prompt(c, a).first().prompt.splitlines()[1] == "- A: r=-0.90, n=9"
    assert [r.factor_id for r in report.phased(a, registry.factor_def(spark)).orderBy("row").collect()] == ["H1_COUNT", "REF_DOMAINS"]


ENTITY = "run_id string, rank int, canon string, name string, type string, salience double, ord int"


def test_providers_and_subjects(spark):
    rows = [("r", 1, "bright smile clinic", "clinic"), ("r", 1, "bsc", "org"), ("r", 2, "sydney", "city"), ("r", 2, "dr who", "person"), ("r", 1, "implant", "service"), ("r", 2, "implant", "service")]
    e = spark.createDataFrame([(a, b, c, c, t, 1.0, k) for k, (a, b, c, t) in enumerate(rows)], ENTITY)
    sites = spark.createDataFrame([("r", 1, "brightsmile.com.au"), ("r", 2, "sydneydental.com")], "run_id string, rank int, domain string")
    t = spark.createDataFrame([("r", 2, "dr who", "phone", "1", False, 1), ("r", 2, "dr who", "email", "2", False, 2), ("r", 1, "implant", "phone", "3", False, 1)], "run_id string, rank int, canon string, attribute string, value string, is_edge boolean, ord int")
    got = entities.provider_canons(e, t, sites)
    assert sorted(r.canon for r in got.collect()) == ["bright smile clinic", "dr who"]
    assert sorted(r.canon for r in entities.to_subject(t, got).collect()) == ["__subject__", "__subject__", "implant"]
    assert [r.canon for r in entities.topic_canons(e, "implants").collect()] == ["implant"]


def test_coverage(spark):
    e = spark.createDataFrame([("r", 1, "implant", "Implant", "s", 0.9, 1), ("r", 2, "bone graft", "bone graft", "s", 0.5, 1)], ENTITY)
    b = spark.createDataFrame([("r", 0, "nothing here"), ("r", 1, "an implant"), ("r", 2, "no implantology; an IMPLANT though"), ("r", 3, "bone grafts")], "run_id string, rank int, body string")
    got = {r.canon: r for r in entities.coverage(e, b).collect()}
    assert (got["implant"].consensus, got["implant"].target_present, got["implant"].place) == (2, False, 1) and got["bone graft"].consensus == 1


def test_brief(spark):
    cov = spark.createDataFrame([("r", "a", "A", 3, False, 1), ("r", "b", "B", 2, False, 2), ("r", "c", "C", 1, True, 3)], "run_id string, canon string, name string, consensus int, target_present boolean, place int")
    rows = [("r", "a", "price", False, 3, "$5", None, True, "missing_attribute"), ("r", "b", "owner", True, 3, "Bob", None, True, "missing_entity"), ("r", "c", "price", False, 4, "$5", "$9", True, "off_consensus"), ("r", "d", "size", False, 2, "x", "x", True, "")]
    eav = spark.createDataFrame(rows, "run_id string, canon string, attribute string, is_edge boolean, consensus int, consensus_value string, target_value string, graded boolean, gap string")
    actions = spark.createDataFrame([("r", "Content", "Content", "Words", 900.0, "Easy", 1), ("r", "Technical", "Technical", "Speed", 1.0, "Easy", 2)], "run_id string, group string, phase string, name string, goal double, difficulty string, place int")
    gaps = spark.createDataFrame([("r", 7, 0.1)], "run_id string, query_id int, best double")
    got = topical.brief(cov, eav, actions, gaps, cov.filter("canon = 'a'").withColumn("add_place", F.lit(1)), 10)
    assert sorted((r.section, r.ord) for r in got.collect()) == sorted((s, 1) for s in topical.CAPS)
    assert topical.markdown(got).first().markdown.startswith("## Entities To Add\n- Cover A (3 of 10 top pages cover it)\n\n## Topics To Expand")


def test_phrase_is_made_of_tokens(spark):
    r = spark.range(1).select(T.phrase_of(F.lit("Best Running-Shoes: 2024")).alias("p"), T.variations(F.lit("Best Running-Shoes: 2024")).alias("v"), T.variations(F.lit("c++ tutorial")).alias("c")).first()
    assert r.p == "best running shoes 2024" and r.v[0] == r.p and "running shoes 2024" in r.v and r.c == ["c tutorial", "tutorial"]


def test_sitemap_bounds_documents_not_pages(spark):
    urls = "".join(f"<loc>https://a.com/{k}</loc>" for k in range(200))
    many = [("s", f"<urlset>{urls}</urlset>")]
    deep = [(f"d{k}", f"<sitemapindex><loc>d{k + 1}</loc><loc>d0</loc></sitemapindex>") for k in range(5)] + [("d4", "<urlset><loc>p4</loc></urlset>"), ("d5", "<urlset><loc>p5</loc></urlset>")]
    wide = [("w", "<sitemapindex>" + "".join(f"<loc>w{k:03}</loc>" for k in range(100)) + "</sitemapindex>")] + [(f"w{k:03}", f"<urlset><loc>q{k}</loc></urlset>") for k in range(100)]
    docs = spark.createDataFrame([*many, *[x for x in deep if x != ("d4", deep[4][1])], *wide, ("h", "<html><loc>no</loc>")], "url string, body string")
    got = topical.expand_sitemaps(docs, spark.createDataFrame([("a", "s"), ("b", "d0"), ("c", "w"), ("e", "h"), ("f", "gone")], "root string, url string")).groupBy("root").count().collect()
    assert {r.root: r["count"] for r in got} == {"a": 200, "b": 1, "c": 59}
    robots = spark.createDataFrame([("a.com", "Sitemap: s")], "domain string, body string")
    assert topical.inventory(robots, docs).count() == 200


def test_analyze_with_all_layers(spark, tmp_path):
    n = 8
    req = spark.createDataFrame([("r", "Car-Seat!", "https://d3.com/x"), ("q", "car seat", None)], "run_id string, keyword string, target_url string")
    items = spark.createDataFrame([(run, k, f"https://d{k}.com/x", f"d{k}.com", "car seat " * (n - k), "", "") for run in "rq" for k in range(1, n + 1)], "run_id string, rank int, url string, domain string, title string, snippet string, displayed_url string")
    html = lambda k: "<html><title>t</title><body><p>" + "car seat comfort " * (n - k + 1) + "</p><p>safety belts matter here. " + "extra words " * k + "</p></body></html>"
    pages = spark.createDataFrame([(f"https://d{k}.com/x", html(k), 5.0, k != 5) for k in range(1, n + 1)], "url string, html string, load_ms double, ok boolean")
    each = spark.createDataFrame([(run, k, 10.0 * k, 90.0 - k, "n", k) for run in "rq" for k in range(n + 1)], "run_id string, rank int, effort double, helpfulness double, note string, ord int")
    votes = spark.createDataFrame([("r", p, k, float(9 - k)) for p in range(2) for k in range(n + 1)], "run_id string, panel int, id int, count double")
    types = spark.createDataFrame([("r", k, "guide" if k % 3 else "tool") for k in range(n + 1)], "run_id string, rank int, page_type string")
    cells = spark.createDataFrame([("r", k, c, (k + len(c)) % 2 == 0) for k in range(n + 1) for c in ("a", "bb")], "run_id string, rank int, canon string, present boolean")
    sims = spark.createDataFrame([("r", k, 0, q, 0.3 + 0.05 * ((k + q) % 7)) for k in range(n + 1) for q in range(3)], "run_id string, rank int, pos int, query_id int, sim double")
    satisfied = each.select("run_id", "rank", F.col("effort").alias("satisfaction"))
    layers = {"quality": each, "votes": votes, "types": types, "cells": cells, "sims": sims, "satisfaction": satisfied}
    for name, df in {"requests": req, "items": items, "pages": pages, **layers}.items():
        df.write.parquet(f"{tmp_path}/{name}")
    cli.main(["analyze", *[x for name in ("requests", "items", "pages", *layers) for x in (f"--{name}", f"{tmp_path}/{name}")], "--salient", "--out", f"{tmp_path}/out"], spark)
    out = {name: spark.read.parquet(f"{tmp_path}/out/{name}") for name in ("factor_values", "gates", "overall")}
    rows = out["factor_values"].collect()
    got = {(r.run_id, r["rank"], r.factor_id): r.value for r in rows}
    assert got["r", 1, "TF"] > got["r", 7, "TF"] > 0 and got["r", 0, "TF"] == got["r", 3, "TF"] and got["r", 1, "EXACT_HTML"] == 8
    assert ("r", 5, "TF") not in got and got["r", 2, "CONTENT_EFFORT"] == 20.0 and ("r", 1, "SALIENT_TERM_COVERAGE") in got and got["r", 0, "SATISFACTION"] == 0.0
    assert len(rows) == len({(r.run_id, r["rank"], r.factor_id) for r in rows})
    gates = {r.gate for r in out["gates"].filter("run_id = 'r'").collect()}
    assert gates == {"access", "lexical", "semantic", "intent", "entities", "quality", "engagement"}  # nobody measured authority
    assert {r.run_id for r in out["overall"].collect()} >= {"r"}


def test_rivals_are_no_advice(spark):
    c = spark.createDataFrame([("r", "roar active", 5, False, 1), ("r", "exclusive personal training", 5, False, 2), ("r", "chris wilson fitness studio", 5, False, 3), ("r", "yoga mat", 5, False, 4), ("r", "spa", 2, False, 5)], "run_id string, canon string, consensus int, target_present boolean, place int")
    n, sites = spark.createDataFrame([("r", 6)], "run_id string, n int"), spark.createDataFrame([("r", "roar.com.au"), ("r", "eptcoaching.com"), ("r", "chriswilsonpt.com")], "run_id string, domain string")
    assert [r.canon for r in entities.must_add(c, n, sites).collect()] == ["yoga mat"] and entities.must_add(c, n).count() == 4


def test_entity_table_plan(spark):
    say = [(k, "Foam mat", "product", 0.9) for k in (1, 2, 3)] + [(4, "the foam mat", "product", 0.5), (0, "Pillow", "product", 0.4)] + [(k, "Sleepy", "brand", 0.3) for k in (1, 2, 3)] + [(k, "Beds", "topic", 0.2) for k in (0, 1, 2, 3)] + [(1, "Menu", "nav", 0.1)]
    raw = spark.createDataFrame([("r", k, n, t, x, i) for i, (k, n, t, x) in enumerate(say)], "run_id string, rank int, name string, type string, salience double, ord int")
    told = [(1, "foam mat", "Cost", "$900", False), (2, "foam mat", "pricing", "$950", False), (3, "the foam mat", "price", "$2,000", False), (1, "beds", "founded", "1999", False), (2, "beds", "established", "2001", False), (0, "beds", "founded", "2010", False)]
    triples = spark.createDataFrame([("r", k, e, a, v, g, i) for i, (k, e, a, v, g) in enumerate(told)], "run_id string, rank int, entity string, attribute string, value string, is_edge boolean, ord int")
    surfaces = spark.createDataFrame([("r", k, "t", "Foam mat" if k < 3 else "x", "", "", "A foam mat here. And a pillow." if k else "My pillow.") for k in range(5)], "run_id string, rank int, title string, h1 string, h2 string, h3 string, body string")
    sites = spark.createDataFrame([("r", 0, "mine.com"), ("r", 1, "sleepybeds.com"), ("r", 2, "two.com"), ("r", 3, "three.com"), ("r", 4, "four.com")], "run_id string, rank int, domain string")
    out = layers.entity_table(spark.createDataFrame([("r", "best bed")], "run_id string, keyword string"), raw, triples, surfaces, sites)
    cover = {r.canon: (r.consensus, r.target_present) for r in out["coverage"].collect()}
    assert cover["foam mat"] == (4, False) and "the foam mat" not in cover
    assert {r.canon for r in out["must_add"].collect()} & {"sleepy"} == set() and any("foam mat" == r.canon for r in out["must_add"].collect())
    eav = {(r.canon, r.attribute): r for r in out["eav"].collect()}
    price = next(r for (c, a), r in eav.items() if a == "price")
    assert price.consensus == 3 and price.backing == 2 and price.gap == "missing_entity" and eav["__subject__", "experience"].gap == ""
    factors = {(r["rank"], r.factor_id): r.value for r in out["factors"].collect()}
    assert factors[1, "ENTITIES_H1"] == 1 and factors[0, "EAV_COMPLETENESS"] == 50.0 and factors[0, "DISTINCT_ENTITIES"] == 2
    assert out["cells"].filter("rank = 0 and present").count() == 2


def test_off_page_and_brand_plans(spark):
    pages = spark.createDataFrame([("r", 0, "https://t.com/x", "t.com"), ("r", 1, "https://brightsmile.com/a", "brightsmile.com")], "run_id string, rank int, url string, domain string")
    stats = spark.createDataFrame([("brightsmile.com", 40.0, 12, 90, 3, 1), ("https://brightsmile.com/a", 22.0, 4, 9, 3, 1), ("https://t.com/", 7.0, 1, 1, 0, 0)], "target string, authority_score double, referring_domains int, total_backlinks int, follow int, nofollow int")
    links = spark.createDataFrame([("r", 1, "d", "s.com", "u1", 50.0, True, 0.5), ("r", 1, "d", "s.com", "u2", 60.0, False, 0.5), ("r", 1, "d", "x.top", "u3", 90.0, True, 0.5)], "run_id string, rank int, destination string, source_domain string, source_url string, source_authority double, dofollow boolean, relevance double")
    out = layers.off_page(pages, stats, links)
    got = {(r["rank"], r.factor_id): r.value for r in out["factors"].collect()}
    assert got[1, "AUTHORITY_SCORE"] == 40 and got[1, "PAGE_FOLLOW_RATIO"] == 75 and got[0, "HOMEPAGE_AUTHORITY"] == 7 and (0, "REF_DOMAINS") not in got
    assert [(r.source_url, r.place) for r in out["links"].collect()] == [("u2", 1)]
    words = spark.createDataFrame([("brightsmile.com", "bright smile", 100.0, 1), ("t.com", "teeth", 5.0, 2), ("t.com", "t com", 9.0, 3)], "domain string, phrase string, volume double, ord int")
    b = layers.brand(pages, words)
    assert {(r["rank"], r.value) for r in b["factors"].collect()} >= {(1, 100.0)} and b["leaderboard"].filter("is_target").count() == 1


def test_searches_in_blocks(spark):
    v = spark.createDataFrame([(1, k, [float(k), 1.0]) for k in range(5)], "page int, pos int, embedding array<double>")
    q = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(7)], "query_id int, query array<double>")
    key = lambda df: sorted((r.page, r.pos, r.query_id, round(r.sim, 9)) for r in df.collect())
    assert key(semantic.similarities(v, q, at_once=2)) == key(semantic.similarities(v, q)) and len(key(semantic.similarities(v, q))) == 35
    pages = spark.createDataFrame([("https://a.com/dental-implants",), ("https://a.com/x",)], "url string")
    terms = spark.createDataFrame([("dental implant", "core"), ("bone graft", "adjacent"), ("implant", "core")], "term string, kind string")
    assert sorted((r.url, r.core_terms, r.adjacent_terms) for r in topical.match_terms(pages, terms).collect()) == [("https://a.com/dental-implants", ["dental implant", "implant"], []), ("https://a.com/x", [], [])]
