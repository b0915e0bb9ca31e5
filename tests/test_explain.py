"""What a run says in words: panels, gate reports, cards, topics, briefs, prompts, pages."""

from __future__ import annotations

import json

from serploom import cli
from serploom.operators import explain, funnel, registry, topical
from serploom.plans import analyze, report, topics


def test_display_names():
    assert registry.BY_ID["TITLE_VARS"].name == "Variations in Title Tag" and len({f.name for f in registry.REGISTRY}) == len(registry.REGISTRY)
    assert registry.Factor("MY_FACTOR", "own", "Content", "Content", "Count", False, False, "Easy", "more_is_better", 999).name == "My factor"


def test_intent_panel(spark):
    rows = [(run, k, t) for run in "abcd" for k, t in ((1, "guide"), (2, "guide"), (3, "tool"))] + [("a", 0, "guide"), ("b", 0, "tool"), ("e", 0, "guide"), ("a", 4, None)]
    types, at = spark.createDataFrame(rows, "run_id string, rank int, page_type string"), spark.createDataFrame([("c", 3)], "run_id string, target_rank int")
    got = {r.run_id: r for r in explain.intent_panel(types, at).collect()}
    assert {k: (r.fit, r.target_type, r.n, r.of) for k, r in got.items()} == {"a": ("match", "guide", 2, 3), "b": ("mismatch", "tool", 2, 3), "c": ("mismatch", "tool", 2, 3), "d": ("partial", None, 2, 3)}
    assert got["d"].note == "2 of 3 typed results are of type guide; yours has no type: the fit is partial."
    none = spark.createDataFrame([], "run_id string, rank int, factor_id string, value double")
    gates = funnel.all_gates(none, registry.factor_def(spark), types=types, fits=explain.intent_panel(types, at)).filter("gate = 'intent' and rank = 0")
    assert {r.run_id: r.score for r in gates.collect()} == {"a": 90.0, "b": 15.0, "c": 15.0, "d": 55.0}
    assert explain.intent_panel(types.limit(0)).collect() == []


def test_gate_report_and_cards(spark):
    scores = [("r", k, "lexical", float(10 * k)) for k in range(4)] + [("r", k, "authority", 50.0 if k < 2 else 90.0) for k in range(4)] + [("r", 4, "lexical", -5.0)]
    gates = spark.createDataFrame(scores, "run_id string, rank int, gate string, score double")
    values = spark.createDataFrame([("r", 0, "TITLE_VARS", 2.0), ("r", 0, "BODY_VARS", 7.25), ("r", 0, "SALIENT_TERM_COVERAGE", None), ("q", 1, "CRUX_CLS", 1.0)], "run_id string, rank int, factor_id string, value double")
    rep = explain.gate_report(gates, funnel.funnel(gates), values, registry.factor_def(spark))
    got = {(r.run_id, r.gate): r for r in rep.collect()}
    assert len(got) == 16 and got["r", "lexical"].details == ["Variations in Title Tag: 2.0", f"{registry.BY_ID['BODY_VARS'].name}: 7.3"] and got["r", "lexical"].verdict == "fail"
    assert got["q", "access"].tier == "measured" and got["r", "access"].tier == "computed" and got["r", "quality"].tier == "estimated"
    assert (got["q", "lexical"].verdict, got["q", "lexical"].weight, got["q", "lexical"].details) == ("n/a", 0.5, [])
    pages = spark.createDataFrame([("r", k, f"u{k}", f"d{k}") for k in range(1, 8)], "run_id string, rank int, url string, domain string")
    place = spark.createDataFrame([("r", 4)], "run_id string, target_rank int")
    c = [(r["rank"], r.place, r.gate) for r in explain.cards(gates, pages, rep, place).orderBy("rank", "place").collect()]
    assert c == [(1, 1, "lexical"), (2, 1, "authority"), (2, 2, "lexical"), (3, 1, "authority"), (3, 2, "lexical")]
    every = explain.cards(gates, pages, rep).orderBy("rank", "place").collect()
    assert [r["rank"] for r in every if r.gate is None] == [4, 5] and max(r["rank"] for r in every) == 5 and every[0].reason == "Lexical Topicality: 10 against your 0, 10 points ahead."
    text = explain.summary(funnel.overall(funnel.funnel(gates))).first().summary
    assert text == "What holds your page back first is Lexical Topicality."


TOPICS = [("a", "https://www.A.com/x", "dental implants", "https://a.com/Dental-Implants?x=1"), ("b", "b.com", None, "https://b.com/red-shoes/42"), ("c", "c.com", " ", None), ("d", "d.com", "bikes", None)]


def test_terms_of_topics(spark):
    requests = spark.createDataFrame(TOPICS, "run_id string, domain string, topic string, target_url string")
    said = {"core": "Dental Implants", "variations": ["tooth implant", " ", "teeth"], "adjacent": ["bone graft"]}
    replies = spark.createDataFrame([("a", "Sure! ```json\n" + json.dumps(said) + "\n```"), ("d", "[AI unavailable: no key]")], "run_id string, reply string")
    got = {r.run_id: r for r in topics.run_terms(requests, replies).collect()}
    assert got["a"].variations == ["Dental Implants", "tooth implant", "teeth"] and got["a"].adjacent == ["bone graft"] and got["a"].query == 'site:a.com "Dental Implants" | "tooth implant" | "teeth"'
    assert got["b"].topic == "red shoes" and got["b"].variations == ["red shoes", "shoes"] and got["c"].topic == "c" and got["d"].variations == ["bikes"]
    assert {r.run_id for r in topics.topic_prompts(requests).collect()} == set("abcd")
    assert topics.run_terms(requests).filter("run_id = 'a'").first().variations == ["dental implants", "implants"]


def test_topic_verdicts(spark):
    rows = [("a", "a.com", "dental implants", "https://a.com/Dental-Implants?x=1"), ("e", "e.com", "dental implants", "https://e.com/x"), ("f", "f.com", "dental implants", None)]
    terms = topics.run_terms(spark.createDataFrame(rows, "run_id string, domain string, topic string, target_url string"), spark.createDataFrame([("a", '{"core": "dental implants", "variations": ["implants"], "adjacent": ["bone graft", "veneers"]}')], "run_id string, reply string"))
    inventory = [("a.com", u) for u in ("https://a.com/dental-implants/", "https://www.a.com/implants-cost", "https://a.com/bone-graft", "https://a.com/implants-and-bone-graft", "https://a.com/about")] + [("e.com", "https://e.com/dental")]
    found = [("a", 1, "http://a.com/", "Home"), ("a", 2, "https://a.com/dental-implants", "Implants"), ("a", 3, "https://a.com/new", "Our implants"), ("a", 4, "https://a.com/bone-graft", "Graft for implants")]
    out = topics.topics(terms, spark.createDataFrame(inventory, "domain string, url string"), spark.createDataFrame(found, "run_id string, pos int, url string, title string"))
    pages = [(r.key, r.slug_match, r.serp_hit, r.is_adjacent, r.matched_terms) for r in out["pages"].filter("run_id = 'a'").orderBy("place").collect()]
    assert pages == [
        ("a.com/dental-implants", True, True, False, ["dental implants", "implants"]), ("a.com/bone-graft", False, True, True, ["bone graft", "implants"]), ("a.com/new", False, True, False, ["implants"]),
        ("a.com/implants-and-bone-graft", True, False, False, ["implants"]), ("a.com/implants-cost", True, False, False, ["implants"]),
    ]
    s = {r.run_id: r for r in out["summary"].collect()}
    assert (s["a"].cluster_size, s["a"].sitemap_total, s["a"].serp_hits, s["a"].adjacent_covered, s["a"].n_adjacent) == (5, 5, 3, 0, 2) and s["a"].target_in_cluster and s["a"].target_is_canonical and s["a"].supports_target
    assert s["a"].score == 63.1 and s["a"].band == "moderate" and s["e"].band == "thin" and not s["e"].supports_target and s["f"].band == "unknown" and s["f"].score == 0
    prompt = {r.run_id: r.prompt for r in out["prompts"].collect()}
    assert "- https://a.com/dental-implants/" in prompt["a"] and prompt["f"].endswith("- none")


def test_brief_texts(spark):
    items = [("r", "facts_to_state", 1, "State price of mat", "3 of 5 top pages state it"), ("r", "entities_to_add", 1, "Cover foam", "4 of 5 top pages cover it"), ("q", "style_targets", 1, "Words: aim for 900", "Content, Easy")]
    got = topical.brief_texts(spark.createDataFrame(items, "run_id string, section string, ord int, text string, evidence string"), spark.createDataFrame([("r", "foam mat", "https://a.com"), ("q", "bed", None), ("n", "none", None)], "run_id string, keyword string, target_url string"))
    by = {r.run_id: r for r in got.collect()}
    assert set(by) == {"r", "q"} and by["r"].summary == '2 recommendations for https://a.com on "foam mat".' and by["q"].summary == '1 recommendation for a new page on "bed".'
    assert by["r"].prompt.index("Cover foam") < by["r"].prompt.index("State price") < by["r"].prompt.index("Rules:") and "<paste it here>" in by["r"].prompt and "<paste it here>" not in by["q"].prompt
    assert by["r"].markdown.startswith("# Writing brief: foam mat\n\n2 recommendations")


def test_briefs_count_the_pages_of_their_run(spark):
    cov = spark.createDataFrame([(run, "a", "A", 2, False, 1) for run in "rs"], "run_id string, canon string, name string, consensus int, target_present boolean, place int")
    eav = spark.createDataFrame([], "run_id string, canon string, attribute string, is_edge boolean, consensus int, consensus_value string, target_value string, graded boolean, gap string")
    actions = spark.createDataFrame([(run, "Entity", "Entities", "Entities in title", 3.0, "Easy", 1) for run in "rs"], "run_id string, group string, phase string, name string, goal double, difficulty string, place int")
    n, unread = spark.createDataFrame([("r", 4), ("s", 9)], "run_id string, n int"), spark.createDataFrame([("s",)], "run_id string")
    got = topical.brief(cov, eav, actions, None, cov.withColumnRenamed("place", "add_place").limit(0), n, unread).collect()
    assert sorted((r.run_id, r.section, r.evidence) for r in got) == [("r", "style_targets", "Entities, Easy"), ("r", "topics_to_expand", "2 of 4 top pages mention it"), ("s", "topics_to_expand", "2 of 9 top pages mention it")]


def test_compare_prompts(spark, tmp_path):
    cols = "run_id string, rank int, url string, domain string"
    before = spark.createDataFrame([("r", 1, "u", "a.com"), ("r", 2, "u", "b.com"), ("r", 3, "u", "c.com")], cols)
    after = spark.createDataFrame([("r", 1, "u", "b.com"), ("r", 2, "u", "a.com"), ("r", 3, "u", "d.com")], cols)
    authority = spark.createDataFrame([("b.com", 55.4, -12.0)], "domain string, authority_score double, traffic_trend_pct double")
    out = analyze.compare(before, after, authority)
    requests = spark.createDataFrame([("r", "foam mat", None, "2024-01-01", None)], "run_id string, keyword string, update_name string, before_date string, after_date string")
    text = report.compare_prompts(requests, out["moves"], out["churn"]).first().prompt
    assert "First place: from a.com to b.com" in text and "- b.com from 2 to 1, authority 55, traffic -12 percent" in text and "- d.com new at 3" in text and "- c.com gone from 3" in text and "Between: 2024-01-01 and ?" in text
    assert text.index("Rose:") < text.index("- d.com") < text.index("- b.com") < text.index("Fell:")


def test_pages_and_verbs(spark, tmp_path):
    rows = {
        "overall": ([("r", 41.239, "Weak <here>")], "run_id string, overall double, summary string"),
        "gate_report": ([("r", "lexical", 2, "Lexical Topicality", 10.0, "fail", ["a: 1.0", "b: 2.0"])], "run_id string, gate string, ord int, name string, score double, verdict string, details array<string>"),
        "brief_texts": ([("r", "# Brief\n- one")], "run_id string, markdown string"),
        "requests": ([("r", "a.com", "red shoes", None)], "run_id string, domain string, topic string, target_url string"),
        "robots": ([("a.com", "Sitemap: https://a.com/s.xml")], "domain string, body string"),
        "documents": ([("https://a.com/s.xml", "<?xml version='1.0'?><urlset><url><loc>https://a.com/red-shoes</loc></url></urlset>")], "url string, body string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}")
    cli.main(["report", "--results", str(tmp_path), "--run", "r", "--out", f"{tmp_path}/page.html"], spark)
    page = (tmp_path / "page.html").read_text()
    assert "Weak &lt;here&gt;" in page and "<td>41.24</td>" in page and "a: 1.0; b: 2.0" in page and "<h1>Brief</h1>" in page and "Actions" not in page
    cli.main(["topic", *[x for n in ("requests", "robots", "documents") for x in (f"--{n}", f"{tmp_path}/{n}")], "--out", f"{tmp_path}/topic"], spark)
    assert [r.cluster_size for r in spark.read.parquet(f"{tmp_path}/topic/summary").collect()] == [1]
