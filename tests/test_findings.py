"""What a review at larger sizes found: sums, ties and bounds that small tables don't show."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from serploom import queries
from serploom.operators import funnel, topical


def _tables(tmp_path, **tables):
    for name, parts in tables.items():
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_equal_means_are_equal(spark):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in the last bit; their means mustn't."""
    rows = [(k, v) for k in (1, 2) for v in ([0.1, 0.2, 0.3] if k == 1 else [0.3, 0.2, 0.1])] + [(3, 1 / 3), (3, 1 / 3), (4, float("nan")), (5, None)]
    got = dict(spark.createDataFrame(rows, "k int, v double").coalesce(1).groupBy("k").agg(queries.exact_avg("v")).collect())
    assert got[1] == got[2] == 0.6 / 3 and got[3] == 1 / 3 and got[4] != got[4] and got[5] is None


def test_moves_add_in_the_order_of_events(spark, tmp_path):
    """The first user's values lie in two files, so partial sums differ in the last bit from the second user's."""
    at = F.lit("2024-01-02").cast("timestamp")
    rows = [(k, u, v) for u in (1, 2) for k, v in zip(range(3 * u, 3 * u + 3), (0.1, 0.2, 0.3), strict=True)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, value double").withColumns({"ts": at, "event_type": F.lit("view"), "props": F.lit("{}")})
    cut = F.col("event_id") == 3
    d = _tables(tmp_path, events=[e.filter(cut), e.filter(~cut)])
    assert {r.domain: r.before_rank for r in queries.rank_moves(spark, d).collect()} == {"u1.example.com": 1, "u2.example.com": 2}


@pytest.mark.parametrize("seed", range(3))
def test_equal_urls_have_one_order(spark, seed):
    rows = spark.createDataFrame([(k, 0, "https://a.com/x") for k in range(40)], "page_id long, run_id int, url string").orderBy(F.rand(seed)).coalesce(1)
    assert all(r.neutral_id == r.page_id + 1 for r in funnel.panel_order(rows, ["run_id"], F.lit("k"), ties=["page_id"]).collect())
    found = rows.withColumns({"domain": F.lit("a.com"), "core_terms": F.array(F.lit("t")), "adjacent_terms": F.array().cast("array<string>"), "in_serp": F.lit(True)})
    assert all(r.place == r.page_id + 1 for r in topical.cluster_order(found, ties=["page_id"]).collect())


def test_built_pages_are_dealt_out(spark, tmp_path):
    """One small file of parts is many pages' work."""
    from serploom import queries_pages

    parts = spark.range(6_000).select(F.col("id").alias("p_partkey"), F.lit("x").alias("p_name"), F.lit("y").alias("p_type"), F.lit(1).alias("p_size"))
    assert queries_pages.built_pages(spark, _tables(tmp_path, part=[parts])).rdd.getNumPartitions() == 3


def test_similarities_of_many_queries_and_pages(spark):
    """More queries than a tile meets at a time, and more pages than leave it at a time."""
    import numpy as np

    from serploom.operators import semantic

    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(400, 8)), rng.normal(size=(2 * semantic.MET + 5, 8))
    page = [k % 150 for k in range(400)]
    rows = spark.createDataFrame([(page[k], k, v[k].tolist()) for k in range(400)], "page int, pos int, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(k, q[k].tolist()) for k in range(len(q))], "query_id int, query array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.clip(unit(v) @ unit(q).T, 0, 1)
    got = semantic.page_similarities(rows, asked).collect()
    assert len(got) == 150 * len(q)
    for r in got[:: 97]:
        of = [k for k in range(400) if page[k] == r.page]
        want = sims[of, r.query_id]
        assert abs(r.m - want.max()) < 1e-9 and abs(r.s - want.sum()) < 1e-9 and r.n == len(of) and r.best_pos == of[int(want.argmax())]


def test_classes_of_words_a_slice_at_a_time():
    """Slices of a batch choose what the whole batch chooses."""
    import numpy as np
    import pyarrow as pa

    from serploom.llm import brown

    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 10, 1 + k % 5).tolist() for k in range(2 * brown.WORDS + 7)]
    cells, ns, fit = pa.array(lists, pa.list_(pa.int32())), pa.array([[1] * len(x) for x in lists], pa.list_(pa.int64())), rng.normal(size=(10, 4))
    parts = [brown._best(cells.slice(k, brown.WORDS), ns.slice(k, brown.WORDS), fit) for k in range(0, len(lists), brown.WORDS)]
    assert len(parts) == 3 and np.concatenate(parts).tolist() == brown._best(cells, ns, fit).tolist()


def test_neighbours_of_far_words_a_slice_at_a_time():
    """A batch is worked on by slices, whatever its rows, and the counts add up to those of single texts."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from serploom.llm import brown

    rng = np.random.default_rng(2)
    rows = 2 * brown.SLICE + 3
    ids = [rng.integers(-2, 3, 6).tolist() for _ in range(rows)]
    far = [[b"x%d" % (k % 7), b"y%d" % (k % 5)] for k in range(rows)]
    batch = pa.record_batch([pa.array(ids, pa.list_(pa.int32())), pa.array([[0, 1]] * rows, pa.list_(pa.int8())), pa.array(far, pa.list_(pa.binary()))], ["ids", "shapes", "far"])
    made = lambda batches: list(brown.neighbours(iter(batches), np.array([1, 1, 2]), np.array([1, 2]), 3))

    def summed(parts):
        out = Counter()
        for r in pa.Table.from_batches(parts).to_pylist():
            out[r["token"], r["next"], r["cell"]] += r["n"]
        return out

    whole = made([batch])
    assert len(whole) == 2 * 3 + 1 and summed(whole) == summed(made([batch.slice(k, 1) for k in range(rows)]))


def test_pages_of_a_large_run_stay_where_they_are(spark):
    """Pages aren't dealt out by run, nor their features: neither the corpus factors nor the salient terms shuffle a body or a feature."""
    from serploom.operators import corpus, panels

    bodies = spark.range(400).select(F.lit("r").alias("run_id"), F.col("id").cast("int").alias("rank"), F.concat(F.lit("some words of body "), "id").alias("body"), F.lit("a b").alias("phrase"), F.array(F.lit("a b")).alias("vars"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [f(bodies)._jdf.queryExecution().executedPlan().toString() for f in (corpus.run_factors, panels.salient_coverage)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plans[0] and "hashpartitioning" not in plans[0]
    assert "SortMergeJoin" not in plans[1] and "feature#" not in plans[1]


def test_features_of_repeated_keys(spark):
    """A key in several rows has the features of all of them; one in a single row is counted without a shuffle."""
    from serploom.operators import corpus

    rows = [(1, "red bike red bike"), (2, "blue bike"), (2, "bike blue bike"), (None, "green"), (None, "green hat"), (3, ""), (4, None), (5, "the of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (docs, docs.filter("doc_id = 1")):
        want = {(r.doc_id, r.feature): r.f for r in corpus.features(df, ["doc_id"]).collect()}
        got = [(r.doc_id, x.feature, x.f) for r in corpus.features_by_key(df, ["doc_id"]).collect() for x in r.feats]
        assert {(k, w): f for k, w, f in got} == want and len(got) == len(want)
    assert "Exchange" not in corpus.features_by_key(docs.filter("doc_id = 1"), ["doc_id"])._jdf.queryExecution().executedPlan().toString()


def test_single_words_are_found_by_the_words_of_a_page(spark):
    """Rows of one page count each, forms of one entity once; longer forms beside them change nothing about single words."""
    from serploom.operators import entities

    bodies = spark.createDataFrame([("r", 1, "A Bike, bikes and b\u00e4r"), ("r", 1, "bike"), ("r", 2, "motorbike bike_x"), ("s", 3, "bike")], "run_id string, rank int, body string")
    one = [("r", "x", "bike"), ("r", "x", "BIKES"), ("r", "y", "b\u00e4r"), ("r", "z", "xy")]
    for forms, more in ((one, []), (one + [("r", "w", "bikes and")], [("r", 1, "w")])):
        got = entities.said_in(spark.createDataFrame(forms, "run_id string, canon string, form string"), bodies)
        assert sorted(map(tuple, got.collect())) == sorted([("r", 1, "x"), ("r", 1, "x"), ("r", 1, "y"), *more])
    plan = entities.said_in(spark.createDataFrame(one, "run_id string, canon string, form string"), bodies)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_count" not in plan


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_vectors_against_items(spark, most):
    """However few features count as frequent, vectors are those of the plain way, and none but the items' features are handed on."""
    from serploom.operators import corpus

    words = "red blue bike hat green tree house road lamp wheel".split()
    rows = [(f"d{k}", " ".join(words[(k * j) % 10 if j % 3 else k % 7] for j in range(1, 3 + k % 9))) for k in range(60)] + [("b1", "red bike hat"), ("b2", "lamp road")]
    docs = spark.createDataFrame(rows, "k string, text string")
    want = {(r.k, r.feature): r.w for r in corpus.tfidf_vectors(corpus.features(docs, ["k"]), ["k"]).collect()}
    left, right = corpus.tfidf_against(corpus.features_by_key(docs, ["k"]), "k", F.col("k").like("b%"), most)
    asked = {w for k, w in want if k[0] == "b"}
    got = {(r.k, r.feature): r.w for r in left.union(right).collect()}
    assert got.keys() == {(k, w) for k, w in want if w in asked} and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_a_text_is_lowered_once_for_all_variations(spark):
    from serploom.functions import text as T

    df = spark.createDataFrame([("A bike, a BIKE", ["bike", "a bike", "car"]), (None, ["bike"]), ("x", []), ("bike", None)], "body string, vars array<string>")
    got = df.repartition(1).select(T.vcount("body", "vars").alias("n"), T.unique_used("body", "vars").alias("u"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 2
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.selectExpr("case when body like 'A%' then 4 when vars is not null then 0 end", "case when body like 'A%' then 2 when vars is not null then 0 end").collect()), key=str)


def test_entity_table_plan_makes_what_it_returns_and_cleans_mentions_once(spark, monkeypatch):
    from serploom.plans import layers
    from serploom.queries_plans import entity_table_plan

    names = []
    monkeypatch.setattr(layers, "written", lambda df, name: names.append(name) or df)
    entity_table_plan(spark, "/root/testdata/sf0.001")
    assert names.count("mentions") == 1 and "cells" not in names


def test_keys_of_fingerprints_are_never_broadcast(spark, tmp_path):
    """A fingerprint has twenty keys, but Spark sizes the exploded table as the file of fingerprints: F1."""
    from serploom.llm import simhash

    spark.range(2_000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/nodes")
    plan = simhash.links(spark.read.parquet(f"{tmp_path}/nodes"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == plan.count("Scan ExistingRDD") == 2  # the fixed table of changed bits, read twice


def test_means_are_added_in_the_order_of_rows(spark, tmp_path):
    """Discounts of 0.1, 0.2, 0.3 in different orders: the SQL's means differ in the last bit, and so do its percentiles. F4, F5, F6, F9."""
    import duckdb

    orders = [(0.1, 0.2, 0.3), (0.3, 0.2, 0.1), (0.2, 0.3, 0.1), (0.1, 0.3, 0.2), (0.3, 0.1, 0.2)]
    lines = [(s, x, float(s)) for k in range(3) for s, o in enumerate(orders) for x in (o[k],)]
    suppliers = spark.createDataFrame([(s, 0, float(s)) for s in range(len(orders))], "s_suppkey long, s_nationkey int, s_acctbal double")
    d = _tables(tmp_path, supplier=[suppliers], lineitem=[spark.createDataFrame(lines, "l_suppkey long, l_discount double, l_quantity double").coalesce(1)])
    con = duckdb.connect()
    con.sql("set threads = 1")
    for t in ("supplier", "lineitem"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    for name in ("percentile_midrank", "gate_scores"):
        want = con.sql(queries.ORACLE_SQL[name])
        assert sorted(want.fetchall()) == sorted(tuple(r) for r in queries.QUERIES[name](spark, d).select(*want.columns).collect())
    assert len({r.percentile for r in queries.percentile_midrank(spark, d).filter("factor_id = 'CRUX_LCP_MS'").collect()}) > 1


def test_layers_without_the_pages_own_factors(spark, monkeypatch):
    """Rows of a layer are those among all factor values, and no factor of a page is made for them: F2."""
    from serploom.plans import analyze as plans

    requests = spark.createDataFrame([(1, "foam mat", "https://t.com/")], "run_id int, keyword string, target_url string")
    items = spark.createDataFrame([(1, k, f"https://a{k}.com/", f"a{k}.com", "Foam mat", "", "") for k in (1, 2)], "run_id int, rank int, url string, domain string, title string, snippet string, displayed_url string")
    html = "<html><body><p>A foam mat is soft. The mat is made of foam.</p></body></html>"
    pages = spark.createDataFrame([(u, html, 5.0, True) for u in ("https://t.com/", "https://a1.com/", "https://a2.com/")], "url string, html string, load_ms double, ok boolean")
    named = F.col("factor_id").isin("BEST_PASSAGE_SIM", "CONTENT_FOCUS", "SUBINTENT_COVERAGE")
    columns = ["run_id", "rank", "factor_id", "value"]
    want = plans.factor_values(requests, items, pages, meaning=True).filter(named).select(columns).collect()

    def measured(*_, **__):
        raise AssertionError("measured")

    monkeypatch.setattr(plans, "_factors", measured)
    got = plans.layer_values(requests, items, pages, meaning=True).filter(named).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 9


def test_weights_of_features_are_made_once(spark, monkeypatch):
    """Pages and queries read one table of weights, and captured vectors are a table: F11."""
    from serploom import queries_plans
    from serploom.operators import semantic

    names = []
    monkeypatch.setattr(semantic, "written", lambda df, name, f=semantic.written: names.append(name) or f(df, name))
    queries_plans.intents_of_runs(spark, "/root/testdata/sf0.001")
    assert names.count("weighted") == 1
    _, vectors = queries_plans._captured_meaning(spark, "/root/testdata/sf0.001", queries_plans._document_pages(spark, "/root/testdata/sf0.001")[0])
    assert "posexplode" not in vectors._jdf.queryExecution().optimizedPlan().toString()


def test_white_space_goes_without_a_pattern(spark):
    """Both ends lose what a pattern of white space takes off them, and nothing else: F11."""
    from serploom.functions import text as T

    texts = ["", " ", " a b ", "\t\n\x0b\f\r x\r\n", "x", "\u00a0 x \u00a0", "\u00e4 \n \u00df\n", "\n\n", "a\n b", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip("t").alias("s"), F.regexp_replace("t", r"^\s+|\s+$", "").alias("want"))
    assert all(r.s == r.want for r in got.collect())
    assert "regexp" not in got.select("s")._jdf.queryExecution().optimizedPlan().toString()
