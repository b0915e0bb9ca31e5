"""Attempts at model calls, analyses from a stream, Markdown, run costs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from serploom.plans import report
from serploom.sources import attempts
from serploom.streaming import runs


def pages_to_ask(spark):
    requests = spark.createDataFrame([("r", "yoga mat"), ("s", "desk")], "run_id string, keyword string")
    bodies = spark.createDataFrame([("r", 1, "mats " * 4000 + "END"), ("r", 2, "two"), ("r", 0, " "), ("s", 1, "desks"), ("s", 2, "none ever"), ("s", 3, None)], "run_id string, rank int, body string")
    return requests, bodies


def test_replies_are_asked_for_until_they_say_something(spark, tmp_path):
    requests, bodies = pages_to_ask(spark)
    prompts = attempts.extraction_prompts(requests, bodies)
    by = {(r.run_id, r["rank"]): r for r in prompts.collect()}
    assert set(by) == {("r", 1), ("r", 2), ("s", 1), ("s", 2)} and len(by["r", 1].prompt.split("Page text:\n")[1]) == 12_000 and "END" not in by["r", 1].prompt
    log = str(tmp_path)

    def chat(prompt, temperature):
        import os
        import uuid

        with open(os.path.join(log, f"{uuid.uuid4().hex}"), "w") as f:
            f.write(f"{temperature}|{prompt[-9:]}")
        if prompt.endswith("two") and temperature < 0.7:
            if temperature == 0:
                raise OSError("no answer")
            return "I can't help with that."
        if prompt.endswith("ever"):
            return "[error] 500"
        return "E;Mat;product;0.5\nT;mat;price;$5\nR;mat;made by;acme"

    entities, triples, tried = attempts.extracted(requests, bodies, chat)
    key = {v.prompt_hash: k for k, v in by.items()}
    got = sorted((key[r.prompt_hash], r.attempt, r.temperature, r.reply) for r in tried.collect())
    assert [(k, a, t) for k, a, t, _ in got] == [(("r", 1), 0, 0.0), *[(("r", 2), k, t) for k, t in enumerate((0.0, 0.35, 0.7))], (("s", 1), 0, 0.0), *[(("s", 2), k, t) for k, t in enumerate((0.0, 0.35, 0.7))]]
    assert len(list(tmp_path.iterdir())) == len(got)  # nothing is asked twice
    assert {(r.run_id, r["rank"], r.name) for r in entities.collect()} == {("r", 1, "Mat"), ("r", 2, "Mat"), ("s", 1, "Mat")} and triples.count() == 6

    # replayed from what was captured: the same, without a call
    again, _, replayed = attempts.extracted(requests, bodies, tried.select("prompt_hash", "temperature", "reply"))
    assert sorted(map(tuple, replayed.collect())) == sorted(map(tuple, tried.collect())) and again.count() == 3 and len(list(tmp_path.iterdir())) == len(got)


def test_names_are_aligned_by_run(spark):
    requests, _ = pages_to_ask(spark)
    rows = [("r", 2, "mat", "Fee!", 1), ("r", 1, "mat", "list price", 5), ("r", 0, "mat", "colour", 1), ("r", 1, "mat", "list_price", 6), ("s", 1, "desk", "height", 1)] + [("t", 1, "x", f"a{k}", k) for k in range(200)]
    triples = spark.createDataFrame(rows, "run_id string, rank int, entity string, attribute string, ord int")
    both = requests.union(spark.createDataFrame([("t", "x")], "run_id string, keyword string"))
    prompts = {r.run_id: r for r in attempts.alignment_prompts(both, triples).collect()}
    assert set(prompts) == {"r", "t"} and prompts["r"].names == ["list_price", "fee", "colour"] and prompts["t"].names == [f"a{k}" for k in range(160)]  # one name needs no aligning
    aliases, tried = attempts.aligned(both, triples, lambda p, t: "fee => list price\nheight => size\ncolour => colour" if "yoga" in p else "[error] 429")
    assert [tuple(r) for r in aliases.select("run_id", "raw", "canonical").collect()] == [("r", "fee", "list_price")] and tried.count() == 2


def test_a_replayed_batch_leaves_one_version(spark, tmp_path):
    schema = "run_id string, rank int, url string, domain string, title string, snippet string, displayed_url string, ts timestamp"
    rows = [("r", k, f"https://d{k}.com/x", f"d{k}.com", "car seat", "", "") for k in range(1, 7)]
    items = spark.createDataFrame([(*r, None) for r in rows], schema).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    requests = spark.createDataFrame([("r", "car seat", "https://d3.com/x"), ("z", "other", None)], "run_id string, keyword string, target_url string")
    pages = spark.createDataFrame([(f"https://d{k}.com/x", "<html><title>t</title><body><p>" + "car seat " * (9 - k) + "</p></body></html>", 5.0, True) for k in range(1, 7)], "url string, html string, load_ms double, ok boolean")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    items.union(items.filter("rank = 1")).write.parquet(source)

    def drain(checkpoint):
        q = runs.analysis_stream(spark.readStream.schema(schema).parquet(source), requests, pages, out).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()

    drain("c1")
    first = sorted(map(tuple, spark.read.parquet(f"{out}/gates").collect()), key=repr)
    assert first and {r.run_id for r in spark.read.parquet(f"{out}/overall").collect()} == {"r"}
    drain("c2")  # a new checkpoint delivers the same batch once more
    assert sorted(map(tuple, spark.read.parquet(f"{out}/gates").collect()), key=repr) == first
    runs.save_batch(items, 7, requests, pages, out)
    assert {r.batch for r in runs.latest(spark, out, "gates").collect()} == {7}


@pytest.mark.parametrize(("text", "want"), [
    ("- a\n  - b\n    1. c\n    2. d\n  - e\n- f", "<ul><li>a<ul><li>b<ol><li>c</li><li>d</li></ol></li><li>e</li></ul></li><li>f</li></ul>"),
    ("- a\n\n- b\n\ntext", "<ul><li>a</li><li>b</li></ul>\n<p>text</p>"),
    ("1. a\n- b\n2) c", "<ol><li>a</li></ol>\n<ul><li>b</li></ul>\n<ol><li>c</li></ol>"),
    ("\t- a\n- b", "<ul><li>a</li></ul>\n<ul><li>b</li></ul>"),
    ("one\ntwo\n\nthree", "<p>one<br>two</p>\n<p>three</p>"),
    ("text\n- a\n# H\nmore", "<p>text</p>\n<ul><li>a</li></ul>\n<h1>H</h1>\n<p>more</p>"),
    (r"r $\Rightarrow$ \leq \less 5\% and $5 or $6, $\text{if } x_{1} \mathbf{is} \unknown{y}$", "<p>r ⇒ ≤ \\less 5% and $5 or $6, if x_1 is y</p>"),
    (r"\[ a \times \mathrm{b \to c} \] \( \sqrt{2} \)", "<p>a × b → c √2</p>"),
    (None, ""), (" \n ", ""),
])
def test_markdown(text, want):
    assert report.markdown_to_html(text) == want


def test_costs_of_runs(spark):
    from serploom.plans import costs

    requests = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    searches = spark.createDataFrame([("a", 0.003), ("a", None), ("b", 0.01)], "run_id string, cost double")
    calls = spark.createDataFrame([("a",)] * 7 + [("c",)], "run_id string")
    pages = spark.createDataFrame([("a", "http"), ("a", "proxy"), ("b", "browser"), ("b", "browser")], "run_id string, via string")
    got = {r.run_id: tuple(r)[1:] for r in costs.run_costs(requests, searches, spark.createDataFrame([("b", 0.02)], "run_id string, cost double"), calls, pages).collect()}
    assert got == {"a": (0.005, 0.0, 0.0084, 0.0001, 0.0135), "b": (0.01, 0.02, 0.0, 0.0002, 0.0302), "c": (0.0, 0.0, 0.0012, 0.0, 0.0012)}
    assert {tuple(r)[1:] for r in costs.run_costs(requests).collect()} == {(0.0, 0.0, 0.0, 0.0, 0.0)}


def test_stages_tell_what_they_did(spark):
    from serploom.plans import costs

    stages = costs.Stages()
    a = stages.written(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "run_id string, x int"), "one")
    stages.written(a.filter("x > 2").select("x"), "two")
    got = [(r.stage, r.rows, r.runs) for r in stages.table(spark).orderBy("ord").collect()]
    assert got == [("one", 3, 2), ("two", 1, None)] and a.count() == 3
