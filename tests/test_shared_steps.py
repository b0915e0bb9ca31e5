"""What several factors or plans have in common is made once, and what nobody asks for isn't made."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from serploom.operators import factors, semantic
from serploom.plans import analyze as plans


def _tables(spark):
    requests = spark.createDataFrame([(1, "foam mat", "https://t.com/")], "run_id int, keyword string, target_url string")
    items = spark.createDataFrame([(1, k, f"https://a{k}.com/", f"a{k}.com", "Foam mat", "", "") for k in (1, 2, 3)], "run_id int, rank int, url string, domain string, title string, snippet string, displayed_url string")
    html = "<html><body><p>A foam mat is soft. The mat is made of foam.</p></body></html>"
    pages = spark.createDataFrame([(u, html, 5.0, True) for u in ["https://t.com/", *(f"https://a{k}.com/" for k in (1, 2, 3))]], "url string, html string, load_ms double, ok boolean")
    return requests, items, pages


def test_syllables_of_a_text_are_those_of_its_words(spark):
    text = "The queue's bee, e E. rhythm 'tis 42 made-up are ée naïve café eye ee aye we're sky x"
    words = re.findall(r"[a-z0-9']+", text.lower())
    want = sum(max(1, len(re.findall("[aeiouy]+", re.sub("e$", "", w)))) for w in words)
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(factors.syllables("t").alias("n")).collect()
    assert [r.n for r in got] == [want, 0, None]


def test_factor_values_with_layers_judge_nothing(spark, monkeypatch):
    tables = _tables(spark)
    whole = plans.analyze(*tables, salient=True)["factor_values"]

    def judged(*_, **__):
        raise AssertionError("judged")

    monkeypatch.setattr(plans.funnel, "all_gates", judged)
    values = plans.factor_values(*tables, salient=True)
    assert sorted(map(tuple, values.collect())) == sorted(map(tuple, whole.select(*values.columns).collect()))
    assert "SALIENT_TERM_COVERAGE" in {r.factor_id for r in values.select("factor_id").distinct().collect()}


def test_measured_values_are_made_once(spark):
    stages = plans.analyze(*_tables(spark), salient=True)["stages"]
    assert "measured" in {v for r in stages.collect() for v in r if isinstance(v, str)}


def test_features_are_shuffled_once_each(spark):
    texts = spark.createDataFrame([("r", -1, 0, "foam mat"), ("r", 1, 0, "foam mat foam mat foam mat soft"), ("r", 2, 0, ""), ("q", 1, 0, "mat")], "run_id string, rank int, pos int, text string")
    out = semantic._weighted(texts)
    rows = {(r.run_id, r.rank): (sorted((w.feature, round(w.x, 9)) for w in r.feats), round(r.len, 9)) for r in out.collect()}
    ln = lambda x: float(spark.range(1).select(F.ln(F.lit(float(x)))).first()[0])
    both, alone = ln(4 / 3) + 1, ln(4 / 2) + 1
    x = {"foam": (1 + ln(3)) * both, "mat": (1 + ln(3)) * both, "foam mat": (1 + ln(3)) * both, "mat foam": (1 + ln(2)) * alone, "soft": alone, "mat soft": alone}
    assert rows["r", 1] == ([(k, round(x[k], 9)) for k in ("foam", "foam mat", "mat")], round(sum(v * v for v in x.values()) ** 0.5, 9))
    assert rows["r", 2] == ([], 0.0) and rows["q", 1][0] == []
    # no row of an occurrence: 7 words of one text are 6 features
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "count(1) windowspecdefinition(run_id" in plan
