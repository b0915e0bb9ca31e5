"""The three flows as plans over captured tables: analyze, compare, topical. Many runs at once, keyed by run_id."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serploom.functions import text as T
from serploom.operators import compare as C
from serploom.operators import correlate as K
from serploom.operators import corpus, explain, factors, funnel, page, panels, registry, roadmap, topical
from serploom.plans import layers
from serploom.plans.costs import Stages


def factor_values(requests: DataFrame, items: DataFrame, pages: DataFrame, **layers: DataFrame | bool | None) -> DataFrame:
    """run_id, rank, url, domain, factor_id, value. The target's page has rank 0.

    requests: run_id, keyword, target_url. items: run_id, rank, url, domain, title, snippet, displayed_url. pages: url, html, load_ms, ok. layers: the optional ones of ``analyze``, whose factor_values these are; nothing is judged.
    """
    if not any(v is not None and v is not False for v in layers.values()):
        return _factors(*_wanted(requests, items, pages), items, requests)
    return _measured(requests, items, pages, **layers)[0]


def layer_values(requests: DataFrame, items: DataFrame, pages: DataFrame, **layers: DataFrame | bool | None) -> DataFrame:
    """run_id, rank, factor_id, value: what the optional layers give, as in ``factor_values``, without the factors measured on the pages themselves. It isn't written, so only what is asked of it is made."""
    return _measured(requests, items, pages, own=False, **layers)[0]


def _keyed(requests: DataFrame) -> DataFrame:
    return requests.select("run_id", T.phrase_of("keyword").alias("phrase"), T.variations("keyword").alias("vars"), "target_url")


def _wanted(requests: DataFrame, items: DataFrame, pages: DataFrame, stages: Stages | None = None) -> tuple[DataFrame, DataFrame]:
    """The pages that each run asks for, and the parsed pages; those are written, so that everything behind them reads one parse."""
    keyed = _keyed(requests)
    listed = items.join(keyed.drop("target_url"), "run_id")
    target = keyed.filter("target_url is not null").select("run_id", F.lit(0).alias("rank"), F.col("target_url").alias("url"), T.host_of("target_url").alias("domain"), "phrase", "vars")
    wanted = listed.select("run_id", "rank", "url", "domain", "phrase", "vars").unionByName(target)
    fetched = page.surfaces(pages.filter("ok").select("url", "html", "load_ms").dropDuplicates(["url"]))  # each page is parsed once, whichever runs show it
    return wanted, (stages or Stages()).written(fetched, "surfaces")


def _factors(wanted: DataFrame, fetched: DataFrame, items: DataFrame, requests: DataFrame) -> DataFrame:
    keys = ["run_id", "rank", "url", "domain"]
    serp = factors.serp_factors(items.join(_keyed(requests).drop("target_url"), "run_id"), keys)
    shown = wanted.join(fetched, "url")
    of_corpus = corpus.run_factors(shown.select("run_id", "rank", F.col("p.body").alias("body"), "phrase", "vars"))
    named = panels.long_rows(of_corpus, ["TF", "TFIDF", "LSI_SENTENCES", "UNIQUE_LSI"]).join(wanted.select(*keys), ["run_id", "rank"]).select(*keys, "factor_id", "value")
    return serp.unionByName(factors.page_factors(shown, keys)).unionByName(named)


def _measured(
    requests: DataFrame, items: DataFrame, pages: DataFrame, more: DataFrame | None = None, sims: DataFrame | None = None, quality: DataFrame | None = None, votes: DataFrame | None = None, satisfaction: DataFrame | None = None,
    salient: bool = False, meaning: bool = False, intents: DataFrame | None = None, embeddings: DataFrame | None = None, entities: DataFrame | None = None, triples: DataFrame | None = None, aliases: DataFrame | None = None,
    stats: DataFrame | None = None, links: DataFrame | None = None, keywords: DataFrame | None = None, crux: DataFrame | None = None, stages: Stages | None = None, own: bool = True,
) -> tuple[DataFrame, dict[str, DataFrame], dict[str, DataFrame]]:
    """What ``analyze`` measures before it judges anything: factor_values, written (without ``own`` the rows of the layers alone, not written); the layers' tables by name; the entity table, if there is one."""
    spark = requests.sparkSession
    stages = stages or Stages()
    wanted, fetched = _wanted(requests, items, pages, stages)
    values = _factors(wanted, fetched, items, requests) if own else None
    values = values.unionByName(more) if own and more is not None else values
    extra = [panels.semantic_factors(sims) if sims is not None else None, panels.quality_factors(quality) if quality is not None else None, panels.engagement_factors(votes, satisfaction)]
    found, table = {}, {}
    heads = lambda n: F.array_join(F.transform(F.filter("p.headings", lambda h: h["level"] == n), lambda h: h["text"]), " ").alias(f"h{n}")
    if salient or meaning or intents is not None or entities is not None:
        seen = stages.written(wanted.join(fetched, "url").select("run_id", "rank", "phrase", "domain", F.col("p.title").alias("title"), *map(heads, (1, 2, 3)), F.col("p.body").alias("body")), "shown")
    if salient:
        extra.append(panels.salient_coverage(seen.select("run_id", "rank", "body", "phrase")))
    if meaning or intents is not None:
        found |= {f"meaning_{k}": v for k, v in layers.meaning(requests, seen.select("run_id", "rank", "body"), intents, embeddings).items()}
    if entities is not None:
        none = spark.createDataFrame([], f"run_id {dict(entities.dtypes)['run_id']}, rank int, entity string, attribute string, value string, is_edge boolean, ord int")
        table = layers.entity_table(requests, entities, none if triples is None else triples, seen.drop("phrase", "domain"), wanted.select("run_id", "rank", "domain"), aliases)
        found |= {f"entities_{k}": v for k, v in table.items()}
    if stats is not None:
        found |= {f"links_{k}": v for k, v in layers.off_page(wanted.select("run_id", "rank", "url", "domain"), stats, links).items()}
    if keywords is not None:
        found |= {f"brand_{k}": v for k, v in layers.brand(wanted.select("run_id", "rank", "domain"), keywords).items()}
    extra += [found.pop(k) for k in [k for k in found if k.endswith("_factors")]]
    if crux is not None:
        extra.append(layers.field_data(wanted.select("run_id", "rank", "url"), crux))
    rows = [r.select("run_id", "rank", "factor_id", "value", F.lit(k).alias("layer")) for k, r in enumerate(r for r in extra if r is not None)]
    first = functools.reduce(DataFrame.unionByName, rows).groupBy("run_id", "rank", "factor_id").agg(F.min_by("value", "layer").alias("value")) if rows else None
    if not own:
        return first, found, table
    if rows:
        values = stages.written(values, "measured")  # read twice below: as it is, and for what it lacks
        values = panels.backfilled(values, first.join(wanted.select("run_id", "rank", "url", "domain"), ["run_id", "rank"], "left"))
    values = stages.written(values, "factor-values")
    return values, found, table


def analyze(
    requests: DataFrame, items: DataFrame, pages: DataFrame, more: DataFrame | None = None, sims: DataFrame | None = None, quality: DataFrame | None = None, votes: DataFrame | None = None, satisfaction: DataFrame | None = None,
    types: DataFrame | None = None, cells: DataFrame | None = None, salient: bool = False, meaning: bool = False, intents: DataFrame | None = None, embeddings: DataFrame | None = None, entities: DataFrame | None = None,
    triples: DataFrame | None = None, aliases: DataFrame | None = None, stats: DataFrame | None = None, links: DataFrame | None = None, keywords: DataFrame | None = None, crux: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """factor_values, correlations, actions, scorecard, gates, gate_report, overall, advantages, cards, stages (rows and seconds of what was written on the way), and what the layers give: their tables under layer_name (entities_eav, meaning_gaps, brand_leaderboard, ...), with types intent_panel, with entities brief and brief_texts.

    Optional layers, each off without its tables: sims and salient, or meaning with intents and embeddings (passages of the pages themselves); quality; votes and satisfaction (engagement); types (intent); cells,
    or entities with triples and aliases (the entity table); stats and links (off-page); keywords (brand); crux (origin, payload, as captured; null where there was no record). See ``layers``, ``panels`` and ``funnel``.
    more: further long rows of the same columns as factor_values. Measured values win over panels.
    """
    spark = requests.sparkSession
    definitions, stages = F.broadcast(registry.factor_def(spark)), Stages()  # one row per registered factor
    values, found, table = _measured(requests, items, pages, more, sims, quality, votes, satisfaction, salient, meaning, intents, embeddings, entities, triples, aliases, stats, links, keywords, crux, stages)
    cells, unread = table["cells"] if cells is None and table else cells, table["unread"] if table else None
    correlations = K.correlate(values, definitions)
    targets = values.filter("rank = 0").select("run_id", "factor_id", "value")
    scored = roadmap.candidates(correlations, definitions, targets)
    got = items.select("run_id", "rank", "url").join(pages.groupBy("url").agg(F.bool_or("ok").alias("ok")), "url", "left").select("run_id", "rank", F.coalesce("ok", F.lit(False)).alias("ok"))
    at = funnel.located(items, requests)
    panel = None if types is None else explain.intent_panel(types, at)
    gates = stages.written(funnel.all_gates(values, definitions, got, cells, types, at, unread, panel), "gates")
    verdicts = funnel.funnel(gates, unread=unread)
    report = explain.gate_report(gates, verdicts, values, definitions, panel)
    if panel is not None:
        found["intent_panel"] = panel
    actions = roadmap.top_actions(scored)
    if entities is not None:
        compared = table["entities"].filter("rank > 0").groupBy("run_id").agg(F.count_distinct("rank").alias("n"))
        found["brief"] = topical.brief(table["coverage"], table["eav"], actions, found.get("meaning_gaps"), table["must_add"], compared, unread)
        found["brief_texts"] = topical.brief_texts(found["brief"], requests)
    return {
        "factor_values": values,
        "correlations": K.ordered(correlations, definitions),
        "actions": actions,
        "scorecard": roadmap.scorecard(scored),
        "gates": verdicts,
        "gate_report": report,
        "overall": explain.summary(funnel.overall(verdicts)),
        "advantages": funnel.advantages(gates),
        "cards": explain.cards(gates, items.select("run_id", "rank", "url", "domain"), report, at),
        "stages": stages.table(spark),
    } | found


def compare(before: DataFrame, after: DataFrame, authority: DataFrame | None = None) -> dict[str, DataFrame]:
    """moves and churn of two result lists (run_id, rank, url, domain)."""
    one = lambda x: C.best_per_domain(x.select("run_id", "domain", "rank", "url"), ["run_id"])
    moved = C.moves(one(before), one(after), ["run_id"])
    return {"moves": moved if authority is None else C.with_authority(moved, authority), "churn": C.churn(moved, ["run_id"])}


def topic(sitemap: DataFrame, terms: DataFrame, hits: DataFrame) -> dict[str, DataFrame]:
    """pages and summary of a domain's cluster. sitemap: domain, url; terms: term, kind; hits: domain, url, terms."""
    merged = topical.merge_hits(topical.match_terms(sitemap, terms), hits)
    n_adjacent = terms.filter("kind = 'adjacent'").select("term").distinct().count()
    return {"pages": merged, "summary": topical.cluster_summary(merged, n_adjacent)}
