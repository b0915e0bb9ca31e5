"""Queries of what a run says in words: gate report, intent panel, cards, topics, briefs; each with DuckDB SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serploom.functions import text as T
from serploom.operators import explain, funnel, registry
from serploom.plans import topics as plans
from serploom.queries import _HOST, _PATH, query, rounded, table
from serploom.queries_plans import _EIGHT_SQL, _eight
from serploom.shared import written

_NAMED = ", ".join(f"('{f}', '{g}', {k}, '{registry.BY_ID[f].name}')" for g, names in explain.SHOWN.items() for k, f in enumerate(names))
_PANEL_OF_TYPES = """
    own AS (SELECT run_id, arg_min(page_type, rank) AS target_type FROM ty WHERE rank = 0 OR (rank = 3 AND run_id % 2 = 0) GROUP BY run_id),
    ct AS (SELECT run_id, count(*) FILTER (page_type = dom) AS n, count(*) AS "of" FROM ty JOIN dm USING (run_id) WHERE rank > 0 GROUP BY run_id),
    ip AS (SELECT run_id, dom AS dominant, n, "of", share, target_type, CASE WHEN target_type = dom AND share >= 0.4 THEN 'match' WHEN target_type <> dom AND share >= 0.5 THEN 'mismatch' ELSE 'partial' END AS fit FROM dm JOIN ct USING (run_id) LEFT JOIN own USING (run_id)),
    im AS (SELECT *, n || ' of ' || "of" || ' typed results are of type ' || dominant || '; ' || coalesce('yours is of type ' || target_type || ': ', 'yours has no type: ') || CASE fit WHEN 'match' THEN 'the formats match' WHEN 'mismatch' THEN 'the formats differ' ELSE 'the fit is partial' END || '.' AS note FROM ip)"""
_REPORT_SQL = f"""{_EIGHT_SQL},{_PANEL_OF_TYPES},
    alv AS (SELECT run_id, rank::BIGINT AS rank, gate, score FROM al WHERE score IS NOT NULL),
    gn(gate, name, ord) AS (VALUES {", ".join(f"('{g}', '{n}', {k})" for k, (g, n) in enumerate(explain.GATE_NAMES.items(), 1))}),
    tp AS (SELECT a.run_id, a.gate, 100 * (count(*) FILTER (q.score < a.score) + 0.5 * count(*) FILTER (q.score = a.score)) / nullif(count(q.score), 0) AS score
           FROM (SELECT * FROM alv WHERE rank = 0) a LEFT JOIN alv q ON q.run_id = a.run_id AND q.gate = a.gate AND q.rank > 0 GROUP BY ALL),
    tr AS (SELECT *, rank() OVER (PARTITION BY run_id, gate ORDER BY score) + (count(*) OVER (PARTITION BY run_id, gate, score) - 1) / 2.0 AS rv FROM alv WHERE rank > 0),
    tw AS (SELECT run_id, gate, CASE WHEN count(*) < 3 OR max(score) = min(score) THEN 0.5 ELSE greatest(abs(corr(rv, rank)), 0.25) END AS weight FROM tr GROUP BY run_id, gate),
    vals AS (SELECT run_id, rank::BIGINT AS rank, factor_id, value FROM v UNION ALL SELECT run_id, rank, factor_id, value FROM pf WHERE factor_id <> 'HELPFULNESS' UNION ALL SELECT run_id, rank, 'EAV_COMPLETENESS', (s_suppkey % 7)::DOUBLE FROM sup),
    sn(factor_id, gate, k, name) AS (VALUES {_NAMED}),
    de AS (SELECT run_id, gate, string_agg(name || ': ' || format('{{:.1f}}', round(value::DECIMAL(18, 6), 1)::DOUBLE), ' | ' ORDER BY k) AS details FROM vals JOIN sn USING (factor_id) WHERE rank = 0 GROUP BY run_id, gate
           UNION ALL SELECT run_id, 'intent', note FROM im),
    gr2 AS (SELECT r.run_id, gn.gate, gn.ord, gn.name, tp.score, CASE WHEN tp.score IS NULL THEN 'n/a' WHEN tp.score >= 55 THEN 'pass' WHEN tp.score >= 30 THEN 'weak' ELSE 'fail' END AS verdict, coalesce(weight, 0.5) AS weight,
                   CASE WHEN gn.gate = 'access' AND r.run_id IN (SELECT run_id FROM v WHERE factor_id LIKE 'CRUX%') THEN 'measured' WHEN gn.gate IN ('intent', 'quality', 'engagement') THEN 'estimated' ELSE 'computed' END AS tier, coalesce(details, '') AS details
            FROM (SELECT DISTINCT run_id FROM vals) r CROSS JOIN gn LEFT JOIN tp ON tp.run_id = r.run_id AND tp.gate = gn.gate LEFT JOIN tw ON tw.run_id = r.run_id AND tw.gate = gn.gate LEFT JOIN de ON de.run_id = r.run_id AND de.gate = gn.gate)"""


def _report(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    values, gates, pages, types, targets = _eight(spark, d)
    values, gates = written(values, "values"), written(gates, "gates")  # read six times
    panel = explain.intent_panel(types, targets)
    return explain.gate_report(gates, funnel.funnel(gates), values, registry.factor_def(spark), panel), gates, pages, targets


@query(f'WITH {_EIGHT_SQL},{_PANEL_OF_TYPES} SELECT run_id, dominant, n, "of", round(share, 6) AS share, target_type, fit, note FROM im')
def intent_panel(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a nation as typed pages of a run."""
    *_, types, targets = _eight(spark, d)
    return rounded(explain.intent_panel(types, targets))


@query(f"WITH {_REPORT_SQL} SELECT run_id, gate, ord, name, round(score, 6) AS score, verdict, round(weight, 6) AS weight, tier, details FROM gr2")
def gate_report(spark: SparkSession, d: str) -> DataFrame:
    """All eight gates of every run with evidence tier and the target's own numbers."""
    report, *_ = _report(spark, d)
    return rounded(report.withColumn("details", F.array_join("details", " | ")))


@query(f"""WITH {_REPORT_SQL},
    pg AS (SELECT run_id, rank, s_suppkey, row_number() OVER (PARTITION BY run_id ORDER BY rank) AS k FROM sup WHERE rank > 0 AND NOT (run_id % 2 = 0 AND rank >= 3) QUALIFY k <= 5),
    ld AS (SELECT h.run_id, h.rank, h.gate, h.score AS theirs, o.score AS yours, round(h.score - o.score, 6) AS lead FROM alv h JOIN alv o ON o.run_id = h.run_id AND o.gate = h.gate AND o.rank = 0 WHERE h.rank > 0 AND round(h.score - o.score, 6) > 2),
    cd AS (SELECT pg.run_id, pg.rank, s_suppkey, ld.gate, theirs, yours, lead, name, tier, row_number() OVER (PARTITION BY pg.run_id, pg.rank ORDER BY lead DESC NULLS LAST, gr2.ord) AS place
           FROM pg LEFT JOIN ld ON ld.run_id = pg.run_id AND ld.rank = pg.rank LEFT JOIN gr2 ON gr2.run_id = ld.run_id AND gr2.gate = ld.gate QUALIFY place <= 3)
    SELECT run_id, rank, 's' || s_suppkey AS url, s_suppkey % 7 AS domain, place::INT AS place, gate, round(theirs, 6) AS theirs, round(yours, 6) AS yours, lead,
           CASE WHEN gate IS NULL THEN 'No gate that was measured explains this rank: authority, a known brand or past behaviour may.' ELSE name || ': ' || format('{{:.0f}}', round(theirs::DECIMAL(18, 6))::DOUBLE) || ' against your ' || format('{{:.0f}}', round(yours::DECIMAL(18, 6))::DOUBLE) || ', ' || format('{{:.0f}}', round(lead::DECIMAL(18, 6))::DOUBLE) || ' points ahead.' END AS reason,
           CASE WHEN gate IS NULL THEN 'all measured gates' ELSE name || ', ' || tier END AS evidence FROM cd""")
def competitor_cards(spark: SparkSession, d: str) -> DataFrame:
    """Why those above the target rank there; every second run knows its target's place."""
    report, gates, pages, targets = _report(spark, d)
    shown = pages.select("run_id", "rank", F.concat(F.lit("s"), "s_suppkey").alias("url"), (F.col("s_suppkey") % 7).alias("domain"))
    return rounded(explain.cards(gates, shown, report, targets))


# --- topics: domains as runs, numbers in addresses as terms; one run has no model's reply, one no target

_TOPICS_SQL = rf"""
    p AS (SELECT page_id, url, regexp_extract({_HOST}, '[^.]*\.[^.]*$') AS domain, lower({_HOST} || regexp_replace({_PATH}, '/+$', '')) AS key, trim(lower(regexp_replace(regexp_replace({_PATH}, '(?i)\.(html?|php|aspx?)$', ''), '[-_/]+', ' ', 'g'))) AS slug FROM pages),
    d AS (SELECT DISTINCT domain FROM p), k AS (SELECT domain, regexp_extract(slug, '(\d+)$', 1) AS t FROM p),
    te AS (SELECT DISTINCT domain, t AS term, 'core' AS kind FROM k WHERE length(t) = 3 AND t LIKE '8%' AND domain <> 'example.org' UNION ALL SELECT DISTINCT domain, t, 'adjacent' FROM k WHERE length(t) = 3 AND t LIKE '1%' AND domain <> 'example.org'
           UNION SELECT DISTINCT domain, '888', 'core' FROM k WHERE domain <> 'example.org' UNION VALUES ('example.org', '777', 'core')),
    rq AS (SELECT domain, CASE WHEN domain <> 'example.net' THEN arg_max(url, page_id) END AS target_url, CASE WHEN domain <> 'example.net' THEN arg_max(key, page_id) END AS target_key FROM p GROUP BY domain),
    sh AS (SELECT p.domain, key, list(DISTINCT term) FILTER (kind = 'core') AS c, list(DISTINCT term) FILTER (kind = 'adjacent') AS a FROM p JOIN te ON te.domain = p.domain AND regexp_matches(slug, '\b' || term) GROUP BY p.domain, key),
    hs AS (SELECT p.domain, page_id, key, list(DISTINCT term) AS terms FROM p JOIN te ON te.domain = p.domain AND kind = 'core' AND regexp_matches('page ' || page_id || ' ' || slug, '\b' || term) WHERE page_id % 3 = 0 GROUP BY p.domain, page_id, key),
    hk AS (SELECT domain, key, list_distinct(flatten(list(terms))) AS h, count(*) AS results, min(page_id) AS pos FROM hs GROUP BY domain, key),
    cl AS (SELECT coalesce(sh.domain, hk.domain) AS domain, coalesce(sh.key, hk.key) AS key, c IS NOT NULL AS slug_match, h IS NOT NULL AS serp_hit, sh.key IS NOT NULL AND c IS NULL AS is_adjacent,
                  array_to_string(list_sort(list_distinct(list_concat(coalesce(c, a, []), coalesce(h, [])))), ',') AS matched_terms, coalesce(c, a, []) AS own, results, pos FROM sh FULL JOIN hk ON hk.domain = sh.domain AND hk.key = sh.key)"""


def _topics(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    p = table(spark, d, "pages").select("page_id", "url", T.registrable_compare(T.host_of("url")).alias("domain"), F.regexp_extract(T.slug_text("url"), r"(\d+)$", 1).alias("t"))
    said = lambda head: F.array_sort(F.collect_set(F.when((F.length("t") == 3) & F.col("t").startswith(head), F.col("t"))))
    replies = p.filter("domain <> 'example.org'").groupBy(F.col("domain").alias("run_id")).agg(F.concat(F.lit("Here it is: "), F.to_json(F.struct(F.lit("888").alias("core"), said("8").alias("variations"), said("1").alias("adjacent")))).alias("reply"))
    last = p.groupBy("domain").agg(F.max_by("url", "page_id").alias("u"))
    requests = last.select(F.col("domain").alias("run_id"), "domain", F.when(F.col("domain") == "example.org", "Spam farm 777").alias("topic"), F.when(F.col("domain") != "example.net", F.col("u")).alias("target_url"))
    searches = p.filter("page_id % 3 = 0").select(F.col("domain").alias("run_id"), F.col("page_id").alias("pos"), "url", F.concat(F.lit("Page "), "page_id").alias("title"))
    return plans.topics(plans.run_terms(requests, replies), p.select("domain", "url"), searches)


@query(f"WITH {_TOPICS_SQL} SELECT domain AS run_id, key, slug_match, serp_hit, is_adjacent, matched_terms FROM cl")
def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each domain's cluster, of sitemap and search."""
    return _topics(spark, d)["pages"].select("run_id", "key", "slug_match", "serp_hit", "is_adjacent", F.array_join("matched_terms", ",").alias("matched_terms"))


@query(f"""WITH {_TOPICS_SQL},
    nu AS (SELECT d.domain, count(*) FILTER (slug_match OR serp_hit) AS cluster_size, count(*) FILTER (NOT (slug_match OR serp_hit)) AS adjacent_pages, coalesce(sum(results), 0)::BIGINT AS serp_hits, arg_min(key, pos) AS canonical FROM d LEFT JOIN cl USING (domain) GROUP BY d.domain),
    ad AS (SELECT domain, count(DISTINCT t) AS adjacent_covered FROM (SELECT domain, unnest(own) AS t FROM cl WHERE NOT (slug_match OR serp_hit)) GROUP BY domain),
    st AS (SELECT domain, count(DISTINCT url) AS sitemap_total FROM p GROUP BY domain), na AS (SELECT domain, count(*) FILTER (kind = 'adjacent') AS n_adjacent FROM te GROUP BY domain),
    z AS (SELECT nu.*, coalesce(adjacent_covered, 0) AS adjacent_covered, sitemap_total, coalesce(n_adjacent, 0) AS n_adjacent, target_url, (nu.domain, target_key) IN (SELECT (domain, key) FROM cl) AS inside, coalesce(target_key = canonical, false) AS target_is_canonical
          FROM nu LEFT JOIN ad USING (domain) JOIN st USING (domain) LEFT JOIN na USING (domain) JOIN rq USING (domain)),
    y AS (SELECT *, round_even(45 * least(1, cluster_size / 8) + 20 * least(1, cluster_size / sitemap_total / 0.15) + 20 * coalesce(adjacent_covered / nullif(n_adjacent, 0), 0) + 15 * least(1, serp_hits / 3), 1) AS score FROM z)
    SELECT domain AS run_id, cluster_size, adjacent_pages, serp_hits, adjacent_covered, sitemap_total, n_adjacent::INT AS n_adjacent, round_even(cluster_size / sitemap_total, 4) AS focus_ratio, score, CASE WHEN score >= 70 THEN 'strong' WHEN score >= 40 THEN 'moderate' ELSE 'thin' END AS band,
           coalesce(target_url IS NOT NULL AND inside, false) AS target_in_cluster, target_is_canonical, cluster_size >= 3 AND (target_url IS NULL OR inside) AS supports_target FROM y""")
def topic_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Score, band and the verdict on the target page of each domain."""
    s = _topics(spark, d)["summary"]
    return s.select("run_id", "cluster_size", "adjacent_pages", "serp_hits", "adjacent_covered", "sitemap_total", "n_adjacent", "focus_ratio", "score", "band", "target_in_cluster", "target_is_canonical", "supports_target")
