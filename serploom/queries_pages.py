"""Queries over pages built from table rows: the SQL computes every factor from the row itself, without parsing HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serploom.functions import text as T
from serploom.operators import factors, page
from serploom.queries import query, table

KEYWORD = "Alpha, Beta!"
#: Factors of built pages whose expected values the SQL states.
STATED = [
    "TITLE_LEN", "TITLE_WORDS", "TITLE_VARS", "TITLE_LEAD_VARS", "TITLE_HAS_DOMAIN", "OG_TITLE_VARS", "HEADING_COUNT", "H1_COUNT", "H1_VARS", "H2_VARS", "H3_VARS", "H1H6_VARS", "H1H3_VARS", "LEAD_VARS_H1H6",
    "EXACT_H1H6", "QUESTIONS_H1", "WORD_COUNT", "UNABRIDGED_WORD_COUNT", "CLEAN_TEXT_KB", "PAGE_SIZE_KB", "SENTENCES", "AVG_WORDS_SENTENCE", "P_TAGS", "HTML_TAGS", "BODY_VARS", "P_VARS", "VAR_DENSITY_30KB", "CLEAN_KW_DENSITY",
    "FLESCH_EASE", "FLESCH_GRADE", "BYTES_TO_FIRST_MATCH", "HTML_VARS", "EXACT_HTML", "UNIQUE_VARS", "LINKS", "INTERNAL_LINKS", "EXTERNAL_LINKS", "HTTPS_LINKS", "DOFOLLOW_EXT_LINKS", "NOFOLLOW_LINKS", "A_VARS", "SOCIAL_LINKS",
    "IMAGES", "IMAGES_ALT", "ALT_VARS", "HAS_JSONLD", "SCHEMA_TYPES", "USES_ORG_LOCALBIZ", "USES_PRODUCT_OFFER", "USES_AGG_RATING", "USES_FAQ", "USES_BREADCRUMB", "CLAIMED_BRANDS", "META_DESC_LEN", "META_DESC_WORDS",
    "META_DESC_VARS", "META_KEYWORDS", "HAS_DOCTYPE", "HAS_FORM", "HAS_VIDEO", "HAS_PRIVACY", "HAS_EMAIL", "LOAD_MS", "TRUST_BYLINE", "TRUST_AUTHOR_PAGE", "TRUST_PERSON_SCHEMA", "TRUST_ORG_SCHEMA", "TRUST_SAMEAS",
    "TRUST_OUTBOUND_CITATIONS", "TRUST_CONTACT_LINK", "TRUST_VISIBLE_DATE",
]


#: Built pages that a task parses. A part is some 20 bytes of a file and its page 1 KB of HTML, so files alone would give very few tasks.
PAGES_A_TASK = 2_500


def dealt(rows: DataFrame, per: int) -> DataFrame:
    """Small rows that much is made of, dealt out to as many tasks as their number asks for."""
    return rows.repartition(max(1, -(-rows.count() // per)))


def _m(n: int, column: str = "p_partkey") -> Column:
    return (F.col(column) % n).cast("int")


def built_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each part: its parts come as often as the part's numbers say."""
    lit, cat = F.lit, F.concat
    times = lambda s, n: F.repeat(lit(s) if isinstance(s, str) else s, n)
    p = dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size"), PAGES_A_TASK)
    jsonld = (
        F.when(_m(4) == 0, '<script type="application/ld+json">{"@type":"Product","name":"x","offers":{"@type":"Offer","price":"1"},"aggregateRating":{"@type":"AggregateRating","ratingValue":4}}</script>')
        .when(_m(4) == 1, '<script type="application/ld+json">{"@graph":[{"@type":["Organization"],"sameAs":["https://one.example.org/a","https://built.example.com/b"]},{"@type":"Person"}]}</script>')
        .when(_m(4) == 2, '<script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"@type":"Question"}]}</script><script type="application/ld+json">{broken</script>')
        .otherwise("")
    )
    head = cat(
        F.when(_m(2) == 0, "<!DOCTYPE html>").otherwise(""), lit("<html><head><title>"), times("Alpha beta ", _m(3)), "p_name", lit("</title>"),
        lit('<meta name="description" content="'), "p_type", times(" alpha", _m(4)), lit('"><meta name="keywords" content="'), times("kw, ", _m(5)), lit('"><meta property="og:title" content="'), times("beta ", _m(2)), lit('">'), jsonld, lit("</head><body>"),
    )
    body = cat(
        lit('<nav><a href="/home">Home</a></nav>'), times("<h1>Which alpha beta is it</h1>", _m(3)), times("<h2>beta part</h2>", _m(4, "p_size")), times("<h3>An alpha</h3>", _m(3, "p_size")),
        times(cat(lit("<p>The "), F.col("p_name"), lit(" is alpha beta. It costs less!</p>")), _m(5, "p_size")), times('<img src="a.png" alt="alpha image">', _m(4)), times('<img src="b.png" alt="">', _m(3)),
        times('<a href="/in">inside</a>', _m(3, "p_size")), times('<a href="https://other.example.org/x" rel="nofollow">beta out</a>', _m(3)), times('<a href="https://second.sample.net/y">out</a>', _m(2)),
        F.when(_m(5) == 0, '<a href="https://www.facebook.com/z">fb</a>').otherwise(""), F.when(_m(6) == 0, "<form></form><video></video>").otherwise(""), F.when(_m(7) == 0, '<time datetime="2024-01-01">then</time>').otherwise(""),
        F.when(_m(8) == 0, '<a rel="author" href="/author/jane">Jane</a>').otherwise(""), F.when(_m(9) == 0, '<a href="/privacy">Privacy</a><a href="/contact">Contact</a>').otherwise(""), F.when(_m(10) == 0, '<a href="mailto:me">mail</a>').otherwise(""),
        F.when(_m(11) == 0, "<noscript>hidden alpha</noscript>").otherwise(""), lit("</body></html>"),
    )
    return p.select("p_partkey", F.lit("https://built.example.com/page").alias("url"), F.lit("built.example.com").alias("domain"), cat(head, body).alias("html"), F.when(_m(3) > 0, _m(3) * 100.0).alias("load_ms"))


_ONE = {
    "doctype": "CASE WHEN k % 2 = 0 THEN '<!DOCTYPE html>' ELSE '' END",
    "title": "trim(repeat('Alpha beta ', k3) || name)",
}
_SYL = "list_sum(list_transform(toks, lambda w: greatest(len(regexp_extract_all(regexp_replace(w, 'e$', ''), '[aeiouy]+')), 1)))"


@query(f"""WITH b AS (
        SELECT p_partkey AS k, p_name AS name, p_type AS type, (p_partkey % 2)::INT AS k2, (p_partkey % 3)::INT AS k3, (p_partkey % 4)::INT AS k4, (p_partkey % 5)::INT AS k5, p_size % 3 AS s3, p_size % 4 AS s4, p_size % 5 AS s5,
               (p_partkey % 5 = 0)::INT AS fb, (p_partkey % 6 = 0)::INT AS form, (p_partkey % 7 = 0)::INT AS dated, (p_partkey % 8 = 0)::INT AS author, (p_partkey % 9 = 0)::INT AS privacy, (p_partkey % 10 = 0)::INT AS mail, (p_partkey % 11 = 0)::INT AS hid FROM part
    ), t AS (
        -- texts as a reader sees them, in order
        SELECT *, {_ONE['title']} AS title, trim(repeat('The ' || name || ' is alpha beta. It costs less! ', s5)) AS ps,
               type || repeat(' alpha', k4) AS descr,
               trim({_ONE['title']} || ' Home ' || repeat('Which alpha beta is it ', k3) || repeat('beta part ', s4) || repeat('An alpha ', s3) || repeat('The ' || name || ' is alpha beta. It costs less! ', s5) || repeat('inside ', s3) || repeat('beta out ', k3)
                    || repeat('out ', k2) || repeat('fb ', fb) || repeat('then ', dated) || repeat('Jane ', author) || repeat('Privacy Contact ', privacy) || repeat('mail ', mail)) AS body,
               CASE k4 WHEN 0 THEN 175 WHEN 1 THEN 171 WHEN 2 THEN 150 ELSE 0 END AS n_json
        FROM b
    ), w AS (
        SELECT *, regexp_extract_all(lower(body), '[a-z0-9'']+') AS toks, len(regexp_extract_all(body, '[.!] ')) + 1 AS n_sent,
               -- alphas, betas and whole phrases that the rows' numbers give
               k3 + k3 + s3 + s5 AS body_a, k3 + k3 + s4 + s5 + k3 AS body_b, k3 + k3 + s5 AS body_p,
               1 + s3 + k3 + k2 + fb + author + 2 * privacy + mail AS n_links
        FROM t
    ), x AS (
        SELECT *, len(toks) AS n_words, n_links - 1 AS content_links,
               octet_length(encode(body)) AS body_bytes,
               -- the lengths of the pieces that the pages are put together from
               (15 * (1 - k2) + 19 + 11 * k3 + length(name) + 8 + 34 + length(type) + 6 * k4 + 33 + 4 * k5 + 37 + 5 * k2 + 2 + n_json + 13
                + 35 + 31 * k3 + 18 * s4 + 17 * s3 + (41 + length(name)) * s5 + 35 * k4 + 24 * k3 + 24 * s3 + 65 * k3 + 45 * k2 + 43 * fb
                + 28 * form + 39 * dated + 44 * author + 60 * privacy + 28 * mail + 33 * hid + 14) AS html_bytes
        FROM w
    ), f AS (
        SELECT k, length(title) AS TITLE_LEN, 2 * k3 + 2 AS TITLE_WORDS, 3 * k3 AS TITLE_VARS, (k3 > 0)::INT AS TITLE_LEAD_VARS, 0 AS TITLE_HAS_DOMAIN, k2 AS OG_TITLE_VARS, k3 + s4 + s3 AS HEADING_COUNT, k3 AS H1_COUNT,
               3 * k3 AS H1_VARS, s4 AS H2_VARS, s3 AS H3_VARS, 3 * k3 + s4 + s3 AS H1H6_VARS, 3 * k3 + s4 + s3 AS H1H3_VARS, s4 AS LEAD_VARS_H1H6, k3 AS EXACT_H1H6, k3 AS QUESTIONS_H1,
               n_words AS WORD_COUNT, n_words + 2 * hid AS UNABRIDGED_WORD_COUNT, body_bytes / 1024.0 AS CLEAN_TEXT_KB, html_bytes / 1024.0 AS PAGE_SIZE_KB, n_sent AS SENTENCES, n_words / n_sent AS AVG_WORDS_SENTENCE, s5 AS P_TAGS,
               3 + 3 + CASE k4 WHEN 3 THEN 0 WHEN 2 THEN 2 ELSE 1 END + 1 + 2 + k3 + s4 + s3 + s5 + k4 + k3 + s3 + k3 + k2 + fb + 2 * form + dated + author + 2 * privacy + mail + hid AS HTML_TAGS,
               body_a + body_b + body_p AS BODY_VARS, 3 * s5 AS P_VARS, (body_a + body_b + body_p) / greatest(n_words, 1) * 100 AS VAR_DENSITY_30KB, (body_a + body_b + body_p) / greatest(n_words, 1) * 100 AS CLEAN_KW_DENSITY,
               206.835 - 1.015 * n_words / n_sent - 84.6 * {_SYL} / n_words AS FLESCH_EASE, 0.39 * n_words / n_sent + 11.8 * {_SYL} / n_words - 15.59 AS FLESCH_GRADE,
               CASE WHEN k3 > 0 THEN 15 * (1 - k2) + 19 WHEN k4 > 0 THEN 15 * (1 - k2) + 19 + length(name) + 8 + 34 + length(type) + 1 WHEN k2 > 0 THEN 15 * (1 - k2) + 19 + length(name) + 8 + 34 + length(type) + 33 + 4 * k5 + 37
                    WHEN s4 > 0 THEN 15 * (1 - k2) + 19 + length(name) + 8 + 34 + length(type) + 33 + 4 * k5 + 37 + 2 + n_json + 13 + 35 + 4 WHEN s3 > 0 THEN 15 * (1 - k2) + 19 + length(name) + 8 + 34 + length(type) + 33 + 4 * k5 + 37 + 2 + n_json + 13 + 35 + 7 WHEN s5 > 0 THEN 15 * (1 - k2) + 19 + length(name) + 8 + 34 + length(type) + 33 + 4 * k5 + 37 + 2 + n_json + 13 + 35 + 7 + length(name) + 4
                    WHEN hid > 0 THEN html_bytes - 14 - 33 + 17 ELSE html_bytes END AS BYTES_TO_FIRST_MATCH,
               body_a + body_b + body_p + 2 * k4 + k2 + hid AS HTML_VARS, body_p AS EXACT_HTML,
               (body_p > 0)::INT + (body_a + 2 * k4 + hid > 0)::INT + (body_b + k2 > 0)::INT AS UNIQUE_VARS,
               content_links AS LINKS, s3 + author + 2 * privacy AS INTERNAL_LINKS, k3 + k2 + fb + mail AS EXTERNAL_LINKS, k3 + k2 + fb AS HTTPS_LINKS, k2 + fb + mail AS DOFOLLOW_EXT_LINKS, k3 AS NOFOLLOW_LINKS, k3 AS A_VARS, fb AS SOCIAL_LINKS,
               k4 + k3 AS IMAGES, k4 AS IMAGES_ALT, k4 AS ALT_VARS, (k4 < 3)::INT AS HAS_JSONLD, CASE k4 WHEN 0 THEN 3 WHEN 3 THEN 0 ELSE 2 END AS SCHEMA_TYPES, (k4 = 1)::INT AS USES_ORG_LOCALBIZ, (k4 = 0)::INT AS USES_PRODUCT_OFFER,
               (k4 = 0)::INT AS USES_AGG_RATING, (k4 = 2)::INT AS USES_FAQ, 0 AS USES_BREADCRUMB, CASE k4 WHEN 1 THEN 2 ELSE 0 END AS CLAIMED_BRANDS, length(descr) AS META_DESC_LEN, k4 + 1 AS META_DESC_WORDS, k4 AS META_DESC_VARS, k5 AS META_KEYWORDS,
               1 - k2 AS HAS_DOCTYPE, form AS HAS_FORM, form AS HAS_VIDEO, privacy AS HAS_PRIVACY, mail AS HAS_EMAIL, 100 * k3 AS LOAD_MS, author AS TRUST_BYLINE, author AS TRUST_AUTHOR_PAGE, (k4 = 1)::INT AS TRUST_PERSON_SCHEMA,
               (k4 = 1)::INT AS TRUST_ORG_SCHEMA, CASE k4 WHEN 1 THEN 1 ELSE 0 END AS TRUST_SAMEAS, k3 + k2 AS TRUST_OUTBOUND_CITATIONS, privacy AS TRUST_CONTACT_LINK, dated AS TRUST_VISIBLE_DATE
        FROM x
    ) SELECT k AS p_partkey, e.name AS factor_id, round(e.value, 6) AS value FROM (SELECT k, unnest([{", ".join(f"{{'name': '{n}', 'value': {n}::DOUBLE}}" for n in STATED)}]) AS e FROM f)""")
def built_page_factors(spark: SparkSession, d: str) -> DataFrame:
    """Every HTML, schema and trust factor of the built pages, long."""
    p = page.surfaces(built_pages(spark, d)).withColumns({"phrase": T.phrase_of(F.lit(KEYWORD)), "vars": T.variations(F.lit(KEYWORD))})
    return factors.page_factors(p, ["p_partkey"]).select("p_partkey", "factor_id", F.round("value", 6).alias("value"))
