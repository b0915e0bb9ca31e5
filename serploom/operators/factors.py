"""Page factors as columns over the parsed surface, and their long form (run_id, rank, url, domain, factor_id, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom.functions import text as T

# Fixed values.
QUESTION_WORDS = ["who", "what", "when", "where", "why", "how", "which", "can", "do", "does", "is", "are"]
SOCIAL_HOSTS = ["facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "youtu.be", "linkedin.com", "pinterest.com", "tiktok.com"]
TRUST_SOCIAL = ["twitter.com", "x.com", "facebook.com", "linkedin.com", "instagram.com", "youtube.com", "pinterest.com"]
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
BYLINE = r"\bby\s+[A-Z][\w.'’-]+(?:\s+[A-Z][\w.'’-]+){0,3}\b"
ORG_TYPES, PRODUCT_TYPES, FAQ_TYPES = ["organization", "localbusiness"], ["product", "offer", "aggregateoffer"], ["faqpage", "question"]
PRICE_KEYS, RATING_KEYS = ["price", "highprice", "lowprice", "pricerange", "offercount"], ["ratingvalue", "reviewcount", "ratingcount"]

P = F.col
VARS = "vars"


def _joined(levels: tuple[int, ...]) -> Column:
    return F.concat_ws(" ", F.transform(F.filter("p.headings", lambda h: h["level"].isin(list(levels))), lambda h: h["text"]))


def _h1() -> Column:
    return F.transform(F.filter("p.headings", lambda h: h["level"] == 1), lambda h: h["text"])


def _question(t: Column) -> Column:
    return F.endswith(F.trim(t), F.lit("?")) | F.regexp_extract(F.lower(t), r"^([a-z0-9']+)", 1).isin(QUESTION_WORDS)


def _content_links() -> Column:
    return F.filter("p.links", lambda x: ~x["chrome"] & (x["href"] != ""))


def _same_site(x: Column) -> Column:
    return (x["host"] != "") & (T.registrable_domain(x["host"]) == T.registrable_domain("domain"))


def _external() -> Column:
    return F.filter(_content_links(), lambda x: ~_same_site(x))


def _types() -> Column:
    return F.array_distinct(F.concat("p.jsonld_types", "p.micro_types"))


def _has(values: list[str]) -> Column:
    return F.arrays_overlap(_types(), F.array(*map(F.lit, values)))


def _has_key(values: list[str]) -> Column:
    return F.arrays_overlap("p.jsonld_keys", F.array(*map(F.lit, values)))


def _any_of(x: Column, values: list[str]) -> Column:
    return F.arrays_overlap(x, F.array(*map(F.lit, values)))


def syllables(text: Column | str) -> Column:
    """Vowel groups of a text's words, a word's silent final e not counted, 1 at least for each word: the published heuristic of this engine.

    Words hold no vowel group across their ends, so groups are counted over the whole text, and words without any are added: two patterns for a text instead of two for each word.
    """
    low = F.lower(T.col(text))
    groups = F.regexp_count(low, F.lit(r"[aeiouy]{2,}|[aiouy]|e(?=[a-z0-9'])"))
    none = F.regexp_count(low, F.lit(r"(?<![a-z0-9'])(?:[b-df-hj-np-tv-xz0-9']++e?|e)(?![a-z0-9'])"))
    return groups + none


#: What several factors take of a page's text: words, sentences, syllables.
TEXT: dict[str, Callable[[], Column]] = {
    "words": lambda: T.word_count("p.body"),
    "sentences": lambda: F.size(T.sentences("p.body")),
    "syllables": lambda: syllables("p.body"),
}


def _flesch(a: float, b: float, c: float, words: Column, sentences: Column, syllables: Column) -> Column:
    return F.when(words > 0, a + b * words / F.greatest(sentences, F.lit(1)) + c * syllables / words).otherwise(0.0)


#: Factor id -> column over the columns of TEXT.
OF_TEXT: dict[str, Callable[[Column, Column, Column], Column]] = {
    "WORD_COUNT": lambda words, sentences, syllables: words,
    "SENTENCES": lambda words, sentences, syllables: sentences,
    "AVG_WORDS_SENTENCE": lambda words, sentences, syllables: words / F.greatest(sentences, F.lit(1)),
    "CLEAN_KW_DENSITY": lambda words, sentences, syllables: T.vcount("p.body", VARS) / F.greatest(words, F.lit(1)) * 100,
    "FLESCH_EASE": lambda words, sentences, syllables: _flesch(206.835, -1.015, -84.6, words, sentences, syllables),
    "FLESCH_GRADE": lambda words, sentences, syllables: _flesch(-15.59, 0.39, 11.8, words, sentences, syllables),
}


def _of_text(name: str) -> Callable[[], Column]:
    return lambda: OF_TEXT[name](*[c() for c in TEXT.values()])


#: Factor id -> column over (p, html, url, domain, vars, phrase, load_ms).
HTML: dict[str, Callable[[], Column]] = {
    "TITLE_LEN": lambda: F.length("p.title"),
    "TITLE_WORDS": lambda: T.spaced_words("p.title"),
    "TITLE_VARS": lambda: T.vcount("p.title", VARS),
    "TITLE_LEAD_VARS": lambda: T.leads("p.title", VARS),
    "TITLE_HAS_DOMAIN": lambda: (T.registrable_label("domain") != "") & F.contains(F.lower("p.title"), T.registrable_label("domain")),
    "OG_TITLE_VARS": lambda: T.vcount("p.og_title", VARS),
    "HEADING_COUNT": lambda: F.size("p.headings"),
    "H1_COUNT": lambda: F.size(_h1()),
    "H1_VARS": lambda: T.vcount(_joined((1,)), VARS),
    "H2_VARS": lambda: T.vcount(_joined((2,)), VARS),
    "H3_VARS": lambda: T.vcount(_joined((3,)), VARS),
    "H1H6_VARS": lambda: T.vcount(_joined((1, 2, 3, 4, 5, 6)), VARS),
    "H1H3_VARS": lambda: T.vcount(_joined((1, 2, 3)), VARS),
    "LEAD_VARS_H1H6": lambda: F.size(F.filter("p.headings", lambda h: T.leads(h["text"], VARS))),
    "EXACT_H1H6": lambda: T.exact_count(_joined((1, 2, 3, 4, 5, 6)), "phrase"),
    "QUESTIONS_H1": lambda: F.size(F.filter(_h1(), _question)),
    "WORD_COUNT": _of_text("WORD_COUNT"),
    "UNABRIDGED_WORD_COUNT": lambda: T.word_count("p.full_text"),
    "CLEAN_TEXT_KB": lambda: F.octet_length("p.body") / 1024.0,
    "PAGE_SIZE_KB": lambda: F.octet_length("html") / 1024.0,
    "SENTENCES": _of_text("SENTENCES"),
    "AVG_WORDS_SENTENCE": _of_text("AVG_WORDS_SENTENCE"),
    "P_TAGS": lambda: P("p.n_p"),
    "HTML_TAGS": lambda: P("p.n_tags"),
    "BODY_VARS": lambda: T.vcount("p.body", VARS),
    "HTML_VARS": lambda: T.vcount("html", VARS),
    "P_VARS": lambda: T.vcount("p.p_text", VARS),
    "EXACT_HTML": lambda: T.exact_count("html", "phrase"),
    "VAR_DENSITY_30KB": lambda: T.vcount("p.head_text", VARS) / F.greatest(P("p.head_words"), F.lit(1)) * 100,
    "CLEAN_KW_DENSITY": _of_text("CLEAN_KW_DENSITY"),
    "FLESCH_EASE": _of_text("FLESCH_EASE"),
    "FLESCH_GRADE": _of_text("FLESCH_GRADE"),
    "BYTES_TO_FIRST_MATCH": lambda: F.coalesce(T.first_offset("html", VARS), F.length("html")),
    "UNIQUE_VARS": lambda: T.unique_used("html", VARS),
    "LINKS": lambda: F.size(_content_links()),
    "INTERNAL_LINKS": lambda: F.size(F.filter(_content_links(), _same_site)),
    "EXTERNAL_LINKS": lambda: F.size(_external()),
    "HTTPS_LINKS": lambda: F.size(F.filter(_content_links(), lambda x: F.startswith(F.lower(x["href"]), F.lit("https")))),
    "DOFOLLOW_EXT_LINKS": lambda: F.size(F.filter(_external(), lambda x: ~x["rel"].contains("nofollow"))),
    "NOFOLLOW_LINKS": lambda: F.size(F.filter(_external(), lambda x: x["rel"].contains("nofollow"))),
    "A_VARS": lambda: T.vcount(F.concat_ws(" ", F.transform(_content_links(), lambda x: x["text"])), VARS),
    "SOCIAL_LINKS": lambda: F.size(F.filter(F.array(*map(F.lit, SOCIAL_HOSTS)), lambda s: F.exists("p.links", lambda x: F.contains(F.lower(x["href"]), s)))),
    "IMAGES": lambda: P("p.n_img"),
    "IMAGES_ALT": lambda: F.size("p.alts"),
    "ALT_VARS": lambda: T.vcount(F.concat_ws(" ", "p.alts"), VARS),
    "HAS_JSONLD": lambda: P("p.has_jsonld"),
    "SCHEMA_TYPES": lambda: F.size(_types()),
    "USES_ORG_LOCALBIZ": lambda: _has(ORG_TYPES),
    "USES_PRODUCT_OFFER": lambda: _has(PRODUCT_TYPES) | _has_key(PRICE_KEYS),
    "USES_AGG_RATING": lambda: _has(["aggregaterating"]) | _has_key(RATING_KEYS),
    "USES_FAQ": lambda: _has(FAQ_TYPES),
    "USES_BREADCRUMB": lambda: _has(["breadcrumblist"]),
    "CLAIMED_BRANDS": lambda: F.size("p.same_as"),
    "META_DESC_LEN": lambda: F.length("p.meta_desc"),
    "META_DESC_WORDS": lambda: T.spaced_words("p.meta_desc"),
    "META_DESC_VARS": lambda: T.vcount("p.meta_desc", VARS),
    "META_KEYWORDS": lambda: F.size(F.filter(F.split("p.meta_keywords", ","), lambda k: F.trim(k) != "")),
    "HAS_DOCTYPE": lambda: F.startswith(F.lower(F.regexp_replace("html", r"^\s+", "")), F.lit("<!doctype")),
    "HAS_FORM": lambda: P("p.has_form"),
    "HAS_VIDEO": lambda: P("p.has_video"),
    "HAS_PRIVACY": lambda: F.exists("p.links", lambda x: F.lower(F.concat(x["href"], F.lit(" "), x["text"])).contains("privacy")),
    "HAS_EMAIL": lambda: F.lower("html").contains("mailto:") | P("html").rlike(EMAIL),
    "LOAD_MS": lambda: F.coalesce("load_ms", F.lit(0.0)),
}


def _outside(host: Column) -> Column:
    return (host != "") & (T.registrable_trust(host) != T.registrable_trust(F.coalesce(T.host_of("url"), F.lit(""))))


def _byline() -> Column:
    return P("p.has_author_mark") | P("p.full_text").rlike(BYLINE)


TRUST: dict[str, Callable[[], Column]] = {
    "TRUST_BYLINE": _byline,
    "TRUST_AUTHOR_PAGE": lambda: _byline() & P("p.has_author_link"),
    "TRUST_PERSON_SCHEMA": lambda: _any_of(P("p.jsonld_types"), ["person"]),
    "TRUST_ORG_SCHEMA": lambda: _any_of(P("p.jsonld_types"), ["organization", "corporation", "localbusiness"]),
    "TRUST_SAMEAS": lambda: F.size(F.filter("p.same_as", lambda u: F.coalesce(_outside(T.host_of(u)), F.lit(False)))),
    "TRUST_OUTBOUND_CITATIONS": lambda: F.least(F.size(F.filter("p.links", lambda x: _outside(x["host"]) & ~T.registrable_trust(x["host"]).isin(TRUST_SOCIAL))), F.lit(50)),
    "TRUST_CONTACT_LINK": lambda: F.exists("p.links", lambda x: ~_outside(x["host"]) & F.lower(F.concat(x["href"], F.lit(" "), x["text"])).rlike("contact|about|impressum")),
    "TRUST_VISIBLE_DATE": lambda: P("p.has_date_mark"),
}

#: Over (domain, url, title, snippet, displayed_url, vars).
SERP: dict[str, Callable[[], Column]] = {
    "SR_DOMAIN_COM": lambda: F.try_element_at(F.split(F.lower("domain"), r"\."), F.lit(-1)).isin("com", "net", "org"),
    "SR_DOMAIN_HYPHEN": lambda: P("domain").contains("-"),
    "SR_DOMAIN_LEN": lambda: F.length("domain"),
    "SR_URL_HAS_YEAR": lambda: P("url").rlike(r"(?:19|20)\d\d"),
    "SR_SUMMARY_LEN": lambda: F.length(F.coalesce("snippet", F.lit(""))),
    "SR_TITLE_VARS": lambda: T.vcount("title", VARS),
    "SR_URL_VARS": lambda: T.vcount(F.coalesce(F.nullif(P("displayed_url"), F.lit("")), F.translate(F.concat(F.coalesce(T.host_of("url"), F.lit("")), T.path_of("url")), "/-", "  ")), VARS),
    "SR_SUMMARY_VARS": lambda: T.vcount("snippet", VARS),
}


def long_form(rows: DataFrame, columns: dict[str, Callable[[], Column]], keys: list[str]) -> DataFrame:
    """keys, factor_id, value; a null value is no row, since not measured isn't zero."""
    every = F.array(*[F.struct(F.lit(k).alias("factor_id"), c().cast("double").alias("value")) for k, c in columns.items()])
    return rows.select(*keys, F.explode(every).alias("f")).select(*keys, "f.factor_id", "f.value").filter("value is not null")


def page_factors(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """HTML, schema and trust factors of parsed pages that were fetched; a text's words, sentences and syllables are counted once for all of them."""
    counted = parsed.withColumns({f"__{k}": c() for k, c in TEXT.items()})
    known = {name: lambda of=of: of(*[F.col(f"__{k}") for k in TEXT]) for name, of in OF_TEXT.items()}
    return long_form(counted, HTML | TRUST | known, keys)


def serp_factors(items: DataFrame, keys: list[str]) -> DataFrame:
    return long_form(items, SERP, keys)
