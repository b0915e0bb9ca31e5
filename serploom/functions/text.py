"""Scalar kernels as column expressions: variations, tokens, sentences, hosts, names, values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the variation builder.
KEYWORD_STOP = "the a an and or of to in for on with at by from is it as be are your you best top".split()
# Attribute aliases, second-level suffixes, stem endings in the order they are tried.
ATTRIBUTE_ALIASES = {"cost": "price", "pricing": "price", "delivery time": "delivery", "shipping": "delivery", "phone number": "telephone", "opening hours": "hours", "hours of operation": "hours"}
SECOND_LEVEL = ["com", "co", "net", "org", "gov", "edu", "ac"]
STEM_ENDINGS = ["ings", "ing", "ers", "er", "es", "s"]
# Attribute families, in the order they are tried.
FAMILIES = [
    ("rating", "rating|review_score|stars"),
    ("price", "price|cost|rate\\b|_rate|fee|pricing|charge"),
    ("address", "address|street_|location$"),
    ("phone", "phone|telephone|mobile|contact_number"),
    ("email", "email|e_mail"),
    ("hours", "hours|opening_time|session_time|schedule"),
    ("warranty", "warranty|guarantee"),
    ("experience", "experience|years_in|established|founded|qualified_since"),
]
# Coarse entity classes by contained word, in the order they are tried.
TYPE_CLASSES = [
    ("person", "person people trainer coach author doctor founder instructor"),
    ("loc", "location place city suburb region country area state neighborhood neighbourhood"),
    ("org", "company organization organisation brand business manufacturer retailer gym studio clinic agency provider school college university platform marketplace facility centre center"),
    ("product", "product model item device tool equipment"),
    ("service", "service procedure treatment program class activity"),
]
# Signs of a bot wall.
BLOCK_MARKERS = ["just a moment", "cf-browser-verification", "attention required", "enable javascript", "captcha-delivery", "px-captcha"]
# Fixed value: what may stand between two words of a term.
TERM_GAP = r"(?:\W+\w*?){0,2}?"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """All white space off both ends; SQL's trim takes spaces only. No pattern: it would be tried at every character in between."""
    return F.btrim(col(x), F.lit(" \t\n\x0b\f\r"))


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z0-9']+)"), F.lit(1))


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.size(tokens(text)), F.lit(0))


def spaced_words(text: Column | str) -> Column:
    """Number of white-space separated words, 0 for blank."""
    t = strip(text)
    return F.when(F.coalesce(t, F.lit("")) == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def sentences(text: Column | str) -> Column:
    return F.filter(F.split(strip(text), r"(?<=[.!?])\s+"), lambda s: strip(s) != "")


def phrase_of(keyword: Column | str) -> Column:
    """The keyword's tokens joined by spaces: punctuation in it is never looked for."""
    return F.array_join(tokens(keyword), " ")


def variations(keyword: Column | str) -> Column:
    """Phrase, content words, bigrams and trigrams, content phrase; longest first, then by text."""
    toks = tokens(keyword)
    phrase = phrase_of(keyword)
    content = F.filter(toks, lambda t: (F.length(t) > 2) & ~t.isin(KEYWORD_STOP))

    def grams(n: int) -> Column:
        return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(toks, i, n)))).otherwise(F.array().cast("array<string>"))

    every = F.filter(F.array_distinct(F.concat(F.array(phrase), content, grams(2), grams(3), F.array(F.concat_ws(" ", content)))), lambda v: v != "")
    return F.array_sort(every, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def _pattern(v: Column) -> Column:
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), v, F.lit(r"\E(?![\p{L}\p{N}_])"))


def _hits(low: Column, v: Column) -> Column:
    """Whole-word matches; the pattern only runs on texts that hold the words at all, which most don't."""
    return F.when(F.contains(low, v), F.regexp_count(low, _pattern(v))).otherwise(0)


def _once(value: Column, of) -> Column:
    """``of`` a column that is made once: inside a lambda a plain one is made again for every element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def vcount(text: Column | str, vars_: Column | str) -> Column:
    """Whole-word matches summed over the variations; overlapping variations each count."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return _once(low, lambda t: F.aggregate(col(vars_), F.lit(0), lambda n, v: n + _hits(t, v)))


def exact_count(text: Column | str, phrase: Column | str) -> Column:
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.when(F.coalesce(col(phrase), F.lit("")) == "", 0).otherwise(F.regexp_count(low, F.concat(F.lit(r"\Q"), F.lower(col(phrase)), F.lit(r"\E"))))


def unique_used(text: Column | str, vars_: Column | str) -> Column:
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return _once(low, lambda t: F.size(F.filter(col(vars_), lambda v: _hits(t, v) > 0)))


def leads(text: Column | str, vars_: Column | str) -> Column:
    """Starts with a variation; no word boundary behind it is asked for."""
    low = F.lower(strip(F.coalesce(col(text), F.lit(""))))
    return F.exists(col(vars_), lambda v: F.startswith(low, v))


def first_offset(text: Column | str, vars_: Column | str) -> Column:
    """Characters before the earliest variation; null without one."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.array_min(F.filter(F.transform(col(vars_), lambda v: F.when(F.contains(low, v), F.regexp_instr(low, _pattern(v)) - 1)), lambda x: x >= 0))


# --- hosts and urls: five different "registrable" functions, deliberately not merged


def _labels(host: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.trim(host)), r"^www\.", ""), r"\."), lambda p: p != "")


def _last(parts: Column, n: int) -> Column:
    return F.try_element_at(parts, F.lit(-n))


def registrable_label(domain: Column | str) -> Column:
    p = _labels(col(domain))
    short = (F.size(p) >= 3) & (F.length(_last(p, 2)) <= 3) & (F.length(_last(p, 1)) <= 3)
    return F.coalesce(F.when(short, _last(p, 3)).when(F.size(p) >= 2, _last(p, 2)).otherwise(_last(p, 1)), F.lit(""))


def _tail(p: Column, n: int) -> Column:
    return F.concat_ws(".", F.slice(p, F.greatest(F.size(p) - n + 1, F.lit(1)), F.lit(n)))


def registrable_domain(domain: Column | str) -> Column:
    p = _labels(col(domain))
    short = (F.size(p) >= 3) & (F.length(_last(p, 2)) <= 3) & (F.length(_last(p, 1)) <= 3)
    return F.coalesce(F.when(short, _tail(p, 3)).otherwise(_tail(p, 2)), F.lit(""))


def registrable_trust(host: Column | str) -> Column:
    """As registrable_domain, port and outer dots taken off first."""
    return registrable_domain(F.regexp_replace(F.split_part(F.lower(col(host)), F.lit(":"), F.lit(1)), r"^\.+|\.+$", ""))


def registrable_compare(domain: Column | str) -> Column:
    """The last two labels, whatever they are."""
    return F.coalesce(_tail(_labels(col(domain)), 2), F.lit(""))


def sld_label(domain: Column | str) -> Column:
    """Label before the suffix; two-part suffixes of a known second level under a country code count as one."""
    p = F.filter(F.split(F.lower(col(domain)), r"\."), lambda x: x != "")
    two = (F.size(p) >= 3) & _last(p, 2).isin(SECOND_LEVEL) & (F.length(_last(p, 1)) == 2)
    return F.coalesce(F.when(two, _last(p, 3)).when(F.size(p) >= 2, _last(p, 2)).otherwise(_last(p, 1)), F.lit(""))


def first_label(host: Column | str) -> Column:
    return F.split_part(F.regexp_replace(F.lower(col(host)), r"^www\.", ""), F.lit("."), F.lit(1))


def host_of(url: Column | str) -> Column:
    """Lower-case host without www.; null on garbage."""
    return F.regexp_replace(F.lower(F.try_parse_url(col(url), F.lit("HOST"))), r"^www\.", "")


def origin_of(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)


def path_of(url: Column | str) -> Column:
    return F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit(""))


def norm_url(url: Column | str) -> Column:
    """Host and path, without scheme, www., query and closing slash."""
    return F.concat(F.coalesce(host_of(url), F.lit("")), F.regexp_replace(path_of(url), r"/+$", ""))


def slug_text(url: Column | str) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(path_of(url), r"(?i)\.(html?|php|aspx?)$", ""), "[-_/]+", " ")))


def origin_of(url: Column | str) -> Column:
    """scheme://host:port of an absolute url, else null."""
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)"
    return F.when(col(url).rlike(shape), F.concat(F.lower(F.regexp_extract(col(url), shape, 1)), F.lit("://"), F.regexp_extract(col(url), shape, 2)))


def topic_from_url(url: Column | str) -> Column:
    """The last path segment that isn't a number, in words."""
    parts = F.filter(F.split(F.regexp_replace(path_of(url), r"\.[a-z0-9]{2,5}$", ""), "/"), lambda s: (s != "") & ~s.rlike(r"^\d+$"))
    return F.trim(F.regexp_replace(F.coalesce(_last(parts, 1), F.lit("")), r"[-_]+", " "))


# --- names, attributes and values


def canon(name: Column | str) -> Column:
    """Entity key: lower, punctuation to spaces, plural s off the last word (over 3 letters, not ss or is)."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(name)), r"(?U)[^\w\s]|_", " "), r"\s+", " "))
    return F.when(t.rlike(r"[^ ]{3,}s$") & ~t.rlike(r"(ss|is)$"), F.regexp_replace(t, "s$", "")).otherwise(t)


def norm_attr(attribute: Column | str) -> Column:
    spaced = F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(attribute)), "[_-]+", " "), r"\s+", " "))
    alias = F.create_map(*[F.lit(x) for pair in ATTRIBUTE_ALIASES.items() for x in pair])
    snake = F.regexp_replace(F.coalesce(F.try_element_at(alias, spaced), spaced), r"[^a-z0-9]+", "_")
    return F.regexp_replace(snake, "^_+|_+$", "")


def attr_family(attribute: Column | str) -> Column:
    a, out = col(attribute), None
    for name, pattern in FAMILIES:
        out = F.when(a.rlike(pattern), name) if out is None else out.when(a.rlike(pattern), name)
    return out.otherwise(a)


def type_class(kind: Column | str) -> Column:
    t, out = F.lower(F.coalesce(col(kind), F.lit(""))), None
    for name, words in TYPE_CLASSES:
        hit = t.rlike("|".join(words.split()))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def stem(token: Column | str) -> Column:
    t, out = col(token), None
    for end in STEM_ENDINGS:
        hit = F.endswith(t, F.lit(end)) & (F.length(t) > len(end) + 2)
        cut = F.regexp_replace(t, f"{end}$", "")
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(t)


def squeeze(text: Column | str) -> Column:
    return strip(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"\s+", " "))


def first_number(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(col(text), r"(-?\d[\d,]*\.?\d*)", 1), ",", "").try_cast("double")


def values_match(a: Column | str, b: Column | str) -> Column:
    """Both numbers: relative difference of at most 15 percent; else either contains the other. Empty matches nothing."""
    x, y, p, q = first_number(a), first_number(b), squeeze(a), squeeze(b)
    top = F.greatest(F.abs(x), F.abs(y))
    numeric = F.when(top == 0, F.lit(True)).otherwise(F.abs(x - y) <= 0.15 * top)
    return F.when((p == "") | (q == ""), False).when(x.isNotNull() & y.isNotNull(), numeric).otherwise(F.contains(p, q) | F.contains(q, p))


def alnum(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9]", "")


def brand_term(domain: Column | str) -> Column:
    return F.trim(F.regexp_replace(sld_label(domain), "[-_]+", " "))


def number(x: Column | str) -> Column:
    """Double, null on garbage, NaN and infinities."""
    v = col(x).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def clamp(x: Column | str, low: float, high: float) -> Column:
    """Within low and high; low on garbage."""
    return F.least(F.greatest(number(x), F.lit(low)), F.lit(high))


def dofollow_ratio(follow: Column | str, nofollow: Column | str) -> Column:
    return F.try_divide(number(follow), F.nullif(number(follow) + number(nofollow), F.lit(0.0)))


def trend_percent(visits: Column | str, before: Column | str) -> Column:
    v, p = number(visits), number(before)
    return F.when(p > 0, (v - p) / p * 100)


def looks_blocked(html: Column | str) -> Column:
    h = F.coalesce(col(html), F.lit(""))
    return (F.length(strip(h)) < 500) | F.lower(h).rlike("|".join(re.escape(m) for m in BLOCK_MARKERS))


def looks_xml(body: Column | str) -> Column:
    return F.lower(F.substring(col(body), 1, 600)).rlike(r"<\?xml|<urlset|<sitemapindex")


def is_sitemap_index(body: Column | str) -> Column:
    return F.lower(F.substring(col(body), 1, 600)).contains("<sitemapindex")


def content_tokens(text: Column | str) -> Column:
    return F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(KEYWORD_STOP))


def term_pattern(term: Column | str) -> Column:
    """The term's content words as prefixes, in order; null for a term of stop words."""
    words = content_tokens(term)
    return F.when(F.size(words) > 0, F.concat(F.lit(r"\b"), F.array_join(F.transform(words, lambda t: F.concat(t, F.lit(r"\w*"))), TERM_GAP)))


def shown(x: Column | str) -> Column:
    """Whole numbers with separators and no decimals, others with two; null as a dash."""
    v = col(x).cast("double")
    return F.when(v.isNull(), "-").when(v == F.floor(v), F.format_number(v, 0)).otherwise(F.format_number(v, 2))
