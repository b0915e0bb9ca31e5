"""The queries of this subpackage, with production parameters over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from serploom.llm import brown, centroids, collocations, decontam, langid, mixing, qrules, quality, secretscan, shards, simhash, urlfilter, warc
from serploom.session import scan

RULES = [
    urlfilter.Rule("block", "net", "/"),
    urlfilter.Rule("allow", "example.net", "/en/"),
    urlfilter.Rule("block", "example.com", "/de/"),
    urlfilter.Rule("allow", "org", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet", name in ("documents", "pages"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), mixing.by_power(0.5))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qrules.judge(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.perplexity(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_simhash_dedup, op3_url_filter, op4_source_mix, op5_secret_scan, op6_quality_rules, op7_warc, op8_decontamination, op9_lm_scoring, op10_quality_classifier,
        op11_collocations, op12_centroid_clusters, op13_feistel_shards,
    )
}

#: What op12 starts from and ends with.
_CLUSTERS, _ROUNDS, _PARTS = 8, 10, 64
_WORD = r"[^\x20\x09-\x0D]+"
_STOP = ", ".join(f"'{w}'" for w in qrules.STOP_WORDS)
_LOWER = f"'{qrules.UPPER}', '{qrules.LOWER}'"

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": rf"""
        WITH p AS (
            SELECT page_id, coalesce(url, '') AS u FROM pages
        ), s AS (
            SELECT page_id,
                   translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {_LOWER}) AS host,
                   regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
            FROM p
        ), r(verdict, rhost, rpath) AS (
            VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
        ), best AS (
            SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule,
                   arg_max(verdict, length(rhost || rpath) * 1000 + length(rhost)) AS verdict
            FROM s JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
            GROUP BY page_id
        )
        SELECT s.page_id, s.host, s.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
        FROM s LEFT JOIN best USING (page_id)""",
    "op6_quality_rules": rf"""
        WITH w AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), win AS (
            SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)
        ), twice AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id
        ), m AS (
            SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                   length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
                   len(list_filter(ws, lambda x: translate(x, {_LOWER}) IN ({_STOP}))) AS n_stop,
                   coalesce(covered.n, 0) AS n_repeat_words
            FROM w LEFT JOIN covered USING (doc_id)
        ), f AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
        )
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
               n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
               NOT base_failed AND 100 * word_chars >= 200 * n_words AND 100 * word_chars <= 1500 * n_words
               AND 100 * n_symbols <= 20 * n_words AND 100 * n_stop >= 2 * n_words AND 100 * n_dup_lines <= 50 * n_lines AS kept
        FROM f""",
    "op7_warc": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h FROM pages
        ), d AS (
            SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p
        )
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(x, ((i // 4) * 5 + 1)::INT, 5))::INT >> (5 * (3 - i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d""",
    "op11_collocations": rf"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
        ), total AS (
            SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang
        ), grams AS (
            SELECT lang, m, g, count(*) AS f FROM (
                SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: ws[i : i + m - 1])) AS g FROM w, range(1, 5) AS s(m)
            ) GROUP BY lang, m, g
        ), c AS (
            SELECT lang, m, g, f AS a FROM grams WHERE m >= 2 AND f >= 30
        ), longer AS (
            SELECT lang, g[i : j] AS part, max(a) AS b FROM c, range(1, 4) AS s(i), range(2, 5) AS t(j) WHERE i < j AND j <= m AND j - i + 1 < m GROUP BY lang, part
        ), kept AS (
            SELECT c.* FROM c LEFT JOIN longer ON c.lang = longer.lang AND c.g = longer.part WHERE b IS NULL OR 100 * b < 80 * a
        ), cuts AS (
            SELECT kept.*, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
            FROM kept, range(1, 4) AS t(k)
            JOIN grams x ON x.lang = kept.lang AND x.g = kept.g[1 : k] JOIN grams y ON y.lang = kept.lang AND y.g = kept.g[k + 1 : kept.m] WHERE k < kept.m
        ), best AS (
            SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
        )
        SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
        ) JOIN total USING (lang) WHERE rank <= 2000""",
    "op12_centroid_clusters": f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = {_PARTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {_PARTS}
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL ORDER BY c LIMIT {_CLUSTERS}
        ), """
    + ", ".join(
        f"""a{k} AS MATERIALIZED (
            SELECT id, arg_min(c, d * {_CLUSTERS} + c) AS c, min(d) AS d FROM (
                SELECT id, c, list_sum(list_transform(list_zip(kept.v, c{k}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{k}
            ) GROUP BY id
        ), s{k} AS MATERIALIZED (
            SELECT c, list(m ORDER BY i) AS v FROM (
                SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
                FROM (SELECT c, unnest(v) AS x, unnest(range({_PARTS})) AS i FROM a{k} JOIN kept USING (id)) GROUP BY c, i
            ) GROUP BY c
        ), c{k + 1} AS MATERIALIZED (
            SELECT c{k}.c, coalesce(s{k}.v, c{k}.v)::BIGINT[] AS v FROM c{k} LEFT JOIN s{k} USING (c)
        )"""
        for k in range(_ROUNDS + 1)
    )
    + f"""
        SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c{_ROUNDS}.v, ',')) AS centroid_sha256
        FROM a{_ROUNDS} JOIN kept USING (id) JOIN c{_ROUNDS} USING (c)""",
}
