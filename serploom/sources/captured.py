"""Readers of captured provider payloads. Acquisition is apart from analysis: a provider only has to write such rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from serploom.functions import text as T
from serploom.operators import compare

# Provider location codes by country.
LOCATIONS = {"us": 2840, "uk": 2826, "gb": 2826, "au": 2036, "ca": 2124, "in": 2356, "de": 2276, "fr": 2250}
CRUX = ["largest_contentful_paint", "interaction_to_next_paint", "cumulative_layout_shift"]

SERP = "results array<struct<url:string,organic_rank:string,position:string,title:string,snippet:string,displayed_url:string>>"
DATED = "tasks array<struct<cost:double,result:array<struct<datetime:string,items:array<struct<type:string,url:string,domain:string,rank_group:int,title:string,datetime:string>>>>>>"
BULK = "results array<struct<target:string,authority_score:double,referring_domains:int,total_backlinks:int,follow:int,nofollow:int>>"
LINKS = "backlinks_total int, backlinks array<struct<source_url:string,anchor:string,is_nofollow:boolean,source_ascore:double,domain_ascore:double,first_seen:string>>"
KEYWORDS = "keywords array<struct<phrase:string,volume:double,position:int,traffic:double>>"
AUTHORITY_ROW = "struct<domain:string,authority_score:double,total_backlinks:int,referring_domains:int,visits:double,prev_visits:double,traffic:struct<visits:double,prev_visits:double>>"


def location_code(country: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LOCATIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(T.col(country))), F.lit(LOCATIONS["us"]))


def _parsed(raw: DataFrame, schema: str, payload: str) -> DataFrame:
    return raw.withColumn("__j", F.from_json(payload, schema))


def serp_items(raw: DataFrame, keys: list[str], payload: str = "payload", most: int | None = None) -> DataFrame:
    """keys, rank, url, domain, title, snippet, displayed_url: http results with a host and a rank, best per domain."""
    rows = _parsed(raw, SERP, payload).select(*keys, F.posexplode("__j.results").alias("pos", "r")).select(*keys, "pos", "r.*")
    out = compare.best_per_domain(compare.valid_items(rows).drop("organic_rank", "position"), keys, "pos")
    return out if most is None else first_items(out, keys, most)


def first_items(items: DataFrame, keys: list[str], most: int) -> DataFrame:

    place = F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "domain"))
    return items.withColumn("__n", place).filter(F.col("__n") <= most).drop("__n")


def dated_items(raw: DataFrame, keys: list[str], payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(items with their snapshot date, costs): organic rows of dated snapshots; they carry neither snippet nor displayed_url."""
    j = _parsed(raw, DATED, payload)
    result = j.select(*keys, F.explode("__j.tasks").alias("t")).select(*keys, F.explode("t.result").alias("s"))
    items = result.select(*keys, F.substring("s.datetime", 1, 10).alias("snapshot_date"), F.posexplode("s.items").alias("pos", "i")).filter("i.type = 'organic'")
    flat = items.select(*keys, "snapshot_date", "pos", "i.url", F.coalesce(T.host_of("i.url"), F.lower("i.domain")).alias("domain"), F.col("i.rank_group").alias("rank"), "i.title")
    costs = j.select(*keys, F.explode_outer("__j.tasks").alias("t")).groupBy(*keys).agg(F.coalesce(F.sum("t.cost"), F.lit(0.0)).alias("cost"))
    return compare.best_per_domain(flat.filter("rank is not null and domain <> ''"), [*keys, "snapshot_date"], "pos"), costs


def bulk_stats(raw: DataFrame, targets: str = "targets", payload: str = "payload") -> DataFrame:
    """target and its numbers; a row without an echoed target is the one asked for at its position."""
    j = _parsed(raw, BULK, payload).select(targets, F.posexplode("__j.results").alias("pos", "r"))
    return j.select(F.coalesce(F.nullif("r.target", F.lit("")), F.get(targets, F.col("pos"))).alias("target"), *[F.col(f"r.{c}") for c in ("authority_score", "referring_domains", "total_backlinks", "follow", "nofollow")]).filter("target is not null")


def backlinks(raw: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    j = _parsed(raw, LINKS, payload).select(*keys, F.explode("__j.backlinks").alias("b"))
    return j.select(*keys, F.col("b.source_url").alias("source_url"), T.host_of("b.source_url").alias("source_domain"), "b.anchor", (~F.coalesce("b.is_nofollow", F.lit(False))).alias("dofollow"), F.coalesce("b.source_ascore", "b.domain_ascore").alias("source_authority"), "b.first_seen")


def ranked_keywords(raw: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    j = _parsed(raw, KEYWORDS, payload).select(*keys, F.posexplode("__j.keywords").alias("ord", "k"))
    return j.select(*keys, "ord", "k.*").filter(T.strip(F.coalesce("phrase", F.lit(""))) != "")


def domain_authority(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """domain (without www.) and its numbers from a list of rows or a map by domain; visits inside or beside ``traffic``."""
    listed = F.from_json(payload, f"array<{AUTHORITY_ROW}>")
    mapped = F.map_entries(F.from_json(payload, f"map<string,{AUTHORITY_ROW}>"))
    is_list = F.regexp_extract(F.ltrim(payload), r"^(.)", 1) == "["
    rows = raw.select(F.explode(F.when(is_list, F.transform(listed, lambda r: F.struct(r["domain"].alias("key"), r.alias("value")))).otherwise(F.transform(mapped, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))).alias("e"))
    v = F.col("e.value")
    visits, before = F.coalesce(v["visits"], v["traffic"]["visits"]), F.coalesce(v["prev_visits"], v["traffic"]["prev_visits"])
    return rows.select(F.regexp_replace(F.lower(F.coalesce(v["domain"], F.col("e.key"))), r"^www\.", "").alias("domain"), v["authority_score"].alias("authority_score"), v["total_backlinks"].alias("total_backlinks"), v["referring_domains"].alias("referring_domains"), visits.alias("visits"), T.trend_percent(visits, before).alias("trend_pct"))


def crux(raw: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """keys and the four field-data factors; a payload without any metric has only the marker, 0."""
    at = lambda m: T.number(F.get_json_object(payload, f"$.record.metrics.{m}.percentiles.p75"))
    out = raw.select(*keys, at(CRUX[0]).alias("CRUX_LCP_MS"), at(CRUX[1]).alias("CRUX_INP_MS"), (at(CRUX[2]) * 100).alias("CRUX_CLS"))
    return out.withColumn("CRUX_HAS_DATA", F.coalesce("CRUX_LCP_MS", "CRUX_INP_MS", "CRUX_CLS").isNotNull().cast("double"))


def embeddings(raw: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """keys, index, embedding of a batch reply; a batch with ragged or non-finite vectors gives none."""
    j = _parsed(raw, "data array<struct<index:int,embedding:array<double>>>", payload)
    sizes = F.array_distinct(F.transform("__j.data", lambda d: F.size(d["embedding"])))
    finite = F.forall("__j.data", lambda d: F.forall(d["embedding"], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return j.filter((F.size(sizes) == 1) & finite).select(*keys, F.explode("__j.data").alias("d")).select(*keys, "d.index", "d.embedding")


def captured_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages in Parquet, with the columns that a capture may lack."""
    df = spark.read.parquet(path)
    missing = {"final_url": "string", "status_code": "int", "load_ms": "double", "ok": "boolean", "error": "string", "via": "string"}
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in df.columns})
    return df.withColumn("ok", F.coalesce("ok", F.lit(True)) & (F.length(F.coalesce("html", F.lit(""))) > 0))
