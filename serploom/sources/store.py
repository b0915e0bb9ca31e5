"""The runs table and the sinks: keyed rows in Parquet, latest wins; JSON, Markdown and HTML reports."""

from __future__ import annotations

import html as html_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECRET_NAMES = ["api_key", "apikey", "token", "password", "secret", "login", "credential", "credentials"]
RUN = "id string, kind string, status string, label string, created_at timestamp, updated_at timestamp, owner_id string, request string, result string, error string"


def scrubbed(runs: DataFrame, secrets: list[str] | None = None) -> DataFrame:
    """Values of credential-like JSON keys blanked in request and result, and known secrets cut out of all three texts."""
    out = runs
    names = "|".join(SECRET_NAMES)
    for c in ("request", "result"):
        out = out.withColumn(c, F.regexp_replace(c, rf'(?i)("[a-z_]*(?:{names})[a-z_]*"\s*:\s*)"(?:[^"\\]|\\.)*"', '$1""'))
    for c in ("request", "result", "error"):
        for s in secrets or []:
            out = out.withColumn(c, F.replace(c, F.lit(s), F.lit("[redacted]"))) if s else out
    return out


def append(runs: DataFrame, path: str, secrets: list[str] | None = None) -> None:
    """Save run versions; older ones stay until compacted."""
    scrubbed(runs, secrets).write.mode("append").parquet(path)


def latest(versions: DataFrame) -> DataFrame:
    """One row per id, the last saved (of equal times the greatest status); kind, created_at and owner_id stay those of the first."""
    first = F.min_by(F.struct("kind", "created_at", "owner_id"), "updated_at").alias("f")
    last = F.max_by(F.struct("status", "label", "updated_at", "request", "result", "error"), F.struct("updated_at", "status")).alias("l")
    return versions.groupBy("id").agg(first, last).select("id", "f.kind", "l.status", "l.label", "f.created_at", "l.updated_at", "f.owner_id", "l.request", "l.result", "l.error")


def run_by_id(versions: DataFrame, id_: str) -> DataFrame:
    return latest(versions.filter(F.col("id") == id_))


def newest(versions: DataFrame, owner: str | None, most: int = 50) -> DataFrame:
    mine = latest(versions).filter(F.col("owner_id") == owner if owner is not None else F.lit(True))
    return mine.orderBy(F.desc("created_at"), "id").limit(most).drop("result")


def interrupted(versions: DataFrame) -> DataFrame:
    """New versions for runs that were left running."""
    return latest(versions).filter("status = 'running'").withColumns({"status": F.lit("failed"), "error": F.lit("interrupted"), "updated_at": F.current_timestamp()})


def copy_missing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of an old table whose id the new one lacks."""
    return old.join(new.select("id"), "id", "left_anti")


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def html_table(df: DataFrame, title: str, most: int = 500) -> str:
    """A report page of a small result on the driver; ``most`` rows are shown, and it says if there are more."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: f"<td>{html_.escape('' if v is None else str(v))}</td>"
    body = "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows[:most])
    more = f"<p>The first {most} rows.</p>" if len(rows) > most else ""
    return f"<!doctype html><meta charset=utf-8><title>{html_.escape(title)}</title><h1>{html_.escape(title)}</h1><table><tr>{''.join(f'<th>{html_.escape(c)}</th>' for c in df.columns)}</tr>{body}</table>{more}"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).parquet(path)


def ordinal(df: DataFrame, by: list[str], *order) -> DataFrame:
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
