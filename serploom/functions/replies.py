"""Parsers of captured model replies: balanced JSON, tagged lines, mapping lines."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from serploom.functions import text as T


def first_balanced(text: str | None, opening: str = "{") -> str | None:
    """The first balanced object (or array) outside strings, code fences removed; None if none closes."""
    body = re.sub(r"```[a-zA-Z]*", "", text or "")
    closing = {"{": "}", "[": "]"}[opening]
    start = body.find(opening)
    while start >= 0:
        depth, quoted, k = 0, False, start
        while k < len(body):
            ch = body[k]
            if quoted:
                k += ch == "\\"
                quoted = ch != '"'
            elif ch == '"':
                quoted = True
            elif ch == opening:
                depth += 1
            elif ch == closing:
                depth -= 1
                if not depth:
                    return body[start : k + 1]
            k += 1
        start = body.find(opening, start + 1)
    return None


def salvage_array(text: str | None) -> str | None:
    """A complete JSON array, else the whole objects of one that was cut off; None if there is none."""
    whole = first_balanced(text, "[")
    if whole:
        return whole
    body = text or ""
    start, found = body.find("["), []
    rest = body[start + 1 :] if start >= 0 else ""
    while part := first_balanced(rest, "{"):
        try:
            found.append(json.loads(part))
        except ValueError:
            pass
        rest = rest[rest.find(part) + len(part) :]
    return json.dumps(found) if found else None


@F.pandas_udf(StringType())
def reply_object(replies: pd.Series) -> pd.Series:
    return pd.Series([first_balanced(r) for r in replies], dtype=object)


@F.pandas_udf(StringType())
def reply_array(replies: pd.Series) -> pd.Series:
    return pd.Series([salvage_array(r) for r in replies], dtype=object)


def without_thoughts(reply: Column | str) -> Column:
    return F.regexp_replace(T.col(reply), r"(?s)<think>.*?</think>", "")


def tagged_lines(replies: DataFrame, keys: list[str], reply: str = "reply", most: int = 40) -> tuple[DataFrame, DataFrame]:
    """(entities, triples) of replies of lines ``E;name;type;salience``, ``T;entity;attribute;value``, ``R;entity;relation;target``.

    Bars count as line ends. Lines of other shapes are left out; entities beyond ``most`` of a page, too.
    """
    lines = replies.select(*keys, F.posexplode(F.split(F.translate(without_thoughts(reply), "|", "\n"), "\n")).alias("ord", "line"))
    cut = lines.select(*keys, "ord", F.transform(F.split("line", ";"), T.strip).alias("p")).filter(F.size("p") >= 4)
    tag = F.upper(F.get("p", F.lit(0)))
    named = F.get("p", F.lit(1)) != ""
    entities = cut.filter((tag == "E") & named).select(*keys, "ord", F.get("p", F.lit(1)).alias("name"), F.get("p", F.lit(2)).alias("type"), F.coalesce(T.clamp(F.get("p", F.lit(3)), 0.0, 1.0), F.lit(0.0)).alias("salience"))

    entities = entities.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).filter(F.col("__n") <= most).drop("__n")
    triples = cut.filter(tag.isin("T", "R") & named).select(*keys, "ord", F.get("p", F.lit(1)).alias("entity"), F.get("p", F.lit(2)).alias("attribute"), F.get("p", F.lit(3)).alias("value"), (tag == "R").alias("is_edge"))
    return entities, triples


def mapping_lines(replies: DataFrame, known: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """keys, raw, canonical of ``raw => canonical`` lines whose raw name is in ``known`` (attribute); identities go."""
    lines = replies.select(*keys, F.explode(F.split(F.col(reply), "\n")).alias("line")).filter(F.contains("line", F.lit("=>")))
    cut = lines.select(*keys, T.norm_attr(F.split_part("line", F.lit("=>"), F.lit(1))).alias("raw"), T.norm_attr(F.split_part("line", F.lit("=>"), F.lit(2))).alias("canonical"))
    good = cut.filter((F.col("raw") != "") & (F.col("canonical") != "") & (F.col("raw") != F.col("canonical")))
    return good.join(known.select(F.col("attribute").alias("raw")).distinct(), "raw", "left_semi").groupBy(*keys, "raw").agg(F.min("canonical").alias("canonical"))
