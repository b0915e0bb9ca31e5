"""Quality rules: a threshold table compiled into one projection of built-in Spark functions.

Every measure is an expression over the text, every rule compares measures, and all of them go into one select: no
user function, no shuffle, one pass. Words are the runs of characters other than space and U+0009 to U+000D.

Defined results: null text is empty text: all counts 0, base failed, not kept. Empty texts likewise. Repeated rows are
judged alike; other columns are ignored; texts are read whole. Windows of three words are told apart by two
independent 64 and 32 bit hashes of theirs, not by their text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom.llm.common import SPACES, check_columns

SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Very frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by at from this an a not or have had "
    "le la les de des du un une et en que qui pour dans par sur est au avec pas "
    "der die das und von zu den mit ist im nicht ein eine als auf dem für sich "
    "el los las una y del se por con para su al lo es como más"
).split()


@dataclass(frozen=True)
class Threshold:
    """The rule holds if low * of <= 100 * measure <= high * of; None is no bound."""

    name: str
    measure: str
    of: str
    low: int | None = None
    high: int | None = None


#: The method's table; shares in hundredths, so that only integers are compared.
TABLE = (
    Threshold("word length", "word_chars", "n_words", low=200, high=1500),
    Threshold("symbols", "n_symbols", "n_words", high=20),
    Threshold("stop words", "n_stop", "n_words", low=2),
    Threshold("duplicate lines", "n_dup_lines", "n_lines", high=50),
)


def measures() -> dict[str, Column]:
    """n_words and the others, from the columns words, lines and text."""
    n = F.size("words")
    windows = F.transform(
        F.slice("words", 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(
            F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), F.hash(w, F.get("words", i + 1), F.get("words", i + 2)).alias("g"), i.alias("i")
        ),
    )
    return {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate("text", SPACES, "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_stop": F.size(F.filter("words", lambda w: F.translate(w, UPPER, LOWER).isin(STOP_WORDS))).cast("long"),
        "windows": F.sort_array(windows),
    }


def repeated_words() -> Column:
    """Words that lie in a window found twice or more, from ``windows`` in order: neighbours with equal hashes are found twice."""
    same = lambda a, b: (a["h"] == b["h"]) & (a["g"] == b["g"])
    twice = F.filter("windows", lambda x, k: F.coalesce(same(x, F.get("windows", k - 1)), F.lit(False)) | F.coalesce(same(x, F.get("windows", k + 1)), F.lit(False)))
    covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.size(F.array_distinct(covered)).cast("long")


def compiled(table: tuple[Threshold, ...] = TABLE) -> Column:
    """All rules of the table as one condition."""
    holds = F.lit(True)
    for t in table:
        if t.low is not None:
            holds &= 100 * F.col(t.measure) >= t.low * F.col(t.of)
        if t.high is not None:
            holds &= 100 * F.col(t.measure) <= t.high * F.col(t.of)
    return holds


def judge(docs: DataFrame, min_words: int = 50, most_repeated: int = 50, table: tuple[Threshold, ...] = TABLE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = check_columns(docs, "doc_id", "text").select(
        "doc_id",
        text.alias("text"),
        F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0).alias("lines"),
    )
    counted = cut.select("doc_id", *[c.alias(n) for n, c in measures().items()]).withColumn("n_repeat_words", repeated_words())
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & compiled(table)).alias("kept"))
