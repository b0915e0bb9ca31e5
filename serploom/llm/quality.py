"""Quality classification by compression.

Two zstandard dictionaries are trained on text labelled good and bad. A text is cut into pieces of PIECE bytes, each is
compressed with either dictionary, and the normalised difference d = (bad - good) / (bad + good) of the summed sizes says
which it resembles. Text that repeats itself is as small with either dictionary, so the compressed share of its bytes,
r = good / length (at most 1), goes along. A logistic curve in d and r, fitted on labelled rows that the dictionaries
haven't seen, turns them into a score from 0 to 1.

Defined results: null and empty texts have d = 0 and r = 1 and get the curve's value there (about the share of label 1);
repeated rows get equal scores; with no usable label, or labels of one value only, the score is the share of label 1
(0.5 without labels); other columns of the inputs are ignored. Texts are compressed whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serploom.llm.common import arrow_map, check_columns, columns_of, fold, unit_hash
from serploom.shipping import ship

#: Bytes that are compressed at once: short enough for a dictionary to tell.
PIECE = 1024
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    """Raw dictionaries and the logistic curve 1 / (1 + exp(-(a + b d + c r))); a few hundred KB."""

    good: bytes
    bad: bytes
    a: float
    b: float
    c: float

    def score(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a + measures @ [self.b, self.c], -30, 30)))


class Sizer:
    def __init__(self, model: QualityModel) -> None:
        self.tools = [zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False) if d else None for d in map(_dictionary, (model.good, model.bad))]

    def measures(self, texts: list[str | None]) -> np.ndarray:
        """d and r of each text."""
        return np.array([self._measure((t or "").encode("utf-8", "surrogatepass")) for t in texts], float).reshape(-1, 2)

    def _measure(self, data: bytes) -> tuple[float, float]:
        if not data or None in self.tools:
            return 0.0, 1.0
        good, bad = (sum(len(tool.compress(data[k : k + PIECE])) for k in range(0, len(data), PIECE)) for tool in self.tools)
        return (bad - good) / (bad + good), min(1.0, good / len(data))


def _dictionary(raw: bytes) -> zstd.ZstdCompressionDict | None:
    if not raw:
        return None
    made = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_AUTO)
    made.precompute_compress(level=LEVEL)
    return made


def _train(samples: list[bytes], dict_bytes: int) -> bytes:
    """A trained dictionary; with too few samples to train on, their text itself."""
    pieces = [s[k : k + PIECE] for s in samples for k in range(0, len(s), PIECE)]
    try:
        return zstd.train_dictionary(min(dict_bytes, max(1024, sum(map(len, pieces)) // 4)), pieces).as_bytes()
    except zstd.ZstdError:
        return b"".join(pieces)[-dict_bytes:]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-4) -> tuple[float, ...]:
    """Intercept and slopes of a weighted logistic regression, by Newton's method on scaled columns."""
    scale = x.std(0) + 1e-9
    X, beta, w = np.column_stack([np.ones(len(x)), x / scale]), np.zeros(x.shape[1] + 1), w / w.sum()
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        g = X.T @ (w * (p - y)) + ridge * beta
        h = (X * (w * p * (1 - p))[:, None]).T @ X + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        beta -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), *map(float, beta[1:] / scale)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 1200, excerpt_bytes: int = 4096, dict_bytes: int = 98304) -> QualityModel:
    """Learn from doc_id, text of ``docs`` and doc_id, quality (0 or 1) of ``labels``.

    Documented bound of the sample: about ``sample_docs`` labelled rows of either label, chosen by a hash of doc_id over
    all labelled rows, and up to ``excerpt_bytes`` characters of each at an offset the hash chooses. Two thirds train the
    dictionaries, the rest fits the curve, weighted back to the labels' shares. A document with both labels counts as 0.
    """
    known = check_columns(labels, "doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        share = float(sum(k * n for k, n in counts.items()) / sum(counts.values())) if counts else 0.5
        return QualityModel(b"", b"", float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))), 0.0, 0.0)
    share = F.when(F.col("quality") == 1, min(1.0, sample_docs / counts[1])).otherwise(min(1.0, sample_docs / counts[0]))
    picked = known.filter(unit_hash("doc_id", F.lit("label")) < share)
    at = F.floor(unit_hash("doc_id", F.lit("at")) * (F.greatest(F.length("text") - excerpt_bytes, F.lit(0)) + 1)).cast("int")
    part = check_columns(docs, "doc_id", "text").select("doc_id", F.substring(F.col("text"), at + 1, F.lit(excerpt_bytes)).alias("part"))
    # the picked ids are about 2 * sample_docs rows, so this side may be broadcast
    rows = part.join(F.broadcast(picked), "doc_id").filter("length(part) > 0").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["part"]))
    train: dict[int, list[bytes]] = {0: [], 1: []}
    curve: list[tuple[int, str]] = []
    for label in (0, 1):
        for k, r in enumerate([r for r in rows if r["quality"] == label]):
            if k % 3 < 2:
                train[label].append(r["part"].encode("utf-8", "surrogatepass"))
            else:
                # beginnings too, for the curve to hold for short texts
                curve += [(label, r["part"][:n]) for n in (excerpt_bytes, 30, 120, 500)]
    bare = QualityModel(_train(train[1], dict_bytes) if train[1] else b"", _train(train[0], dict_bytes) if train[0] else b"", 0.0, 0.0, 0.0)
    sizer, y = Sizer(bare), np.array([c[0] for c in curve], float)
    if len(set(y)) < 2:
        return QualityModel(bare.good, bare.bad, 0.0, 60.0, 0.0)
    x = sizer.measures([c[1] for c in curve])
    weight = np.where(y == 1, counts[1] / max((y == 1).sum(), 1), counts[0] / max((y == 0).sum(), 1))
    return QualityModel(bare.good, bare.bad, *_logistic(x, y, weight))


@lru_cache(maxsize=2)
def _sizer(model: QualityModel) -> Sizer:
    return Sizer(model)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """All columns of ``docs`` but text, and ``score``; repeated names in ``docs`` are not allowed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [n for n in docs.columns if n not in ("text", "score")]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols, m = columns_of(batch), shared.value
        p = m.score(_sizer(m).measures(cols["text"].to_pylist()))
        return pa.RecordBatch.from_arrays([*(cols[n] for n in rest), pa.array(p, pa.float64())], [*rest, "score"])

    kinds = dict(docs.dtypes)
    return arrow_map(docs.select(*rest, "text"), step, ", ".join([*(f"`{n}` {kinds[n]}" for n in rest), "score double"]))


def outside(docs: DataFrame, folds: int, held: int) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, accept: float = 0.7, **fit_params: int) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; labels are learned outside fold ``held`` only."""
    rows = outside(check_columns(docs, "doc_id", "text"), folds, held)
    model = fit(rows.filter(~F.col("held_out")), labels.filter(fold(F.col("doc_id"), folds) != held), **fit_params)
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = 0.7, folds: int = 4, held: int = 2, **fit_params: int) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``accept``."""
    rows = outside(check_columns(docs, "doc_id", "text"), folds, held)
    model = fit(rows.filter(~F.col("held_out")), labels.filter(fold(F.col("doc_id"), folds) != held), **fit_params)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(_sizer(shared.value).measures([None if t is None else str(t) for t in texts])))

    return docs.filter(good("text") >= accept)
