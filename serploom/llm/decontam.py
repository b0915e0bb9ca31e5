"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items (bounded, checked) go to every task as word numbers. Every n-gram of an item is a seed, however often it occurs
in the documents: a leak can be as hot as everyday words are, so frequency alone tells nothing. One pass finds the seeds in every text. Items of
which the text holds too few words to reach the threshold go; for the others a window is opened around each (item, diagonal),
and item and window are aligned by words: match 2, mismatch -1, gap -1. The score is the best local alignment over that of the whole item with itself, so an exact copy has 1.0, a copy with every fifth
word replaced about 0.7, and chance overlaps of a few words and everyday words between stay below 0.35.

Words are runs of word characters, lower-cased. Defined results: null and empty texts, null items and items without a
word match nothing; items of any length are aligned whole, in memory that follows the window (time follows item times window); items that repeat one another are reported each; items shorter than an n-gram are one n-gram
of all their words; equal best alignments give the first; repeated rows are reported each; other columns are ignored or, in
``drop_contaminated``, kept. Texts are searched whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from serploom.llm.common import arrow_map, check_columns, columns_of, packed, persisted

WORD = re.compile(r"\w+")
#: Characters of test items that go out with tasks; beyond it, items must be split and searched in turns.
MOST_ITEM_CHARS = 32_000_000
MATCH, MISMATCH, GAP = 2, 1, 1


@dataclass(frozen=True)
class Items:
    """Test items in the order of rows: ids as text in ``names`` for errors, words, and n."""

    ids: tuple
    words: tuple[tuple[str, ...], ...]
    n: int


class Index:
    """Word numbers, n-gram codes and their places; built once per Python worker."""

    def __init__(self, items: Items) -> None:
        self.items = items
        self.number: dict[str, int] = {}
        self.rows = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in ws], np.int64) for ws in items.words]
        self.times = [Counter(row.tolist()) for row in self.rows]
        self.base = len(self.number) + 2
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short = {len(r) for r in self.rows if 0 < len(r) < items.n}
        for i, row in enumerate(self.rows):
            for k, code in enumerate(self.codes(row, min(items.n, len(row))).tolist()):
                self.places[code].append((i, k))
        self.sorted = np.array(sorted(self.places), np.int64)

    def codes(self, row: np.ndarray, n: int) -> np.ndarray:
        """One number per n-gram; -1 where a word is in no item. Lengths other than n never share a number."""
        if n == 0 or len(row) < n:
            return np.zeros(0, np.int64)
        code, known = np.zeros(len(row) - n + 1, np.int64), np.ones(len(row) - n + 1, bool)
        for k in range(n):
            part = row[k : len(row) - n + 1 + k]
            code = (code * self.base + part) % ((1 << 61) - 1) if self.base > 1_000_000 else code * self.base + part
            known &= part > 0
        code[~known] = -1
        return code

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in WORD.findall((text or "").lower())], np.int64)

    def found(self, row: np.ndarray) -> list[tuple[int, int]]:
        """(place, code) of the n-grams of a text that are an item's."""
        among = self.sorted
        if not len(among):
            return []
        out: list[tuple[int, int]] = []
        for n in {self.items.n, *self.short}:
            codes = self.codes(row, n)
            at = np.minimum(np.searchsorted(among, codes), len(among) - 1)
            hit = np.flatnonzero((among[at] == codes) & (codes >= 0))
            out += zip(hit.tolist(), codes[hit].tolist(), strict=True)
        return out


@lru_cache(maxsize=2)
def _index(items: Items) -> Index:
    return Index(items)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score and the window's words that it spans, [start, end)."""
    score, end, stop = _ends(item, window)
    if score <= 0:
        return 0, 0, 0
    back, length, _ = _ends(item[: stop + 1][::-1], window[: end + 1][::-1], anchored=True, want=score)
    return score, end - length, end + 1


def _ends(item: np.ndarray, window: np.ndarray, anchored: bool = False, want: int | None = None) -> tuple[int, int, int]:
    """Score and last cell (window, item) of the first best alignment; anchored: it begins at both beginnings."""
    places = np.arange(len(window))
    slope = GAP * places
    last = np.zeros(len(window) + 1, np.int64) if not anchored else -GAP * np.arange(len(window) + 1)
    best = (0, -1, -1)
    for i, word in enumerate(item):
        hit = np.where((window == word) & (window > 0), MATCH, -MISMATCH)
        edge = 0 if not anchored else -GAP * (i + 1)
        cell = np.maximum(last[:-1] + hit, last[1:] - GAP)
        if not anchored:
            cell = np.maximum(cell, 0)
        cell = np.maximum(np.maximum.accumulate(np.maximum(cell + slope, edge - GAP)) - slope, cell)
        if not anchored:
            cell = np.maximum(cell, 0)
        last = np.concatenate([[edge], cell])
        k = int(cell.argmax())
        if cell[k] > best[0]:
            best = (int(cell[k]), k, i)
            if want is not None and best[0] >= want:
                return best
    return best


def windows(hits: list[tuple[int, int]], size: int, words: int) -> list[tuple[int, int]]:
    """Windows [from, to) of a text that hold an item of ``size`` words at the diagonals hit, overlapping ones merged.

    Merging stops at eight item lengths, so that a text that repeats an item many times is aligned in bounded pieces.
    """
    pad = size // 2 + 4
    spans = sorted((max(0, p - q - pad), min(words, p - q + size + pad)) for p, q in hits)
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1] and b - out[-1][0] <= 8 * (size + 2 * pad):
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif not out or (a, b) != out[-1]:
            out.append((a, b))
    return out


def read_items(benchmark: DataFrame, n: int) -> Items:
    rows = check_columns(benchmark, "item_id", "text").filter("text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > MOST_ITEM_CHARS:
        raise ValueError(f"{size} characters of test items; search them in parts of {MOST_ITEM_CHARS}")
    got = sorted(((r["item_id"], tuple(WORD.findall(r["text"].lower()))) for r in rows.collect()), key=lambda x: (x[0] is None, x[0], x[1]))
    return Items(tuple(g[0] for g in got), tuple(g[1] for g in got), n)


def find(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.45) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word for every document and item whose score reaches the threshold."""
    rows = check_columns(docs, "doc_id", "text")
    items = read_items(benchmark, n)
    spark = docs.sparkSession
    kinds = dict(rows.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    item_kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    shared = spark.sparkContext.broadcast(items)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = shared.value
        index, cols = _index(items), columns_of(batch)
        out: list[tuple] = []
        known: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        for d, t in enumerate(cols["text"]):
            row = index.numbers(t.as_py())
            hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for p, code in index.found(row):
                for i, q in index.places[code]:
                    hits[i].append((p, q))
            words = row.tolist() if hits else []
            present = set(words)
            for i, places in sorted(hits.items()):
                item, best = index.rows[i], (0, 0, 0)
                # an alignment can't score more than the share of the item's words that are there
                if sum(map(index.times[i].__getitem__, index.times[i].keys() & present)) < threshold * len(item):
                    continue
                for a, b in windows(places, len(item), len(row)):
                    if sum(map(index.times[i].__getitem__, index.times[i].keys() & words[a:b])) < threshold * len(item):
                        continue
                    part = row[a:b]
                    key = (i, part.tobytes())
                    if key not in known:
                        if len(known) > 5000:
                            known.clear()
                        known[key] = align(item, part)
                    s, x, y = known[key]
                    if s > best[0]:
                        best = (s, a + x, a + y)
                if best[0] and best[0] >= threshold * MATCH * len(item):
                    out.append((d, i, best[0] / (MATCH * len(item)), best[1], best[2]))
        at = pa.array([o[0] for o in out], pa.int64())
        return pa.RecordBatch.from_arrays([cols["doc_id"].take(at), pa.array([items.ids[o[1]] for o in out], item_kind), *(pa.array([o[k] for o in out], pa.float64() if k == 2 else pa.int64()) for k in (2, 3, 4))], ["doc_id", "item_id", "score", "first_word", "end_word"])

    return arrow_map(rows, step, f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, first_word long, end_word long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how: float) -> DataFrame:
    """``docs`` without the documents that hold a copy of a test item, all columns; rows with null doc_id stay."""
    bad = persisted(find(docs, benchmark, **how).select("doc_id").distinct(), "contaminated")
    return docs.select(packed(docs).alias("row"), "doc_id").join(bad, "doc_id", "left_anti").select("row.*")
