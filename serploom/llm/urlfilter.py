"""URL rules by Bloom filter cascades.

A cascade is exact on a known universe of keys: level 0 is a Bloom filter of the listed keys, level 1 one of the keys of
the universe that level 0 lets through by mistake, level 2 one of the listed keys that level 1 catches by mistake, and so
on until nothing is left. The first level that doesn't hold a key decides, by its parity. The universe here is every
key that the corpus's urls can ask for (host suffixes times path beginnings), so no url can meet a false positive, and
the urls are judged in one pass with a few hundred bytes to some MB of filters instead of a join. Filters are made by tasks, as
words of bits that are put together by an aggregation; the driver holds the finished filters, never keys.

A rule is host + path, such as ``example.net/en/``. It fits its host and all subdomains if the url's path starts with
the rule's path. The longest fitting rule wins; of equally long ones the one with the longer host.

Defined results: null urls, and urls without ``://``, have empty host and path and fit no rule; without a fitting rule
the verdict is ``otherwise``; repeated rows are judged alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serploom.llm.common import arrow_map, check_columns, columns_of, persisted
from serploom.shipping import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a filter that may go out with the tasks: 256 MB, some 10 ** 8 to 10 ** 9 keys.
MOST_BITS = 1 << 31


@dataclass
class Bloom:
    bits: np.ndarray
    size: int
    probes: int
    level: int

    @classmethod
    def over(cls, keys: DataFrame, n: int, rate: float, level: int) -> Bloom:
        """A filter of the column ``key`` of n rows, made by tasks."""
        made = cls._sized(n, rate, level)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(np.array([p for k in batch.column(0).to_pylist() for p in made._at(k)], np.uint64))
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

        ship(keys.sparkSession)
        got = keys.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        made.bits = np.zeros(-(-made.size // 64), "<u8")
        made.bits[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
        made.bits = made.bits.view(np.uint8)
        return made

    @classmethod
    def _sized(cls, n: int, rate: float, level: int) -> Bloom:
        probes = max(1, round(-np.log2(rate)))
        size = max(64, int(np.ceil(n * probes / np.log(2))))
        if size > MOST_BITS:
            raise ValueError(f"a filter of {size} bits: split the list by key and judge in parts")
        return cls(np.zeros(0, np.uint8), size, probes, level)

    def _at(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.level)
        a, b = h & (1 << 64) - 1, h >> 64 | 1
        return [(a + k * b) % (1 << 64) % self.size for k in range(self.probes)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in self._at(key))


@dataclass
class Cascade:
    """Exact membership for every key of the universe that it was built with."""

    levels: list[Bloom] = field(default_factory=list)

    def __contains__(self, key: str) -> bool:
        for n, level in enumerate(self.levels):
            if key not in level:
                return n % 2 == 1
        return len(self.levels) % 2 == 1

    @classmethod
    def build(cls, listed: Iterable[str] | DataFrame, universe: DataFrame) -> Cascade:
        """listed: keys, or a table with them in column ``key``; ``universe``: one column of distinct keys."""
        spark = universe.sparkSession
        listed = listed if isinstance(listed, DataFrame) else spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")
        universe = universe.toDF("key")
        listed = persisted(listed.select("key").distinct(), "listed")
        inside, outside = listed, universe.join(listed, "key", "left_anti")
        n, others = listed.count(), universe.count()
        levels: list[Bloom] = []
        while n:
            # as many false positives as there are keys, whatever the size of the universe; half of them from there on
            rate = 0.5 if levels else min(0.5, max(1e-9, n * 0.5**0.5 / max(others, 1)))
            levels.append(Bloom.over(inside, n, rate, len(levels)))
            inside, outside = persisted(_let_through(outside, levels[-1]), "cascade"), inside
            n = inside.count()
        return cls(levels)


def _let_through(keys: DataFrame, level: Bloom) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k in batch.column(0).to_pylist() if k in shared.value], pa.string())], ["key"])

    return arrow_map(keys, step, "key string")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every row."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select("page_id", F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, pattern, 2).alias("path"))


def candidates(host: str, path: str, lengths: tuple[int, ...]) -> list[tuple[str, int]]:
    """The keys that can fit, longest first, then longest host first. lengths: those of the rules' paths."""
    if not host:
        return []
    labels = host.split(".")
    hosts = [".".join(labels[k:]) for k in range(len(labels))]
    keys = [(h + path[:n], len(h)) for h in hosts if h for n in lengths if len(path) >= n]
    return sorted(keys, key=lambda k: (-len(k[0]), -k[1]))


def judge(pages: DataFrame, rules: list[Rule], otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url)."""
    spark = pages.sparkSession
    rows = parsed(check_columns(pages, "page_id", "url"))
    lengths = tuple(sorted({len(r.path) for r in rules}))

    def ask(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = columns_of(batch)
        keys = {k for h, p in zip(cols["host"].to_pylist(), cols["path"].to_pylist(), strict=True) for k, _ in candidates(h, p, lengths)}
        return pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.string())], ["key"])

    universe = persisted(arrow_map(rows.select("host", "path").distinct(), ask, "key string").distinct(), "universe")
    cascades = {v: Cascade.build([r.key for r in rules if r.verdict == v], universe) for v in ("block", "allow")}
    # a key is a host and a path run together: which of its beginnings is the host is told by the candidate itself
    splits = frozenset((r.key, len(r.host)) for r in rules) if _ambiguous(rules) else None
    shared = spark.sparkContext.broadcast((cascades, splits))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = columns_of(batch)
        found, splits = shared.value
        rule: list[str | None] = []
        verdict: list[str] = []
        for host, path in zip(cols["host"].to_pylist(), cols["path"].to_pylist(), strict=True):
            hit = next(((k, v) for k, n in candidates(host, path, lengths) if splits is None or (k, n) in splits for v in ("block", "allow") if k in found[v]), (None, otherwise))
            rule.append(hit[0])
            verdict.append(hit[1])
        return pa.RecordBatch.from_arrays([cols["page_id"], cols["host"], cols["path"], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return arrow_map(rows, step, f"page_id {dict(rows.dtypes)['page_id']}, host string, path string, rule string, verdict string")


def _ambiguous(rules: list[Rule]) -> bool:
    """A rule whose path doesn't start with / could be read as another host."""
    return any(not r.path.startswith("/") for r in rules)
