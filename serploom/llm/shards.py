"""A reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows get gapless numbers in an order that depends on their content alone, not on files, partitions or tasks. A keyed Feistel network permutes the
numbers within the next power of four, and cycle walking (applying it again to what falls outside) makes that a permutation of the numbers themselves. The number's image, divided by the
number of shards, gives slot and shard. So shards differ by one row at most, slots have no gaps, and either direction is computed without a table: ``Feistel.places`` of a row, ``Feistel.numbers`` of a place.

Numbering never gathers copies: equal rows are counted first, and since nothing tells them apart, a row's copies are laid out again from its count, in pieces dealt out over tasks. Distinct
rows are numbered in ranges of a hash, whose sizes are summed in groups.

Defined results: null text has no bytes, so size 1 and CRC 0; null ids are ids like any other; repeated rows are separate rows; an empty table gives an empty result; other columns travel along in ``shuffled`` and
``write_shards``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serploom.llm.common import check_columns, packed, persisted, unit_hash
from serploom.shipping import ship

SEED, ROUNDS, SHARDS = 42, 6, 8
#: Distinct rows that one task numbers, ranges that one task sums up, and copies of a row that one task lays out.
PER_RANGE, GROUP, COPIES = 2000, 4096, 10_000


class Feistel:
    """A permutation of 0 .. n - 1."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n, self.seed, self.rounds = n, seed, rounds
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)

    def _mixed(self, x: np.ndarray, turn: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            z = x + np.uint64(((self.seed << 8) + turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return (z ^ z >> np.uint64(31)) & np.uint64((1 << self.half) - 1)

    def _network(self, x: np.ndarray, back: bool) -> np.ndarray:
        h = np.uint64(self.half)
        left, right = x >> h, x & np.uint64((1 << self.half) - 1)
        for turn in reversed(range(self.rounds)) if back else range(self.rounds):
            left, right = (right ^ self._mixed(left, turn), left) if back else (right, left ^ self._mixed(right, turn))
        return left << h | right

    def _walked(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._network(np.asarray(x).astype(np.uint64), back)
        outside = np.flatnonzero(out >= self.n)
        while len(outside):
            out[outside] = self._network(out[outside], back)
            outside = outside[out[outside] >= self.n]
        return out.astype(np.int64)

    def places(self, numbers: np.ndarray) -> np.ndarray:
        return self._walked(numbers, False)

    def numbers(self, places: np.ndarray) -> np.ndarray:
        return self._walked(places, True)


def _before(keys: list[str], *by: str) -> Column:
    """The sum of n over the rows of the keys that come before."""
    rows = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(rows), F.lit(0))


def numbered(df: DataFrame, total: int, per_range: int = PER_RANGE, copies: int = COPIES) -> DataFrame:
    """row (a struct of df's columns), row_number from 0: the order of rows' hashes, then of the rows."""
    ranges = max(1, -(-total // per_range))
    distinct = df.select(packed(df).alias("row")).groupBy("row").agg(F.count("*").alias("n"))
    distinct = persisted(distinct.withColumn("u", unit_hash("row", F.lit("shards"))).withColumn("r", F.floor(F.col("u") * ranges)), "distinct")
    sizes = distinct.groupBy("r").agg(F.sum("n").alias("n")).withColumn("g", F.floor(F.col("r") / GROUP))
    groups = sizes.groupBy("g").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0)).select("g", _before(["all"], "g").alias("base"))  # a row for 8 million of the table
    starts = sizes.withColumn("in", _before(["g"], "r")).join(groups, "g").select("r", (F.col("base") + F.col("in")).alias("start"))
    first = distinct.withColumn("before", _before(["r"], "u", "row")).join(starts, "r").select("row", "n", (F.col("start") + F.col("before")).alias("first"))
    each = lambda t, a, b: t.select("row", F.explode(F.sequence(a, b)).alias("row_number"))
    few = each(first.filter(F.col("n") <= copies), F.col("first"), F.col("first") + F.col("n") - 1)
    many = first.filter(F.col("n") > copies).withColumn("end", F.col("first") + F.col("n"))
    many = many.select("row", "end", F.explode(F.sequence("first", F.col("end") - 1, F.lit(copies).cast("long"))).alias("from"))
    dealt = many.repartition(F.col("from"))
    return few.union(each(dealt, F.col("from"), F.least(F.col("from") + copies, F.col("end")) - 1))


def shuffled(df: DataFrame, shards: int = SHARDS, seed: int = SEED, **how: int) -> DataFrame:
    """row (a struct of df's columns), row_number, shard (0 to shards - 1), slot (from 0 within the shard)."""
    total = df.count()
    ship(df.sparkSession)

    @F.arrow_udf("long")
    def places(numbers: pa.Array) -> pa.Array:
        return pa.array(Feistel(total, seed).places(numbers.to_numpy(zero_copy_only=False)))

    placed = numbered(df, total, **how).withColumn("place", places("row_number"))
    return placed.select("row", "row_number", F.expr(f"cast(place % {shards} as int)").alias("shard"), F.expr(f"place div {shards}").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, files: int = 1, folder: str = "shard") -> None:
    """``df`` as folders shard=0, shard=1, ... of ``files`` Parquet files each, the rows in order of their slots. folder: their name, if df has such a column."""
    if folder in df.columns:
        raise ValueError(f"there is a column {folder}: name the folders otherwise")
    found = shuffled(df, shards, seed)
    most = max(1, -(-df.count() // shards))
    file = F.floor(F.col("slot") * files / most).cast("int")
    # by range, so that each file is one task's
    laid = found.withColumn("file", file).repartitionByRange(shards * files, "shard", "file").withColumn("folder", F.col("shard")).sortWithinPartitions("folder", "slot")
    laid.select("row.*", F.col("folder").alias(folder)).write.partitionBy(folder).parquet(path)


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **how: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number of every document. Law ``rows``: shards' counts differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = check_columns(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    found = shuffled(slim, shards, seed, **how)
    return found.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
