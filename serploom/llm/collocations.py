"""Phrase collocations, counted by slots of a minimal perfect hash.

Phrases grow word by word. Frequent words of a language get numbers (so do equal words of other languages, others), and texts become runs of numbers with gaps. A phrase of k words
is the pair of its first and its last k - 1 words, both frequent phrases of the level before, as one integer. That is the Apriori rule, and the key says exactly which phrase it is. For each level:

1. Mappers add pairs up in an array of capped counts by a hash of the pair, a bucket for every eight words of the corpus; its sum over all texts bounds every pair's count from above. Pairs in buckets below the least
   count are out, safely.
2. What is left are the candidates. They are cut by hash into slices of bounded size; each slice gets a minimal perfect hash with the keys stored by slot.
3. Mappers look pairs up, verify the stored key, and count with ``bincount`` in one array by slot. Arrays are summed as a tree, in blocks of slots.
4. Slots with enough become the next level's numbers, and one pass writes the runs in these.

A phrase's parts are frequent, too, so a cut's two counts are read by the slots' numbers: a phrase's prefix and suffix, theirs, and so on down to the words.

Memory is bounded at any size: a slice's hash (``slice_keys``) and counts in a worker and in the driver, ``buckets`` at most, a dictionary of ``slice_words`` words. More candidates mean
more slices, each one more pass over the runs; nothing is dropped. Beyond some 500 million words the buckets fill up and let more candidates through. Runs hold 2,048 numbers of one text at most and the three behind them, which they don't count.

Defined results: null text is empty; null lang is ``und``; repeated rows count again; texts without words, an empty table and languages without a candidate give no rows; other columns are ignored. Up to 2 ** 31 frequent
phrases of a length can be told apart; more are an error.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from serploom.llm.common import arrow_map, check_columns, columns_of, forgotten, persisted, scratch, written
from serploom.llm.perfecthash import PerfectHash, below, mixed
from serploom.shipping import ship

LEAST, LONGEST, TOP = 30, 4, 2000
#: The most that a worker holds: words of a dictionary, candidates of a slice, buckets of the filter (a byte each for the usual least count).
SLICE_WORDS, SLICE_KEYS, BUCKETS = 1_000_000, 4_000_000, 1 << 26
#: Numbers of a run that count, numbers worked on at a time, bytes split at a time, slots of a block of counts, arrays that one task sums, parts that slices are made of.
RUN, AT_ONCE, SPLIT, BLOCK, FAN, PARTS = 2048, 2_000_000, 1 << 20, 1 << 16, 256, 1024
#: Counted words and found pairs that a task holds before it hands them over; phrases that one task ranks first.
HELD, HELD_KEYS, RANKED = 200_000, 2_000_000, 50_000

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _BREAKS, bytes(range(97, 123)) + b"\n" * len(_BREAKS))
#: Stands for the end of a piece; no byte of UTF-8 is like it.
_GAP = b"\xff"

RUNS = "ids array<int>, own int"


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, with _GAP between pieces, in lists of some megabyte each."""
    whole = (text or b"").translate(_TABLE)
    at = 0
    while at < len(whole):
        end = at + SPLIT
        if end < len(whole):  # cut behind the next white space
            ends = [k for k in (whole.find(c, end) for c in (b" ", b"\t", b"\n")) if k >= 0]
            end = min(ends) + 1 if ends else len(whole)
        yield whole[at:end].replace(b"\n", b" \xff ").split()
        at = end


def _texts(docs: DataFrame) -> DataFrame:
    rows = check_columns(docs, "text", "lang")
    return rows.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f: every word of every language."""

    def table(counts: dict[str, Counter]) -> pa.RecordBatch:
        flat = [(lang, w, n) for lang, c in counts.items() for w, n in c.items() if w != _GAP]
        cols = list(zip(*flat, strict=True)) if flat else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            cols = columns_of(batch)
            for lang, text in zip(cols["lang"], cols["text"], strict=True):
                own = counts.setdefault(lang.as_py(), Counter())
                for words in pieces(text.as_py()):
                    own.update(words)
                    if sum(map(len, counts.values())) > HELD:
                        yield table(counts)
                        counts = {}
                        own = counts.setdefault(lang.as_py(), Counter())
        yield table(counts)

    ship(docs.sparkSession)
    found = _texts(docs).mapInArrow(run, "lang string, word binary, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("f"))


def _cut(ids: list[np.ndarray]) -> pa.RecordBatch:
    """Runs of texts' numbers: RUN of their own and the LONGEST - 1 behind."""
    parts = [(a[k : k + RUN + LONGEST - 1], min(RUN, len(a) - k)) for a in ids for k in range(0, len(a), RUN)]
    return _runs(np.concatenate([p for p, _ in parts]) if parts else np.empty(0, np.int32), np.array([len(p) for p, _ in parts], np.int64), np.array([n for _, n in parts], np.int64))


def _runs(values: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32))), pa.array(own.astype(np.int32))], ["ids", "own"])


def _spelt(texts: DataFrame, numbers: dict[str, dict[bytes, int]], last: bool) -> DataFrame:
    """Texts as numbers of their words, -1 for other words and gaps: added to what ``ids`` has, or cut into runs if these numbers are the last."""
    sent = texts.sparkSession.sparkContext.broadcast(numbers)
    more = "ids" in texts.columns

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols, known, out = columns_of(batch), sent.value, []
        for k, (lang, text) in enumerate(zip(cols["lang"], cols["text"], strict=True)):
            get = known.get(lang.as_py(), {}).get
            ids = [np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)) for words in pieces(text.as_py())]
            found = np.concatenate([*ids, np.empty(0, np.int32)])
            out.append(np.maximum(found, cols["ids"][k].values.to_numpy()) if more else found)
        if last:
            return _squeezed(_cut(out))
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in out])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([cols["lang"], cols["text"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*out, np.empty(0, np.int32)])))], ["lang", "text", "ids"])

    return arrow_map(texts, step, RUNS if last else "lang string, text binary, ids array<int>")


def _flat(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """values, row and place within the row of every number, and the rows' own, for some rows of a batch after another."""
    ids, own = batch.column("ids"), batch.column("own").to_numpy().astype(np.int64)
    offsets = ids.offsets.to_numpy().astype(np.int64)
    values = ids.values.to_numpy()
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, "right")) - 1)
        sizes = np.diff(offsets[at : end + 1])
        row = np.repeat(np.arange(end - at), sizes)
        place = np.arange(len(row)) - np.repeat(offsets[at:end] - offsets[at], sizes)
        yield values[offsets[at] : offsets[end]].astype(np.int64), row, place, own[at:end]
        at = end


def _pairs(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where two numbers stand next to each other in a row (by the first one's index)."""
    return np.flatnonzero((values[:-1] >= 0) & (values[1:] >= 0) & (row[:-1] == row[1:]))


def _owned(values: np.ndarray, row: np.ndarray, place: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Keys of the pairs that the rows count."""
    at = _pairs(values, row)
    at = at[place[at] < own[row[at]]]
    return values[at] << 32 | values[at + 1]


def _squeezed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Runs without what stands alone: numbers next to another one stay, a gap before each stretch of them, and no empty run."""
    out = []
    for values, row, place, own in _flat(batch):
        at = _pairs(values, row)
        keep = np.zeros(len(values) + 1, bool)
        keep[at] = keep[at + 1] = True
        keep = keep[:-1]
        gap = np.zeros(len(values), bool)
        gap[:-1] = keep[1:] & ~keep[:-1] & (row[1:] == row[:-1])
        stay = keep | gap
        sizes = np.bincount(row[stay], minlength=len(own))
        mine = np.bincount(row[stay & (place < own[row])], minlength=len(own))
        some = mine > 0
        stay &= some[row]
        out.append((np.where(keep, values, -1)[stay], sizes[some], mine[some]))
    cols = list(zip(*out, strict=True)) if out else [[np.empty(0, np.int64)]] * 3
    return _runs(*(np.concatenate(c) for c in cols))


def _sent_blocks(total: np.ndarray) -> pa.RecordBatch:
    """An array of counts in blocks, without those of zeros alone, compressed."""
    task, rows = TaskContext.get().partitionId(), []
    for b in range(0, len(total), BLOCK):
        part = total[b : b + BLOCK]
        if part.any():
            rows.append((b // BLOCK, task, pa.compress(part.tobytes(), "zstd", asbytes=True)))
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["block", "task", "data"])


def tree_sum(runs: DataFrame, start: Callable[[], np.ndarray], add: Callable[[np.ndarray, np.ndarray], np.ndarray], cap: int | None = None) -> np.ndarray:
    """The sum over all tasks of an array that starts as ``start()`` and takes in keys by ``add``. cap: sums above it count as it, and what comes back is bits, whether a sum is at the cap."""
    dtype, size = start().dtype, len(start())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = start()
        for batch in batches:
            for part in _flat(batch):
                total = add(total, _owned(*part))
        yield _sent_blocks(total)

    def summed(group: pa.Table, last: bool) -> pa.Table:
        block = group["block"][0].as_py()
        size_ = min(BLOCK, size - block * BLOCK)
        total = np.zeros(size_, np.int64)
        for data in group["data"]:
            total += np.frombuffer(pa.decompress(data.as_py(), size_ * dtype.itemsize, "zstd"), dtype)
            if cap is not None:
                np.minimum(total, cap, out=total)
        packed_ = pa.compress((np.packbits(total >= cap, bitorder="little") if last and cap is not None else total.astype(dtype)).tobytes(), "zstd", asbytes=True)
        return pa.table([pa.array([block], pa.int32()), group["task"][:1].cast(pa.int32()), pa.array([packed_], pa.binary())], ["block", "task", "data"])

    ship(runs.sparkSession)
    blocks = runs.mapInArrow(run, "block int, task int, data binary")
    some = blocks.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("block", "task").applyInArrow(lambda g: summed(g, False), "block int, task int, data binary")
    # the array is of a bounded size or a slice's; so is what the driver gets
    bits = cap is not None
    out = np.zeros(-(-size // 8), np.uint8) if bits else np.zeros(size, dtype)
    step = BLOCK // 8 if bits else BLOCK
    for r in some.groupBy("block").applyInArrow(lambda g: summed(g, True), "block int, task int, data binary").toArrow().to_pylist():
        part = out[r["block"] * step : (r["block"] + 1) * step]
        part[:] = np.frombuffer(pa.decompress(r["data"], part.nbytes, "zstd"), out.dtype)
    return out


def _heavy(runs: DataFrame, least: int, buckets: int) -> np.ndarray:
    """Bits of the buckets whose pairs together come ``least`` times or more."""
    dtype = np.min_scalar_type(least)

    def add(total: np.ndarray, keys: np.ndarray) -> np.ndarray:
        at, times = np.unique(below(mixed(keys.view(np.uint64), PARTS), buckets), return_counts=True)
        total[at] = np.minimum(times + total[at], least)
        return total

    return tree_sum(runs, lambda: np.zeros(buckets, dtype), add, least)


def _key_sets(keys: np.ndarray, task: int) -> pa.RecordBatch:
    """Sorted keys as one row for each part that has any."""
    part = below(mixed(keys.view(np.uint64), PARTS + 1), PARTS)
    order = np.argsort(part, kind="stable")
    parts, starts = np.unique(part[order], return_index=True)
    sets = np.split(keys[order], starts[1:]) if len(parts) else []
    cols = [pa.array(parts.astype(np.int32)), pa.array(np.full(len(parts), task, np.int32)), pa.array([len(x) for x in sets], pa.int64()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in sets], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["part", "task", "n", "keys"])


def _keys(table: pa.Table) -> Iterator[np.ndarray]:
    for n, keys in zip(table["n"].to_pylist(), table["keys"], strict=True):
        yield np.frombuffer(pa.decompress(keys.as_py(), n * 8, "zstd"), np.int64)


def _candidates(runs: DataFrame, heavy: np.ndarray, buckets: int) -> DataFrame:
    """part, task, n, keys: pairs in heavy buckets, each once, as one set for each of PARTS classes of keys; sets are united as a tree."""
    sent = runs.sparkSession.sparkContext.broadcast(heavy)
    schema = "part int, task int, n long, keys binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, task = sent.value, np.empty(0, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for part in _flat(batch):
                keys = _owned(*part)
                at = below(mixed(keys.view(np.uint64), PARTS), buckets)
                held = np.union1d(held, keys[(bits[at >> 3] >> (at & 7) & 1).astype(bool)])
                if len(held) > HELD_KEYS:
                    yield _key_sets(held, task)
                    held = np.empty(0, np.int64)
        yield _key_sets(held, task)

    def united(group: pa.Table) -> pa.Table:
        every = functools.reduce(np.union1d, _keys(group))
        return pa.Table.from_batches([_key_sets(every, group["task"][0].as_py())])

    ship(runs.sparkSession)
    some = runs.mapInArrow(run, schema).withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("part", "task").applyInArrow(united, schema)
    return some.groupBy("part").applyInArrow(united, schema)


def _slices(parts: dict[int, int], most: int) -> Iterator[list[int]]:
    """Parts, by their numbers of keys, in groups of ``most`` keys or fewer."""
    group, held = [], 0
    for p, n in sorted(parts.items()):
        if group and held + n > most:
            yield group
            group, held = [], 0
        group.append(p)
        held += n
    if group:
        yield group


def _renumbered(runs: DataFrame, hashed: PerfectHash, numbers: np.ndarray, last: bool) -> DataFrame:
    """Runs in the next level's numbers: added to what ``next`` has, or squeezed if this slice is the last."""
    sent = runs.sparkSession.sparkContext.broadcast((hashed, numbers))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashed, numbers = sent.value
        values, sizes = [], []
        for ids, row, _, own in _flat(batch):
            at = _pairs(ids, row)
            slots = hashed.slots(ids[at] << 32 | ids[at + 1])
            to = np.full(len(ids), -1, np.int64)
            to[at] = np.where(slots >= 0, numbers[slots], -1)
            values.append(to)
            sizes.append(np.bincount(row, minlength=len(own)))
        to = np.concatenate([*values, np.empty(0, np.int64)])
        if "next" in batch.schema.names:
            to = np.maximum(to, batch.column("next").values.to_numpy())
        found = _runs(to, np.concatenate([*sizes, np.empty(0, np.int64)]), batch.column("own").to_numpy())
        return _squeezed(found) if last else pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("own"), found.column("ids")], ["ids", "own", "next"])

    return arrow_map(runs, step, RUNS if last else RUNS + ", next array<int>")


class _Runs:
    """The texts as runs in the shared folder; what they were before is deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.df = spark, None, None

    def become(self, df: DataFrame) -> None:
        before, self.path = self.path, scratch(self.spark, "runs")
        self.df = written(df, self.path)
        if before:
            forgotten(self.spark, before)

    def forget(self) -> None:
        if self.path:
            forgotten(self.spark, self.path)


class _Growing:
    """A table in the shared folder that the driver adds a slice to at a time."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.path, self.schema = spark, scratch(spark, name), schema
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, table: pa.Table) -> None:
        self.spark.createDataFrame(table, self.schema).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def _numbered_words(docs: DataFrame, counts: DataFrame, runs: _Runs, least: int, slice_words: int) -> DataFrame:
    """id, lang, word, f of frequent words; ``runs`` become the texts in their ids."""
    spark = docs.sparkSession
    frequent = counts.filter(F.col("f") >= least).withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(PARTS)).cast("int"))
    table, texts, base = _Growing(spark, "words", "id int, lang string, word binary, f long"), _texts(docs), 0
    slices = list(_slices({r["part"]: r["n"] for r in frequent.groupBy("part").agg(F.count("*").alias("n")).collect()}, slice_words))
    for k, parts in enumerate(slices):
        words = frequent.filter(F.col("part").isin(parts)).select("lang", "word", "f").toArrow()
        ids = pa.array(np.arange(base, base + len(words)), pa.int32())
        base += len(words)
        table.add(pa.table([ids, words["lang"], words["word"], words["f"]], ["id", "lang", "word", "f"]))
        known: dict[str, dict[bytes, int]] = {}
        for lang, word, i in zip(words["lang"].to_pylist(), words["word"].to_pylist(), ids.to_pylist(), strict=True):
            known.setdefault(lang, {})[word] = i
        runs.become(_spelt(texts, known, k == len(slices) - 1))
        texts = runs.df
    if not slices:
        runs.become(spark.createDataFrame([], RUNS))
    return table.read()


def _grown(runs: _Runs, least: int, buckets: int, slice_keys: int, last: bool) -> tuple[DataFrame, bool]:
    """id, pid, sid, a of the frequent phrases that are pairs of ``runs``, and whether there are any; unless last, ``runs`` become the texts in their ids."""
    spark = runs.spark
    place = scratch(spark, "candidates")
    candidates = written(_candidates(runs.df, _heavy(runs.df, least, buckets), buckets), place)
    table, base = _Growing(spark, "phrases", "id int, pid int, sid int, a long"), 0
    slices = list(_slices({r["part"]: r["n"] for r in candidates.select("part", "n").collect()}, slice_keys))
    for k, parts in enumerate(slices):
        hashed = PerfectHash(np.concatenate(list(_keys(candidates.filter(F.col("part").isin(parts)).toArrow()))))
        sent = spark.sparkContext.broadcast(hashed)

        def add(total: np.ndarray, keys: np.ndarray, sent=sent) -> np.ndarray:
            slots = sent.value.slots(keys)
            return total + np.bincount(slots[slots >= 0], minlength=len(total))

        counts = tree_sum(runs.df, lambda n=len(hashed): np.zeros(n, np.int64), add)
        frequent = np.flatnonzero(counts >= least)
        if base + len(frequent) >= 1 << 31:
            raise ValueError("over 2 ** 31 frequent phrases of a length: raise least")
        numbers = np.full(len(hashed), -1, np.int64)
        numbers[frequent] = np.arange(base, base + len(frequent))
        base += len(frequent)
        keys = hashed.keys[frequent]
        table.add(pa.table([pa.array(numbers[frequent], pa.int32()), pa.array(keys >> 32, pa.int32()), pa.array(keys & 0xFFFFFFFF, pa.int32()), pa.array(counts[frequent])], ["id", "pid", "sid", "a"]))
        if not last:
            runs.become(_renumbered(runs.df, hashed, numbers, k == len(slices) - 1))
        sent.destroy()
    forgotten(spark, place)
    return table.read(), base > 0


def _named(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """id, lang, words, heads, tails, a of phrases (id, pid, sid, a): heads and tails count the phrase's first and last 1, 2, ... words."""
    p = words.select(F.col("id").alias("pid"), "lang", F.col("words").alias("pw"), "heads")
    s = words.select(F.col("id").alias("sid"), F.element_at("words", -1).alias("end"), "tails")
    both = pairs.join(p, "pid").join(s, "sid")
    return both.select("id", "lang", F.concat("pw", F.array("end")).alias("words"), F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"), "a")


def _cuts(phrases: DataFrame, size: int) -> DataFrame:
    """lang, phrase, a, l, r, score: each phrase's lowest-scoring cut, ties to the first."""
    cuts = phrases.withColumns({f"l{k}": F.col("heads")[k - 1] for k in range(1, size)} | {f"r{k}": F.col("tails")[size - k - 1] for k in range(1, size)})
    # as decimals: 2,000,000 a may pass 64 bits, and div of decimals is exact
    score = lambda k: F.expr(f"(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div cast(l{k} + r{k} as decimal(20,0))")
    best = F.array_min(F.array(*[F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]))
    return cuts.select("lang", F.array_join(F.transform("words", lambda w: w.cast("string")), " ").alias("phrase"), "a", best.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _first(phrases: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top`` with their rank: first within shares of a language, then within groups of FAN / 16 such shares, and so on."""
    order, shares = [F.desc("score"), F.desc("a"), "phrase"], -(-max(phrases.count(), 1) // RANKED)
    left = phrases.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    while shares > 1:
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
        left, shares = left.withColumn("share", F.floor(F.col("share") / 16)), -(-shares // 16)
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, buckets: int = BUCKETS, slice_keys: int = SLICE_KEYS, slice_words: int = SLICE_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` (4 at most) words that come ``least`` times or more.

    A phrase's score is its lowest over all cuts in two, 2,000,000 a / (l + r) in whole numbers. Phrases inside a longer one that has 80 percent of their occurrences are left out.
    """
    spark = docs.sparkSession
    counts = persisted(word_counts(docs), "counts")
    runs = _Runs(spark)
    words = _numbered_words(docs, counts, runs, least, slice_words)
    n = counts.agg(F.sum("f")).first()[0] or 0
    buckets = min(buckets, max(1 << 16, 1 << (n // 8).bit_length()))
    level = words.select("id", "lang", F.array("word").alias("words"), F.array("f").alias("heads"), F.array("f").alias("tails"))
    levels, pairs = [], []
    for size in range(2, longest + 1):
        grown, any_ = _grown(runs, least, buckets, slice_keys, size == longest)
        if not any_:
            break
        level = persisted(_named(grown, level), "phrases")
        levels.append(level)
        pairs.append(grown)
    runs.forget()
    found = None
    for k, level in enumerate(levels):
        if k + 1 < len(levels):
            longer = pairs[k + 1].select(F.explode(F.array("pid", "sid")).alias("id"), F.col("a").alias("b")).groupBy("id").agg(F.max("b").alias("b"))
            level = level.join(longer, "id", "left").filter(F.col("b").isNull() | (F.col("b") * 100 < F.col("a") * 80))
        part = _cuts(level, k + 2)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    total = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    return _first(persisted(found, "collocations"), top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
