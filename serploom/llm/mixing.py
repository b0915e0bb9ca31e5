"""Mixing sources to target weights by Pfair scheduling.

A source's documents are put in a fixed pseudo-random order and cut into blocks. With weight w its block j may not come
before slot floor(j / w) and has to be out by ceil((j + 1) / w); among the blocks that may come, the one with the earliest
deadline comes (then the source's name decides). With weights that sum to 1 every deadline is met, so at each slot every
source is less than one block away from its target.

Weights are integers that sum to ``quanta``, fine enough (2 ** 48) that rounding never adds up to a visible part of a block. The
driver lays out each phase from the weights and the numbers of blocks: memory for the sources, and four bytes and some
microseconds for each block of documents (so ``block`` is to be raised for corpora of billions of documents). The slots are written to the shared folder, and a document finds its own by one
join. When a source runs out, a new phase begins in which the others share its weight. No document is dropped or repeated.

The main path is DataFrame functions only. Documents are numbered within a source in ranges of a hash, so that a source with
a third of all rows is many tasks' work.

Defined results: null and empty source are one source; sources without a positive weight come last, in a phase with equal
weights; repeated rows are separate documents; an empty table gives an empty result; other columns are kept, but for older
mix_phase, mix_slot and mix_place, which are replaced.
"""

from __future__ import annotations

import heapq
import itertools
import math
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from serploom.llm.common import packed, scratch, unit_hash

#: Sources that the driver may hold.
MOST_SOURCES = 20_000
QUANTA = 1 << 48
#: Slots that are broadcast, some 30 MB; more are joined by a shuffle. And how many are handed over at a time.
MOST_SENT, CHUNK = 400_000, 500_000
#: Ranges of a source that one task sums up; the sums of such groups are added up after.
GROUP = 4096


def shares(weights: dict[str, float], quanta: int) -> dict[str, int]:
    """Positive weights as integers that sum to quanta, by largest remainders, 1 at least."""
    total = sum(weights.values())
    exact = {s: w / total * quanta for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    left = quanta - sum(out.values())
    order = sorted(exact, key=lambda s: (-(exact[s] - math.floor(exact[s])), s))
    for s in order[: max(left, 0)]:
        out[s] += 1
    while left < 0:
        s = max(out, key=lambda x: (out[x] - exact[x] if out[x] > 1 else -math.inf, x))
        out[s] -= 1
        left += 1
    return out


def slots(quanta: dict[str, int]) -> Iterator[str]:
    """The source of slot after slot without end, by earliest deadline first among released blocks."""
    size = sum(quanta.values())
    coming = [(0, s, 0) for s in quanta]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []
    for t in itertools.count():
        while coming and coming[0][0] <= t:
            _, s, j = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(j + 1) * size // quanta[s]), s, j))
        _, s, j = heapq.heappop(ready)
        yield s
        heapq.heappush(coming, ((j + 1) * size // quanta[s], s, j + 1))


def period(quanta: dict[str, int]) -> list[str]:
    """The slots until all sources have had their quanta; from there on they repeat."""
    return list(itertools.islice(slots(quanta), sum(quanta.values())))


@dataclass(frozen=True)
class Phase:
    first_slot: int
    slots: int
    quanta: dict[str, int]
    turns: np.ndarray  # of each slot, the place of its source in quanta
    first_block: dict[str, int]
    blocks: dict[str, int]

    @cached_property
    def order(self) -> list[str]:
        names = list(self.quanta)
        return [names[k] for k in self.turns]


def plan(blocks: dict[str, int], weights: dict[str, float], quanta: int = QUANTA) -> list[Phase]:
    """Phases until all blocks are out, each until a source is. blocks: how many each source has."""
    done, left, slot, phases = dict.fromkeys(blocks, 0), {s: n for s, n in blocks.items() if n}, 0, []
    while left:
        active = {s: weights[s] for s in left if weights.get(s, 0) > 0} or dict.fromkeys(left, 1.0)
        q = shares(active, max(quanta, len(active)))
        order, number = array("i"), {s: k for k, s in enumerate(q)}
        used = dict.fromkeys(q, 0)
        for s in slots(q):
            order.append(number[s])
            used[s] += 1
            if used[s] == left[s]:
                break
        end = len(order)
        phases.append(Phase(slot, end, q, np.frombuffer(order, np.int32), {s: done[s] for s in q}, used))
        for s, n in used.items():
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        slot += end
    return phases


def by_power(power: float) -> Callable[[dict[str, int]], dict[str, float]]:
    """Target weights proportional to a power of the sources' sizes: 1 as they are, 0 all alike."""
    return lambda sizes: {s: n**power for s, n in sizes.items()}


def _slot_table(spark: SparkSession, phases: list[Phase]) -> DataFrame:
    """__s, __j, mix_phase, mix_slot of every block, in the shared folder."""
    path = scratch(spark, "slots")
    schema = "__s string, __j long, mix_phase int, mix_slot long"
    spark.createDataFrame([], schema).write.parquet(path)
    for part in _slot_rows(phases):
        spark.createDataFrame(part, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _slot_rows(phases: list[Phase]) -> Iterator[pa.Table]:
    for k, p in enumerate(phases):
        names = pa.array(list(p.quanta), pa.string())
        next_ = np.array([p.first_block[s] for s in p.quanta], np.int64)
        for at in range(0, p.slots, CHUNK):
            which = p.turns[at : at + CHUNK]
            by_source = np.argsort(which, kind="stable")
            times = np.bincount(which, minlength=len(names))
            nth = np.empty(len(which), np.int64)
            nth[by_source] = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.table([names.take(pa.array(which)), pa.array(next_[which] + nth), pa.array(np.full(len(which), k, np.int32)), pa.array(p.first_slot + at + np.arange(len(which)))], ["__s", "__j", "mix_phase", "mix_slot"])
            next_ += times


def _before(keys: list[str], by: str) -> Column:
    """The sum of __n over the rows of the keys that come before."""
    rows = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("__n").over(rows), F.lit(0))


def mix(docs: DataFrame, weights: dict[str, float] | Callable[[dict[str, int]], dict[str, float]], block: int = 16, quanta: int = QUANTA, per_range: int = 500, ordered: bool = False) -> DataFrame:
    """``docs`` with mix_phase, mix_slot (from 0) and mix_place (within the slot's block); ordered: laid out in that order.

    weights: by source, or a function from the sources' numbers of documents to them.
    """
    spark = docs.sparkSession
    ids = [n for n in ("doc_id", "source") if n in docs.columns]
    # the row travels as one column, so that no name of it can clash with those made here
    keyed = docs.select(packed(docs.drop("mix_phase", "mix_slot", "mix_place")).alias("row"), F.coalesce(F.col("source"), F.lit("")).alias("__s"), unit_hash(*ids, F.lit("mix")).alias("__u"))
    slim = docs.select("source")
    sizes = {r["s"]: r["n"] for r in slim.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources: mix groups of sources first")
    phases = plan({s: -(-n // block) for s, n in sizes.items()}, weights(sizes) if callable(weights) else weights, quanta)
    table = _slot_table(spark, phases)
    table = F.broadcast(table) if sum(p.slots for p in phases) <= MOST_SENT else table
    ranges = max(1, -(-sum(sizes.values()) // per_range))
    keyed = keyed.withColumn("__r", F.floor(F.col("__u") * ranges).cast("int"))
    counts = docs.select(F.coalesce(F.col("source"), F.lit("")).alias("__s"), F.floor(unit_hash(*ids, F.lit("mix")) * ranges).cast("int").alias("__r")).groupBy("__s", "__r").agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__g", F.floor(F.col("__r") / GROUP))
    groups = counts.groupBy("__s", "__g").agg(F.sum("__n").alias("__n")).select("__s", "__g", _before(["__s"], "__g").alias("__base"))
    starts = counts.withColumn("__in", _before(["__s", "__g"], "__r")).join(groups, ["__s", "__g"]).select("__s", "__r", (F.col("__base") + F.col("__in")).alias("__start"))
    nth = F.row_number().over(Window.partitionBy("__s", "__r").orderBy("__u", *[F.col("row")[i] for i in ids], F.xxhash64("row")))
    placed = keyed.withColumn("__k", nth).join(starts, ["__s", "__r"]).withColumn("__at", F.col("__start") + F.col("__k") - 1)
    placed = placed.withColumn("__j", F.floor(F.col("__at") / block)).withColumn("mix_place", (F.col("__at") % block).cast("int"))
    out = placed.join(table, ["__s", "__j"])
    out = out.select("row.*", "mix_phase", "mix_slot", "mix_place")
    if ordered:
        out = out.repartitionByRange(F.col("mix_slot"), F.col("mix_place")).sortWithinPartitions("mix_slot", "mix_place")
    return out
