"""Language-model scoring with Brown class-based n-grams.

P(word | before) = P(class(word) | class(before)) * P(word | class(word)). Every training word has a class of its own choice:

1. Exchange clustering of the core, the ``clustered`` most frequent words, and of SHAPES groups of all other words by ending:
   starting from classes dealt by frequency, each element moves to the class that raises the likelihood of the corpus's
   class bigrams most, until nothing moves. The groups' classes stand in for words that have none yet.
2. Every further word of the head takes the class under which its neighbours in the corpus are likeliest, from all its
   bigrams with the classes. The same for the rest of the vocabulary, the tail, whose neighbours in the head have their
   final classes by then. So what is clustered grows with the corpus; only words that the training documents lack have the
   class of their group.
3. Class bigrams are counted anew with all final classes. Both probabilities are smoothed by adding 0.5.

All counts are over all training documents. Texts are cut into words twice: for the word counts, and to be written out as word numbers, which all further
passes read. Word counts are summed per task before the shuffle. The head, a fixed number of words, goes out with the
tasks; only rarer words of a document are shuffled to meet their counts and classes, so no word is hot in that join.

Defined results: null and empty texts are one end token; a null doc_id is neither held out nor learned from; repeated
rows are scored each; without training documents every count is 0 and every probability 1; other columns are ignored.
Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serploom.llm.common import check_columns, columns_of, fold, lower_words, persisted
from serploom.shipping import ship

SHAPES = 64
#: Words that go out with the tasks: some 30 MB in a Python worker, whatever the corpus.
HEAD = 150_000
#: Rows of a batch that are scored before they are handed on.
SLICE = 1000
#: Words whose cells are weighed against all classes at a time: 10 MB for 250 words with a hundred cells each.
WORDS = 250
#: Distinct words, or cells of contexts, that a task counts before it hands them on.
FLUSH, CELLS = 250_000, 2_000_000
SMOOTH = 0.5


def shape(word: bytes) -> int:
    """The group of a word by its last three bytes."""
    return zlib.crc32(word[-3:]) % SHAPES


def exchange(counts: np.ndarray, classes: int, fixed: int, sweeps: int = 20) -> np.ndarray:
    """The class of each element from the bigram counts of elements; element ``fixed`` keeps a class of its own, 0."""
    n = len(counts)
    weight = counts.sum(0) + counts.sum(1)
    order = [w for w in np.argsort(-weight, kind="stable") if w != fixed]
    cls = np.zeros(n, np.int64)
    for k, w in enumerate(order):
        cls[w] = 1 + k % (classes - 1)
    one = np.eye(classes)[cls]
    after, before = counts @ one, counts.T @ one
    table = one.T @ counts @ one

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            a, own = cls[w], counts[w, w]
            row, col = after[w].copy(), before[w].copy()
            row[a] -= own
            col[a] -= own
            table[a] -= row
            table[:, a] -= col
            table[a, a] -= own
            down, across = f(table + row) - f(table), f(table + col[:, None]) - f(table)
            d = np.diag_indices(classes)
            gain = down.sum(1) - down[d] + across.sum(0) - across[d] + f(table[d] + row + col + own) - f(table[d])
            out, into = table.sum(1), table.sum(0)
            gain -= f(out + row.sum() + own) - f(out) + f(into + col.sum() + own) - f(into)
            gain[0] = -np.inf
            b = int(gain.argmax()) if gain.max() > gain[a] + 1e-7 else a
            table[b] += row
            table[:, b] += col
            table[b, b] += own
            if b != a:
                cls[w] = b
                after[:, a] -= counts[:, w]
                after[:, b] += counts[:, w]
                before[:, a] -= counts[w]
                before[:, b] += counts[w]
                moved += 1
        if not moved:
            break
    return cls


def word_counts(train: DataFrame) -> DataFrame:
    """token (binary), n over all rows' words; ends are not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["token", "n"])
            seen.clear()
            return made

        for batch in batches:
            for t in batch.column(0):
                seen.update(lower_words(t.as_py()))
                if len(seen) >= FLUSH:
                    yield out()
        yield out()

    return train.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> list:
    """The words above a count, by descending count: the lowest count of a logarithmic grid that leaves ``most`` at most.

    A grid of counts is summed first, so that tasks send the driver what it keeps and nothing else.
    """
    grid = F.floor(F.log2("n") * 64).cast("int")
    level, room = None, most
    for r in sorted(counts.groupBy(grid.alias("g")).count().collect(), reverse=True):  # 64 steps for each doubling
        room -= r["count"]
        if room < 0:
            break
        level = r["g"]
    kept = counts.filter(grid >= level).collect() if level is not None else []
    return sorted(kept, key=lambda r: (-r["n"], bytes(r["token"])))


def encoded(rows: DataFrame, head: list[bytes]) -> DataFrame:
    """``rows`` with their texts as word numbers: ids (a place in the head, or -1 - a place in far), far (the text's other words), shapes (of those)."""
    shared = rows.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(head)})
    kept = [n for n in rows.columns if n != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            cols = columns_of(batch)
            ids, far, shapes = [], [], []
            for t in cols["text"]:
                own: dict[bytes, int] = {}
                put = own.setdefault
                words = lower_words(t.as_py())
                ids.append(np.array([k if (k := get(w)) is not None else -1 - put(w, len(own)) for w in words], np.int32))
                far.append(list(own))
                shapes.append(np.array([shape(w) for w in own], np.int8))
            yield pa.RecordBatch.from_arrays([*(cols[n] for n in kept), _lists(ids, np.int32), pa.array(far, pa.list_(pa.binary())), _lists(shapes, np.int8)], [*kept, "ids", "far", "shapes"])

    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    return rows.select(*kept, "text").mapInArrow(run, ", ".join([*(f"{n} {kinds[n]}" for n in kept), "ids array<int>, far array<binary>, shapes array<tinyint>"]))


def _lists(rows: list[np.ndarray], kind: type) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *rows]).astype(kind)))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins (and the last ends), and the values of all of them."""
    ends = lists.offsets.to_numpy()
    return ends - ends[0], lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]


class Sequence:
    """The texts of a batch as one row of numbers: an end, the words of the first text, an end, and so on.

    Numbers below ``head`` are words of the head, ``head`` is the end, head + 1 + k is the batch's k-th far word.
    """

    def __init__(self, batch: pa.RecordBatch, head: int) -> None:
        cols = columns_of(batch)
        starts, ids = _flat(cols["ids"])
        self.far_starts, self.shapes = _flat(cols["shapes"])
        self.lengths = np.diff(starts)
        n = len(self.lengths)
        doc = np.repeat(np.arange(n), self.lengths)
        ids = ids.astype(np.int64)
        self.at = np.full(len(ids) + n + 1, head, np.int64)
        self.at[np.arange(len(ids)) + doc + 1] = np.where(ids >= 0, ids, head + self.far_starts[:-1][doc] - ids)
        #: The text of every number but the first.
        self.doc = np.repeat(np.arange(n), self.lengths + 1)


def _summed(batches: Iterator[tuple[np.ndarray, np.ndarray]], most: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) added up by key, handed on when ``most`` are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in batches:
        held.append(part)
        if sum(len(k) for k, _ in held) >= most:
            held = [_merged(held)]
            if len(held[0][0]) >= most // 2:
                yield held.pop()
    yield _merged(held)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in parts)]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([np.zeros(0), *(n for _, n in parts)]), len(keys)).astype(np.int64)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _cells(texts: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], name: str) -> DataFrame:
    """name, n: how often each key occurs, per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (_counted(keys(b)) for whole in batches for b in (whole.slice(k, SLICE) for k in range(0, whole.num_rows, SLICE)))
        for k, n in _summed(parts):
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], [name, "n"])

    return texts.select("ids", "shapes").mapInArrow(run, f"{name} long, n long")


def bigrams(texts: DataFrame, head_shapes: np.ndarray, core: int) -> np.ndarray:
    """Counts of neighbouring elements over all encoded rows: the core's words, the groups, and last the end, which stands before a text, too."""
    size, head = core + SHAPES + 1, len(head_shapes)
    element = np.concatenate([np.arange(core), core + head_shapes[core:], [size - 1]]).astype(np.int64)

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        row = Sequence(batch, head)
        e = np.concatenate([element, core + row.shapes.astype(np.int64)])[row.at]
        return e[:-1] * size + e[1:]

    # at most size * size rows come back, a fixed number
    cells = _cells(texts, keys, "cell").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return out.reshape(size, size)


def steps_of(flow: np.ndarray) -> np.ndarray:
    """log10 P(class | class before) from class bigrams."""
    return np.log10((flow + SMOOTH) / (flow.sum(1, keepdims=True) + SMOOTH * len(flow)))


def _fit_of(steps: np.ndarray) -> np.ndarray:
    """Rows: the class before (0 ..), none, the class behind, none. Columns: how well each class goes with it; 0, the end's own, is for no word."""
    none = np.zeros((1, len(steps)))
    fit = np.concatenate([steps, none, steps.T, none])
    fit[:, 0] = -1e3
    return fit


def head_classes(texts: DataFrame, head_shapes: np.ndarray, core_class: np.ndarray, shape_class: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Classes of all words of the head: the core's as they are, the others' by all their bigrams."""
    core, head, classes = len(core_class), len(head_shapes), len(steps)
    now = np.concatenate([core_class, shape_class[head_shapes[core:]]]).astype(np.int64)
    if core == head:
        return now
    side = classes + 1

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        row = Sequence(batch, head)
        c = np.concatenate([now, [0], shape_class[row.shapes]])[row.at]
        p = np.flatnonzero((row.at >= core) & (row.at < head))
        first = row.at[p] * 2 * side
        return np.concatenate([first + c[p - 1], first + side + c[p + 1]])

    fit = _fit_of(steps)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, WORDS) for whole in batches for k in range(0, whole.num_rows, WORDS)):
            cols = columns_of(b)
            yield pa.RecordBatch.from_arrays([cols["word"], pa.array(_best(cols["cells"], cols["ns"], fit), pa.int32())], ["word", "class"])

    cells = _cells(texts, keys, "cell").select(F.floor(F.col("cell") / (2 * side)).alias("word"), (F.col("cell") % (2 * side)).cast("int").alias("cell"), "n")
    # one exchange by word serves both aggregations; a word has at most 2 * side cells
    lists = cells.repartition("word").groupBy("word", "cell").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("ns"))
    got = lists.mapInArrow(choose, "word long, class int").toArrow()  # the head's words at most
    now[got["word"].to_numpy()] = got["class"].to_numpy()
    return now


def _best(cells: pa.Array, ns: pa.Array, fit: np.ndarray) -> np.ndarray:
    """For each list of cells the class that goes best with them, the lowest of equals."""
    starts, at = _flat(cells)
    n = _flat(ns)[1]
    total = np.zeros((len(starts) - 1, fit.shape[1]))
    np.add.at(total, np.repeat(np.arange(len(starts) - 1), np.diff(starts)), fit[at] * n[:, None])
    return total.round(9).argmax(1).astype(np.int32)


def neighbours(batches: Iterator[pa.RecordBatch], now: np.ndarray, shape_class: np.ndarray, classes: int) -> Iterator[pa.RecordBatch]:
    """token, next, cell, n: what far words stand between, per ``SLICE`` texts (next: a far word behind a far word); without token, the class bigrams of all other words."""
    head, side = len(now), classes + 1
    near = np.zeros(classes * classes, np.int64)
    for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
        row = Sequence(batch, head)
        words = columns_of(batch)["far"].flatten().dictionary_encode()
        code, names = words.indices.to_numpy().astype(np.int64), words.dictionary
        own = np.concatenate([now, [0], np.full(len(code), classes)])
        c = own[row.at]
        both = (c[:-1] < classes) & (c[1:] < classes)
        near += np.bincount(c[:-1][both] * classes + c[1:][both], minlength=classes * classes)
        p = np.flatnonzero(c == classes)
        k, n = _counted(code[row.at[p] - head - 1] * side * side + c[p - 1] * side + c[p + 1])
        yield _contexts(names.take(pa.array(k // (side * side))), pa.nulls(len(k), pa.binary()), k % (side * side), n)
        p = np.flatnonzero((c[:-1] == classes) & (c[1:] == classes))
        k, n = _counted(code[row.at[p] - head - 1] * max(len(names), 1) + code[row.at[p + 1] - head - 1])
        yield _contexts(names.take(pa.array(k // max(len(names), 1))), names.take(pa.array(k % max(len(names), 1))), np.full(len(k), -1), n)
    at = np.flatnonzero(near)
    yield _contexts(pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary()), at, near[at])


def tail(texts: DataFrame, now: np.ndarray, shape_class: np.ndarray, steps: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """The rest of the vocabulary as token, n, class in the shared folder, and all class bigrams."""
    classes = len(steps)
    side = classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from neighbours(batches, now, shape_class, classes)

    seen = persisted(texts.select("ids", "shapes", "far").mapInArrow(run, "token binary, next binary, cell int, n long"), "contexts")
    fit, by_shape = _fit_of(steps), shape_class

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, WORDS) for whole in batches for k in range(0, whole.num_rows, WORDS)):
            cols = columns_of(b)
            starts, cell = _flat(cols["cells"])
            n = _flat(cols["ns"])[1]
            owner = np.repeat(np.arange(b.num_rows), np.diff(starts))
            total = np.zeros((b.num_rows, classes))
            np.add.at(total, owner, (fit[cell // side] + fit[side + cell % side]) * n[:, None])
            best = total.round(9).argmax(1)
            bare = np.bincount(owner, cell != side * side - 1, b.num_rows) == 0  # no neighbour in the head
            best[bare] = [by_shape[shape(cols["token"][int(k)].as_py())] for k in np.flatnonzero(bare)]
            times = np.bincount(owner, n, b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([cols["token"], pa.array(times), pa.array(best.astype(np.int32)), cols["cells"], cols["ns"]], ["token", "n", "class", "cells", "ns"])

    own = seen.filter("token is not null and next is null").repartition("token").groupBy("token", "cell").agg(F.sum("n").alias("n"))
    lists = own.groupBy("token").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("ns"))
    words = persisted(lists.mapInArrow(choose, "token binary, n long, class int, cells array<int>, ns array<long>"), "tail")
    flow = np.zeros((side, side))
    for r in seen.filter("token is null").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        flow[r["cell"] // classes, r["cell"] % classes] += r["n"]
    for r in words.select("class", F.explode(F.arrays_zip("cells", "ns")).alias("x")).groupBy("class", "x.cells").agg(F.sum("x.ns").alias("n")).collect():
        # a neighbour that is of the tail itself is counted with the pairs
        flow[r["cells"] // side, r["class"]] += r["n"]
        flow[r["class"], r["cells"] % side] += r["n"]
    of = words.select("token", "class")
    pairs = seen.filter("next is not null").groupBy("token", "next").agg(F.sum("n").alias("n")).join(of, "token").select(F.col("next").alias("token"), F.col("class").alias("a"), "n")
    for r in pairs.join(of, "token").groupBy("a", "class").agg(F.sum("n").alias("n")).collect():
        flow[r["a"], r["class"]] += r["n"]
    return words.select("token", "n", "class"), flow[:classes, :classes]


def _contexts(token: pa.Array, next_: pa.Array, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([token, next_, pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64))], ["token", "next", "cell", "n"])


@dataclass(frozen=True)
class ClassModel:
    """What scoring needs: the head's words, counts and classes, the groups' classes, and the class tables (log10)."""

    head: tuple[bytes, ...]
    counts: tuple[int, ...]
    classes: tuple[int, ...]
    shape_class: tuple[int, ...]
    steps: tuple[tuple[float, ...], ...]
    class_norm: tuple[float, ...]
    ends: int
    tokens: int
    distinct: int

    @property
    def base_norm(self) -> float:
        return self.tokens + SMOOTH * (self.distinct + 1)


class Scorer:
    """The model's tables as arrays; the words themselves stay behind, texts come as their numbers."""

    def __init__(self, m: ClassModel) -> None:
        counts = np.array([*m.counts, m.ends], float)
        self.known = counts > 0
        self.cls = np.array([*m.classes, 0], np.int64)
        self.norm, self.base_norm = np.array(m.class_norm), m.base_norm
        self.base = np.log10((counts + SMOOTH) / m.base_norm)
        self.emit = np.log10((counts + SMOOTH) / self.norm[self.cls])
        self.steps = np.array(m.steps)
        self.shape_class = np.array(m.shape_class, np.int64)

    def near(self, batch: pa.RecordBatch) -> list[pa.Array]:
        """Of each text: tokens, known ones, base and model sums without what far words have a part in; times of its far
        words; and the steps to or from those, a class as its number, the k-th far word as the number of classes + k."""
        head, classes = len(self.base) - 1, len(self.steps)
        row = Sequence(batch, head)
        n, far = len(row.lengths), len(row.shapes)
        pad = lambda x: np.concatenate([x, np.zeros(far)])[row.at[1:]]
        total = lambda x: np.bincount(row.doc, x, n)
        local = classes + np.arange(far) - np.repeat(row.far_starts[:-1], np.diff(row.far_starts))
        code = np.concatenate([self.cls, local])[row.at]
        a, b = code[:-1], code[1:]
        plain = (a < classes) & (b < classes)
        walked = np.zeros(len(a))
        walked[plain] = self.steps[a[plain], b[plain]]
        open_ = ~plain
        ends = np.concatenate([[0], np.cumsum(np.bincount(row.doc[open_], minlength=n))]).astype(np.int32)
        times = np.bincount(row.at[row.at > head] - head - 1, minlength=far).astype(np.int32)
        lists = lambda x, e: pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(x.astype(np.int32)))
        return [
            pa.array(row.lengths.astype(np.int64) + 1), pa.array(total(pad(self.known)).astype(np.int64)), pa.array(total(pad(self.base))), pa.array(total(pad(self.emit) + walked)),
            lists(times, row.far_starts), lists(a[open_], ends), lists(b[open_], ends),
        ]

    def far(self, lists: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the far words of each text add: known ones, base, model. lists: shapes, times, a, b of each text, and pos, n, class of
        those of its far words that the training documents have."""
        starts, shapes = lists["shapes"]
        texts, classes = len(starts) - 1, len(self.steps)
        of = lambda name: np.repeat(np.arange(texts), np.diff(lists[name][0]))
        cls, n = self.shape_class[shapes], np.zeros(len(shapes))
        at = starts[of("pos")] + lists["pos"][1]
        cls[at], n[at] = lists["class"][1], lists["n"][1]
        times, word = lists["times"][1], of("shapes")
        known = np.bincount(word, times * (n > 0), texts)
        base = np.bincount(word, times * np.log10((n + SMOOTH) / self.base_norm), texts)
        model = np.bincount(word, times * np.log10((n + SMOOTH) / self.norm[cls]), texts)
        code, step = np.concatenate([np.arange(classes), cls]), of("a")
        a, b = (np.where(x < classes, x, x + starts[step]) for x in (lists["a"][1], lists["b"][1]))
        return known.astype(np.int64), base, model + np.bincount(step, self.steps[code[a], code[b]], texts)


def _row_ids(rows: DataFrame, head: list[bytes]) -> DataFrame:
    """Encoded rows with a number each, in the shared folder."""
    return persisted(encoded(rows, head).withColumn("row", F.monotonically_increasing_id()), "encoded")


def _fit(spark: SparkSession, texts: DataFrame, counts: DataFrame, top: list, clustered: int, classes: int) -> tuple[ClassModel, DataFrame]:
    ends = texts.count()
    words, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    names = tuple(bytes(r["token"]) for r in top)
    core, shapes = min(clustered, len(top)), np.array([shape(w) for w in names], np.int64)
    table = bigrams(texts, shapes, core)
    cls = exchange(table, classes, len(table) - 1)
    one = np.eye(classes)[cls]
    steps, by_shape = steps_of(one.T @ table @ one), cls[core:-1]
    now = head_classes(texts, shapes, cls[:core], by_shape, steps)
    rest, flow = tail(texts, now, by_shape, steps)
    steps = steps_of(flow)
    # tokens and distinct words of each class
    times = np.array([r["n"] for r in top], float)
    tokens, kinds = np.bincount(now, times, classes), np.bincount(now, minlength=classes).astype(float)
    for r in rest.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        tokens[r["class"]] += r["n"]
        kinds[r["class"]] += r["kinds"]
    tokens[0] += ends
    kinds[0] += ends > 0
    norm = tokens + SMOOTH * (kinds + 1)
    if not ends:
        steps, norm = np.zeros_like(steps), np.full(classes, SMOOTH)
    numbers = lambda x: tuple(x.tolist())
    return ClassModel(names, tuple(r["n"] for r in top), numbers(now), numbers(by_shape), tuple(map(tuple, steps.tolist())), numbers(norm), ends, int(words or 0) + ends, int(distinct or 0) + (ends > 0)), rest


def train(docs: DataFrame, clustered: int = 500, classes: int = 48, head: int = HEAD) -> tuple[ClassModel, DataFrame]:
    """The model, and the words beyond its head (token, n, class) in the shared folder."""
    ship(docs.sparkSession)
    counts = persisted(word_counts(docs), "words")
    top = most_frequent(counts, head)
    return _fit(docs.sparkSession, _row_ids(docs.select("text"), [bytes(r["token"]) for r in top]), counts, top, clustered, classes)


def score(docs: DataFrame, model: ClassModel, rest: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row (doc_id, held_out, text)."""
    ship(docs.sparkSession)
    return _score(_row_ids(docs.select("doc_id", "held_out", "text"), list(model.head)), model, rest)


def _score(texts: DataFrame, model: ClassModel, rest: DataFrame) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(Scorer(model))
    kind = dict(texts.dtypes)["doc_id"]
    same = ["row", "doc_id", "held_out", "shapes"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            cols = columns_of(batch)
            yield pa.RecordBatch.from_arrays([*(cols[n] for n in same), *shared.value.near(batch)], [*same, *numbers, "times", "a", "b"])

    numbers = ["n_tokens", "n_known", "base_score", "score"]
    typed = f"doc_id {kind}, held_out boolean"
    half = texts.select(*same, "ids").mapInArrow(near, f"row long, {typed}, shapes array<tinyint>, n_tokens long, n_known long, base_score double, score double, times array<int>, a array<int>, b array<int>")
    words = texts.select("row", F.posexplode("far").alias("pos", "token")).join(rest, "token")
    found = words.groupBy("row").agg(*[F.collect_list(c).alias(c) for c in ("pos", "n", "class")])  # the text's own words

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            cols = columns_of(batch)
            more = shared.value.far({c: _flat(cols[c]) for c in ("shapes", "times", "a", "b", "pos", "n", "class")})
            sums = [pa.array(cols[c].to_numpy(zero_copy_only=False) + x) for c, x in zip(numbers[1:], more, strict=True)]
            yield pa.RecordBatch.from_arrays([cols["doc_id"], cols["held_out"], cols["n_tokens"], *sums], ["doc_id", "held_out", *numbers])

    # no list where a text has no such word
    both = half.join(found, "row", "left").drop("row").withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in (("pos", "array<int>"), ("n", "array<long>"), ("class", "array<int>"))})
    out = both.mapInArrow(far, f"{typed}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(docs: DataFrame, folds: int = 5, held: int = 1, clustered: int = 500, classes: int = 48, head: int = HEAD) -> DataFrame:
    """Train on the rows outside fold ``held`` and score every row; see score."""
    ship(docs.sparkSession)
    rows = check_columns(docs, "doc_id", "text").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)))
    learn = ~F.col("held_out") & F.col("doc_id").isNotNull()
    counts = persisted(word_counts(rows.filter(learn)), "words")
    top = most_frequent(counts, head)
    texts = _row_ids(rows, [bytes(r["token"]) for r in top])
    model, rest = _fit(docs.sparkSession, texts.filter(learn), counts, top, clustered, classes)
    return _score(texts, model, rest)
