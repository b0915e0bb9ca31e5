"""Language identification by cross-parsing entropy.

For each language a suffix automaton over a bounded sample of labelled text yields, from any position of a text, the
longest match. Parsing a text greedily into longest matches (a Ziv-Merhav cross parse) costs few phrases when the text
resembles the training text; phrases * log2(training length) / length estimates the cross entropy, and the lowest wins.

The parse itself is a finite automaton: a missing edge ends a phrase and follows the edge out of the root. The edges of
all automata are one hash table, as large as they are many, whatever the alphabets, and a batch of texts is parsed in lock step with NumPy.

Defined results: null text or text without any letter gives ``und`` with score 0; equal entropies go to the
alphabetically first language; repeated rows are scored alike; no labelled training row at all gives ``und`` everywhere;
other columns of the input are ignored. Texts are parsed whole. So that one very long text is many short lanes, it is cut into blocks of
BLOCK symbols, each parsed as if a phrase began there; then each block is parsed again from the state that the block
before ended in, until both parses meet, which they do after some phrases. The result is that of one parse.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serploom.llm.common import arrow_map, check_columns, columns_of, fold, unit_hash

#: Symbols of a text that one lane parses.
BLOCK = 4096
#: Symbols that are parsed together, which bounds the memory of a batch.
GROUP = 3_000_000
#: An odd number near 2 ** 64 / golden ratio: spreads keys over the table.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Training text per language, in the order of names. It is small (see fit) and goes out with the tasks."""

    langs: tuple[str, ...]
    texts: tuple[str, ...]


def fit(train: DataFrame, sample_docs: int = 256, excerpt_chars: int = 512, most_chars: int = 4_000_000, max_langs: int = 5_000) -> LanguageModel:
    """Learn from columns doc_id, text, lang of labelled rows.

    Documented bound of the sample: about ``sample_docs`` rows per language, chosen by a hash of doc_id over all rows,
    and ``excerpt_chars`` characters of each, at an offset that the hash chooses; with many languages fewer rows of each, so that all
    samples together stay at about ``most_chars`` characters. Only the model is fitted on a sample.
    """
    rows = check_columns(train, "doc_id", "text", "lang").filter("lang is not null and text is not null and length(text) > 0")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs")
    if not counts:
        return LanguageModel((), ())
    sample_docs = max(1, min(sample_docs, most_chars // (excerpt_chars * len(counts))))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, sample_docs / n))])
    at = F.floor(unit_hash("doc_id", F.lit("at")) * (F.greatest(F.length("text") - excerpt_chars, F.lit(0)) + 1)).cast("int")
    picked = rows.filter(F.col("lang").isin(list(counts)) & (unit_hash("doc_id", F.lit("row")) < share[F.col("lang")])).select(
        "lang", "doc_id", F.substring(F.col("text"), at + 1, F.lit(excerpt_chars)).alias("part")
    )
    texts: dict[str, list[str]] = {lang: [] for lang in sorted(counts)}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"], r["part"])):
        texts[r["lang"]].append(r["part"])
    kept = {lang: "\n".join(parts)[: 2 * sample_docs * excerpt_chars] for lang, parts in texts.items() if parts}
    return LanguageModel(tuple(kept), tuple(kept.values()))


def _suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Edges of the minimal automaton of all factors of the sequence; state 0 is the root."""
    edges: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in symbols.tolist():
        new = len(edges)
        edges.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return edges


class CrossParser:
    """The tables of one model; built once per Python worker."""

    def __init__(self, model: LanguageModel) -> None:
        self.langs = model.langs
        letters = sorted({ch for t in model.texts for ch in t.lower() if LETTER.match(ch)})
        # 0 is any run of other characters, 1 a letter that no training text has
        self.lut = np.zeros(0x110000, np.int32)
        for m in range(0x110000 >> 8):
            page = "".join(map(chr, range(m << 8, (m + 1) << 8)))
            if page.isprintable() or any(map(str.isalpha, page)):
                self.lut[m << 8 : (m + 1) << 8] = [ch.isalpha() for ch in page]
        for k, ch in enumerate(letters):
            self.lut[ord(ch)] = 2 + k
        self.width = 2 + len(letters)
        keys, targets, roots, logs, states = [], [], [], [], 0
        self.first = np.full((len(model.texts), self.width), -1, np.int64)
        for n, text in enumerate(model.texts):
            symbols = self.encode([text])[0]
            edges = _suffix_automaton(symbols)
            keys.append(np.array([(states + s) * self.width + c for s, to in enumerate(edges) for c in to], np.int64))
            targets.append(np.array([states + t for to in edges for t in to.values()], np.int64))
            for c, t in edges[0].items():
                self.first[n, c] = states + t
            roots.append(states)
            logs.append(np.log2(max(len(symbols), 2)))
            states += len(edges)
        self.roots, self.logs = np.array(roots, np.int64), np.array(logs)
        self._hash(np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *targets]))

    def _hash(self, keys: np.ndarray, targets: np.ndarray) -> None:
        """Open addressing, a quarter full at most."""
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.targets = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            self.keys[slot[left[free]]] = keys[left[free]]  # of several for one slot the last stays
            put = left[self.keys[slot[left]] == keys[left]]
            self.targets[slot[put]] = targets[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and how many phrases end: one where an edge is missing, and one more if the root lacks it, too."""
        key = state * self.width + symbol
        slot = self._slot(key)
        held = self.keys[slot]
        next_ = self.targets[slot].astype(np.int64)
        ended = np.zeros(len(state), np.int64)
        off = np.flatnonzero(held != key)
        while len(off):  # probe on; an empty slot tells that there is no such edge
            gone = off[held[off] < 0]
            if len(gone):
                l = lang[gone]
                root, first = self.roots[l], self.first[l, symbol[gone]]
                ended[gone] = 1 + ((first < 0) & (state[gone] != root))
                next_[gone] = np.where(first < 0, root, first)
            off = off[held[off] >= 0]
            slot[off] = (slot[off] + 1) & self.mask
            held[off] = self.keys[slot[off]]
            next_[off] = self.targets[slot[off]]
            off = off[held[off] != key[off]]
        return next_, ended

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts one after the other, runs of non-letters squeezed to one; and each text's number of symbols."""
        each = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        sizes = np.array([len(x) for x in each], np.int64)
        if not sizes.sum():
            return np.zeros(0, np.int64), sizes
        symbols = self.lut[np.concatenate(each)]
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        ends = np.cumsum(sizes)
        keep[(ends - sizes)[sizes > 0]] = True
        before = np.concatenate([[0], np.cumsum(keep)])
        return symbols[keep].astype(np.int64), before[ends] - before[ends - sizes]

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits per symbol, texts x languages; the texts must not be empty."""
        symbols, sizes = self.encode(texts)
        starts = np.cumsum(sizes) - sizes
        lanes = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = starts[owner] + nth * BLOCK
        length = np.minimum(sizes[owner] - nth * BLOCK, BLOCK)
        many = len(self.langs)
        # one lane for each language and block, the longest first
        order = np.argsort(-length, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        lang = np.tile(np.arange(many), len(order))
        at_, length_ = np.repeat(at[order], many), np.repeat(length[order], many)
        state, phrases = self.roots[lang], np.zeros(len(lang), np.int64)
        running = np.searchsorted(-length_, -np.arange(length_[0]), side="left")
        for t in range(length_[0]):
            k = running[t]
            state[:k], ended = self.step(state[:k], symbols[at_[:k] + t], lang[:k])
            phrases[:k] += ended
        self._join_blocks(symbols, (rank, owner, nth), at_, length_, lang, state, phrases)
        last = rank[np.cumsum(lanes) - 1][:, None] * many + np.arange(many)
        total = np.zeros((len(texts), many))
        np.add.at(total, np.repeat(owner[order], many).reshape(-1, many)[:, 0], phrases.reshape(-1, many))
        total += state[last] != self.roots[None, :]
        return total * self.logs / sizes[:, None]

    def _join_blocks(self, symbols: np.ndarray, blocks: tuple, at: np.ndarray, length: np.ndarray, lang: np.ndarray, state: np.ndarray, phrases: np.ndarray) -> None:
        """Corrects end states and phrases of blocks that begin in the middle of a phrase."""
        rank, _, nth = blocks
        many = len(self.langs)
        inner = np.flatnonzero(nth > 0)
        lane = (rank[inner][:, None] * many + np.arange(many)).ravel()
        before = (rank[inner - 1][:, None] * many + np.arange(many)).ravel()
        was = self.roots[lang[lane]]  # the state that the lane was last parsed from
        while True:
            now = state[before]
            open_ = np.flatnonzero(now != was)
            if not len(open_):
                return
            old, new, was = was.copy(), now.copy(), now.copy()
            ends = length[lane]
            t = 0
            while len(open_):
                on, letter = lane[open_], symbols[at[lane[open_]] + t]
                old[open_], a = self.step(old[open_], letter, lang[on])
                new[open_], b = self.step(new[open_], letter, lang[on])
                phrases[on] += b - a
                t += 1
                over = open_[(ends[open_] == t) & (old[open_] != new[open_])]
                state[lane[over]] = new[over]
                open_ = open_[(ends[open_] > t) & (old[open_] != new[open_])]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return lang, score
        open_ = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
        group: list[int] = []
        chars = 0
        for n, k in enumerate(open_):
            group.append(k)
            chars += len(texts[k])
            if chars * max(1, len(self.langs) // 4) < GROUP and n + 1 < len(open_):
                continue
            bits = self.entropies([texts[k] for k in group])
            best = bits.argmin(1)
            ordered = np.sort(bits, 1)
            low, next_ = ordered[:, 0], ordered[:, min(1, bits.shape[1] - 1)]
            sure = next_ / (low + next_) if len(self.langs) > 1 else np.ones(len(group))
            for j, k in enumerate(group):
                lang[k], score[k] = self.langs[best[j]], sure[j]
            group, chars = [], 0
        return lang, score


@lru_cache(maxsize=2)
def _parser(model: LanguageModel) -> CrossParser:
    return CrossParser(model)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text); texts are read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = columns_of(batch)
        lang, score = _parser(shared.value).predict(cols["text"].to_pylist())
        return pa.RecordBatch.from_arrays([cols["doc_id"], cols["held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "held_out" if "held_out" in docs.columns else F.lit(False).alias("held_out"), "text")
    return arrow_map(rows, step, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2, **fit_params: int) -> DataFrame:
    """Fit on the labelled rows outside fold ``held`` and predict every row: doc_id, held_out, lang_pred, score.

    A null doc_id is in no fold: it is neither held out nor learned from.
    """
    rows = check_columns(docs, "doc_id", "text", "lang").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)))
    model = fit(rows.filter(~F.col("held_out") & F.col("doc_id").isNotNull()), **fit_params)
    return predict(rows, model)
