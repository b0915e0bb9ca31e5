"""Collocations, centroid clusters and shards against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from serploom.llm import centroids, collocations, shards
from serploom.llm.perfecthash import PerfectHash

# --- collocations


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(-(1 << 63), (1 << 63) - 1), max_size=300), st.lists(st.integers(-(1 << 63), (1 << 63) - 1), max_size=50))
def test_perfect_hash_is_minimal_and_verified(keys, others):
    found = PerfectHash(np.array(sorted(keys), np.int64))
    slots = found.slots(np.array(sorted(keys), np.int64))
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert all((s >= 0) == (k in keys) for k, s in zip(others, found.slots(np.array(others, np.int64)).tolist(), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.text(" \t\n\rab,.É\x00", max_size=40))
def test_pieces_are_the_rules(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    want = [re.findall(r"[^\x20\x09]+", p) for p in re.split("[.,;:!?\\x0A-\\x0D]", lower)]
    flat = [w for words in collocations.pieces(text.encode()) for w in words]
    got, part = [], []
    for w in [*flat, b"\xff"]:
        if w == b"\xff":
            got.append(part)
            part = []
        else:
            part.append(w.decode())
    assert [p for p in got if p] == [p for p in want if p]


def test_long_texts_are_split_between_words():
    text = (b"abc def\tghi " * 200_000) + b"x" * 3_000_000 + b" end"
    parts = list(collocations.pieces(text))
    assert len(parts) > 2 and sum(parts, []) == text.split()


def brute_collocations(rows, least, top):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            counts.update((lang, tuple(ws[i : i + m])) for m in range(1, 5) for i in range(len(ws) - m + 1))
    cands = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, g), a in cands.items():
        inside = any(l2 == lang and len(h) > len(g) and 100 * b >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for (l2, h), b in cands.items())
        if not inside:
            score, k = min((2_000_000 * a // (counts[lang, g[:k]] + counts[lang, g[k:]]), k) for k in range(1, len(g)))
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), counts[lang, g[:k]], counts[lang, g[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(5)
    words = ["the", "The", "cat", "sat", "on", "mat", "é", "ü-x", "a"]
    rows = []
    for k in range(120):
        size = pick.choice([0, 1, 3, 20, 60])
        rows.append((" ".join(pick.choices(words, k=size)).replace(" mat ", pick.choice([" mat ", " mat, ", "\tmat\n"])), pick.choice(["en", "en", "fr", None, "und"])))
    rows += [("one two three four five six " * 900, "en"), (None, "en"), ("", None), ("the cat sat on the mat", "de")]
    return rows


@pytest.mark.parametrize("how", [{}, {"slice_keys": 5, "slice_words": 3, "buckets": 16}], ids=["one slice", "slices"])
def test_collocations_against_brute_force(spark, texts, how):
    df = spark.createDataFrame(texts, "text string, lang string").repartition(3)
    got = collocations.mine(df, least=4, top=25, **({"buckets": 1 << 12} | how)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == brute_collocations(texts, 4, 25)


def test_scores_pass_64_bits(spark):
    a = 9_000_000_000_000
    rows = [(1, "en", [b"x", b"y"], [a + 7, a], [a + 5, a], a)]
    got = collocations._cuts(spark.createDataFrame(rows, "id int, lang string, words array<binary>, heads array<long>, tails array<long>, a long"), 2).first()
    assert got.score == 2_000_000 * a // (2 * a + 12)


def test_first_in_shares(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RANKED", 2)
    rows = [("en" if k % 3 else "fr", f"p{k}", k % 7, k % 11) for k in range(200)]
    got = collocations._first(spark.createDataFrame(rows, "lang string, phrase string, a long, score long"), 5).collect()
    want = {lang: [r[1] for r in sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[3], -r[2], r[1]))[:5]] for lang in ("en", "fr")}
    assert {lang: [r.phrase for r in sorted(got, key=lambda r: r["rank"]) if r.lang == lang] for lang in want} == want


# --- centroid clusters


def brute_clusters(rows, k, rounds, parts):
    kept = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == parts and all(x is not None and np.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(cents)), key=lambda c: (dist(v, cents[c]), c))
    for _ in range(rounds):
        at = [near(v) for _, v in kept]
        groups = [[v for (_, v), a in zip(kept, at, strict=True) if a == c] for c in range(len(cents))]
        cents = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, cents, strict=True)]
    at = [(i, near(v), v) for i, v in kept]
    d = [(i, c, dist(v, cents[c])) for i, c, v in at]
    per = Counter()
    for _, c, x in d:
        per[c] += x
    return [(i, c, x, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, x in d]


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_clusters_against_brute_force(spark, rounds):
    pick = random.Random(3)
    rows = [(k % 180, [pick.choice([-2.0, -0.5, 0.0, 0.25, 1.5]) + pick.gauss(0, 0.3) * (k % 2) for _ in range(4)]) for k in range(200)]
    rows += [(500 + k, [0.25, 0.25, 0.25, 0.25]) for k in range(60)] + [(None, [1.0, 2.0, 3.0, 4.0]), (700, [float("nan")] * 4), (701, None), (702, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = centroids.cluster(df, k=5, rounds=rounds, parts=4).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_clusters(rows, 5, rounds, 4), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 6))
def test_bounds_never_change_an_assignment(seed, k):
    rng = np.random.default_rng(seed)
    v = rng.integers(-6, 7, (80, 3))
    cents, old = rng.integers(-6, 7, (k, 3)), None
    near, upper, lower = np.full(80, -1), np.full(80, np.inf), np.zeros(80)
    for _ in range(6):
        near, upper, lower, _n = centroids.assign(v, near, upper, lower, old, cents)
        want, best, second = centroids.scan(v, cents)
        assert (near == want).all() and (upper**2 >= best - 1e-6).all() and ((second < 0) | (lower <= np.sqrt(np.maximum(second, 0)) + 1e-6)).all()
        old = cents
        cents = cents + rng.integers(-1, 2, cents.shape) * (rng.random((k, 1)) < 0.5)


def test_bounds_save_scans():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(0, 50, (300, 8)), rng.integers(5000, 5050, (300, 8))])
    cents = np.array([v[0], v[300]])
    state = centroids.assign(v, np.full(600, -1), np.full(600, np.inf), np.zeros(600), None, cents)
    assert state[3] == 600 and centroids.assign(v, *state[:3], cents, cents + 1)[3] == 0


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), parts=2)


# --- shards


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 700), st.integers(0, 1 << 40))
def test_feistel_is_a_permutation(n, seed):
    f = shards.Feistel(n, seed)
    places = f.places(np.arange(n))
    assert sorted(places.tolist()) == list(range(n)) and (f.numbers(places) == np.arange(n)).all()


def plain_place(x, n, seed=shards.SEED, rounds=shards.ROUNDS):
    half, mask = max(1, (max(n - 1, 1).bit_length() + 1) // 2), (1 << 64) - 1
    while True:
        left, right = x >> half, x & (1 << half) - 1
        for turn in range(rounds):
            z = right + ((seed << 8) + turn + 1) * 0x9E3779B97F4A7C15 & mask
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
            z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
            left, right = right, left ^ (z ^ z >> 31) & (1 << half) - 1
        x = left << half | right
        if x < n:
            return x


def shard_rows():
    rows = [(k, f"text {k} é", f"s{k % 3}") for k in range(150)]
    return rows + [(None, "copy", "s")] * 90 + [(7, None, None), (7, "", "s"), (7, "text 7 é", "s1")]


def test_shards_against_brute_force(spark):
    rows = shard_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = shards.assign(df.repartition(3), per_range=20, copies=8).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted(r.row_number for r in got) == list(range(len(rows))) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    for r in got:
        assert (r.slot * 8 + r.shard) == plain_place(r.row_number, len(rows))
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_dont_depend_on_the_layout(spark):
    rows = shard_rows()
    random.Random(2).shuffle(rows)
    schema = "doc_id long, text string, source string"
    one = shards.assign(spark.createDataFrame(shard_rows(), schema).repartition(5), per_range=20, copies=8)
    two = shards.assign(spark.createDataFrame(rows, schema).coalesce(1), per_range=20)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_shards_as_files(spark, tmp_path):
    df = spark.createDataFrame(shard_rows(), "doc_id long, text string, source string").withColumn("slot", F.lit("x"))
    shards.write_shards(df, str(tmp_path / "out"), shards=4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t) for i, t, _ in shard_rows())
    assert [r["count"] for r in back.groupBy("shard").count().orderBy("shard").collect()] == [61, 61, 61, 60]
    assert all(len(list((tmp_path / "out" / f"shard={k}").glob("*.parquet"))) == 2 for k in range(4)) and {r.slot for r in back.collect()} == {"x"}
    with pytest.raises(ValueError, match="column"):
        shards.write_shards(df.withColumn("shard", F.lit(1)), str(tmp_path / "no"))
