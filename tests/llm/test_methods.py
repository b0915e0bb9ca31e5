"""The operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard as zstd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from serploom.llm import brown, decontam, langid, mixing, neardup, qrules, quality, queries, secretscan, simhash, urlfilter, warc

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def docs(spark, d=SMALL):
    return spark.read.parquet(f"{d}/documents.parquet")


# --- language identification


def brute_phrases(text: str, train: str) -> int:
    n, k = 0, 0
    while k < len(text):
        size = 0
        while k + size < len(text) and text[k : k + size + 1] in train:
            size += 1
        k += max(size, 1)
        n += 1
    return n


@settings(max_examples=40, deadline=None)
@given(st.text("abc d", min_size=5, max_size=60), st.lists(st.text("abcx ", min_size=1, max_size=40), min_size=1, max_size=5))
def test_cross_parse_is_greedy_longest_match(train, texts):
    if not re.search("[a-z]", train):
        return
    parser = langid.CrossParser(langid.LanguageModel(("x",), (train,)))
    squeeze = lambda t: re.sub(r"[^a-z]+", " ", t)
    bits = parser.entropies(texts)[:, 0]
    for text, b in zip(texts, bits, strict=True):
        t = squeeze(text)
        assert round(b * len(t) / math.log2(max(len(squeeze(train)), 2))) == brute_phrases(t, squeeze(train))


@settings(max_examples=60, deadline=None)
@given(st.text("abc d", min_size=5, max_size=80), st.text("abcx ", min_size=1, max_size=300), st.integers(1, 40))
def test_blocks_are_one_parse(train, text, block):
    if not re.search("[a-z]", train):
        return
    parser = langid.CrossParser(langid.LanguageModel(("x", "y"), (train, "c" + train[::-1])))
    whole = parser.entropies([text, "ab", text])
    before, langid.BLOCK = langid.BLOCK, block
    try:
        assert (parser.entropies([text, "ab", text]) == whole).all()
    finally:
        langid.BLOCK = before


def test_alphabets_of_thousands_of_letters():
    one, two = ("".join(chr(0x4E00 + k) for k in range(a, a + 3000)) for a in (0, 3000))
    parser = langid.CrossParser(langid.LanguageModel(("one", "two"), (one, two)))
    assert parser.predict([one[500:560], two[500:560], two[:2000]])[0] == ["one", "two", "two"]
    assert brute_phrases(one[40:90] + two[:3], one) * math.log2(3000) / 53 == pytest.approx(parser.entropies([one[40:90] + two[:3]])[0, 0])


def test_long_texts_are_parsed_in_blocks():
    parser = langid.CrossParser(langid.LanguageModel(("x", "y"), ("abab" * 50, "cdcd" * 50)))
    lang, score = parser.predict(["ab" * 20_000, "cd" * 20_000, None, "..."])
    assert lang == ["x", "y", "und", "und"] and score[0] > 0.9 and score[3] == 0


def test_held_out_languages(spark):
    got = langid.identify(docs(spark, MIDDLE)).join(docs(spark, MIDDLE).select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count()
    held = {r.doc_id for r in got.collect()}
    assert held == {k for k in range(1000) if zlib.crc32(str(k).encode()) % 4 == 2}


# --- near-duplicates


def brute_fingerprint(text):
    w = [x.encode() for x in WORD.findall(ascii_lower(text or ""))]
    sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


@pytest.mark.parametrize("crowd", [512, 2])
def test_simhash_against_all_pairs(spark, crowd):
    rows = docs(spark).collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark), crowd=crowd).collect()}
    assert got == {k: ("%016x" % fps[k], want[k]) for k in fps}


@pytest.mark.parametrize("crowd", [512, 3])
def test_links_of_planted_fingerprints(spark, crowd):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(30)]
    fps = {c for c in centres}
    for c in centres:
        for _ in range(12):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.roots(simhash.links(nodes, crowd=crowd)).collect()}
    want = brute_components(dict(enumerate(fps)))
    groups = {}
    for k, x in enumerate(fps):
        groups.setdefault(roots.get(x, x), set()).add(want[k])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_pivots_never_discard_a_link():
    rng = random.Random(1)
    refs = simhash.pivots()
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3)))
        assert max(abs(bin(a ^ r).count("1") - bin(b ^ r).count("1")) for r in refs) <= 3
        assert any(a & m == b & m for m in simhash.block_masks(6, 3))


def brute_jaccard_groups(texts):
    def shingles(t):
        w = WORD.findall(ascii_lower(t or ""))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, root = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_near_copies_against_all_jaccard_pairs(spark):
    rng = random.Random(11)
    words, rows = [f"w{k}" for k in range(500)], {}
    for _ in range(12):  # chains: each differs in some words from the one before, so that groups hold pairs below 0.8
        now = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(10):
            rows[len(rows)] = " ".join(now)
            for j in rng.sample(range(len(now)), rng.randint(0, max(1, len(now) // 40))):
                now[j] = rng.choice(words)
    for text in ("", None, "\n", "one two", "One  two", "one two three"):
        rows[len(rows)] = text
    rows |= {1000 + r.doc_id: r.text for r in docs(spark).collect()}
    want = brute_jaccard_groups(rows)
    made = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for how in ({}, {"block": 3}, {"volume": 500}):  # one block, blocks in pairs, blocks by shingles
        assert {r.doc_id: r.component_id for r in neardup.components(made, **how).collect()} == want
    kept = corpus_pipeline.simhash_near_dedup(spark, made, SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_the_near_duplicate_stage_proposes_by_simhash(spark):
    def plain(shingles):  # SimHash, bit by bit
        mask, lead = (1 << 64) - 1, []
        for xor, times in zip(neardup._XOR[0].tolist(), neardup._TIMES[0].tolist(), strict=True):
            each = [(s ^ xor) * times & mask for s in shingles]
            each = [x ^ x >> 32 for x in each]
            lead += [2 * sum(x >> b & 1 for x in each) - len(each) for b in range(64)]
        words = [sum((lead[64 * w + b] > 0) << b for b in range(64)) for w in range(neardup.WORDS)]
        groups = [lead[k : k + neardup.GROUP] for k in range(0, len(lead), neardup.GROUP)]
        place = [max(range(neardup.GROUP), key=lambda j: (abs(g[j]), -j)) for g in groups]
        said = [2 * j + (g[j] > 0) for j, g in zip(place, groups, strict=True)]
        n = neardup.GROUPS
        return words, [said[k] << 16 | said[(k + neardup.STEPS[0]) % n] << 8 | said[(k + neardup.STEPS[1]) % n] for k in range(n)]

    rng = random.Random(7)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(90))
    texts = {1: base, 2: base + " more words at the end", 3: "one two", 4: " ".join(f"v{k}" for k in range(300)), 5: ""}
    rows = {r.doc_id: r for r in neardup.signatures(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for k in (1, 2, 3, 4):
        words, keys = plain(neardup.shingle_set(texts[k]).tolist())
        assert [x % (1 << 64) for x in rows[k].fp] == words and rows[k].keys == keys, k
    assert rows[5].fp == [0] * neardup.WORDS and rows[5].keys == []
    nodes = spark.createDataFrame([(k, list(r.keys), list(r.fp)) for k, r in rows.items()], "node long, keys array<int>, fp array<long>")
    found = neardup.proposed(nodes, 5)
    assert {(r.u, r.v) for r in neardup.within_radius(found.filter("k is null"), nodes).collect()} == {(1, 2)}
    made = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(9) if rng.random() < 0.004 else j}" for j in range(150))) for i in range(80)], "doc_id long, text string")
    want = brute_jaccard_groups({r.doc_id: r.text for r in made.collect()})
    for crowd in (2, 100):  # keys' members with the smallest and in blocks, or in pairs
        assert {r.doc_id: r.component_id for r in neardup.components(made, crowd=crowd, block=100).collect()} == want


def test_intersections_of_a_block():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 5000))).astype(np.uint64) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = neardup._intersections(sets)
    assert all(got[i, j] == want[i][j] for i in range(20) for j in range(20) if i != j)


# --- url filters


def test_cascade_is_exact_on_its_universe(spark):
    keys = [f"key{k}" for k in range(3000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    listed = set(keys[::7]) | {"not in the corpus"}
    made = urlfilter.Cascade.build(listed, universe)
    assert len(made.levels) >= 2 and {k for k in keys if k in made} == set(keys[::7])


def test_cascade_of_a_table_of_keys(spark):
    keys = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("key"))
    made = urlfilter.Cascade.build(keys.filter("hash(key) % 3 = 0"), keys)
    want = {r.key for r in keys.filter("hash(key) % 3 = 0").collect()}
    assert {k for k in (f"k{n}" for n in range(0, 40_000, 7)) if k in made} == {k for k in want if int(k[1:]) % 7 == 0}
    assert urlfilter.Cascade.build(keys.limit(0), keys).levels == []


# --- mixing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 40), min_size=1), st.integers(40, 300))
def test_period_stays_within_one_block(weights, quanta):
    q = mixing.shares({s: float(w) for s, w in weights.items()}, quanta)
    assert sum(q.values()) == quanta and min(q.values()) >= 1
    order, done = mixing.period(q), Counter()
    for t, s in enumerate(order, 1):
        done[s] += 1
        assert all(abs(done[x] - t * q[x] / quanta) < 1 for x in q)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 60), min_size=1), st.data())
def test_plan_places_every_block_once(blocks, data):
    weights = {s: data.draw(st.integers(0, 5)) / 2 for s in blocks}
    phases = mixing.plan(blocks, weights, quanta=20)
    assert {s: sum(p.blocks.get(s, 0) for p in phases) for s in blocks} == blocks
    assert sum(p.slots for p in phases) == sum(blocks.values())


@pytest.mark.parametrize("blocks", [{"big": 40_000, **{f"s{k}": 2_000 + 313 * k for k in range(19)}}, {"a": 30_000, "b": 3, "c": 50_001}])
def test_long_phases_stay_within_one_block_of_the_stated_weights(blocks):
    weights = {s: n**0.5 for s, n in blocks.items()}
    left = dict(blocks)
    for p in mixing.plan(blocks, weights):
        names, total = list(p.blocks), sum(weights[s] for s in p.blocks)
        at = np.array([names.index(p.order[t % len(p.order)]) for t in range(p.slots)])
        for k, s in enumerate(names):
            ideal = np.arange(1, p.slots + 1) * (weights[s] / total)
            assert np.abs(np.cumsum(at == k) - ideal).max() < 1 + 1e-6
            left[s] -= p.blocks[s]
    assert not any(left.values())


def test_small_weights_are_not_served_tenfold():
    first = mixing.plan({"a": 20_000, "b": 20_000}, {"a": 0.9999, "b": 0.0001})[0]
    assert first.slots == pytest.approx(20_002, abs=1) and first.blocks["b"] in (2, 3)


def test_mix_as_seen_from_outside(spark):
    """The promise itself, from the result alone: whole blocks, every document once, and less than one block off at every slot."""
    got = mixing.mix(docs(spark, MIDDLE), mixing.by_power(0.5), block=4, per_range=50).collect()
    sizes = Counter(r.source or "" for r in docs(spark, MIDDLE).collect())
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs(spark, MIDDLE).collect())
    slot, phase = {}, {}
    for r in got:
        slot.setdefault(r.mix_slot, []).append((r.mix_place, r.source or ""))
        phase[r.mix_slot] = r.mix_phase
    left = {s: -(-n // 4) for s, n in sizes.items()}
    assert sorted(slot) == list(range(sum(left.values()))) and all(len({s for _, s in v}) == 1 and sorted(p for p, _ in v) == list(range(len(v))) for v in slot.values())
    done, now, since = Counter(), None, 0
    for t in sorted(slot):
        if phase[t] != now:  # a phase ends when a source has run out
            assert now is None or any(left[s] == 0 for s in done)
            now, since, done, active = phase[t], t, Counter(), {s: sizes[s] ** 0.5 for s in left if left[s]}
        s = slot[t][0][1]
        done[s] += 1
        left[s] -= 1
        for x, w in active.items():
            assert abs(done[x] - (t + 1 - since) * w / sum(active.values())) < 1


def test_mix_against_the_plan(spark):
    got = mixing.mix(docs(spark, MIDDLE), mixing.by_power(0.5), block=4, per_range=50).collect()
    sizes = Counter(r.source for r in got)
    phases = mixing.plan({s: -(-n // 4) for s, n in sizes.items()}, {s: n**0.5 for s, n in sizes.items()})
    want = {}
    for k, p in enumerate(phases):
        for t in range(p.slots):
            want[p.first_slot + t] = (k, p.order[t % len(p.order)])
    assert {r.mix_slot: (r.mix_phase, r.source) for r in got} == want
    assert len({(r.mix_slot, r.mix_place) for r in got}) == len(got) == 1000 and max(r.mix_place for r in got) == 3


# --- secrets


def brute_base(t):
    t = t or ""
    a = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
    return sorted(a + b + c)


def test_base_spans_against_brute_force(spark):
    got = {r.doc_id: r for r in secretscan.scan(docs(spark, MIDDLE)).collect()}
    for r in docs(spark, MIDDLE).collect():
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in brute_base(r.text))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()


@given(st.text("token: =\"'AKIA09afsecretſK ", max_size=120))
def test_base_spans_of_odd_texts(text):
    assert secretscan.base_spans(text) == brute_base(text)


def test_novelty_reports_keys_and_leaves_names():
    key = "x9Kq72LmZp0RtVb4Wc8YdN3e"
    assert [s[1] for s in secretscan.spans_of(f"Authorization: Bearer {key}")[1]] == [3]
    assert secretscan.spans_of("client_id of configuration_settings_production_2024")[1] == []
    assert secretscan.spans_of(f"an ordinary sentence with {key} in it")[1] == []
    base, every = secretscan.spans_of(f'api_key = "{key}"')
    assert base == every and len(base) == 1


@pytest.mark.parametrize("name", ["aws_secret_access_key=", "AWS_SECRET_ACCESS_KEY=", "pwd=", "export CREDENTIAL=", "GET /x?a=1&signature=", "sk_secret_", "bearer-token-", "access_key=key=", "pwd: "])
@pytest.mark.parametrize("key", ["9bFlIkpYt5HfavHYMD5hzcS7hsPRxCcQ", "9bFlIkpYt5HfavHYMD5hzcS7hsPRxC==", "FWCEPyYngFbyBMWXaSCrUZoLgub"])
def test_novelty_reaches_values_joined_to_their_names(name, key):
    text = f"{name}{key}&next"
    assert secretscan.spans_of(text)[1] == [(len(name), 3, len(name) + len(key))]
    assert secretscan.redacted(text) == f"{name}[SECRET]&next"
    assert secretscan.spans_of(name + "=" * 40)[1] == secretscan.spans_of(name + "abcdefghijklmnopqrstuvwxyz")[1] == []


# --- quality rules and classifier


def test_quality_rules_by_hand(spark):
    text = "a b c a b c " + "\n".join(["dup line"] * 3) + " #*"
    r = qrules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    w = WORD.findall(text)
    win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(win)
    assert r.n_repeat_words == len({j for k, x in enumerate(win) if n[x] > 1 for j in (k, k + 1, k + 2)}) and (r.n_words, r.n_symbols) == (len(w), 2) and not r.kept


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    got = quality.classify(docs(spark, MIDDLE), labels).filter("held_out").join(labels, "doc_id")
    assert got.filter("predicted = quality").count() >= 0.93 * got.count()
    assert {r.c for r in got.selectExpr("predicted = cast(score >= 0.7 as int) as c").distinct().collect()} == {True}


# --- WARC


@given(st.lists(st.lists(st.integers(0, 50)), max_size=9))
def test_loser_tree_merges(runs):
    assert list(warc.LoserTree([[(x,) for x in sorted(r)] for r in runs])) == sorted((x,) for r in runs for x in r)


def test_warc_round_trip_and_order(spark):
    pages = spark.read.parquet(f"{MIDDLE}/pages.parquet")
    pages = pages.union(pages.select(F.col("page_id") + 1000, "url", "html").filter("page_id < 1050"))
    folder = warc.scratch(spark, "t")
    index = warc.merge(warc.write(pages, folder, file_bytes=20_000), range_rows=60)
    rows = warc.read(index, folder, with_payload=True).collect()
    assert len({r.history for r in rows}) == len(rows) == pages.count()
    html = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        twin = r.page_id - 1000 if r.page_id >= 1000 else None
        assert r.record_type == ("revisit" if twin is not None else "response") and r.refers_to == twin
        data = html[r.page_id].encode()
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.payload == (None if twin is not None else data)
    keys = [r.urlkey for r in sorted(rows, key=lambda r: r.history)]
    assert keys == sorted(keys)


# --- decontamination


def brute_align(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = 2 if a[i - 1] == b[j - 1] and b[j - 1] > 0 else -1
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=14), st.lists(st.integers(0, 5), min_size=1, max_size=25))
def test_alignment_scores(item, window):
    score, a, b = decontam.align(np.array(item), np.array(window))
    assert score == brute_align(item, window)
    if score:
        assert brute_align(item, window[a:b]) == score and 0 <= a < b <= len(window)


def test_planted_and_edited_leaks(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    tests = [[rng.choice(words) for _ in range(30)] for _ in range(20)]
    rows = []
    for k in range(60):
        body = [rng.choice(words) for _ in range(400)]
        if k < 20:
            copy = list(tests[k])
            for j in range(k % 5, 30, 6):  # every sixth word replaced
                copy[j] = "edited"
            body[150:150] = [x.upper() + "," for x in copy]
        elif k < 40:
            body[150:150] = tests[k - 20][:6]  # a short overlap is no leak
        rows.append((k, " ".join(body)))
    got = decontam.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(tests)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(k, k) for k in range(20)]
    for r in got.collect():
        assert 0.45 <= r.score < 1 and 148 <= r.first_word <= 156 and r.end_word <= 182


def test_hot_edited_copies_beside_an_exact_one(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(2000)]
    item = [f"t{k}" for k in range(40)]
    rows = []
    for k in range(200):
        body = [rng.choice(words) for _ in range(60)]
        if k <= 60:  # every fourth word replaced in sixty documents, the whole item in one
            body[20:20] = [w if k == 60 or j % 4 else rng.choice(words) for j, w in enumerate(item)]
        rows.append((k, " ".join(body)))
    got = decontam.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(61)) and min(r.score for r in got) > 0.6


def plain_alignment(item, text):
    """Smith-Waterman cell by cell over the whole text."""
    last, best = [0] * (len(text) + 1), 0
    for w in item:
        row = [0]
        for j, x in enumerate(text, 1):
            row.append(max(0, last[j - 1] + (2 if x == w else -1), last[j] - 1, row[-1] - 1))
        best, last = max(best, max(row)), row
    return best / (2 * len(item))


def test_find_against_every_document_and_item(spark):
    bench = [(r.item_id, decontam.WORD.findall(r.text.lower())) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()][:12]
    rng, texts = random.Random(6), {r.doc_id: decontam.WORD.findall((r.text or "").lower())[:250] for r in docs(spark).filter("doc_id < 60").collect()}
    for k, (_, ws) in enumerate(bench):  # copies whole, cut, and edited more and more
        for j, edits in enumerate((0, 9, 6, 4, 3)):
            now = [rng.choice(ws) if edits and n % edits == 0 else w for n, w in enumerate(ws)]
            texts[1000 + 10 * k + j] = texts[k % 50][:30] + (now[: len(now) * 3 // 4] if j == 1 else now) + texts[(k + 1) % 50][:30]
    made = spark.createDataFrame([(k, " ".join(ws)) for k, ws in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(ws)) for i, ws in bench], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.find(made, items).collect()}
    grams = lambda ws: {tuple(ws[k : k + 3]) for k in range(len(ws) - 2)}
    want = {}
    for d, ws in texts.items():
        for i, item in bench:
            if len(set(ws) & set(item)) * 4 >= len(set(item)) and grams(ws) & grams(item) and (s := plain_alignment(item, ws)) >= 0.45:
                want[d, i] = s
    assert set(got) == set(want) and len(want) >= 40
    assert all(math.isclose(got[k], want[k]) for k in want)


# --- language model


def test_base_scores_against_brute_force(spark):
    rows = docs(spark).collect()
    c, ends = Counter(), 0
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            c.update(WORD.findall(ascii_lower(r.text)))
            ends += 1
    c[None] = ends
    n, v = sum(c.values()), len(c)
    for head in (brown.HEAD, 50):
        got = {r.doc_id: r for r in brown.perplexity(docs(spark), head=head).collect()}
        for r in rows:
            w = [*WORD.findall(ascii_lower(r.text)), None]
            g = got[r.doc_id]
            assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
            assert math.isclose(g.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


@pytest.mark.parametrize("head", [brown.HEAD, 40])
def test_model_against_a_plain_count(spark, head):
    """Classes from the model; everything else counted plainly: class bigrams, class sizes, every document's score."""
    rows = docs(spark).filter("doc_id < 60").collect()
    df = spark.createDataFrame([(r.doc_id, r.text, False) for r in rows], "doc_id long, text string, held_out boolean")
    model, rest = brown.train(df.filter("doc_id < 40"), clustered=30, classes=5, head=head)
    words = {r.doc_id: [w.encode() for w in WORD.findall(ascii_lower(r.text or ""))] for r in rows}
    n = Counter(w for k, ws in words.items() if k < 40 for w in ws)
    cls = dict(zip(model.head, model.classes, strict=True)) | {bytes(r.token): r["class"] for r in rest.collect()}
    assert set(cls) == set(n) and {bytes(r.token): r.n for r in rest.collect()} == {w: c for w, c in n.items() if w not in set(model.head)}
    of = lambda w: 0 if w is None else cls.get(w, model.shape_class[brown.shape(w)])
    flow, size, kinds = np.zeros((5, 5)), np.zeros(5), np.zeros(5)
    size[0], kinds[0] = sum(k < 40 for k in words), 1
    for w, c in n.items():
        size[cls[w]] += c
        kinds[cls[w]] += 1
    for k, ws in words.items():
        if k < 40:
            for x, y in zip([None, *ws], [*ws, None], strict=True):
                flow[of(x), of(y)] += 1
    steps = (flow + 0.5) / (flow.sum(1, keepdims=True) + 2.5)
    assert np.allclose(10.0 ** np.array(model.steps), steps) and np.allclose(steps.sum(1), 1)
    # all words of a class, and one that is none of them, are a whole
    assert all(math.isclose(sum((n[w] + 0.5) / model.class_norm[c] for w in n if cls[w] == c) + (size[0] + 0.5) / model.class_norm[0] * (c == 0) + 0.5 / model.class_norm[c], 1) for c in range(5))
    for r in brown.score(df, model, rest).collect():
        want = 0.0
        for x, y in zip([None, *words[r.doc_id]], [*words[r.doc_id], None], strict=True):
            c = size[0] if y is None else n[y]
            want += math.log10(steps[of(x), of(y)]) + math.log10((c + 0.5) / model.class_norm[of(y)])
        assert math.isclose(r.score, want, rel_tol=1e-9)


def test_every_word_takes_the_class_its_neighbours_ask_for(spark):
    rng = random.Random(8)
    nouns, verbs = [f"n{k}" for k in range(60)], [f"v{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice((nouns, verbs)[j % 2]) for j in range(40))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for head in (brown.HEAD, 50):  # words of the head, and of the tail
        model, rest = brown.train(df, clustered=40, classes=8, head=head)
        cls = dict(zip(model.head, model.classes, strict=True)) | {bytes(r.token): r["class"] for r in rest.collect()}
        mixed = sum(min(sum(cls[w.encode()] == c for w in nouns), sum(cls[w.encode()] == c for w in verbs)) for c in range(8))
        assert mixed <= 6, mixed


# --- quality


def test_quality_scores_against_plain_compression(spark):
    """Every score from the model's two dictionaries and its curve, compressed piece by piece with fresh tools."""
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    keep = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    model = quality.fit(docs(spark, MIDDLE).filter(keep), labels.filter(keep))
    got = {r.doc_id: r for r in quality.classify(docs(spark, MIDDLE), labels).collect()}

    def size(data, raw):
        tool = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False)
        return sum(len(tool.compress(data[k : k + 1024])) for k in range(0, len(data), 1024))

    for r in docs(spark, MIDDLE).filter("doc_id % 5 = 0").collect():
        data = (r.text or "").encode()
        good, bad = size(data, model.good), size(data, model.bad)
        d, share = ((bad - good) / (bad + good), min(1.0, good / len(data))) if data else (0.0, 1.0)
        want = 1 / (1 + math.exp(-(model.a + model.b * d + model.c * share)))
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-9) and got[r.doc_id].predicted == (want >= 0.7)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [k for k in truth if k in got and got[k].held_out]
    assert sum((got[k].score >= 0.7) == truth[k] for k in held) >= 0.9 * len(held)


# --- secrets


def brute_novel(text, base):
    """The rule itself: every run near a sensitive word, measured by fresh compressors."""
    raw = zstd.ZstdCompressionDict(secretscan.IDENTIFIERS.encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
    size = lambda t: len(zstd.ZstdCompressor(level=6, dict_data=raw, write_content_size=False).compress(t.encode()))
    words = [m.end() for m in secretscan.SENSITIVE.finditer(text)]
    out = []
    for start, kind, end in secretscan.spans_of(text)[1]:
        if kind == 3:
            before, run, after = text[max(0, start - secretscan.AROUND) : start], text[start:end], text[end : end + secretscan.AROUND]
            assert any(0 <= start - w for w in words) and (size(before + run + after) - size(before + after)) / len(run) >= secretscan.NOVEL
            assert not any(start < e and s < end for s, _, e in base)
            out.append((start, end))
    return out


ALPHABETS = {
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "HEX": "0123456789ABCDEF",
    "digits": "0123456789",
}
PLACES = [
    "Authorization: Bearer {}\n", "aws_secret_access_key={}\n", '"client_secret" : "{}",', "signature {} ends", "https://h.example/x?access_key={}&y=1",
    "private_key: |\n  {}\n", "set the credential for the server of the production environment and the database host to {}\n", "pwd={}",
]


@pytest.mark.parametrize("kind", ALPHABETS)
def test_recall_on_planted_keys(spark, kind):
    rng, texts = random.Random(3), [r.text or "" for r in docs(spark).limit(40).collect()]
    hit = 0
    for k in range(200):
        key = "".join(rng.choice(ALPHABETS[kind]) for _ in range(rng.randint(24, 48)))
        text = texts[k % 40][:400] + "\n" + PLACES[k % len(PLACES)].format(key) + "\n" + texts[(k + 7) % 40][:400]
        base, every = secretscan.spans_of(text)
        brute_novel(text, base)
        at = text.index(key)
        hit += any(s <= at and at + len(key) <= e for s, _, e in every)
    assert hit >= 180, hit


# --- queries and pipeline


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(want.columns) == sorted(got.columns)
    order = sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(repr, want.project(", ".join(order)).fetchall()))


def test_pipeline_against_brute_force(spark):
    names = docs(spark).columns
    now = docs(spark)
    for stage, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in now.collect()}
        now = f(spark, now, SMALL)
        after = {r.doc_id: r for r in now.collect()}
        if stage < 4:
            assert now.columns == names, name
        if stage == 0:
            scores = {r.doc_id: r.score for r in quality.classify(docs(spark), spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
            assert set(after) == {k for k in before if scores[k] >= 0.7}
        elif stage == 1:
            # the rule for near-duplicate stages: five words, a similarity of 0.8 or more
            assert set(after) == set(brute_jaccard_groups({k: r.text for k, r in before.items()}).values())
        elif stage == 2:
            bench = [decontam.WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            text = {k: " " + " ".join(decontam.WORD.findall(r.text.lower())) + " " for k, r in before.items()}
            assert set(after) == {k for k, t in text.items() if not any(" " + " ".join(b) + " " in t for b in bench)}
        elif stage == 3:
            assert set(after) == set(before)
            for k, r in after.items():
                assert not brute_base(r.text) or "[SECRET]" in r.text
                if not secretscan.spans_of(before[k].text)[1]:
                    assert r == before[k]
                else:
                    assert r.text != before[k].text and r.n_chars == len(r.text)
        else:
            assert set(after) == set(before) and {"mix_slot", "mix_place"} <= set(now.columns)
    assert len(after) > 50
