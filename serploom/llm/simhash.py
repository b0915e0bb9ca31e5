"""SimHash near-duplicates, linked through pivot distance tables.

A text's fingerprint has a bit set where more than half of its shingles' XXH64 values (seed 42) have it set. Documents
with equal fingerprints are one node, so groups of exact copies cost one row from there on. Nodes link at ``radius`` or
fewer differing bits, and the smallest doc_id reachable names the component.

Linking, without ever comparing all nodes of a group:

1. Every node gets a row of the pivot table: its Hamming distances to PIVOTS reference fingerprints. By the triangle
   inequality nodes that link differ by at most ``radius`` in every coordinate.
2. Seeds. Alone, that test keeps close to half of all pairs per pivot (distances of random fingerprints lie within 32 +-
   4), so pairs are first proposed by agreement: of ``blocks`` blocks of the 64 bits, at most ``radius`` differ, so linked
   nodes agree on some blocks - radius of them. Each such choice of blocks is a join key.
3. Within a key, pairs whose largest coordinate difference exceeds ``radius`` are discarded, the survivors verified by
   the bits that differ.
4. Keys with more than ``crowd`` nodes are not paired: there each node puts the fingerprints within r1 = radius // 2 and
   r2 = radius - r1 changed bits (among the bits outside the key) on the table. Nodes link exactly if one's r1 neighbour is the other's
   r2 neighbour, so a star per such neighbour joins them: linear in the key's nodes, and exact too.

Components: alternating large-star and small-star steps on the edges, each written to the shared folder.

Defined results: null text is empty text, its fingerprint is zero and links like any other; a text of fewer words than a
shingle is one shingle of all its words; rows with null doc_id are fingerprinted but take part as their fingerprint's
copies without ever naming a component (component_id is null if all are null); repeated rows give repeated results;
empty tables give empty results; other columns are ignored or, in ``keep_one``, kept.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom.llm.common import arrow_map, check_columns, columns_of, forgotten, lower_words, packed, persisted, scratch, written

SEED = 42
#: Reference fingerprints: the splitmix64 sequence from 1.
PIVOTS = 8


def pivots(n: int = PIVOTS) -> list[int]:
    out, mask = [], (1 << 64) - 1
    for k in range(1, n + 1):
        z = k * 0x9E3779B97F4A7C15 & mask
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        out.append(z ^ z >> 31)
    return out


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of every shingle, repeats included; none without a word."""
    words = lower_words(text)
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    h = xxhash.xxh64_intdigest
    return [h(b" ".join(words[k : k + width]), SEED) for k in range(len(words) - width + 1)]


def fingerprint(hashes: list[int]) -> int:
    """Bits set in over half of the hashes."""
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    all_ = np.array(hashes, "<u8")
    for k in range(0, len(all_), 1 << 16):
        counts += np.unpackbits(all_[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(all_), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, keep_hash: bool = False) -> DataFrame:
    """doc_id, h (XXH64 of the text, if asked for), fp (the fingerprint as a signed 64-bit integer) of every row."""
    rows = check_columns(docs, "doc_id", "text").select("doc_id", *[F.xxhash64("text").alias("h")] * keep_hash, "text")
    kept = rows.columns[:-1]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = columns_of(batch)
        fps = np.array([fingerprint(shingle_hashes(t.as_py(), width)) for t in cols["text"]], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*(cols[n] for n in kept), pa.array(fps, pa.int64())], [*kept, "fp"])

    kinds = dict(rows.dtypes)
    return arrow_map(rows, step, ", ".join([*(f"{n} {kinds[n]}" for n in kept), "fp long"]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of blocks - radius out of ``blocks`` blocks: linked fingerprints agree under at least one."""
    edges = [round(k * 64 / blocks) for k in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(each, blocks - radius)]


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def pivot_row(fp: Column, refs: list[int]) -> Column:
    """The distances to the references, one byte each, in one integer."""
    packed = F.lit(0).cast("long")
    for k, r in enumerate(refs):
        packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(r)).cast("long"))).cast("long"), 8 * k))
    return packed


def within_pivots(a: Column, b: Column, n: int, radius: int) -> Column:
    """No coordinate differs by more than radius."""
    byte = lambda x, k: F.shiftright(x, 8 * k).bitwiseAND(F.lit(255).cast("long"))
    near = F.lit(True)
    for k in range(n):
        near &= F.abs(byte(a, k) - byte(b, k)) <= radius
    return near


def links(nodes: DataFrame, radius: int = 3, blocks: int = 6, crowd: int = 512, refs: list[int] | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``nodes`` (fp) whose transitive closure links exactly what is within radius.

    Pairs in keys of up to ``crowd`` nodes are edges themselves; larger keys give stars. No pair is lost either way.
    """
    refs = (pivots() if refs is None else refs)[:8]
    masks = block_masks(blocks, radius)
    table = nodes.select("fp", pivot_row(F.col("fp"), refs).alias("pv"))
    cut = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])
    keys = table.select("fp", "pv", F.posexplode(cut).alias("m", "k"))
    shared = keys.groupBy("m", "k").count().filter("count > 1")
    crowded = shared.filter(F.col("count") > crowd).select("m", "k")
    # Spark sizes what comes out of an explode as what goes in, and would broadcast all keys: "merge" keeps every side in its tasks
    few = keys.join(shared.filter(F.col("count") <= crowd).select("m", "k").hint("merge"), ["m", "k"])
    a, b = few.select("m", "k", F.col("fp").alias("u"), F.col("pv").alias("pu")), few.select("m", "k", F.col("fp").alias("v"), F.col("pv").alias("pw"))
    near = within_pivots(F.col("pu"), F.col("pw"), len(refs), radius) & (_differ("u", "v") <= radius)
    pairs = a.join(b.hint("merge"), ["m", "k"]).filter((F.col("u") < F.col("v")) & near).select("u", "v")
    return pairs.union(_stars(keys.join(crowded.hint("merge"), ["m", "k"]).select("m", "fp"), masks, radius)).distinct()


def _stars(members: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Edges for the nodes of crowded keys, see the module's step 4."""
    r1 = radius // 2
    r2 = radius - r1
    rows = []
    for m, mask in enumerate(masks):
        free = [1 << k for k in range(64) if not mask >> k & 1]
        rows += [(m, _signed(sum(c)), n <= r1) for n in range(r2 + 1) for c in combinations(free, n)]
    # its size depends on blocks and radius alone: some ten thousand rows
    changes = F.broadcast(members.sparkSession.createDataFrame(rows, "m int, d long, near boolean"))
    around = members.join(changes, "m").select("m", "fp", F.col("fp").bitwiseXOR(F.col("d")).alias("hub"), "near")
    centre = around.groupBy("m", "hub").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("u"), F.count("*").alias("n")).filter("u is not null and n > 1")
    return around.join(centre.hint("merge"), ["m", "hub"]).filter("u <> fp").select("u", F.col("fp").alias("v"))


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge that isn't the root itself; root is the smallest node that it reaches.

    Large-star and small-star steps by turns. A node's neighbourhood is never gathered: its minimum is aggregated and
    joined back, which skewed-join handling splits for nodes with very many neighbours.
    """
    spark = edges.sparkSession
    path = scratch(spark, "edges")
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), path)
    sign = None
    while True:  # the edges shrink in every round that changes them, so there is an end
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", "m")).distinct()
        before, path = path, scratch(spark, "edges")
        now = written(small, path)
        forgotten(spark, before)
        last, sign = sign, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(docs: DataFrame, width: int = 3, radius: int = 3, **how: int) -> DataFrame:
    """doc_id, h (hash of the text), fp, component_id of every row."""
    hashed = check_columns(docs, "doc_id", "text")
    rows = persisted(fingerprints(hashed, width, keep_hash=True), "fingerprints")
    nodes = persisted(rows.groupBy("fp").agg(F.min("doc_id").alias("label")), "nodes")
    linked = roots(links(nodes.select("fp"), radius, **how))
    return named(rows, nodes, linked, "fp").select("doc_id", "h", "fp", "component_id")


def named(rows: DataFrame, nodes: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """``rows`` with component_id: the least label of the nodes (key, label) that are linked (node, root) with the row's."""
    member = linked.union(linked.select("root", "root").distinct()).toDF("__node", "root")
    least = member.join(nodes, member["__node"] == nodes[key]).groupBy("root").agg(F.min("label").alias("component_id"))
    moved = member.join(least, "root").select(F.col("__node").alias(key), "component_id")
    final = nodes.join(moved, key, "left").select(key, F.coalesce("component_id", "label").alias("component_id"))
    # written out, so that the join below is one of two exchanges: then a node with very many rows can be split
    final = persisted(final, "components")
    return rows.join(final, key)


def digest(fp: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, **how: int) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    return components(docs, **how).select("doc_id", digest(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **how: int) -> DataFrame:
    """``docs`` with one row of each component, the one that names it, all columns.

    Rows with null doc_id can't be told apart and stay. Of repeated rows of the naming document one stays.
    """
    return keep_named(docs, components(docs, **how))


def keep_named(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the rows that name a component of ``found`` (doc_id, h, component_id), and those with null doc_id."""
    keep = found.filter("doc_id = component_id").select(F.col("doc_id").alias("id"), "h").distinct()
    marked = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    first = marked.filter("id is not null").join(keep, ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
    return first.unionByName(marked.filter("id is null")).select("row.*")
