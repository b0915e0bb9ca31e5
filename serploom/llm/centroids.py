"""Centroid clustering in exact integers, with Hamerly's bounds.

Components become integers floor(scale * x), so distances are integers and every assignment is exact. Each vector keeps an upper bound of the
distance to its own centroid and one lower bound of the distance to all others. A round loosens both by how far centroids have drifted; where the upper bound stays below the lower one,
or below half the way to the nearest other centroid, no distance is computed. Else the own distance is made exact first, and what is ambiguous still gets a full scan. Bounds are rounded outwards
and compared strictly, so ties always get the full scan, and there the smaller number wins.

A round is two jobs: one pass writes vectors with new bounds to the shared folder (the former is deleted), then the sums of the clusters change by the vectors that moved, alone.
The driver holds k centroids and their sums and nothing else. Rounds end early once no vector moves, since from there on nothing changes.

Defined results: vectors that are null, of another number of components, or with a null or non-finite component get no row. Repeated rows are separate vectors. The first centroids are the vectors whose ids
have the smallest SHA-256 of ``salt:id``, ties by components; vectors with a null id are clustered but start no centroid. With fewer than k vectors to start from there are as many centroids as those; with
none, no rows. Other columns are ignored. Components of 2 ** 27 and more after scaling are an error: squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom.llm.common import arrow_map, check_columns, columns_of, forgotten, scratch, written

SALT = "3"
LARGEST = 1 << 27
#: Bounds are widened by this share, far more than the rounding of their few additions.
SLACK = 1e-9
#: Vectors compared at a time.
AT_ONCE = 8192

STATE = "vec_id {id}, v array<int>, cluster int, was int, upper double, lower double"


def whole(embedding: Column, parts: int, scale: int) -> Column:
    """floor(scale * x) of every component; null for vectors that are left out."""
    usable = (F.size(embedding) == parts) & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    fits = lambda y: F.when(F.abs(y) < LARGEST, y.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for distances in a long")).cast("int"))
    return F.when(usable, F.transform(embedding, lambda x: fits(F.floor(x.cast("double") * scale))))


def squared(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = v - centroid
    return np.einsum("ij,ij->i", d, d)


def scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector: the nearest centroid (ties: smaller number), its squared distance, the second-nearest's (inf as -1 if there is one centroid)."""
    d = np.stack([squared(v, c) for c in centroids], 1)
    near = d.argmin(1)
    at = np.arange(len(v))
    best = d[at, near]
    if len(centroids) == 1:
        return near, best, np.full(len(v), -1)
    d[at, near] = np.iinfo(np.int64).max
    return near, best, d.min(1)


def assign(v: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray | None, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New cluster, upper and lower bounds, and how many vectors were scanned in full. old: the centroids that the bounds are of; None if there are no bounds yet."""
    near, upper, lower = near.copy(), upper.copy(), lower.copy()
    if old is None:
        todo = np.arange(len(v))
    else:
        drift = np.sqrt(((centroids - old).astype(float) ** 2).sum(1)) * (1 + SLACK)
        most = int(drift.argmax())
        others = np.full(len(drift), drift[most])
        others[most] = np.delete(drift, most).max(initial=0.0)
        upper = (upper + drift[near]) * (1 + SLACK)
        lower = (lower - others[near]) * np.where(lower > others[near], 1 - SLACK, 1 + SLACK)
        apart = ((centroids[:, None].astype(float) - centroids[None].astype(float)) ** 2).sum(2)
        np.fill_diagonal(apart, np.inf)
        floor = np.maximum(lower, (np.sqrt(apart.min(1)) / 2 * (1 - SLACK))[near])
        todo = np.flatnonzero(upper >= floor)
        upper[todo] = np.sqrt(squared(v[todo], centroids[near[todo]]).astype(float)) * (1 + SLACK)
        todo = todo[upper[todo] >= floor[todo]]
    near[todo], best, second = scan(v[todo], centroids)
    upper[todo] = np.sqrt(best.astype(float)) * (1 + SLACK)
    lower[todo] = np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0).astype(float)) * (1 - SLACK))
    return near, upper, lower, len(todo)


def _vectors(column: pa.Array, parts: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, parts)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, AT_ONCE):
        yield batch.slice(k, AT_ONCE)


def _pass(state: DataFrame, old: np.ndarray | None, centroids: np.ndarray, schema: str) -> DataFrame:
    parts = centroids.shape[1]

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in _slices(batch):
            cols = columns_of(part)
            was = cols["cluster"].to_numpy().astype(np.int64)
            near, upper, lower, _ = assign(_vectors(cols["v"], parts), was, cols["upper"].to_numpy(), cols["lower"].to_numpy(), old, centroids)
            yield pa.RecordBatch.from_arrays([cols["vec_id"], cols["v"], pa.array(near, pa.int32()), cols["cluster"], pa.array(upper), pa.array(lower)], ["vec_id", "v", "cluster", "was", "upper", "lower"])

    return arrow_map(state, step, schema)


def _moves(state: DataFrame, parts: int) -> list:
    """Of every cluster that gained or lost vectors: by how much its number and its components' sums change."""
    sides = F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign")))
    moved = state.filter("cluster <> was").select("v", F.explode(sides).alias("side")).filter("side.c >= 0")
    sums = [F.try_sum((F.col("v")[k] * F.col("side.sign")).cast("long")).alias(f"s{k}") for k in range(parts)]
    return moved.groupBy("side.c").agg(F.sum("side.sign").alias("n"), *sums).collect()  # a row for each centroid


def distances(state: DataFrame, centroids: np.ndarray, id_type: str) -> DataFrame:
    """vec_id, cluster, distance (squared, exact)."""
    parts = centroids.shape[1]

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in _slices(batch):
            cols = columns_of(part)
            own = centroids[cols["cluster"].to_numpy()]
            yield pa.RecordBatch.from_arrays([cols["vec_id"], cols["cluster"], pa.array(squared(_vectors(cols["v"], parts), own))], ["vec_id", "cluster", "distance"])

    return arrow_map(state.select("vec_id", "v", "cluster"), step, f"vec_id {id_type}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, parts: int = 64, scale: int = 1024, salt: str = SALT) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector (vec_id, embedding), after ``rounds`` rounds and one more assignment."""
    spark = vectors.sparkSession
    rows = check_columns(vectors, "vec_id", "embedding")
    id_type = dict(rows.dtypes)["vec_id"]
    schema = STATE.format(id=id_type)
    out = f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    usable = rows.select("vec_id", whole(F.col("embedding"), parts, scale).alias("v")).filter("v is not null")
    path = scratch(spark, "vectors")
    state = written(usable.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(-1).alias("was"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")), path)
    first = state.filter("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256), "v").select("v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], out)
    centroids, old = np.array([r["v"] for r in first], np.int64), None
    sizes, sums = [0] * len(first), [[0] * parts for _ in first]
    for turn in range(rounds + 1):
        before, path = path, scratch(spark, "vectors")
        state = written(_pass(state, old, centroids, schema), path)
        forgotten(spark, before)
        if turn == rounds:
            break
        moves = _moves(state, parts)
        if not moves:  # so no centroid changes any more, nor will an assignment
            break
        for r in moves:
            gained = [r[f"s{i}"] for i in range(parts)]
            if None in gained:
                raise OverflowError("a cluster's sum passes 64 bits")
            sizes[r["c"]] += r["n"]
            sums[r["c"]] = [a + b for a, b in zip(sums[r["c"]], gained, strict=True)]
        old = centroids
        centroids = np.array([[s // n for s in row] if n else list(c) for row, n, c in zip(sums, sizes, centroids.tolist(), strict=True)], np.int64)
    last = scratch(spark, "distances")
    done = written(distances(state, centroids, id_type), last)
    forgotten(spark, path)
    inertia = {r["cluster"]: int(r["d"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, d, sum(inertia.values()), digests[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string") if inertia else None
    return spark.createDataFrame([], out) if facts is None else done.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid
