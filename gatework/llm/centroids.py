"""Centroid clustering in exact integers, screened in float32.

A batch of vectors meets all centroids in one float32 matrix product. Its rounding error is bounded rigorously (Higham's
gamma for any order of summation), which gives each score |c|^2 - 2 v.c an interval that holds the true value. A centroid
whose interval lies above another's upper end can't be nearest; where more than one is left, their distances are computed
anew in 64-bit integers, and the smaller number wins a tie. So the result is that of exact arithmetic throughout.

Centroids (k x dim integers) are all that passes through the driver. A round is a scan of the vectors with a sum for each
task and centroid, added up by Spark; the vectors are neither shuffled nor kept.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatework.llm.common import written
from gatework.llm.vectors import finite, matrix, numeric

#: Unit roundoff of float32.
UNIT = 2.0**-24


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; an error beyond what keeps squared distances of such vectors in 64 bits."""
    v = np.floor(x.astype(np.float64) * scale)
    most = isqrt((2**63 - 1) // v.shape[1]) // 2
    if v.size and np.abs(v).max() > most:
        raise OverflowError(f"a component of {np.abs(v).max():g} is beyond {most}: squared distances don't fit in 64 bits")
    return v.astype(np.int64)


def intervals(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of |c|^2 - 2 v.c for each vector and centroid, which hold the exact value.

    A float32 product of n terms, summed in any order, is off by gamma(n) sum|v_i c_i| at most, rounding v and c to float32
    makes that gamma(n + 2), and sum|v_i c_i| <= |v| |c|. Two more units and the last terms stand for the rounding of the bound."""
    steps = v.shape[1] + 4
    gamma = steps * UNIT / (1 - steps * UNIT)
    squares = (centroids * centroids).sum(1).astype(np.float64)
    lengths = np.sqrt((v * v).sum(1).astype(np.float64))
    dots = (v.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    score = squares - 2 * dots
    off = 2 * gamma * np.outer(lengths, np.sqrt(squares)) + 2.0**-50 * (squares + 2 * np.abs(dots))
    return score - off, score + off


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.square(v - c).sum(1)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of each vector's nearest centroid, and how many vectors needed a second look."""
    low, high = intervals(v, centroids)
    open_ = low <= high.min(1, keepdims=True)
    best = open_.argmax(1)
    unsure = np.flatnonzero(open_.sum(1) > 1)
    if len(unsure):
        left = np.full(len(unsure), np.iinfo(np.int64).max)
        for c in range(len(centroids)):  # in ascending order, so that a tie stays with the smaller number
            some = np.flatnonzero(open_[unsure, c])
            d = distances(v[unsure[some]], centroids[c])
            closer = d < left[some]
            left[some[closer]] = d[closer]
            best[unsure[some[closer]]] = c
    return best, distances(v, centroids[best]), len(unsure)


def totals(rows: DataFrame, centroids: np.ndarray, scale: int) -> dict[int, list[int]]:
    """By number of each non-empty centroid: the sums of its vectors' components, then their count."""
    k, dim = centroids.shape

    def run(batches):
        sums = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            v = whole(matrix(batch.column("v"), dim), scale)
            best = nearest(v, centroids)[0] if len(v) else []
            for c in np.unique(best):
                sums[c] += np.append(v[best == c].sum(0), (best == c).sum())
        some = np.flatnonzero(sums[:, dim])
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "sums": pa.array(sums[some].tolist(), pa.list_(pa.int64()))})

    parts = rows.select("v").mapInArrow(run, "cluster int, sums array<long>")
    summed = parts.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
    out: dict[int, list[int]] = {}
    for r in summed.collect():  # k * (dim + 1) rows at most
        out.setdefault(r.cluster, [0] * (dim + 1))[r.pos] = int(r.total)
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly dim components, none null or non-finite, as integers floor(scale * x). Centroids start as the
    k vectors with the smallest sha256 of `seed:id` (fewer vectors: fewer centroids; equal ids are ordered by their
    components, null ids come last). Repeated rows and ids count each; a null id gives a row with a null vec_id. A centroid
    without vectors stays. No kept vector gives an empty result. Extra columns are ignored, whatever their names. Integers
    whose squared distances could pass 64 bits are an error; an inertia that does is null.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), numeric(vectors, vector_col).alias("v"))
    rows = rows.where((F.size("v") == dim) & finite(F.col("v")))
    first = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = whole(np.array([r.v for r in first]).reshape(-1, dim), scale)
    for _ in range(rounds if len(centroids) else 0):
        for c, sums in totals(rows, centroids, scale).items():
            centroids[c] = [s // sums[dim] for s in sums[:dim]]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                best, d, _ = nearest(whole(matrix(batch.column("v"), dim), scale), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = written(rows.mapInArrow(run, "vec_id long, cluster int, distance long"), "centroids")
    inertia = {r.cluster: int(r.inertia) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    long = lambda n: n if n < 2**63 else None
    facts = [(c, long(n), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in inertia.items()]
    facts_df = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts_df), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows are broadcast
