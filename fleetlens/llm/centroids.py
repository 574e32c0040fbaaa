"""Operator 12: centroid clustering by a bisector tournament.

Vectors and centroids are whole numbers, so which of two centroids is nearer is the sign of a whole number: of
2 * x . (b - a) + |a|^2 - |b|^2, negative exactly where a is nearer, zero on the bisector. Normals and thresholds of all
pairs are computed once a round; a vector then meets k - 1 pairs in a knockout, in which the smaller number always
stands on the left and stays where the sign is zero. Only the winner's distance is computed.

Tasks add up the vectors of each cluster and send k rows; the centroids, k rows, are all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.shared import Scratch, written

SCALE = 256
#: Components up to these sizes keep every sum below 2**53 (floats are exact) or 2**63; larger ones are Python's numbers.
FLOATS, LONGS = 1 << 21, 1 << 26
#: Vectors that meet their bisectors at once. It only moves work.
ROWS = 4096
#: Where components are larger, a sum travels as five numbers of 40 bits, so that adding them up cannot overflow.
LIMB, LIMBS = 40, 5
#: The largest float, 256 times, is less.
LARGEST = float(1 << 136)


def quantised(vectors: DataFrame, dims: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors of exactly `dims` components, none null or not finite, as floor(256 * component), in doubles.

    Doubles that no float could hold count as not finite.
    """
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: F.coalesce(F.abs(c) < LARGEST / SCALE, F.lit(False)))  # a NaN is larger than any number
    rows = vectors.select(F.col(vec_id).alias("vec_id"), x.alias("x")).where((F.size("x") == dims) & sound)
    return rows.withColumn("x", F.transform("x", _floored))


def _floored(c):
    """floor(256 * c) as a double; F.floor ends at 64 bits, beyond 2**53 every double is whole."""
    scaled = c * F.lit(float(SCALE))
    return F.when(F.abs(scaled) < float(1 << 53), F.floor(scaled).cast("double")).otherwise(scaled)


def first_centroids(rows: DataFrame, k: int, seed: str) -> list[tuple[int, ...]]:
    """The k vectors of the smallest hex SHA-256 of `<seed>:<vec_id>`, in its order; rows of one id by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    # a null id comes last, whatever its digest
    picked = rows.select(F.col("vec_id").isNull().alias("none"), digest.alias("h"), "x").orderBy("none", "h", "x").limit(k)
    return [tuple(int(c) for c in r.x) for r in picked.collect()]


class Bisectors:
    """Normals and thresholds of all pairs of centroids, at the width that keeps them exact."""

    def __init__(self, centroids: list[tuple[int, ...]]) -> None:
        self.centroids = centroids
        self.most = max((abs(c) for row in centroids for c in row), default=0)
        self.by_kind: dict[object, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _tables(self, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if kind not in self.by_kind:
            c = np.array(self.centroids, kind)
            square = (c * c).sum(axis=1)
            # [a, b]: the normal 2 * (b - a) and the threshold |b|^2 - |a|^2
            self.by_kind[kind] = c, 2 * (c[None, :, :] - c[:, None, :]), square[None, :] - square[:, None]
        return self.by_kind[kind]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row of whole doubles; ties to the smaller number."""
        most = max(self.most, int(np.abs(x).max(initial=0)))
        kind = "f8" if most <= FLOATS else "i8" if most <= LONGS else object
        x = x if kind == "f8" else x.astype("i8") if kind == "i8" else np.array([[int(c) for c in r] for r in x.tolist()], object).reshape(x.shape)
        c, normals, thresholds = self._tables(kind)
        k = len(c)
        alive = np.broadcast_to(np.arange(k), (len(x), k))
        while alive.shape[1] > 1:
            left, right = alive[:, 0:alive.shape[1] // 2 * 2:2], alive[:, 1::2]
            if alive.shape[1] == k:  # the first pairs are the same for all rows
                side = x @ normals[left[0], right[0]].T
            else:
                side = np.stack([(x * normals[left[:, m], right[:, m]]).sum(axis=1) for m in range(left.shape[1])], axis=1)
            winner = np.where(side > thresholds[left, right], right, left)
            alive = np.concatenate((winner, alive[:, -1:]), axis=1) if alive.shape[1] % 2 else winner
        best = alive[:, 0]
        away = x - c[best]
        return best, (away * away).sum(axis=1)


def _rows_of(batch: pd.DataFrame, dims: int) -> np.ndarray:
    return np.concatenate(batch["x"].to_numpy()).reshape(len(batch), dims) if len(batch) else np.zeros((0, dims))


def _cluster_sums(rows: DataFrame, centroids: list[tuple[int, ...]], dims: int, limbs: int) -> dict[int, tuple[int, list[int]]]:
    """Of every cluster with vectors, their number and their sum."""
    bisectors = Bisectors(centroids)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = [0] * len(centroids), [[0] * dims for _ in centroids]
        for batch in batches:
            every = _rows_of(batch, dims)
            for at in range(0, len(every), ROWS):
                x = every[at:at + ROWS]
                best, _ = bisectors.nearest(x)
                small = np.abs(x).max(initial=0) <= LONGS
                for cluster in np.unique(best).tolist():
                    part = x[best == cluster]
                    sums = part.astype("i8").sum(axis=0).tolist() if small else [sum(map(int, col)) for col in part.T.tolist()]
                    count[cluster] += len(part)
                    total[cluster] = [a + b for a, b in zip(total[cluster], sums)]
        used = [c for c in range(len(centroids)) if count[c]]
        mask, top = (1 << LIMB) - 1, limbs - 1
        cut = lambda s: [*(s >> LIMB * i & mask for i in range(top)), s >> LIMB * top]
        yield pd.DataFrame({"cluster": used, "n": [count[c] for c in used], "sums": [[v for s in total[c] for v in cut(s)] for c in used]})

    parts = rows.select("x").mapInPandas(summed, "cluster int, n long, sums array<long>")
    places = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(limbs * dims)]
    found = {}
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *places).collect():
        s = [r[f"s{i}"] for i in range(limbs * dims)]
        found[r.cluster] = r.n, [sum(v << LIMB * i for i, v in enumerate(s[at:at + limbs])) for at in range(0, len(s), limbs)]
    return found


def clustered(
    vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", dims: int = 64, vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that `quantised` keeps.

    Centroids start as the k vectors of `first_centroids` (all, if there are fewer). A round assigns every vector to the
    nearest centroid by squared Euclidean distance, ties to the smaller number, then moves each centroid that has vectors
    to the floor of their mean, component by component; at last vectors are assigned once more. `distance` is squared,
    the inertias are its sums over the cluster and over all, `centroid_sha256` is of the components joined by commas.

    Null, short and long vectors and those with null or non-finite components take no part; without any there are no
    rows. Repeated rows count and are returned each; a null id is a vector like any other, but starts as a centroid only
    after all others. All numbers are whole and exact at any size of component; a distance or an inertia beyond 63 bits
    is null. Other columns are not read, whatever their names.
    """
    scratch = Scratch()
    rows = scratch.written(quantised(vectors, dims, vec_id, embedding), "vectors")
    centroids = first_centroids(rows, k, seed)
    most = rows.agg(F.max(F.array_max(F.transform("x", F.abs))).alias("most")).head().most or 0
    for _ in range(rounds if centroids else 0):
        for cluster, (n, total) in _cluster_sums(rows, centroids, dims, 1 if most <= LONGS else LIMBS).items():
            centroids[cluster] = tuple(s // n for s in total)
    bisectors = Bisectors(centroids)
    digests = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""], object)

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = _rows_of(batch, dims)
            for at in range(0, len(every), ROWS):
                best, away = bisectors.nearest(every[at:at + ROWS])
                some = batch.iloc[at:at + ROWS]
                far = pd.array([int(d) if d < 1 << 63 else None for d in away.tolist()], "Int64")
                yield pd.DataFrame({
                    "vec_id": some["vec_id"].to_numpy(), "cluster": best.astype("i4"), "distance": far, "centroid_sha256": digests[best]})

    kind = rows.schema["vec_id"].dataType.simpleString()
    nearest = scratch.written(
        rows.mapInPandas(assigned, f"vec_id {kind}, cluster int, distance long, centroid_sha256 string"), "nearest")
    # k rows, so they may be sent to every task
    wide = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(20,0)")))
    per = nearest.groupBy("cluster").agg(wide.alias("wide")).collect()
    whole = None if any(r.wide is None for r in per) else sum(int(r.wide) for r in per)
    fits = lambda v: int(v) if v is not None and v < 1 << 63 else None
    sums = nearest.sparkSession.createDataFrame(
        [(r.cluster, fits(r.wide), fits(whole)) for r in per], "cluster int, cluster_inertia long, inertia long")
    found = written(nearest.join(F.broadcast(sums), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters")
    scratch.clear(vectors.sparkSession)
    return found
