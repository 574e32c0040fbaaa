"""Operator 2: approximate nearest neighbours by balanced posting lists.

The space is cut by balanced bisection of a bounded sample, and every vector is posted in the list of its nearest
centroid. A vector near a boundary is posted in further lists, unless a chosen centroid is nearer to such a list's
centroid than the vector is. A query walks a neighbour graph of the centroids in memory and selects the lists whose
distance is within a ratio of the nearest one's. The ratio is measured: brute force over all vectors tells for a sample
of queries in which lists their true neighbours are, and the smallest ratio that reaches the wanted recall is taken.

Nearness is the inner product. One more coordinate makes all vectors equally long, so that the largest inner product
is the smallest distance. Lists lie in shards of bounded size; a list of many vectors is spread over several shards. A
shard gives at most the wanted number of neighbours per query, and these are merged per query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.shared import partitions_of, written

#: Vectors that the cut of the space is fitted on, queries that the ratio is measured on; both are drawn by a hash.
SAMPLE, TRIALS = 16_384, 256
#: Vectors per list that are aimed at, sample vectors that a list has at least, lists that a vector is posted in at most.
LIST, SUPPORT, REPLICAS = 256, 16, 4
#: A vector is posted in lists whose distance is within this ratio of its nearest one's.
BOUNDARY = 1.15
#: Postings of a shard, and queries that meet a shard at once; both only move work.
SHARD, QUERIES = 8_192, 8_192
#: Recall on the sampled queries that the ratio is chosen for.
RECALL = 0.97
DEGREE = 16


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components finite, not all zero."""
    return (
        vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, "f8") for v in column]) if len(column) else np.zeros((0, 1))


class Lists:
    """Centroids, the graph over them, and what lengthens vectors. Bounded by the sample, so it fits every task."""

    def __init__(self, sample: np.ndarray, lists: int, longest: float) -> None:
        self.longest = longest
        points = self.lengthened(sample)
        leaves = [np.arange(len(points))]
        while len(leaves) < lists:
            at = max(range(len(leaves)), key=lambda i: len(leaves[i]))
            if len(leaves[at]) < 2:
                break
            leaves[at:at + 1] = self._halves(points, leaves[at])
        self.centroids = np.array([points[leaf].mean(axis=0) for leaf in leaves])
        self.norms = (self.centroids**2).sum(axis=1)
        self.apart = self.distances(self.centroids)
        near = np.argsort(self.apart, axis=1, kind="stable")[:, 1:DEGREE + 1]
        around = [set(row.tolist()) for row in near]
        for a, row in enumerate(near):
            for b in row.tolist():
                around[b].add(a)
        # lists follow each other in space, so a chain along them keeps the graph in one piece
        for a in range(len(around) - 1):
            around[a].add(a + 1)
            around[a + 1].add(a)
        self.around = [np.array(sorted(s - {a}), "i8") for a, s in enumerate(around)]
        self.entry = int(np.argmin(self.apart.sum(axis=1)))

    @staticmethod
    def _halves(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """Two equal halves along the line between two means."""
        some = points[rows]
        far = some[np.argmax(((some - some.mean(axis=0)) ** 2).sum(axis=1))]
        a, b = far, some[np.argmax(((some - far) ** 2).sum(axis=1))]
        for _ in range(4):
            side = some @ (b - a) > ((b**2).sum() - (a**2).sum()) / 2
            if side.all() or not side.any():
                break
            a, b = some[~side].mean(axis=0), some[side].mean(axis=0)
        order = np.argsort(some @ (b - a), kind="stable")
        return [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]

    def lengthened(self, vectors: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.longest - (vectors**2).sum(axis=1), 0))
        return np.concatenate((vectors, more[:, None]), axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((points**2).sum(axis=1)[:, None] + self.norms - 2 * points @ self.centroids.T, 0))

    def posted(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) postings of vectors: the nearest list, and others across a near boundary."""
        far = self.distances(self.lengthened(vectors))
        order = np.argsort(far, axis=1, kind="stable")[:, :2 * REPLICAS]
        chosen = np.zeros(order.shape, bool)
        chosen[:, 0] = True
        rows = np.arange(len(far))
        for j in range(1, order.shape[1]):
            own = far[rows, order[:, j]]
            near = (own <= BOUNDARY * far[rows, order[:, 0]]) & (chosen.sum(axis=1) < REPLICAS)
            for i in range(j):
                near &= ~(chosen[:, i] & (self.apart[order[:, i], order[:, j]] < own))
            chosen[:, j] = near
        at, place = np.nonzero(chosen)
        return at, order[at, place]

    def selected(self, query: np.ndarray, ratio: float, sizes: np.ndarray, wanted: int) -> list[int]:
        """Lists within `ratio` of the nearest one, walking the graph from near to far; more where they hold too little."""
        point = np.append(query, 0.0)

        def away(nodes: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(point @ point + self.norms[nodes] - 2 * self.centroids[nodes] @ point, 0))

        seen = np.zeros(len(self.norms), bool)
        seen[self.entry] = True
        heap, found, best = [(float(away(np.array([self.entry]))[0]), self.entry)], [], np.inf
        held = 0
        while heap:
            distance, node = heapq.heappop(heap)
            best = min(best, distance)
            # the walk goes on until a breadth of nodes is known, so that it doesn't end in a valley on the way
            if distance > ratio * best and len(found) >= DEGREE and held >= wanted:
                break
            found.append((distance, node))
            held += int(sizes[node])
            new = self.around[node][~seen[self.around[node]]]
            seen[new] = True
            for d, n in zip(away(new).tolist(), new.tolist()):
                heapq.heappush(heap, (d, n))
        out, held = [], 0
        for distance, node in sorted(found):
            if distance > ratio * best and held >= wanted:
                break
            out.append(node)
            held += int(sizes[node])
        return out


def nearest_of(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, top: int) -> pd.DataFrame:
    """(query_id, vec_id, score): for each query its `top` largest inner products, ties to smaller ids, itself left out.

    Equal vectors are scored once and stand for their smallest ids; those in reach are scored again, component by
    component in one order, so that equal vectors get equal scores.
    """
    frames = [pd.DataFrame({"query_id": np.zeros(0, "i8"), "vec_id": np.zeros(0, "i8"), "score": np.zeros(0)})]
    if len(ids) and len(queries):
        order = np.argsort(ids, kind="stable")
        vectors, ids = np.ascontiguousarray(vectors[order]), ids[order]
        raw = vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).reshape(-1)
        _, first, group = np.unique(raw, return_index=True, return_inverse=True)
        group = group.reshape(-1)
        by_group = np.argsort(group, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=len(first)))))
        place = np.arange(len(ids)) - starts[group[by_group]]
        by_group = by_group[place <= top]  # the smallest ids of a group, one more in case of the query itself
        counts = np.bincount(group[by_group], minlength=len(first))
        starts = np.concatenate(([0], np.cumsum(counts)))
        alone = vectors[first]
        for at in range(0, len(queries), 256):
            some, names = queries[at:at + 256], query_ids[at:at + 256]
            scores = some @ alone.T
            reach = min(top + 1, scores.shape[1])
            least = np.partition(scores, -reach, axis=1)[:, -reach]
            slack = 1e-9 * (1 + np.abs(least))
            row, column = np.nonzero(scores >= (least - slack)[:, None])
            exact = (some[row] * alone[column]).sum(axis=1)
            n = counts[column]
            r, s = np.repeat(row, n), np.repeat(exact, n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            v = ids[by_group[np.repeat(starts[column], n) + inner]]
            other = v != names[r]
            r, s, v = r[other], s[other], v[other]
            order = np.lexsort((v, -s, r))
            r, s, v = r[order], s[order], v[order]
            new = np.concatenate(([True], r[1:] != r[:-1])) if len(r) else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
            keep = np.arange(len(r)) - start < top
            frames.append(pd.DataFrame({"query_id": names[r[keep]], "vec_id": v[keep], "score": s[keep]}))
    return pd.concat(frames, ignore_index=True)


FOUND = "query_id long, vec_id long, score double"


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the best of what several tasks found; a query has a few rows from each."""
    best = found.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("b"))
    rows = best.select("query_id", F.posexplode(F.slice("b", 1, top)).alias("at", "row"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), "row.vec_id", (-F.col("row.s")).alias("score"))


def brute_force(queries: DataFrame, rows: DataFrame, top: int) -> DataFrame:
    """The exact answer for a bounded table of queries (query_id, vec), which every task gets."""
    asked = queries.toPandas()
    ids, matrix = asked["query_id"].to_numpy("i8"), _matrix(asked["vec"])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield nearest_of(matrix, ids, _matrix(batch["vec"]), batch["vec_id"].to_numpy("i8"), top)

    return _ranked(rows.mapInPandas(best, FOUND), top)


def nearest(
    table: DataFrame, is_query: Column, top: int = 20, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest rows that were found for each row that `is_query` picks.

    Score is the inner product in double precision, ties go to the smaller id, a query is no candidate of itself. Rows
    without an id, and vectors that are null, zero, hold null or non-finite components, or have not the length that
    most vectors have (the smaller of equally frequent lengths), take no part. Of rows with equal ids the one with the
    smallest vector counts. Fewer rows than `top` give fewer neighbours, an empty table none.
    """
    spark = table.sparkSession
    rows = table.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
    lengths = rows.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.where(F.size(vector) == (lengths["size"] if lengths else 0)).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"), is_query.alias("asks"))
    rows = written(rows.groupBy("vec_id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks")), "vectors")
    facts = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)), F.count_if("asks")).first()
    n, longest, n_queries = facts
    queries = rows.where("asks").select(F.col("vec_id").alias("query_id"), "vec")
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = F.xxhash64("vec_id")
    sample = _matrix(rows.orderBy(drawn).select("vec").limit(SAMPLE).toPandas()["vec"])
    lists = Lists(sample, max(1, min(-(-n // LIST), len(sample) // SUPPORT)), longest)
    shared = spark.sparkContext.broadcast(lists)

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, to = shared.value.posted(_matrix(batch["vec"]))
            yield pd.DataFrame({"list": to.astype("i4"), "vec_id": batch["vec_id"].to_numpy("i8")[at], "vec": batch["vec"].to_numpy()[at]})

    index = written(rows.select("vec_id", "vec").mapInPandas(posted, "list int, vec_id long, vec array<double>"), "index")
    sizes = np.zeros(len(lists.norms), "i8")
    for r in index.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    ratio = _measured_ratio(queries, rows, index, lists, top, recall)

    # lists lie in shards: several small ones in space's order, or several shards for a large one
    first, parts, shard, room = np.zeros(len(sizes), "i4"), np.ones(len(sizes), "i4"), -1, 0
    for at, size in enumerate(sizes.tolist()):
        parts[at] = max(1, -(-size // SHARD))
        if parts[at] > 1 or size > room:
            shard += 1
            room = SHARD
        first[at] = shard
        room -= size
        if parts[at] > 1:
            shard += int(parts[at]) - 1
            room = 0
    told = spark.sparkContext.broadcast((first, parts, sizes))

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, (first, parts, sizes) = shared.value, told.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                part, where, rows_at = batch.iloc[at:at + 512], [], []
                for k, vec in enumerate(part["vec"]):
                    to = {s for x in of.selected(np.asarray(vec, "f8"), ratio, sizes, 3 * top) for s in range(first[x], first[x] + parts[x])}
                    where += to
                    rows_at += [k] * len(to)
                ids = part["query_id"].to_numpy("i8")
                yield pd.DataFrame({"shard": np.array(where, "i4"), "id": ids[rows_at], "vec": part["vec"].to_numpy()[rows_at]})

    @F.pandas_udf("int")
    def shard_of(list_: pd.Series, id_: pd.Series) -> pd.Series:
        first, parts, _ = told.value
        at = list_.to_numpy()
        return pd.Series((first[at] + id_.to_numpy("i8") % parts[at]).astype("i4"))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Shard by shard: its vectors are held, then its queries pass by, some at a time."""
        at, held, asking, waiting = None, [], [], 0

        def answers() -> pd.DataFrame:
            holds, asks = pd.concat(held, ignore_index=True).drop_duplicates("id"), pd.concat(asking, ignore_index=True)
            held[:] = [holds]
            return nearest_of(_matrix(asks["vec"]), asks["id"].to_numpy("i8"), _matrix(holds["vec"]), holds["id"].to_numpy("i8"), top)

        for batch in batches:
            for (shard, asks), part in batch.groupby(["shard", "asks"], sort=True):
                if shard != at:
                    if held and asking:
                        yield answers()
                    at, held, asking, waiting = shard, [], [], 0
                (asking if asks else held).append(part[["id", "vec"]])
                waiting += len(part) * int(asks)
                if held and waiting >= QUERIES:
                    yield answers()
                    asking, waiting = [], 0
        if held and asking:
            yield answers()

    asks = queries.mapInPandas(asked, "shard int, id long, vec array<double>").withColumn("asks", F.lit(True))
    holds = index.select(shard_of("list", "vec_id").alias("shard"), F.col("vec_id").alias("id"), "vec", F.lit(False).alias("asks"))
    both = asks.unionByName(holds).repartition(partitions_of(table), "shard").sortWithinPartitions("shard", "asks")
    found = both.mapInPandas(scored, FOUND)
    return _ranked(found, top)


def _measured_ratio(queries: DataFrame, rows: DataFrame, index: DataFrame, lists: Lists, top: int, recall: float) -> float:
    """The smallest ratio at which the lists of sampled queries hold the wanted share of their true neighbours."""
    trials = queries.orderBy(F.xxhash64("query_id")).limit(TRIALS)
    truth = brute_force(trials, rows.select("vec_id", "vec"), top).select("query_id", "vec_id")
    where = truth.join(index.select("vec_id", "list"), "vec_id").toPandas()
    if not len(where):
        return 1.0
    asked = trials.toPandas().set_index("query_id")["vec"]
    away = lists.distances(np.concatenate((_matrix(asked), np.zeros((len(asked), 1))), axis=1))
    away = pd.DataFrame(away / np.maximum(away.min(axis=1), 1e-12)[:, None], index=asked.index)
    needed = away.to_numpy()[away.index.get_indexer(where["query_id"]), where["list"].to_numpy()]
    needed = where.assign(needed=needed).groupby(["query_id", "vec_id"])["needed"].min()
    return float(np.quantile(needed, recall, method="higher")) * (1 + 1e-9)
