"""Approximate retrieval with a recall gate, and predictions from near routes."""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import arrays


#: Memories and queries of a block, and rows of a matrix product at most.
MEMORY_ROWS, QUERY_ROWS, TILE = 65_536, 32_768, (512, 4096)


def approximate(queries: DataFrame, memory: DataFrame, k: int, reach: float, tables: int = 8, width: float = 2.0, seed: int = 11) -> DataFrame:
    """(q_id, m_id, distance, rank): the k nearest memories within `reach` that share a bucket with the query.

    queries: q_id, q_v; memory: m_id, m_v. On vectors of unit length the order by distance is that by cosine. Each table's
    buckets are intervals of `width` along a random direction, and a query is compared with the rows of its buckets only.
    Null vectors, and those with null components, take no part.
    """
    return nearest(queries, memory, k, lambda cosine, one, other: np.sqrt(np.maximum(one + other - 2 * cosine, 0.0)), reach, tables, width, seed)


def exact(queries: DataFrame, memory: DataFrame, k: int) -> DataFrame:
    """The same by comparing a stated query set with all rows."""
    return nearest(queries, memory, k, lambda cosine, one, other: np.sqrt(2 * np.clip(1 - cosine, 0.0, 2.0)))


def nearest(queries: DataFrame, memory: DataFrame, k: int, distance: Callable, reach: float = math.inf, tables: int = 0, width: float = 1.0, seed: int = 0) -> DataFrame:
    """Both sides are dealt into blocks by hashes of their ids; a task compares the queries of a block with its memories by
    matrix products and puts out k rows for each query. So neither pairs nor buckets are shuffled."""
    sound = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull())
    m, q = memory.where(sound("m_v")).select("m_id", "m_v"), queries.where(sound("q_v")).select("q_id", "q_v")
    ms, qs = (max(1, math.ceil(x.count() / rows)) for x, rows in ((m, MEMORY_ROWS), (q, QUERY_ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    m = m.withColumn("_m", part("m_id", ms)).withColumn("_q", every(qs))
    q = q.withColumn("_q", part("q_id", qs)).withColumn("_m", every(ms))
    ids = {"q_id": queries.schema["q_id"].dataType.simpleString(), "m_id": memory.schema["m_id"].dataType.simpleString()}

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("m_id")
            u, v = unit(left.column("q_v")), unit(right.column("m_v"))
            # Of equal vectors the smallest ids come first, and one of them may be the query itself.
            keep = first_copies(v, k + 1)
            v, m_ids, q_ids = v[keep], right.column("m_id").combine_chunks().take(pa.array(keep)), left.column("q_id").combine_chunks()
            plain_m, plain_q = m_ids.to_numpy(zero_copy_only=False), q_ids.to_numpy(zero_copy_only=False)
            groups = [(np.arange(len(u)), np.arange(len(v)))] if not tables else shared_buckets(u, v, tables, width, seed)
            one, other = (u**2).sum(axis=1), (v**2).sum(axis=1)
            narrow = v.astype(np.float32)
            for asking, rows in groups:
                some = narrow if len(rows) == len(v) else narrow[rows]
                for at in range(0, len(asking), TILE[0]):
                    of = asking[at : at + TILE[0]]
                    i, j = likely(u[of].astype(np.float32), some, k + 1)
                    i, j = of[i], rows[j]
                    d = np.concatenate([distance((u[i[x : x + 50_000]] * v[j[x : x + 50_000]]).sum(axis=1), one[i[x : x + 50_000]], other[j[x : x + 50_000]]) for x in range(0, len(i), 50_000)] or [np.zeros(0)])
                    fit = (plain_q[i] != plain_m[j]) & (d <= reach)
                    i, j, d = i[fit], j[fit], d[fit]
                    order = np.lexsort((j, d, i))
                    i, j, d = i[order], j[order], d[order]
                    starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, int)
                    nth = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
                    found.append((i[nth < k], j[nth < k], d[nth < k]))
        if not found:
            return pa.table([left.column("q_id").slice(0, 0), right.column("m_id").slice(0, 0), pa.array([], pa.float64())], names=["q_id", "m_id", "distance"])
        i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([q_ids.take(pa.array(i)), m_ids.take(pa.array(j)), pa.array(d, pa.float64())], names=["q_id", "m_id", "distance"])

    pairs = q.groupBy("_m", "_q").cogroup(m.groupBy("_m", "_q")).applyInArrow(search, f"q_id {ids['q_id']}, m_id {ids['m_id']}, distance double")
    w = Window.partitionBy("q_id").orderBy("distance", "m_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unit(x: pa.ChunkedArray) -> np.ndarray:
    v = x.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)
    n = np.sqrt((v**2).sum(axis=1, keepdims=True))
    return v / np.where(n > 0, n, 1.0)


def first_copies(v: np.ndarray, most: int) -> np.ndarray:
    """Places of rows but those that come after `most` equal ones."""
    _, same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]]))
    nth = np.arange(len(v)) - np.repeat(starts, np.diff(np.append(starts, len(v))))
    return np.sort(order[nth < most])


def shared_buckets(u: np.ndarray, v: np.ndarray, tables: int, width: float, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries of the same buckets, and the rows that share a bucket of any table with them."""
    directions = np.random.default_rng(seed).normal(size=(u.shape[1], tables))
    directions /= np.sqrt((directions**2).sum(axis=0))
    asked, there = (np.floor(x @ directions / width).astype(np.int32) for x in (u, v))
    kinds, which = np.unique(asked, axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    for kind, asking in zip(kinds, np.split(order, np.cumsum(np.bincount(which.ravel()))[:-1]), strict=True):
        yield asking, np.flatnonzero((there == kind).any(axis=1))


def likely(u: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in u, place in v) that hold the k rows of largest product for each query, and few others: all that come
    up to the k-th of the first rows, less what single precision may err."""
    slack, least, found = 4e-7 * u.shape[1], None, []
    for at in range(0, len(v), TILE[1]):
        x = u @ v[at : at + TILE[1]].T
        if least is None:
            least = np.full(len(u), -np.inf, np.float32) if x.shape[1] <= k else np.partition(x, -k, axis=1)[:, -k] - np.float32(slack)
        i, j = np.divmod(np.flatnonzero(x >= least[:, None]), x.shape[1])
        found.append((i, j + at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))


def recall(found: DataFrame, truth: DataFrame, least: float) -> DataFrame:
    """One row: the share of true neighbours found, and whether it passes the gate."""
    hit = truth.select("q_id", "m_id").join(found.select("q_id", "m_id", F.lit(1).alias("_hit")), ["q_id", "m_id"], "left")
    return hit.agg(F.count("*").alias("n"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall")).withColumn("passed", F.col("recall") >= least)


def by_routes(projected: DataFrame, key: str, k: int) -> DataFrame:
    """The median remaining way over the k routes that pass nearest, ties to the smaller route."""
    w = Window.partitionBy(key).orderBy("cross_km", "route")
    near = projected.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return near.groupBy(key).agg(F.count("*").alias("routes"), F.median("remaining_km").alias("remaining_km"), F.min("cross_km").alias("cross_km"))


class Graph:
    """A layered graph of near neighbours: a search goes down from few far-reaching links to the many of the lowest layer,
    always from the nearest place found so far."""

    def __init__(self, vectors: np.ndarray, links: int = 16, width: int = 64, seed: int = 11):
        self.v, self.links, self.width, self.evaluated = vectors, links, width, 0
        levels = np.minimum(np.floor(-np.log(np.random.default_rng(seed).random(len(vectors))) / math.log(links)), 8).astype(int)
        self.layers: list[dict[int, list[int]]] = [{} for _ in range(int(levels.max(initial=0)) + 1)]
        self.entry, self.top = -1, -1
        for node, level in enumerate(levels.tolist()):
            self.insert(node, level)

    def distances(self, q: np.ndarray, nodes: list[int]) -> list[float]:
        self.evaluated += len(nodes)
        return ((self.v[nodes] - q) ** 2).sum(axis=1).tolist()

    def walk(self, q: np.ndarray, starts: list[int], layer: int, width: int) -> list[tuple[float, int]]:
        """The nearest `width` nodes of a layer that a best-first search from some of its nodes meets, nearest first."""
        seen, links = set(starts), self.layers[layer]
        near = sorted(zip(self.distances(q, starts), starts, strict=True))[:width]
        ahead = list(near)
        heapq.heapify(ahead)
        while ahead and (len(near) < width or ahead[0][0] <= near[-1][0]):
            _, node = heapq.heappop(ahead)
            new = [x for x in links[node] if x not in seen]
            seen.update(new)
            for found in zip(self.distances(q, new), new, strict=True) if new else ():
                if len(near) < width or found < near[-1]:
                    insort(near, found)
                    del near[width:]
                    heapq.heappush(ahead, found)
        return near

    def insert(self, node: int, level: int) -> None:
        q, starts = self.v[node], [self.entry]
        for layer in range(self.top, -1, -1):
            near = self.walk(q, starts, layer, self.width if layer <= level else 1)
            starts = [x for _, x in near]
            if layer <= level:
                most = self.links * (2 if layer == 0 else 1)
                self.layers[layer][node] = starts[:most]
                for other in starts[:most]:
                    others = self.layers[layer][other]
                    others.append(node)
                    if len(others) > most:
                        self.layers[layer][other] = [x for _, x in sorted(zip(self.distances(self.v[other], others), others, strict=True))[:most]]
        for layer in range(self.top + 1, level + 1):
            self.layers[layer][node] = []
        if level > self.top:
            self.entry, self.top = node, level

    def search(self, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        starts = [self.entry]
        for layer in range(self.top, 0, -1):
            starts = [self.walk(q, starts, layer, 1)[0][1]]
        return self.walk(q, starts, 0, max(k, self.width))[:k]


def graph_neighbours(queries: DataFrame, memory: DataFrame, k: int, rows: int = 4096, links: int = 16, width: int = 64) -> DataFrame:
    """(q_id, rank, m_owner, m_id, distance, evaluated): the k nearest owners of each query by graphs over its cohort's rows.

    queries: q_id, q_owner, q_gate, q_v; memory: m_id, m_owner, m_gate, m_v. Vectors are compared at unit length, so that
    the order is that by cosine; evaluated is how many distances a query took. Each cohort is dealt into graphs of about
    `rows` rows, each built and searched in one task by the queries of the cohort; an owner counts once, by its nearest
    row, and the query's own not at all. More rows make more graphs, not larger ones.
    """
    unit = lambda c: arrays.normalised(F.col(c)).alias("v")
    parts = memory.groupBy(F.col("m_gate").alias("gate")).agg(F.ceil(F.count("*") / rows).cast("int").alias("_parts"))
    dealt = memory.withColumnRenamed("m_gate", "gate").join(parts, "gate").select("gate", F.pmod(F.xxhash64("m_id"), F.col("_parts")).cast("int").alias("part"), "m_id", "m_owner", unit("m_v"))
    asked = queries.withColumnRenamed("q_gate", "gate").join(parts, "gate").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select("gate", "part", "q_id", "q_owner", unit("q_v"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("m_id")
        part = left.column("part")[0].as_py() if left.num_rows else 0
        ids, owners = right.column("m_id").to_pylist(), right.column("m_owner").to_pylist()
        out = []
        if ids and left.num_rows:
            graph = Graph(np.array(right.column("v").to_pylist(), float), links, width)
            for q_id, q_owner, q in zip(left.column("q_id").to_pylist(), left.column("q_owner").to_pylist(), left.column("v").to_pylist(), strict=True):
                before, best, wanted = graph.evaluated, {}, 2 * k
                while True:
                    found = graph.search(np.array(q), wanted)
                    for distance, node in found:
                        if owners[node] != q_owner:
                            best.setdefault(owners[node], (math.sqrt(max(distance, 0.0)), ids[node]))
                    if len(best) >= k or len(found) < wanted:
                        break
                    wanted *= 2
                out += [(q_id, owner, m_id, distance, graph.evaluated - before, part) for owner, (distance, m_id) in list(best.items())[:k]]
        names = ["q_id", "m_owner", "m_id", "distance", "evaluated", "part"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32()]
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=names)

    found = asked.groupBy("gate", "part").cogroup(dealt.groupBy("gate", "part")).applyInArrow(search, "q_id long, m_owner long, m_id long, distance double, evaluated long, part int")
    spent = found.select("q_id", "evaluated", "part").distinct().groupBy("q_id").agg(F.sum("evaluated").alias("evaluated"))
    best = found.groupBy("q_id", "m_owner").agg(F.min(F.struct("distance", "m_id")).alias("x"))
    w = Window.partitionBy("q_id").orderBy("x.distance", "x.m_id")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.join(spent, "q_id").select("q_id", "rank", "m_owner", F.col("x.m_id").alias("m_id"), F.col("x.distance").alias("distance"), "evaluated")
