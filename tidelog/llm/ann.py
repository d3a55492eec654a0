"""Nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import mix, numbers

#: Rows of the index, or queries, that one group holds, about; a cell with more is split by a hash of the row's id.
CELL_ROWS = 4096
#: Rows with the least hashes of their ids, on which parameters are chosen; how many of them, of each length, are pilots:
#: queries whose true neighbours are sought among all rows for that. Share of the neighbours that buckets must find there.
SAMPLE, PILOTS, TARGET = 2000, 64, 0.95


def probing_order(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of perturbations by estimated success, as places in the list of boundary distances sorted ascending.

    The expected squared distance of the j-th nearest of the 2m boundaries is known beforehand; a heap walks sets by
    their sums, by shifting a set's last place or adding the next. A set may not move one hash both ways.
    """
    m = hashes
    j = np.arange(1, 2 * m + 1)
    k = 2 * m + 1 - j
    expected = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2)))
    out: list[tuple[int, ...]] = [()]
    heap = [(float(expected[0]), (0,))]
    while heap and len(out) < probes:
        total, places = heapq.heappop(heap)
        if not any(2 * m - 1 - x in places for x in places):
            out.append(places)
        last = places[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - float(expected[last]) + float(expected[last + 1]), (*places[:-1], last + 1)))
            heapq.heappush(heap, (total + float(expected[last + 1]), (*places, last + 1)))
    return out


class Tables:
    """`tables` independent p-stable hashes of `hashes` projections each, with bucket width `width`."""

    def __init__(self, dims: int, tables: int, hashes: int, width: float, probes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(tables, dims, hashes)) / width
        self.offsets = rng.random((tables, hashes))
        self.weights = mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        sets = probing_order(hashes, probes)
        self.sets = np.zeros((len(sets), 2 * hashes), np.uint64)
        for row, places in zip(self.sets, sets, strict=True):
            row[list(places)] = 1

    def slots(self, table: int, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.directions[table] + self.offsets[table]

    def keys(self, table: int, slots: np.ndarray) -> np.ndarray:
        """The bucket's key: a sum, so that moving a hash by one slot adds or takes its weight."""
        return np.floor(slots).astype(np.int64).astype(np.uint64) @ self.weights + np.uint64(table)

    def probes(self, table: int, slots: np.ndarray) -> np.ndarray:
        """Keys of all buckets to visit, a row for each vector: its own and those across near boundaries."""
        into = slots - np.floor(slots)
        moves = np.concatenate([np.uint64(0) - self.weights, self.weights])
        order = np.argsort(np.concatenate([into, 1 - into], axis=1), axis=1, kind="stable")
        return self.keys(table, slots)[:, None] + moves[order] @ self.sets.T


class Hashes(dict):
    """The tables for vectors of each length. A length that the sample doesn't have is rare; its rows share one bucket."""

    def __init__(self, tables: int, probes: int, seed: int):
        self.tables, self.probes, self.seed = tables, probes, seed

    def made(self, dims: int, hashes: int, width: float) -> Tables:
        return Tables(dims, self.tables, hashes, width, self.probes, self.seed)

    def __missing__(self, dims: int) -> Tables:
        self[dims] = self.made(dims, 1, float("inf"))
        return self[dims]

    def choose(self, pilots: np.ndarray, near: list[np.ndarray], sample: np.ndarray, rows: int) -> None:
        """Set the number of projections and the width by which pilots find TARGET of their neighbours and meet the fewest
        rows of the sample; if none does so, those that find the most. Projections are up to log2(rows)."""
        scale = float(np.median([np.sqrt(((x - q) ** 2).sum(axis=1)).max() for q, x in zip(pilots, near, strict=True) if len(x)] or [1.0])) or 1.0
        found = []
        for hashes in range(1, max(1, int(math.log2(max(rows, 2)))) + 1):
            for width in (1.4, 2.0, 2.8, 4.0):
                tables = self.made(pilots.shape[1], hashes, width * scale)
                hits, met = [np.zeros(len(x), bool) for x in near], np.zeros((len(pilots), len(sample)), bool)
                for t in range(self.tables):
                    visited = tables.probes(t, tables.slots(t, pilots))
                    every = tables.keys(t, tables.slots(t, sample))
                    for k, keys in enumerate(visited):
                        met[k] |= np.isin(every, keys)
                        hits[k] |= np.isin(tables.keys(t, tables.slots(t, near[k])), keys)
                recall = float(np.concatenate(hits).mean()) if any(map(len, hits)) else 1.0
                found.append((recall < TARGET, float(met.mean()) if recall >= TARGET else -recall, hashes, width * scale))
            # More projections find fewer; once the widest slots miss too many, they do for good.
            if found[-1][0]:
                break
        _, _, hashes, width = min(found)
        self[pilots.shape[1]] = self.made(pilots.shape[1], hashes, width)


def nearest(rows: DataFrame, is_query: Column, k: int = 10, tables: int = 4, probes: int = 320, seed: int = 5) -> DataFrame:
    """Each query's k nearest other rows found, by Euclidean distance: query_id, rank, vec_id, score.

    rows has vec_id and embedding. Every row is in the index, once in each table; a query visits `probes` buckets of each
    in the order of estimated success, and what the tables give is merged and ranked by exact distances of the original
    vectors in double precision, ties by vec_id. Width of the slots and number of projections are chosen by pilots from a
    sample of SAMPLE rows, whose true neighbours among all rows are sought: the fewest rows met that find TARGET of them.
    Where vectors lie evenly in all directions, as in the test tables, a query meets most rows, and far fewer where
    neighbours are near. Buckets are grouped into cells of about CELL_ROWS rows; a cell with more rows or queries is split
    by hashes of their ids, and each part of the queries meets each part of the rows. Of equal vectors only the k + 1 with
    the smallest ids are in the index, as others are nobody's k nearest. Each part returns k rows a query at most.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without an id; vectors of
    different lengths have no distance and don't meet; rows that repeat an id count once for a query, by the nearer; a
    query's own id is never a candidate. An empty table gives no rows; other columns are ignored.
    """
    sc = rows.sparkSession.sparkContext
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("is_query")).where("vec_id is not null and embedding is not null")
    usable = usable.where(F.coalesce(sound, F.lit(False)))
    kind = np.float32 if rows.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    if kind == np.float64:
        usable = usable.withColumn("embedding", F.col("embedding").cast("array<double>"))
    total = usable.count()
    cells = max(1, total // CELL_ROWS)
    hashes = Hashes(tables, probes, seed)
    sample: dict[int, list[tuple[int, list[float]]]] = {}
    for x in usable.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect():
        sample.setdefault(len(x.embedding), []).append((x.vec_id, x.embedding))
    near = pilot_neighbours(usable, sample, kind, k)
    for dims, found in sample.items():
        v = np.array([x for _, x in found], np.float64)
        hashes.choose(v[:PILOTS], [near.get((dims, i), np.zeros((0, dims))) for i in range(min(len(v), PILOTS))], v, total)
    shared = sc.broadcast(hashes)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw, v in by_length(batches):
            data = [x.tobytes() for x in raw]
            for t in range(tables):
                keys = shared.value[v.shape[1]].keys(t, shared.value[v.shape[1]].slots(t, v))
                yield pa.RecordBatch.from_arrays([pa.array(cell_of(t, v, keys)), pa.array(keys.view(np.int64)), pa.array(ids), pa.array(data, pa.binary())], names=["cell", "bucket", "vec_id", "vector"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw, v in by_length(batches):
            for t in range(tables):
                keys = shared.value[v.shape[1]].probes(t, shared.value[v.shape[1]].slots(t, v))
                out = []
                for row, where in enumerate(cell_of(t, v, keys)):
                    order = np.argsort(where, kind="stable")
                    ends = np.flatnonzero(np.diff(where[order])) + 1
                    data = raw[row].tobytes()
                    out += [(int(where[x[0]]), int(ids[row]), data, keys[row][x].tobytes()) for x in np.split(order, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["cell", "query_id", "vector", "buckets"])

    def cell_of(table: int, v: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return (v.shape[1] * tables + table) * cells + (mix(keys) % np.uint64(cells)).astype(np.int64)

    alike = Window.partitionBy("embedding").orderBy("vec_id")
    first = usable.select("vec_id", "embedding").distinct().withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1)
    entries = first.select("vec_id", "embedding").mapInArrow(index, "cell long, bucket long, vec_id long, vector binary")
    asked = usable.where("is_query").select("vec_id", "embedding").mapInArrow(probe, "cell long, query_id long, vector binary, buckets binary")

    # Only cells that are split take part in a join; most tables have none.
    def split(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count("*") / (2 * CELL_ROWS)).cast("long").alias(name)).where(F.col(name) > 1)

    def dealt(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        """Rows in one part of their own kind, and in all parts of the other."""
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))
        both = df.join(split(entries, "parts"), "cell", "left").join(split(asked, "turns"), "cell", "left")
        return both.withColumn(f"{own}_", F.pmod(F.xxhash64(by), F.coalesce(own, F.lit(1)))).withColumn(f"{other}_", every).drop("parts", "turns")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        buckets, ids = right.column("bucket").to_numpy(), right.column("vec_id").to_numpy()
        order = np.argsort(buckets, kind="stable")
        buckets, ids = buckets[order], ids[order]
        v = np.frombuffer(b"".join(right.column("vector").to_pylist()), kind).reshape(len(ids), -1 if len(ids) else 0)[order].astype(np.float64)
        for query, raw, keys in zip(left.column("query_id").to_pylist(), left.column("vector").to_pylist(), left.column("buckets").to_pylist(), strict=True):
            wanted = np.unique(np.frombuffer(keys, np.int64))
            low, high = np.searchsorted(buckets, wanted, "left"), np.searchsorted(buckets, wanted, "right")
            at = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True) if a < b] or [np.zeros(0, np.int64)])
            at = at[ids[at] != query]
            if not len(at):
                continue
            distance = np.sqrt(((v[at] - np.frombuffer(raw, kind).astype(np.float64)) ** 2).sum(axis=1))
            best = np.lexsort((ids[at], distance))
            # Repeated ids count once.
            _, first = np.unique(ids[at][best], return_index=True)
            best = best[np.sort(first)[:k]]
            found.append((np.full(len(best), query), ids[at][best], distance[best]))
        arrays = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(x) for x in arrays], names=["query_id", "vec_id", "score"])

    groups = ["cell", "parts_", "turns_"]
    left, right = dealt(asked, "query_id", "turns", "parts"), dealt(entries, "vec_id", "parts", "turns")
    found = left.groupBy(groups).cogroup(right.groupBy(groups)).applyInArrow(rank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, vectors in double precision) of the rows of each length in a batch of vec_id and embedding."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        for dims in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == dims))
            raw = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            yield numbers(part, "vec_id"), raw, raw.astype(np.float64)


def pilot_neighbours(usable: DataFrame, sample: dict[int, list[tuple[int, list[float]]]], kind: type, k: int) -> dict[tuple[int, int], np.ndarray]:
    """The k nearest rows of each pilot among all rows; a task keeps k for each pilot."""
    pilots = {dims: (np.array([x for x, _ in found[:PILOTS]]), np.array([x for _, x in found[:PILOTS]], np.float64)) for dims, found in sample.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple[float, int, bytes]]] = {}
        for ids, raw, v in by_length(batches):
            own, q = pilots.get(v.shape[1], (np.zeros(0), np.zeros((0, v.shape[1]))))
            # Products order the rows well enough here; the distances kept are exact.
            far = (v**2).sum(axis=1)[None] - 2 * q @ v.T
            for i, row in enumerate(np.where(own[:, None] == ids[None], np.inf, far)):
                at = np.argpartition(row, k)[:k] if len(row) > k else np.arange(len(row))
                some = [(float(np.sqrt(((v[j] - q[i]) ** 2).sum())), int(ids[j]), raw[j].tobytes()) for j in at.tolist() if np.isfinite(row[j])]
                best[v.shape[1], i] = heapq.nsmallest(k, best.get((v.shape[1], i), []) + some)
        out = [(dims, i, *x) for (dims, i), found in best.items() for x in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["dims", "pilot", "score", "vec_id", "vector"])

    found = usable.select("vec_id", "embedding").mapInArrow(scan, "dims long, pilot long, score double, vec_id long, vector binary")
    by = Window.partitionBy("dims", "pilot").orderBy("score", "vec_id")
    near: dict[tuple[int, int], list[np.ndarray]] = {}
    for x in found.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k).collect():
        near.setdefault((x.dims, x.pilot), []).append(np.frombuffer(x.vector, kind).astype(np.float64))
    return {key: np.stack(x) for key, x in near.items()}
