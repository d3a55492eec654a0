"""Column functions on arrays of numbers, and the two sequence kernels that need Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def normalised(x: Column) -> Column:
    """x over its length; a zero vector stays as it is."""
    n = norm(x)
    return F.transform(x, lambda v: v.cast("double") / F.when(n > 0, n).otherwise(1.0))


def cosine_distance(x: Column, y: Column) -> Column:
    """1 - cosine, within [0, 2]."""
    den = norm(x) * norm(y)
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - dot(x, y) / F.when(den > 0, den).otherwise(1.0)))


def dtw_many(x: np.ndarray, y: np.ndarray, band: int = 2) -> np.ndarray:
    """Dynamic time warping in a Sakoe-Chiba band, over the sum of the lengths, of many pairs of sequences of one length each:
    x is (pairs, n, 2), y (pairs, m, 2)."""
    pairs, n, m = len(x), x.shape[1], y.shape[1]
    reach = max(band, abs(n - m))
    cost = np.sqrt(((x[:, :, None, :] - y[:, None, :, :]) ** 2).sum(axis=3))
    last = np.full((m + 1, pairs), np.inf)
    last[0] = 0.0
    for i in range(1, n + 1):
        row = np.full((m + 1, pairs), np.inf)
        for j in range(max(1, i - reach), min(m, i + reach) + 1):
            row[j] = cost[:, i - 1, j - 1] + np.minimum(np.minimum(last[j], row[j - 1]), last[j - 1])
        last = row
    return last[m] / (n + m)


def dtw_nearest(x: pa.ChunkedArray, y: pa.ChunkedArray, one: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in x and y, and dtw_many, of the k rows of y nearest to each row of x, ties to the earlier; rows with equal
    `one` and `other` don't meet. Sequences are flat: x, y, x, y ...; empty ones and those with unknown numbers take no part.

    A few rows give a distance that the k nearest can't exceed; all pairs then pass in single precision, those too far at
    both ends first, and what may be near enough is computed by dtw_many.
    """
    sides, found = [], []
    for side in (x, y):
        sizes, flat = np.asarray(pc.fill_null(pc.list_value_length(side), 0)), side.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        ends = np.cumsum(sizes)
        rows = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes) if n}
        values = {n // 2: (at, flat[(ends[at] - n)[:, None] + np.arange(n)].reshape(-1, n // 2, 2)) for n, at in rows.items()}
        sides.append({n: (at[good], v[good]) for n, (at, v) in values.items() for good in [np.isfinite(v).all(axis=(1, 2))] if good.any()})
    for n, (a, q) in sides[0].items():
        for m, (b, v) in sides[1].items():
            middle = v.mean(axis=(0, 1))
            q32, v32 = ((z - middle).astype(np.float32) for z in (q, v))
            most = max(float(np.abs(q32).max()), float(np.abs(v32).max()))
            slack = 1e-6 * (n + m) ** 2 * most
            columns = np.ascontiguousarray(v32.transpose(1, 2, 0))
            step, few = max(1, 32_768 // len(b)), min(len(b), 4 * k + 1)
            for at in range(0, len(a), step):
                s = slice(at, at + step)
                if n == m and few < len(b):
                    u = q32[s].reshape(-1, 2 * n)
                    seeds = np.argpartition((v32.reshape(-1, 2 * n) ** 2).sum(axis=1) - 2 * u @ v32.reshape(-1, 2 * n).T, few - 1, axis=1)[:, :few]
                else:
                    seeds = np.tile(np.arange(few), (len(q[s]), 1))
                own = one[a[s]][:, None] == other[b[seeds]]
                first = np.where(own, np.inf, dtw_many(np.repeat(q[s], few, axis=0), v[seeds.ravel()]).reshape(-1, few))
                limit = np.partition(first, k - 1, axis=1)[:, k - 1] * (n + m) if few >= k else np.full(len(first), np.inf)
                i, j = dtw_within(q32[s], columns, (limit + slack).astype(np.float32))
                other_owner = one[a[i + at]] != other[b[j]]
                i, j = i[other_owner], j[other_owner]
                d = np.concatenate([dtw_many(q[i[c : c + 20_000] + at], v[j[c : c + 20_000]]) for c in range(0, len(i), 20_000)] or [np.zeros(0)])
                found.append((a[i + at], b[j], d))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    i, j, d = (np.concatenate(z) for z in zip(*found, strict=True))
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], d[keep]


def dtw_within(q: np.ndarray, columns: np.ndarray, limit: np.ndarray, band: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose warped distance, not over the lengths, is within each query's limit. q: (queries, n, 2); columns: (m, 2, rows)."""
    n, m = q.shape[1], len(columns)
    reach = max(band, abs(n - m))
    cost = lambda i, j: np.sqrt((columns[j, 0] - q[:, i, 0, None]) ** 2 + (columns[j, 1] - q[:, i, 1, None]) ** 2)
    # Every way has both ends; that bound alone may leave few pairs.
    ends = cost(0, 0) + cost(n - 1, m - 1) if n + m > 2 else cost(0, 0)
    at, row = np.nonzero(ends <= limit[:, None])
    if few := 2 * len(at) < ends.size:
        some, asked = columns[:, :, row], q[at]
        cost = lambda i, j: np.sqrt((some[j, 0] - asked[:, i, 0]) ** 2 + (some[j, 1] - asked[:, i, 1]) ** 2)
    last = [0.0] + [np.float32(np.inf)] * m
    for i in range(1, n + 1):
        now = [np.float32(np.inf)] * (m + 1)
        for j in range(max(1, i - reach), min(m, i + reach) + 1):
            now[j] = cost(i - 1, j - 1) + np.minimum(np.minimum(last[j], now[j - 1]), last[j - 1])
        last = now
    if few:
        good = last[m] <= limit[at]
        return at[good], row[good]
    return np.nonzero(last[m] <= limit[:, None])


@F.arrow_udf(T.DoubleType())
def dtw_distance(x: pa.Array, y: pa.Array) -> pa.Array:
    """DTW of arrays of points struct<x, y>, all pairs of a batch that have the same lengths at once; NULL for an empty one."""
    out = np.full(len(x), np.nan)
    a, b = np.asarray(x.value_lengths().fill_null(0)), np.asarray(y.value_lengths().fill_null(0))
    for n, m in {*zip(a.tolist(), b.tolist(), strict=True)}:
        if n and m:
            rows = np.flatnonzero((a == n) & (b == m))
            out[rows] = dtw_many(points(x.take(pa.array(rows)), n), points(y.take(pa.array(rows)), m))
    return pa.array(out, mask=np.isnan(out))


def points(x: pa.Array, n: int) -> np.ndarray:
    flat = x.flatten()
    return np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], axis=1).reshape(-1, n, 2)
