"""Exact substring deduplication with suffix runs, front coding and a loser tree that knows common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidelog.llm.common import column, heads, numbers, small
from tidelog.llm.phrases import COUNT_BITS, TAG_BITS, all_candidates, covered, dealt, keyed, marked, marks_by_document, pack_at, places_of, unpack_at, with_places

#: Suffixes in one part, about; bytes of different suffixes that a map task gathers; suffixes that are settled at a time.
PART, RUN_BYTES, SETTLED = 8_000, 24 << 20, 4_096
#: What a run has of each suffix besides its bytes.
HEAD = np.dtype([("d", "<i8"), ("at", "<i8"), ("right", "<u4"), ("more_right", "<u4"), ("left", "<u4"), ("more_left", "<u4"), ("repeats", "<u4")])

#: A suffix: bytes from its point on, bytes before it backwards, document, first window and tag, whether it repeats in its
#: run (a settled one that stands for its copies).
Suffix = tuple[bytes, bytes, int, int, int]


def byte_numbers() -> Callable[[bytes], np.ndarray]:
    return lambda text: np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)


def common_prefix(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known: the first bit set in the exclusive or tells."""
    n = min(len(x), len(y))
    p, q = x[known:n], y[known:n]
    return n if p == q else n - ((int.from_bytes(p) ^ int.from_bytes(q)).bit_length() + 7) // 8


def front_coded(run: list[Suffix]) -> bytes:
    """A sorted run: of each suffix the lengths that it shares with the one before, on both sides, and the rest."""
    rows, body = [], []
    last, last_left = b"", b""
    for right, left, d, at, repeats in run:
        same, same_left = common_prefix(last, right), common_prefix(last_left, left)
        rows.append((d, at, same, len(right) - same, same_left, len(left) - same_left, repeats))
        body += [right[same:], left[same_left:]]
        last, last_left = right, left
    return len(run).to_bytes(8, "little") + heads(rows, HEAD) + b"".join(body)


def decoded(run: bytes) -> Iterator[tuple[int, Suffix]]:
    """(shared length with the one before, suffix) of a front-coded run."""
    n = int.from_bytes(run[:8], "little")
    at, last, last_left = 8 + HEAD.itemsize * n, b"", b""
    for d, place, same, more, same_left, more_left, repeats in np.frombuffer(run, HEAD, n, 8).tolist():
        last = last[:same] + run[at : at + more]
        at += more
        last_left = last_left[:same_left] + run[at : at + more_left]
        at += more_left
        yield same, (last, last_left, d, place, repeats)


def merge(runs: list[bytes]) -> Iterator[tuple[int, Suffix]]:
    """(length shared with the suffix before, suffix) of all runs in order, by a loser tree.

    Every contestant carries how long a prefix it shares with the last winner. Of two, the one that shares more is
    smaller, and nothing is read; if they share the same, bytes are compared from there on only, and the loser keeps the
    length it shares with the one it lost to.
    """
    sources = [decoded(x) for x in runs]
    size = 1
    while size < len(sources):
        size *= 2
    items: list[Suffix | None] = [next(x, (0, None))[1] for x in sources] + [None] * (size - len(sources))
    shared = [0] * size
    losers = [0] * size

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser)."""
        one, two = items[x], items[y]
        if one is None or two is None:
            return (y, x) if one is None else (x, y)
        if shared[x] != shared[y]:
            return (x, y) if shared[x] > shared[y] else (y, x)
        p, q = one[0], two[0]
        n = common_prefix(p, q, shared[x])
        if n == len(p) or n < len(q) and p[n] < q[n]:
            shared[y] = n
            return x, y
        shared[x] = n
        return y, x

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if size > 1 else 0
    before = 0
    while (item := items[winner]) is not None:
        yield before, item
        same, items[winner] = next(sources[winner], (0, None))
        shared[winner] = same
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(losers[node], winner)
            node //= 2
        before = shared[winner]


def repeated_windows(merged: list[Suffix], shared: list[int], width: int, most: int) -> np.ndarray:
    """[i, k]: whether the window that begins k bytes ahead of the point of suffix i is also that of another suffix, given
    the sorted suffixes and the length that each shares with the one before; k is below `most` for all windows.

    Such a window is common to suffixes that share width - k bytes from the point on and k bytes ahead of it. For each k,
    the suffixes in order fall into classes that share so much, and in the order of the bytes ahead, likewise. Two in the
    same class both ways have the window in common.
    """
    n = len(merged)
    right = np.array(shared, np.int64)
    right[0] = 0
    lefts = [x[1] for x in merged]
    order = sorted(range(n), key=lefts.__getitem__)
    left = np.array([0] + [common_prefix(lefts[i], lefts[j]) for i, j in zip(order, order[1:], strict=False)], np.int64)
    near_right = np.maximum(right, np.append(right[1:], 0))
    near_left = np.zeros(n, np.int64)
    near_left[order] = np.maximum(left, np.append(left[1:], 0))
    length = np.array([len(x) for x in lefts])
    class_left = np.zeros(n, np.int64)
    out = np.zeros((n, most), bool)
    for k in range(most):
        some = np.flatnonzero((near_right >= width - k) & (near_left >= k) & (length >= k))
        if len(some) > 1:
            class_left[order] = np.cumsum(left < k)
            both = np.cumsum(right < width - k)[some] * n + class_left[some]
            _, which, count = np.unique(both, return_inverse=True, return_counts=True)
            out[some[count[which] > 1], k] = True
    return out


def marks_of(merged: list[Suffix], shared: list[int], width: int, most: int) -> pa.RecordBatch:
    """(d, at) of the repeated windows of suffixes that aren't settled yet."""
    windows = repeated_windows(merged, shared, width, most)
    windows[[x[4] > 0 for x in merged]] = False
    edge = np.diff(np.pad(windows, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, near = np.nonzero(edge == 1)
    far = np.nonzero(edge == -1)[1] - 1
    d, at, off = (np.array(x, np.int64)[row] for x in ([x[2] for x in merged], [x[3] for x in merged], [len(x[1]) for x in merged]))
    first, _, tag = unpack_at(at)
    return marks(d, pack_at(first + off - far, far - near + 1, tag))


def marks(d: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(at, pa.int64())], names=["d", "at"])


def suffix_runs(own: DataFrame, places: DataFrame, width: int, parts: int) -> DataFrame:
    """(part, run): front-coded sorted runs of the suffixes that begin at the points of the elements at places, dealt by
    the bytes that every window of an element has from its point on.

    Of equal suffixes, with equal bytes ahead, a map task sends one, as they are repeats of each other: their places come
    out as a run of marks, of no part (below 0). The one that is sent stands for the others' copies elsewhere.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[bytes, bytes, int], list[int]] = {}
        settled: list[tuple[int, int]] = []
        size = 0
        for batch in small(batches):
            for text, doc, tag, places in zip(column(batch, "text"), numbers(batch, "d").tolist(), numbers(batch, "tag").tolist(), places_of(batch), strict=True):
                for first, count, off, cell in np.stack(places, axis=1).tolist():
                    part, place = text[first : first + count - 1 + width], first << COUNT_BITS + TAG_BITS | count << TAG_BITS | tag
                    element = (part[off:], part[:off][::-1], cell)
                    known = found.setdefault(element, [doc, place, -1])
                    if known[2] < 0:
                        known[2] = 0
                        size += len(part) + 300
                        continue
                    if not known[2]:
                        known[2] = 1
                        settled.append((known[0], known[1]))
                    settled.append((doc, place))
                if size > RUN_BYTES or len(settled) > 50_000:
                    yield coded(found, settled)
                    found, settled, size = {}, [], 0
        if found:
            yield coded(found, settled)

    def coded(found: dict[tuple[bytes, bytes, int], list[int]], settled: list[tuple[int, int]]) -> pa.RecordBatch:
        common = lambda right, cell: xxhash.xxh3_64_intdigest(right[: width - cell + 1]) % parts
        suffixes = sorted((common(right, cell), right, left, d, at, repeats) for (right, left, cell), (d, at, repeats) in found.items())
        by = [(part, front_coded([x[1:] for x in run])) for part, run in groupby(suffixes, lambda x: x[0])]
        if settled:
            by.append((-1 - settled[0][0] % parts, np.array(settled, np.int64).tobytes()))
        part, run = zip(*by, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(run, pa.binary())], names=["part", "run"])

    return with_places(own, places).mapInArrow(cut, "part long, run binary")


def merged_marks(runs: DataFrame, width: int, widest: int) -> DataFrame:
    """(d, at) of repeated windows, from merging the runs of each part."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks = None, []
        for batch in small(batches, 64):
            for here, run in zip(column(batch, "part"), column(batch, "run"), strict=True):
                if here < 0:
                    yield marks(*np.frombuffer(run, np.int64).reshape(-1, 2).T)
                    continue
                if here != part and blocks:
                    yield from of_part(blocks)
                    blocks = []
                part = here
                blocks.append(run)
        if blocks:
            yield from of_part(blocks)

    def of_part(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        merged: list[Suffix] = []
        shared: list[int] = []
        for same, suffix in merge(blocks):
            # Windows in common need as many common bytes from their point on.
            if same < width - widest + 1:
                if len(merged) == 1:
                    merged, shared = [], []
                elif len(merged) >= SETTLED:
                    yield marks_of(merged, shared, width, widest)
                    merged, shared = [], []
            merged.append(suffix)
            shared.append(same)
        if len(merged) > 1:
            yield marks_of(merged, shared, width, widest)

    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(settle, "d long, at long")


def drop_repeated_bytes(docs: DataFrame, width: int = 400, gram: int = 64, keep_text: bool = True) -> DataFrame:
    """Remove every byte covered by a string of `width` bytes that also starts anywhere else.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left, if keep_text).

    Hashes only choose: elements of at most `width` - `gram` + 1 neighbouring windows that may have a window in common with
    others (see phrases). Each becomes a suffix, from its point on, and the bytes ahead of it. Map tasks send front-coded
    sorted runs of them; a loser tree merges those by the prefixes they are known to share, and what neighbours in that
    order, and in the order of the bytes ahead, have in common decides which windows repeat. An element whose key very
    many different ones have is divided into narrower ones before, down to single windows, whose key only equal strings
    (and collisions) have; so no task has to hold a passage's many surroundings.

    A null text counts as empty; a null doc_id stays null; rows that repeat a doc_id are documents of their own, so that
    the long strings of identical rows go from each. An empty table gives no rows; other columns are ignored.
    """
    own = dealt(keyed(docs))
    widest = -(-(width - gram + 1) // 2)
    places, size = all_candidates(keyed(docs), byte_numbers, width, gram, (widest, max(1, round(widest**0.5)), 1), earlier_only=False)
    found = merged_marks(suffix_runs(own, places, width, max(1, size // PART)), width, widest)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sizes, removed, spans, digests, left = [], [], [], [], []
            for text, tag, at in zip(column(batch, "text"), numbers(batch, "tag").tolist(), marked(batch, "marks"), strict=True):
                text = text or b""
                gone = covered(at, tag, len(text), width)
                kept = text
                if gone.any():
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                sizes.append(len(text))
                removed.append(len(text) - len(kept))
                spans.append(int((gone[1:] & ~gone[:-1]).sum()) + bool(len(gone) and gone[0]))
                digests.append(hashlib.sha256(kept).hexdigest())
                left.append(kept)
            arrays = [batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(left, pa.binary())] * keep_text, names=names + ["kept"] * keep_text)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return own.join(marks_by_document(found), "d", "left").select("d", "tag", "doc_id", "text", "marks").mapInArrow(remove, schema)
