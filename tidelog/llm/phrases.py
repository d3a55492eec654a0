"""Places of a text where a window may repeat, by phrases and cells that content alone delimits.

A window's anchor is its gram with the least hash. Neighbouring windows with one anchor form a phrase, and those of a
phrase that begin between i and i + 1 cells ahead of the anchor form an element. Equal windows lie at the same place around
equal anchors, so they belong to elements of equal cells, and all windows of a cell have a string in common: from the
cell's point, i cells ahead of the anchor, on. The hash of that string is the element's key. Elements with equal keys are
candidates, no more; who compares them has to read their words or bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import BASE, UNBASE, as_bytes, checkpointed, column, lists, mix, numbers, released, sliding_argmin, small, stored

#: Windows of a sequence that are hashed at a time.
STRETCH = 1 << 18
COUNT_BITS, TAG_BITS, DIGEST_BITS = 10, 22, 11
#: a: key; d, at: the element's document and place; geo: offset of its cell's point from its beginning, the cell's width,
#: and a digest of the element's whole string.
ELEMENTS = "a long, d long, at long, geo int"
#: Rows that a map task combines before it sends them.
ROWS_AT_ONCE = 250_000
#: Different digests in a key beyond which its cell is divided: 1,200 of 2,048 are about 1,800 different elements.
HOT = 1_200
#: Places are sent to every executor only up to this many; beyond it documents are dealt to them.
SENT_PLACES = 200_000

Sequence = Callable[[], Callable[[bytes], np.ndarray]]


class Powers:
    """Powers of the hash base and of its inverse, as many as were ever needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)]).cumprod(dtype=np.uint64) for x in (BASE, UNBASE))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix(x: np.ndarray) -> np.ndarray:
    up, _ = POWERS.of(len(x) + 1)
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[:-1], out=out[1:])
    return out


def hash_of(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of x[start:end], given h = prefix(x)."""
    _, down = POWERS.of(len(h))
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pack_at(start: np.ndarray, count: np.ndarray, tag: int) -> np.ndarray:
    return start << (COUNT_BITS + TAG_BITS) | count << TAG_BITS | tag


def unpack_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, tag."""
    return at >> (COUNT_BITS + TAG_BITS), at >> TAG_BITS & (1 << COUNT_BITS) - 1, at & (1 << TAG_BITS) - 1


def unpack_geo(geo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset of the cell's point, width of the cell."""
    return geo & (1 << COUNT_BITS) - 1, geo >> COUNT_BITS & (1 << COUNT_BITS) - 1


def anchors_of(h: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor's place) of the phrases of a sequence, given h = prefix(x)."""
    places = np.arange(len(h) - gram)
    anchor = sliding_argmin(hash_of(h, places, places + gram), width - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return first, np.diff(np.concatenate([first, [len(anchor)]])), anchor[first]


def cells(h: np.ndarray, point: np.ndarray, low: np.ndarray, high: np.ndarray, span: int, cell: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, whole hash, first window, number of windows, geo, which point) of elements: the windows that begin low to high
    places ahead of a point, where that is less than span, by cells."""
    for k in range(0, span, cell):
        near, far = np.maximum(low, k), np.minimum(high, k + cell - 1)
        some = np.flatnonzero(near <= far)
        at, near, far = point[some], near[some], far[some]
        first, count = at - far, far - near + 1
        keys, whole = hash_of(h, at - k, at - k + width - cell + 1), hash_of(h, first, first + count - 1 + width)
        digest = (whole >> np.uint64(64 - DIGEST_BITS)).astype(np.int64)
        yield keys.view(np.int64), whole.view(np.int64), first, count, (far - k | cell << COUNT_BITS | digest << 2 * COUNT_BITS).astype(np.int32), some


def keyed(docs: DataFrame) -> DataFrame:
    """d (the doc_id, or a hash of the text where it is null), tag (bits of the text's hash, to tell repeated ids apart), doc_id and text as bytes."""
    own = F.xxhash64("text")
    doc = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc, own).alias("d"), F.pmod(own, F.lit(1 << TAG_BITS)).alias("tag"), doc.alias("doc_id"), as_bytes().alias("text"))


def element_rows(docs: DataFrame, sequence: Sequence, width: int, gram: int, cell: int, earlier_only: bool) -> DataFrame:
    """The elements of keyed docs, combined (see there). sequence() makes what turns a text into numbers, one per place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, rows = sequence(), Combiner(earlier_only)
        for batch in small(batches):
            for text, doc, tag in zip(column(batch, "text"), numbers(batch, "d"), numbers(batch, "tag"), strict=True):
                if not text or len(text) < width:
                    continue
                x = numbered(text)
                for base in range(0, max(0, len(x) - width + 1), STRETCH):
                    h = prefix(x[base : base + STRETCH + width - 1])
                    first, count, anchor = anchors_of(h, width, gram)
                    for a, r, begin, n, geo, _ in cells(h, anchor, anchor - first - count + 1, anchor - first, width - gram + 1, cell, width):
                        yield from rows.add(a, r, np.full(len(a), doc), pack_at(base + begin, n, tag), geo)
        yield from rows.rest()

    return docs.select("d", "tag", "text").mapInArrow(cut, ELEMENTS)


def finer_rows(docs: DataFrame, wide: DataFrame, sequence: Sequence, width: int, cell: int, earlier_only: bool) -> DataFrame:
    """The elements of wide (d, at, geo), each divided into cells of a smaller width."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, rows = sequence(), Combiner(earlier_only)
        for batch in small(batches, 64):
            parts, owners = [], []
            for text, doc, tag, places in zip(column(batch, "text"), numbers(batch, "d"), numbers(batch, "tag"), places_of(batch), strict=True):
                x = numbered(text)
                for first, count, off, span in zip(*(y.tolist() for y in places), strict=True):
                    parts.append(x[first : first + count - 1 + width])
                    owners.append((doc, tag, first, count, off, span))
            if not owners:
                continue
            # All elements stand one after another; each has as many places as its windows need.
            doc, tag, first, count, off, span = np.array(owners, np.int64).T
            size = np.array([len(x) for x in parts])
            begin = np.cumsum(size) - size
            sound = np.flatnonzero(size == count + width - 1)
            point = (begin + off)[sound]
            for a, r, at, n, geo, which in cells(prefix(np.concatenate(parts)), point, (off - count + 1)[sound], off[sound], int(span.max()), cell, width):
                which = sound[which]
                yield from rows.add(a, r, doc[which], pack_at(at - begin[which] + first[which], n, tag[which]), geo)
        yield from rows.rest()

    return with_places(docs, wide, wide.count() <= SENT_PLACES).mapInArrow(cut, ELEMENTS)


class Combiner:
    """Gathers elements and gives them out combined."""

    def __init__(self, earlier_only: bool) -> None:
        self.earlier_only = earlier_only
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of key, hash of the whole, document, place and geo."""
        self.parts.append(rows)
        self.size += len(rows[0])
        if self.size > ROWS_AT_ONCE:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        """Rows, of which those that have copies here on both sides of them in order carry ~at for at: they are candidates
        whatever comes, and are dealt out evenly. So a passage that very many documents share comes to its key's task as
        two rows from each map task. With earlier_only, rows of one document alone don't make each other candidates."""
        if not self.parts:
            return
        a, r, d, at, geo = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.lexsort((d, a.view(np.uint64) ^ mix(r.view(np.uint64))))
        a, r, d, at, geo = (x[order] for x in (a, r, d, at, geo))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
        last = np.concatenate([new[1:], [True]])
        settled = ~new & ~last
        if self.earlier_only:
            settled &= (d[new] < d[last])[np.cumsum(new) - 1]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, d, np.where(settled, ~at, at), geo)], names=["a", "d", "at", "geo"])


def whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by the first column, in pieces that hold all rows of their values there."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        rows = {name: numbers(batch, name) for name in names}
        key = rows[names[0]]
        if not len(key):
            continue
        changes = np.flatnonzero(key[1:] != key[:-1])
        goes_on = bool(held) and held[-1][names[0]][-1] == key[0]
        at = int(changes[-1]) + 1 if len(changes) else 0
        if at or not goes_on:
            if held or at:
                head = held + [{name: x[:at] for name, x in rows.items()}]
                yield {name: np.concatenate([x[name] for x in head]) for name in names}
            held = []
        held.append({name: x[at:] for name, x in rows.items()})
    if held:
        yield {name: np.concatenate([x[name] for x in held]) for name in names}


def candidates(rows: DataFrame, earlier_only: bool) -> DataFrame:
    """(a, d, at, geo, hot): the elements whose key another has; with earlier_only, another document's. a is now a part of
    the key, which serves to find those of hot keys, that have more than HOT different digests.

    Rows arrive sorted and are read as a stream. Of one key there are as many as it has different elements, and two of
    each from a map task; those that are candidates already go through as they come.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in whole_groups(batches, ("a", "d", "at", "geo")):
            a, d, at = x["a"], x["d"], x["at"]
            change = np.concatenate([[True], a[1:] != a[:-1]])
            group, starts = np.cumsum(change) - 1, np.flatnonzero(change)
            size = np.diff(np.concatenate([starts, [len(a)]]))
            hot = np.zeros(len(size), bool)
            for k in np.flatnonzero(size > HOT).tolist():
                hot[k] = len(np.unique(x["geo"][starts[k] : starts[k] + size[k]] >> 2 * COUNT_BITS)) > HOT
            several = np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts) if earlier_only else size > 1
            keep = several[group] | (at < 0)
            if keep.any():
                out = ((a[keep] >> 32).astype(np.int32), d[keep], np.where(at < 0, ~at, at)[keep], x["geo"][keep].astype(np.int32), hot[group][keep])
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in out], names=["a", "d", "at", "geo", "hot"])

    settled = F.col("at") < 0
    spread = rows.repartition(F.when(settled, F.xxhash64("d", "at")).otherwise(F.col("a")))
    return spread.sortWithinPartitions("a").mapInArrow(stream, "a int, d long, at long, geo int, hot boolean")


def all_candidates(docs: DataFrame, sequence: Sequence, width: int, gram: int, widths: tuple[int, ...], earlier_only: bool) -> tuple[DataFrame, int]:
    """(d, at, geo) of the candidates of keyed docs, from tables written out, and how many they are.

    Elements of a hot key are divided into the next narrower cells and chosen again; those of the last width, 1, are single
    windows, of which a key has as many different ones as its hash has collisions.
    """
    if not 0 < gram <= width or widths[0] >= 1 << COUNT_BITS:
        raise ValueError("a gram fits in a window, and a cell has fewer than 1,024 windows")
    rows = element_rows(docs, sequence, width, gram, widths[0], earlier_only)
    chosen, size = None, 0
    for finer in (*widths[1:], None):
        known = stored(candidates(rows, earlier_only))
        released(docs.sparkSession)
        found = known
        hot = checkpointed(known.where("hot").select("a").distinct()) if finer else None
        wide = None
        if hot is not None and not hot.isEmpty():
            wide = known.join(hot, "a", "left_semi")
            found = known.join(hot, "a", "left_anti")
        found = found.select("d", "at", "geo")
        size += found.count()
        chosen = found if chosen is None else chosen.unionAll(found)
        if wide is None:
            break
        rows = finer_rows(docs, wide, sequence, width, finer, earlier_only)
    return chosen, size


def with_places(docs: DataFrame, places: DataFrame, sent: bool = False) -> DataFrame:
    """d, tag, doc_id, text, places: the distinct (at, geo) of the document's elements."""
    lists = places.groupBy("d").agg(F.collect_set(F.struct("at", "geo")).alias("x")).select("d", F.col("x").alias("places"))
    return docs.join(F.broadcast(lists) if sent else lists, "d").select("d", "tag", "doc_id", "text", "places")


def places_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """For each row: (first window, number of windows, offset of the cell's point, width of the cell) of its places that
    carry its tag."""
    ends, places = lists(batch, "places")
    first, count, tags = unpack_at(places.field(0).to_numpy(zero_copy_only=False))
    off, cell = unpack_geo(places.field(1).to_numpy(zero_copy_only=False).astype(np.int64))
    own = np.repeat(numbers(batch, "tag"), np.diff(ends))
    for a, z in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        mine = tags[a:z] == own[a:z]
        yield first[a:z][mine], count[a:z][mine], off[a:z][mine], cell[a:z][mine]


def marks_by_document(marks: DataFrame) -> DataFrame:
    """d, marks: the distinct places of a document in one row; they are no more than its windows."""
    return marks.groupBy("d").agg(F.collect_set("at").alias("marks"))


def covered(at: np.ndarray, tag: int, n: int, width: int) -> np.ndarray:
    """Which of n places lie in a window at places of that tag."""
    first, count, tags = unpack_at(at)
    first, count = first[tags == tag], count[tags == tag]
    if not len(first):
        return np.zeros(n, bool)
    edge = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(first + count - 1 + width, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:-1]) > 0


def marked(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """The list of numbers of each row; a null one is empty."""
    ends, values = lists(batch, name)
    values = values.to_numpy(zero_copy_only=False)
    return (values[a:z] for a, z in zip(ends.tolist(), ends[1:].tolist(), strict=False))


def dealt(docs: DataFrame) -> DataFrame:
    """Keyed documents dealt by d: joins by d share this one exchange, if they read the same columns of it."""
    return docs.repartition("d")
