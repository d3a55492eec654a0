"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import as_bytes, column, small, stored

#: Word bytes stay (A-Z lower-cased), all others become spaces.
TABLE = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


class WuManber:
    """Multi-pattern search over sequences of words, patterns of one length; a block is the last two words (one, for
    patterns of one word).

    Tables are arrays: SHIFT by bits of a block's hash, where blocks of the same bits share the smaller shift; patterns in
    the order of their last block's hash, and in a bucket of equal ones by the hash of the whole, so that a bucket is
    searched and not walked. What it selects is compared as bytes.
    """

    def __init__(self, m: int, texts: list[list[bytes]], items: list[int | None]):
        self.m, self.block = m, min(2, m)
        jump = min(m - self.block + 1, 255)
        self.right = 64 - max(10, (8 * sum(map(len, texts))).bit_length())
        shift = np.full(1 << 64 - self.right, jump, np.uint8)
        suffix, whole, begins, ends = [], [], [], []
        size = 0
        for words in texts:
            n = len(words)
            blocks = np.array([hashed(words, end - self.block, end) for end in range(self.block, n + 1)], np.uint64)
            last = np.arange(self.block, n + 1)
            np.minimum.at(shift, (blocks >> np.uint64(self.right)).astype(np.int64), np.minimum(np.maximum(m - last, 0), jump).astype(np.uint8))
            stops = np.cumsum([len(x) + 1 for x in words]) - 1
            starts = np.concatenate([[0], stops[:-1] + 1])
            suffix.append(blocks[m - self.block :])
            whole.append(np.array([hashed(words, at, at + m) for at in range(n - m + 1)], np.uint64))
            begins.append(size + starts[: n - m + 1])
            ends.append(size + stops[m - 1 :])
            size += int(stops[-1])
        self.shift = shift.tobytes()
        self.text = b"".join(b" ".join(x) for x in texts)
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in whole])
        suffix, whole, begins, ends = (np.concatenate(x) for x in (suffix, whole, begins, ends))
        order = np.lexsort((owner, whole, suffix))
        self.suffix, self.whole, self.begins, self.ends = suffix[order], whole[order], begins[order].astype(np.uint32), ends[order].astype(np.uint32)
        self.owner = owner[order].astype(np.uint32)
        self.items = items

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """(start, items) of all occurrences in words."""
        m, block, right, shift, end, n = self.m, self.block, self.right, self.shift, self.m, len(words)
        while end <= n:
            key = hashed(words, end - block, end)
            if step := shift[key >> right]:
                end += step
                continue
            a, z = span(self.suffix, key)
            if a < z:
                start = end - m
                window = b" ".join(words[start:end])
                i, j = span(self.whole[a:z], hashed(words, start, end))
                if same := [k for k in range(a + i, a + j) if self.text[self.begins[k] : self.ends[k]] == window]:
                    yield start, {self.items[self.owner[k]] for k in same}
            end += 1


def span(ordered: np.ndarray, value: int) -> tuple[int, int]:
    """Where equal values stand in an array in order."""
    x = np.uint64(value)
    return int(ordered.searchsorted(x)), int(ordered.searchsorted(x, "right"))


def hashed(words: list[bytes], start: int, end: int) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words[start:end]))


class Benchmark:
    """A searcher for each length of windows."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], width: int):
        by: dict[int, tuple[list, list]] = {}
        for item, text in items:
            if words := words_of(text):
                texts, owners = by.setdefault(min(len(words), width), ([], []))
                texts.append(words)
                owners.append(item)
        self.searchers = [WuManber(m, *x) for m, x in sorted(by.items())]

    def scan(self, words: list[bytes]) -> tuple[bytearray, set]:
        hit, items = bytearray(len(words)), set()
        for searcher in self.searchers:
            for start, owners in searcher.find(words):
                hit[start : start + searcher.m] = b"\1" * searcher.m
                items |= owners
        return hit, items


def blocks_of(spark: SparkSession, benchmark: DataFrame, most_bytes: int) -> list[list[tuple[int | None, bytes | None]]]:
    """The items in blocks of about most_bytes; each is bounded, so that it may travel to all executors."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), as_bytes().alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // most_bytes) or 1
    if n == 1:
        return [[(x.item_id, x.text and bytes(x.text)) for x in items.collect()]]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return ([(x.item_id, x.text and bytes(x.text)) for x in items.where(part == k).collect()] for k in range(n))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, most_bytes: int = 16 << 20) -> DataFrame:
    """Words of each document that lie in an occurrence of a window of a benchmark item.

    Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (array of ids) and spans (array of
    start, end in words). An item with fewer words than a window is one window; one without words is none.

    A benchmark of over most_bytes is searched in blocks, one pass each, with what was found carried along in a table
    written out; a block's tables take about eight times its bytes, and no more than one is alive at a time. A null text has no words; a null item_id hits words but isn't listed or counted; repeated items
    count once, repeated documents each for itself; empty tables give no rows or no hits; other columns are ignored.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"), F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<long>").alias("items"))
    schema = "doc_id long, text binary, hit binary, items array<long>"
    blocks = blocks_of(docs.sparkSession, benchmark, most_bytes)
    many = not isinstance(blocks, list)
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(block, width))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                hits, items = [], []
                for text, old_hit, old_items in zip(column(batch, "text"), column(batch, "hit"), column(batch, "items"), strict=True):
                    hit, now = shared.value.scan(words_of(text))
                    if old_hit:
                        hit = bytearray(x | y for x, y in zip(hit, old_hit, strict=True))
                    hits.append(bytes(hit))
                    items.append(sorted({*now, *(old_items or ())} - {None}))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1) if many else pa.nulls(len(hits), pa.binary()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "text", "hit", "items"])

        found = found.mapInArrow(search, schema)
        if many:
            found = stored(found)
            shared.destroy()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, items = column(batch, "hit"), column(batch, "items")
            listed = [sorted(map(str, x)) for x in items]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in hits], pa.int64()),
                    pa.array([x.count(1) for x in hits], pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed], pa.string()),
                    pa.array([1 in x for x in hits], pa.bool_()),
                    pa.array(items, pa.list_(pa.int64())),
                    pa.array([[{"start": a, "end": b} for a, b in runs(x)] for x in hits], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
            )

    return found.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>, spans array<struct<start: long, end: long>>")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, most_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text has no occurrence of a window of a benchmark item.

    A benchmark of over most_bytes is searched in blocks, one pass each, over what is left in a table written out; nothing
    is shuffled. A null text has no occurrence; a null item_id counts as any other; repeated rows and items, and columns of
    any name, make no difference; an empty table gives no rows, an empty benchmark all.
    """
    blocks = blocks_of(docs.sparkSession, benchmark, most_bytes)
    many = not isinstance(blocks, list)
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(block, width))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([1 not in shared.value.scan(words_of(x))[0] for x in texts], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
        if many:
            docs = stored(docs)
            shared.destroy()
    return docs


def runs(hit: bytes) -> list[tuple[int, int]]:
    out, at = [], hit.find(1)
    while at >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        out.append((at, end))
        at = hit.find(1, end)
    return out
