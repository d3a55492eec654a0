"""Substring deduplication by relative Lempel-Ziv parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import column, heads, numbers, small
from tidelog.llm.minhash import WordHashes
from tidelog.llm.phrases import COUNT_BITS, TAG_BITS, all_candidates, covered, dealt, keyed, marked, places_of, unpack_at, with_places

#: Elements in one reference block, about; bytes and places that a map task gathers.
BLOCK, RUN_BYTES, RUN_PLACES = 8_000, 24 << 20, 300_000
#: What is sent of each element besides its words: document, place, bytes (none: as the one before), and where in them the
#: words stand that all its windows have.
HEAD = np.dtype([("d", "<i8"), ("at", "<i8"), ("size", "<u4"), ("begin", "<u4"), ("end", "<u4")])
COUNTS = (1 << COUNT_BITS) - 1 << TAG_BITS
FACTORS = ("d", "at", "ref", "ref_start")


def word_numbers() -> Callable[[bytes], np.ndarray]:
    hashes = WordHashes()
    return lambda text: hashes.of(text.split())


class Block:
    """An index over the words of reference pieces: every run of `width` words or more in them, as a trie whose roots are
    runs of `width` words. A node is [document, place of the run's first word, children by the next word]; pieces come in
    the order of their documents, so it is that of the smallest."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.roots: dict[tuple[bytes, ...], list] = {}

    def add(self, words: list[bytes], d: int, start: int) -> None:
        for i in range(len(words) - self.width + 1):
            node = self.roots.setdefault(tuple(words[i : i + self.width]), [d, start + i, {}])
            for word in words[i + self.width :]:
                node = node[2].setdefault(word, [d, start + i, {}])

    def factors(self, words: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(first word, end, document, its first word) of the greedy parse: at each place the longest factor that the
        block has. The next place is that of the first window which the factor cuts at its end, so that none is missed;
        a place without a factor of `width` words is passed over by one word."""
        i = 0
        while i <= len(words) - self.width:
            node = self.roots.get(tuple(words[i : i + self.width]))
            if node is None:
                i += 1
                continue
            end = i + self.width
            while end < len(words) and (longer := node[2].get(words[end])):
                node, end = longer, end + 1
            yield i, end, node[0], node[1]
            i = end - self.width + 1


def pieces(own: DataFrame, places: DataFrame, width: int, blocks: int) -> DataFrame:
    """(block, run): the words of the elements at places, dealt by those that all windows of an element have.

    Of equal ones a map task sends those of the smallest document; the others are factors, which come out as a run of
    factors, of no block (below 0).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list[tuple[int, int, int, int]]] = {}
        size = n = 0
        for batch in small(batches):
            for text, doc, tag, (first, count, off, cell) in zip(column(batch, "text"), column(batch, "doc_id"), numbers(batch, "tag").tolist(), places_of(batch), strict=True):
                if doc is None or not len(first):
                    continue
                words = text.split()
                whole = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                begins = np.concatenate([[0], ends[:-1] + 1])
                # Another text of the same id and tag may be shorter.
                first, count, off, cell = (x[first + count + width - 1 <= len(words)] for x in (first, count, off, cell))
                last, point = first + count + width - 2, first + off
                begin = begins[first]
                packed = first << COUNT_BITS + TAG_BITS | count << TAG_BITS | tag
                rows = np.stack([packed, begin, ends[last], begins[point] - begin, ends[point + width - cell] - begin], axis=1)
                for place, left, right, key, key_end in rows.tolist():
                    piece = whole[left:right]
                    if (known := found.get(piece)) is None:
                        known = found[piece] = []
                        size += right - left + 150
                    known.append((doc, place, key, key_end))
                n += len(rows)
                if size > RUN_BYTES or n > RUN_PLACES:
                    yield coded(found)
                    found, size, n = {}, 0, 0
        if found:
            yield coded(found)

    def coded(found: dict[bytes, list[tuple[int, int, int, int]]]) -> pa.RecordBatch:
        by: dict[int, tuple[list, list]] = {}
        factors: list[tuple[int, int, int, int]] = []
        for words, here in found.items():
            least, at, begin, end = min(here)
            start = at >> COUNT_BITS + TAG_BITS
            head, body = by.setdefault(xxhash.xxh3_64_intdigest(words[begin:end]) % blocks, ([], []))
            sent = len(words)
            for d, place, *_ in here:
                if d == least:
                    head.append((d, place, sent, begin, end))
                    sent = 0
                else:
                    factors.append((d, place, least, start))
            body.append(words)
        runs = [len(head).to_bytes(8, "little") + heads(head, HEAD) + b"".join(body) for head, body in by.values()]
        block = list(by)
        if factors:
            block.append(-1 - factors[0][0] % blocks)
            runs.append(np.array(factors, np.int64).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(runs, pa.binary())], names=["block", "run"])

    return with_places(own, places).mapInArrow(cut, "block long, run binary")


def unpacked(run: bytes) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(key, words, document, place) of the elements of a run."""
    n = int.from_bytes(run[:8], "little")
    at, words = 8 + HEAD.itemsize * n, b""
    for d, place, size, begin, end in np.frombuffer(run, HEAD, n, 8).tolist():
        if size:
            words = run[at : at + size]
            at += size
        yield words[begin:end], words, d, place


def factored(runs: DataFrame, width: int) -> DataFrame:
    """(d, at, ref, ref_start): factors of the elements of each block against those of smaller documents there."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in small(batches, 64):
            for here, run in zip(column(batch, "block"), column(batch, "run"), strict=True):
                if here < 0:
                    yield rows(np.frombuffer(run, np.int64).reshape(-1, 4))
                    continue
                if here != last and held:
                    yield from of_block(held)
                    held = []
                last = here
                held.append(run)
        if held:
            yield from of_block(held)

    def of_block(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        by: dict[bytes, dict[bytes, list[tuple[int, int]]]] = {}
        for run in held:
            for key, words, d, at in unpacked(run):
                by.setdefault(key, {}).setdefault(words, []).append((d, at))
        out: list[tuple[int, int, int, int]] = []
        for pieces_here in by.values():
            block = Block(width)
            least = [(*min(here), words, here) for words, here in pieces_here.items()]
            for d, together in groupby(sorted(least), lambda x: x[0]):
                split = [(at >> COUNT_BITS + TAG_BITS, words.split() if len(least) > 1 else (), here) for _, at, words, here in together]
                for start, words, here in split:
                    # Equal pieces of larger documents are one factor each; the smallest's is parsed.
                    out += [(other, at, d, start) for other, at in here if other > d]
                    if block.roots:
                        factors = [(begin, end - begin - width + 1, ref, ref_start) for begin, end, ref, ref_start in block.factors(words)]
                        for other, at in here if factors else ():
                            if other == d:
                                out += [(d, at + (begin << COUNT_BITS + TAG_BITS) & ~COUNTS | count << TAG_BITS, ref, ref_start) for begin, count, ref, ref_start in factors]
                for start, words, _ in split:
                    block.add(words, d, start)
        if out:
            yield rows(np.array(out, np.int64))

    def rows(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(y) for y in x.T], names=list(FACTORS))

    return runs.repartition("block").sortWithinPartitions("block").mapInArrow(settle, ", ".join(f"{x} long" for x in FACTORS))


def joined(at: list[int], refs: list[int], starts: list[int], tag: int, width: int) -> list[dict[str, int]]:
    """Factors of a document, those that go on in the same reference as one: start, end, ref_doc, ref_start."""
    first, count, tags = unpack_at(np.array(at, np.int64))
    out: list[dict[str, int]] = []
    rows = sorted((ref, start - a, a, a + n - 1 + width) for a, n, t, ref, start in zip(first.tolist(), count.tolist(), tags.tolist(), refs, starts, strict=True) if t == tag)
    for (ref, shift), parts in groupby(rows, lambda x: x[:2]):
        for _, _, a, z in parts:
            if out and out[-1]["ref_doc"] == ref and out[-1]["ref_start"] - out[-1]["start"] == shift and a <= out[-1]["end"]:
                out[-1]["end"] = max(z, out[-1]["end"])
            else:
                out.append({"start": a, "end": z, "ref_doc": ref, "ref_start": a + shift})
    return sorted(out, key=lambda x: (x["start"], x["end"], x["ref_doc"]))


def drop_repeats(docs: DataFrame, width: int = 13, gram: int = 5, keep_text: bool = True) -> DataFrame:
    """Remove words covered by a window of `width` words that also starts in a document with a smaller doc_id.

    Columns: doc_id, n_words, n_removed, kept_sha256; with keep_text also kept (the words left) and factors (array of
    start, end, ref_doc, ref_start: words start to end of the document are those from ref_start on of ref_doc).

    The reference of a document is all documents with smaller ids. Its blocks hold pieces of them: neighbouring windows
    around the words that content alone chooses as their anchor (see phrases), dealt by those words, so that a document
    meets only blocks that may have a factor for it. There each piece is factored greedily against an index of the pieces
    of smaller documents, by comparing words, and after a factor the windows that its end cuts are looked up next. All
    factors of `width` words or more are duplicates; those that go on in the same reference from piece to piece are
    joined. Hashes of the words only choose which pieces are sent at all.

    A null text has no words; a null doc_id is compared with nothing, and nothing is removed from it. Rows that repeat a
    doc_id don't count as smaller than each other. Fewer words than a window are never removed. An empty table gives no
    rows; other columns are ignored.
    """
    own = dealt(keyed(docs))
    some = keyed(docs.where("doc_id is not null"))
    places, size = all_candidates(some, word_numbers, width, gram, (width - gram + 1, 1), earlier_only=True)
    found = factored(pieces(own, places, width, max(1, size // BLOCK)), width)
    names = FACTORS[1:] if keep_text else FACTORS[1:2]
    lists = found.groupBy("d").agg(F.collect_set(F.struct(*names)).alias("x")).select("d", *(F.col(f"x.{name}").alias(f"{name}s") for name in names))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sizes, removed, digests, left = [], [], [], []
            for text, doc, tag, at in zip(column(batch, "text"), column(batch, "doc_id"), numbers(batch, "tag").tolist(), marked(batch, "ats"), strict=True):
                words = (text or b"").split()
                gone = covered(at if doc is not None else at[:0], tag, len(words), width)
                kept = words
                if gone.any():
                    kept = [words[k] for k in np.flatnonzero(~gone)]
                whole = b" ".join(kept)
                sizes.append(len(words))
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(whole).hexdigest())
                left.append(whole)
            arrays = [batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                rows = zip(*(column(batch, name) for name in ("doc_id", "ats", "refs", "ref_starts")), numbers(batch, "tag").tolist(), strict=True)
                factors = [joined(at, refs, starts, tag, width) if at and doc is not None else [] for doc, at, refs, starts, tag in rows]
                arrays += [pa.array(left, pa.binary()), pa.array(factors, pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "ref_doc", "ref_start")])))]
                columns += ["kept", "factors"]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary, factors array<struct<start: long, end: long, ref_doc: long, ref_start: long>>" * keep_text
    return own.join(lists, "d", "left").select("d", "tag", "doc_id", "text", *(f"{name}s" for name in names)).mapInArrow(remove, schema)
