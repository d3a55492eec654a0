"""Packing by power-of-two decomposition of token counts."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import as_bytes, column, small

#: Words whose ids a worker remembers; then it starts afresh.
REMEMBERED = 350_000
#: Stems that are encoded as one string.
JOINED = 100


#: ASCII punctuation that follows a Latin letter and ends a word; the apostrophe, which may begin an ending, and the
#: less-than sign, which may begin a special token, aren't in it.
MARKS = r"[!-&(-/:;=-@\[-^`{-~]"
MARKED = re.compile(rf"{MARKS}(?<=[a-z\u00df-\u00f6\u00f8-\u024f]{MARKS}){MARKS}*(?=[ \n]|\Z)")
#: Letters for which lower case isn't the same everywhere, and more; such texts stay as they are.
EXOTIC = re.compile("[\u0250-\U0010ffff]")


# What a vocabulary's file must say for texts to be encoded word by word, and its words of letters together.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def simpler(text: str) -> str:
    """A text of the same ids that has fewer distinct words: in lower case, as the tokenizer makes it, and with
    punctuation after words apart from them, as the tokenizer cuts it."""
    if "<|" in text or not text.isascii() and EXOTIC.search(text):
        return text
    return MARKED.sub(r" \g<0>", text.lower())


class WordEncoder:
    """Ids of whole texts by way of their distinct space-separated words, if the vocabulary's file is as BY_WORDS says;
    texts go to the tokenizer whole if not.

    Such a vocabulary drops white space and never merges across it, so a text's ids are its words' ids in order. Only the
    space and the line feed divide words here; all else is left to the tokenizer. A word of Latin letters is one
    pre-token; many such are encoded as one string, in which a token that ends a word ends a pre-token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit
        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.by_words = all(told[name] == x for name, x in BY_WORDS.items()) and told["model"]["end_of_word_suffix"] == "</w>"
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        known = self.known
        plain = [x for x in words if x.isalpha() and x.islower() and not EXOTIC.search(x)] if self.ends.any() else []
        got = self.tokenizer.encode_batch_fast([" ".join(plain[k : k + JOINED]) for k in range(0, len(plain), JOINED)], add_special_tokens=False)
        flat = np.concatenate([np.array(x.ids, "<u4") for x in got]) if got else np.zeros(0, "<u4")
        stops = (4 * np.flatnonzero(self.ends[flat]) + 4).tolist()
        if len(stops) != len(plain):
            raise ValueError("the vocabulary doesn't keep words of letters whole")
        raw = flat.tobytes()
        known.update(zip(plain, map(raw.__getitem__, map(slice, [0, *stops], stops)), strict=True))
        other = list(words.difference(plain))
        for word, x in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            known[word] = np.array(x.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian. Texts come in small groups, so that new words are encoded together."""
        if not self.by_words:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        words = [simpler(x).replace("\n", " ").split(" ") for x in texts]
        if new := set(chain.from_iterable(words)).difference(known):
            self.learn(new)
        return [b"".join(map(known.__getitem__, x)) for x in words]


@cache
def encoder_of(path: str) -> WordEncoder:
    """One encoder for each Python worker, whatever the number of its tasks."""
    return WordEncoder(path)


def binary_pieces(n: int, largest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: as many of the largest power as fit, then the binary digits of the rest."""
    out = [(at, largest) for at in range(0, n - n % largest, largest)]
    at, bit = n - n % largest, largest >> 1
    while bit:
        if n & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def encoded(encoder: WordEncoder, docs: list, texts: list[bytes | None], group: int = 64) -> Iterator[tuple[int | None, bytes]]:
    for k in range(0, len(docs), group):
        yield from zip(docs[k : k + group], encoder.encode([(x or b"").decode("utf-8", "replace") for x in texts[k : k + group]]), strict=True)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, largest: int = 4096, keep_ids: bool = True) -> DataFrame:
    """Cut each document's ids (and end_id) into pieces of a power-of-two length; equal lengths form a bucket.

    Each piece is a sequence of its own, so that no sequence crosses documents and none needs padding. Columns:
    doc_id, start, length, bucket (log2 of the length), ids (if kept), ids_crc32, doc_tokens, sequence_id, offset (0).
    Batches are drawn from one bucket at a time: write with partitionBy("bucket").

    A null text counts as empty and gives the single piece [end_id]; a null doc_id stays null; repeated rows are packed
    each for itself; an empty table gives no rows; other columns are ignored. The longest text must fit in a worker.
    Nothing is shuffled: sequence_id is unique and depends only on the place of a row in its partition, so pack a table
    that is read from files, not the result of a shuffle, whose order may change when a partition is computed again.
    """
    if largest & (largest - 1) or largest < 1:
        raise ValueError("largest must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(vocabulary), np.uint32(end_id).astype("<u4").tobytes()
        for batch in small(batches):
            rows: list[tuple] = []
            size = 0
            for doc, found in encoded(encoder, column(batch, "doc_id"), column(batch, "text")):
                raw = found + end
                total = len(raw) // 4
                for start, n in binary_pieces(total, largest):
                    piece = raw[4 * start : 4 * (start + n)]
                    rows.append((doc, start, n, n.bit_length() - 1, piece if keep_ids else None, zlib.crc32(piece), total))
                size += total
                if size > 1_000_000:
                    yield table_of(rows)
                    rows, size = [], 0
            if rows:
                yield table_of(rows)

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        doc, start, n, bucket, ids, crc, total = zip(*rows, strict=True)
        arrays = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(bucket, pa.int32())]
        names = ["doc_id", "start", "length", "bucket"]
        if keep_ids:
            arrays.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays([*arrays, pa.array(crc, pa.int64()), pa.array(total, pa.int64())], names=[*names, "ids_crc32", "doc_tokens"])

    schema = "doc_id long, start long, length long, bucket int, " + "ids array<int>, " * keep_ids + "ids_crc32 long, doc_tokens long"
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")).mapInArrow(pieces, schema)
    return cut.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
