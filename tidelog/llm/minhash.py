"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import as_bytes, checkpointed, column, dropped, lists, mix, numbers, powers, released, small

LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
#: Places of the circulant permutation, a power of two.
PLACES = 1 << 21
#: Candidates of one key in a block, and deviations below the threshold at which signatures rule out a link.
BLOCK_ROWS, SLACK = 2048, 4.7
#: Doc ids are sent to every executor only up to this many; beyond it they are joined by a shuffle.
SENT_IDS = 1_000_000
#: Read by nothing any more, as keys of all sizes are treated alike; tests set them to see that results don't change.
HOT_QUERIES, ORDER_SHARE = 8192, 32


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        x = self[word] = xxhash.xxh3_64_intdigest(word)
        return x

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes | None, hashes: WordHashes, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; all words as one shingle if they are fewer than width."""
    words = hashes.of((text or b"").translate(LOWER).split())
    if not len(words):
        return words
    n = min(width, len(words))
    weights = mix(powers(0x2545F4914F6CDD1D, width + 1)[1:] + np.uint64(n)) | np.uint64(1)
    out = words[: len(words) - n + 1] * weights[0]
    for k in range(1, n):
        out += words[k : len(words) - n + 1 + k] * weights[k]
    return np.unique(mix(out))


@cache
def permutation(seed: int, rows: int) -> np.ndarray:
    """The second permutation, its beginning repeated after its end; entry [i] of the view is its part of `rows` places from i."""
    p = np.random.default_rng(seed).permutation(PLACES).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[: rows - 1]]), rows)


def signature(found: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """All coordinates of a non-empty set: coordinate k is the least value of the second permutation, shifted by k
    places, at the places to which the first permutation (a bijective mixer) sends the elements."""
    shifted = permutation(seed, rows)
    places = (mix(found ^ np.uint64(seed)) >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)
    out = np.full(rows, PLACES, np.uint32)
    for at in range(0, len(places), 2048):
        np.minimum(out, shifted[places[at : at + 2048]].min(axis=0), out=out)
    return out


def band_keys(signed: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    rows = signed.astype(np.uint64).reshape(bands, per_band)
    weights = mix(powers(0x9E3779B97F4A7C15, per_band + 1)[1:]) | np.uint64(1)
    return mix((rows * weights).sum(axis=1, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int, per_band: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, a digest of the set in two numbers, the keys of its bands and the last byte of each coordinate
    of its signature (none for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small(batches):
            sizes, digests, keys, marks = [], [], [], []
            for text in column(batch, "text"):
                found = shingles(text, hashes, width)
                sizes.append(len(found))
                digests.append(np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64))
                marks.append(None)
                if len(found):
                    signed = signature(found, bands * per_band, seed)
                    keys.append(band_keys(signed, bands, per_band))
                    marks[-1] = signed.astype(np.uint8).tobytes()
            some = np.array(sizes, np.int64) > 0
            offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            digest = np.stack(digests) if digests else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(marks, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "marks"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")).mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, marks binary")


def set_rows(docs: DataFrame, ids: DataFrame, most: int, width: int) -> DataFrame:
    """(doc_id, members): the full sets of the documents in ids, of which there are at most `most`, as bytes; with the label,
    if ids have one."""
    labelled = "label" in ids.columns
    ids = F.broadcast(ids) if most <= SENT_IDS else ids

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small(batches):
            found = pa.array([shingles(x, hashes, width).tobytes() for x in column(batch, "text")], pa.binary())
            names = ["doc_id", "members"] + ["label"] * labelled
            yield pa.RecordBatch.from_arrays([batch.column(0), found] + [batch.column(batch.schema.get_field_index("label"))] * labelled, names=names)

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")).join(ids, "doc_id", "inner" if labelled else "left_semi")
    return joined.mapInArrow(sets, "doc_id long, members binary" + ", label long" * labelled)


def prefixes(docs: DataFrame, ids: DataFrame, most: int, width: int, percent: int, alone: bool = True) -> DataFrame:
    """(doc_id, label, n_shingles, shingle, rest, short): of each document in ids the shingles of which any link to
    another label has one in common, written out; where ids have no label, each document is one.

    Two sets with 100 * intersection >= percent * union share a shingle among the first of each, in any order that both
    follow: so many are the first that the others are fewer than the intersection needs. short tells those that are enough
    for the smaller set of a link, so that of two documents that share a shingle one has it short. The order begins with
    the shingles that no other label has (left out if not alone, as they are in no link); those that several have follow,
    rare ones first. rest is the number of a set's shingles from this one on: two sets of which this is the first in common
    have no more in common than the smaller rest of the two.
    """
    if "label" not in ids.columns:
        ids = ids.select("doc_id", F.col("doc_id").cast("long").alias("label"))
    # Rows that repeat a doc_id have sets of their own.
    sets = checkpointed(set_rows(docs, ids, most, width).withColumn("own", F.monotonically_increasing_id()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 64):
            members = column(batch, "members")
            sizes = [len(x) // 8 for x in members]
            of = [pa.array(np.repeat(numbers(batch, name), sizes)) for name in ("own", "label")]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(members), np.int64)), *of], names=["shingle", "own", "label"])

    every = sets.select("own", "label", "members").mapInArrow(each, "shingle long, own long, label long")
    # Written first, so that the join is a plain shuffle of both sides (see near_duplicates).
    counted = every.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"))
    common = checkpointed(counted.where("least < most").select("shingle", "n"))
    listed = every.select("shingle", "own").join(common, "shingle").groupBy("own").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("common"))
    listed = listed.select("own", F.col("common.shingle").alias("common"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 64):
            ends, values = lists(batch, "common")
            values = values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            for k, (doc_id, label, members) in enumerate(zip(numbers(batch, "doc_id").tolist(), numbers(batch, "label").tolist(), column(batch, "members"), strict=True)):
                found, met = np.frombuffer(members, np.int64), values[ends[k] : ends[k + 1]]
                n, begin = len(found), 0 if alone else len(found) - len(met)
                long, short = (n + (-percent * x // y) + 1 for x, y in ((n, 100), (2 * n, 100 + percent)))
                taken = np.concatenate([np.setdiff1d(found, met), met])[begin:long]
                at = begin + np.arange(len(taken))
                arrays = [np.full(len(taken), doc_id), np.full(len(taken), label), np.full(len(taken), n), taken, n - at, at < short]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["doc_id", "label", "n_shingles", "shingle", "rest", "short"])

    rows = sets.select("own", "doc_id", "label", "members").join(listed, "own", "left")
    out = checkpointed(rows.mapInArrow(first, "doc_id long, label long, n_shingles long, shingle long, rest long, short boolean"))
    dropped(sets, common)
    return out


def confirmed(edges: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of edges (a, b), those whose full sets meet 100 * intersection >= percent * union."""
    members = set_rows(docs, edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), 2 * edges.count(), width)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [similar(x, y, percent) for x, y in zip(column(batch, "x"), column(batch, "y"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    pairs = edges.join(members.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a").join(members.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, by least labels of neighbours and label doubling.

    Each round's labels go to the shared checkpoint folder; stars of copies need two or three rounds.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label").union(labels)
        least = near.groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        nxt = least.join(up, "label", "left").select("node", F.least("label", "higher").alias("label"))
        nxt = checkpointed(nxt)
        moved = nxt.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        dropped(labels, *(() if moved else (both,)))
        labels = nxt
        if not moved:
            return labels


def across_classes(placed: DataFrame, signed: DataFrame, docs: DataFrame, width: int, percent: int, rows: int) -> DataFrame:
    """Links (a, b) between documents of different classes; placed has key, doc_id and label, signed doc_id and marks.

    All documents of keys that hold several classes, however many, meet by the shingles of which any link between classes
    has one in common (prefixes). In each such shingle the documents outside its largest class are queries against all that
    have it, in blocks of BLOCK_ROWS; what shares a shingle is compared whole, whatever its size.
    Within a task signatures are compared by matrix operations; a pair counts only if the shingles from this one on are
    enough for a link, and the signatures agree in as many places as SLACK deviations below the threshold.
    A first pass tells which documents have such pairs at all; their full sets then go to the same blocks, where pairs are
    confirmed, the likeliest first, until the two classes are one. So what is put out grows with the documents, not with
    their pairs.
    """
    mixed = placed.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key")
    mixed = checkpointed(mixed)
    wide = checkpointed(placed.join(mixed, "key", "left_semi").select("doc_id", "label").distinct())
    firsts = prefixes(docs, wide, wide.count(), width, percent, alone=False)
    left = firsts.withColumnRenamed("shingle", "key")
    sizes = left.groupBy("key", "label").agg(F.count("*").alias("n"), F.max("short").alias("short"))
    several = sizes.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n").alias("total"), F.max(F.struct("n", "label")).alias("main"), F.max("short").alias("short"))
    several = checkpointed(several.where("classes > 1 and short").select("key", F.col("main.label").alias("main"), F.ceil(F.col("total") / BLOCK_ROWS).cast("long").alias("parts")))
    left = left.join(several, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    # Role 0: only a candidate; 1: only a query, in the blocks of others, after all candidates there; 2: both.
    names = ["key", "block", "role", "doc_id", "label", "n_shingles", "rest"]
    at_home = left.withColumn("block", F.col("own")).withColumn("role", F.when(F.col("label") == F.col("main"), 0).otherwise(2))
    away = left.where("label <> main and parts > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("block <> own").withColumn("role", F.lit(1))
    members = checkpointed(at_home.select(names).unionAll(away.select(names)))
    dropped(mixed, wide, firsts, several)
    p = percent / 100
    needed = int(rows * (p + (1 - p) / 256) - SLACK * (rows * p * (1 - p)) ** 0.5)

    def spread(df: DataFrame) -> DataFrame:
        return df.repartition("key", "block").sortWithinPartitions("key", "block", F.col("role") == 1)

    def who(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block, q, i, c, j, _ in alike(batches, percent, needed, ()):
            ids = np.unique(np.concatenate([q["doc_id"][i], c["doc_id"][j]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key)), pa.array(np.full(len(ids), block)), pa.array(ids)], names=["key", "block", "doc_id"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, joined = None, {}
        for key, block, q, i, c, j, agree in alike(batches, percent, needed, ("members",)):
            if at != (key, block):
                at, joined = (key, block), {}
            found = []
            for k in np.argsort(-agree, kind="stable").tolist():
                x, y = root(joined, int(q["label"][i[k]])), root(joined, int(c["label"][j[k]]))
                if x != y and similar(q["members"][i[k]], c["members"][j[k]], percent):
                    joined[max(x, y)] = min(x, y)
                    found.append(sorted((int(q["doc_id"][i[k]]), int(c["doc_id"][j[k]]))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    released(docs.sparkSession)
    wanted = checkpointed(spread(members.join(signed, "doc_id")).mapInArrow(who, "key long, block long, doc_id long").distinct())
    ids = wanted.select("doc_id").distinct()
    full = set_rows(docs, ids, wanted.count(), width)
    again = members.join(wanted, ["key", "block", "doc_id"]).join(signed, "doc_id").join(full, "doc_id")
    links = checkpointed(spread(again).mapInArrow(confirm, "a long, b long").distinct())
    dropped(members, wanted)
    return links


def root(joined: dict[int, int], x: int) -> int:
    while x in joined:
        x = joined[x]
    return x


def similar(x: bytes, y: bytes, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets of distinct numbers."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def alike(batches: Iterator[pa.RecordBatch], percent: int, needed: int, more: tuple[str, ...]) -> Iterator[tuple]:
    """(key, block, queries, places in them, candidates, places in them, agreeing coordinates) of pairs of different
    classes whose signatures agree enough, from rows sorted by key and block, queries from other blocks last."""
    kept: dict[str, np.ndarray] | None = None
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x = {name: numbers(batch, name) for name in ("key", "block", "role", "doc_id", "label", "n_shingles", "rest")}
        x["marks"] = np.frombuffer(b"".join(column(batch, "marks")), np.uint8).reshape(n, -1)
        for name in more:
            x[name] = np.array(column(batch, name) + [None], object)[:-1]
        starts = np.concatenate([[0], np.flatnonzero((x["key"][1:] != x["key"][:-1]) | (x["block"][1:] != x["block"][:-1])) + 1, [n]])
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            rows = {name: y[i:j] for name, y in x.items()}
            at = (int(rows["key"][0]), int(rows["block"][0]))
            new = {name: y[rows["role"] != 1] for name, y in rows.items()}
            if last == at:
                # Candidates that came before meet the queries that come now, and the other way round.
                candidates = {name: np.concatenate([kept[name], y]) for name, y in new.items()}
                groups = [(rows, candidates), (kept, new)]
            else:
                candidates = new
                groups = [(rows, candidates)]
            for queries, others in groups:
                asking = {name: y[queries["role"] != 0] for name, y in queries.items()}
                for q, a, b, agree in agreeing(asking, others, percent, needed):
                    yield *at, q, a, others, b, agree
            last, kept = at, candidates


def agreeing(queries: dict[str, np.ndarray], c: dict[str, np.ndarray], percent: int, needed: int) -> Iterator[tuple]:
    for at in range(0, len(queries["doc_id"]), 64):
        q = {name: x[at : at + 64] for name, x in queries.items()}
        able = q["label"][:, None] != c["label"][None]
        # Of two queries that are candidates for each other, the smaller asks.
        able &= (q["doc_id"][:, None] < c["doc_id"][None]) | (c["role"][None] == 0) | (q["role"][:, None] == 1)
        able &= 100 * np.minimum(q["n_shingles"][:, None], c["n_shingles"][None]) >= percent * np.maximum(q["n_shingles"][:, None], c["n_shingles"][None])
        able &= (100 + percent) * np.minimum(q["rest"][:, None], c["rest"][None]) >= percent * (q["n_shingles"][:, None] + c["n_shingles"][None])
        x, y = np.nonzero(able)
        for k in range(0, len(x), 20_000):
            i, j = x[k : k + 20_000], y[k : k + 20_000]
            agree = (q["marks"][i] == c["marks"][j]).sum(axis=1)
            enough = agree >= needed
            if enough.any():
                yield q, i[enough], j[enough], agree[enough]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, bands: int = 48, per_band: int = 5, seed: int = 12) -> DataFrame:
    """Classes of near-duplicate documents: doc_id, n_shingles, component_id, kept; one row per row of docs.

    Documents are linked if 100 * intersection >= percent * union of their sets of word shingles; a class is what links
    connect, and its smallest doc_id stays. Documents of equal sets are one candidate. Candidates that share a band key
    are compared with the key's smallest document; where keys still hold several classes after that, their documents of
    different classes are compared with each other. So a link is lost only if no band of the two agrees: with 48 bands
    of 5, two in a million at a similarity of exactly 0.75, fewer above; the comparison of classes leaves out pairs whose
    signatures lie SLACK deviations below the threshold, which has odds of about the same size. Keys of all sizes are
    treated alike.

    A text without words, or null, has an empty set and is linked with nothing. A null doc_id is linked with nothing,
    has no component_id and is kept. Rows that repeat a doc_id count as one document, linked by any set of that id. An
    empty table gives no rows; other columns are ignored.
    """
    signed = checkpointed(signatures(docs, width, bands, per_band, seed))
    some = signed.where("n_shingles > 0 and doc_id is not null")
    # Tables of what repeats are written first: joins with them are then plain shuffles of both sides, whose large
    # partitions adaptive execution splits, so a set or key that very many documents have doesn't end in one task.
    copies = checkpointed(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "rep"))
    every = some.join(copies, ["d1", "d2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    member = checkpointed(every.select("doc_id", "rep"))
    keyed = every.where("doc_id = rep").select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    # Only keys that several sets share go on: few, as unrelated texts share none.
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key", "least")
    shared = checkpointed(shared)
    released(docs.sparkSession)
    together = checkpointed(keyed.join(shared, "key"))
    dropped(shared, copies)
    first = checkpointed(together.where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct())
    links = checkpointed(confirmed(first, docs, width, percent))
    dropped(first)
    released(docs.sparkSession)
    labels = components(links)
    placed = together.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    more = across_classes(placed, some.select("doc_id", "marks"), docs, width, percent, bands * per_band)
    dropped(together)
    released(docs.sparkSession)
    # Documents of equal sets go with the smallest of them; an id with several sets joins their classes.
    spread = member.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    several = checkpointed(member.join(spread.where("rep < last").select("doc_id", F.col("rep").alias("a")), "doc_id").where("a < rep").select("a", F.col("rep").alias("b")).distinct())
    added = more.union(several)
    joined = labels if added.isEmpty() else components(links.union(added))
    dropped(links, more, several)
    found = spread.select("doc_id", "rep").join(joined.select(F.col("node").alias("rep"), "label"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
