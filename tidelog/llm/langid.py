"""Language identification with a string kernel, Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import as_bytes, column, mix, small

UNKNOWN = "und"
#: Characters are read in stretches of so many, so that memory doesn't follow a text's length.
STRETCH = 1 << 20
#: Texts whose kernel rows are computed in one matrix product.
BATCH = 64
#: A text is like those learned if the share of its letters' n-grams that the model knows is at least LIKE times that which
#: all but LEAST_LIKE of held-out labelled rows reach.
LIKE, LEAST_LIKE = 0.8, 0.01
#: Classes of characters that a model tells apart, so that its tables have ALPHABET**3 places at most. If the landmarks
#: have more characters, those that tell languages apart have a class each; the others share the last SHARED by a hash.
ALPHABET, SHARED = 200, 80


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of 1 to 3 characters, as numbers (21 bits a character, which is one more than its code point)."""
    out = [np.zeros(0, np.int64)]
    for at in range(0, max(len(text), 1), STRETCH):
        x = characters(text[at : at + STRETCH + 2]) + 1
        out.append(np.unique(np.concatenate([x, x[:-1] << 21 | x[1:], x[:-2] << 42 | x[1:-1] << 21 | x[2:]])))
    return np.unique(np.concatenate(out))


@functools.cache
def letter_table() -> np.ndarray:
    """Whether a character, as its code point and one, is a letter."""
    return np.array([False, *(chr(x).isalpha() for x in range(0x110000))])


def lettered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where 1, 2 and 3 letters follow one another, of the STRETCH places that a stretch counts."""
    one = letter_table()[x]
    two = one[:-1] & one[1:]
    return one[:STRETCH], two[:STRETCH], two[:-1] & one[2:]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of letters alone in a text and how often each occurs."""
    codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, max(len(text), 1), STRETCH):
        x = characters(text[at : at + STRETCH + 2]) + 1
        parts = x[:STRETCH], (x[:-1] << 21 | x[1:])[:STRETCH], x[:-2] << 42 | x[1:-1] << 21 | x[2:]
        found, n = np.unique(np.concatenate([part[where] for part, where in zip(parts, lettered(x), strict=True)]), return_counts=True)
        codes.append(found)
        counts.append(n)
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def classes(letters: np.ndarray) -> np.ndarray:
    """The class of each character, as its code point and one, of those given, the most telling first; 0 for all others."""
    out = np.zeros(0x110001, np.int32)
    alone = letters if len(letters) <= ALPHABET else letters[: ALPHABET - SHARED]
    out[alone] = np.arange(1, len(alone) + 1)
    other = letters[len(alone) :]
    out[other] = ALPHABET - SHARED + 1 + (mix(other.astype(np.uint64)) % np.uint64(SHARED)).astype(np.int32)
    return out


def classed(codes: np.ndarray, lookup: np.ndarray) -> np.ndarray:
    """n-grams of characters as n-grams of their classes; -1 where a character has none."""
    out, sound = np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
    for k in range(3):
        x = codes >> (21 * k) & 0x1FFFFF
        out |= lookup[x].astype(np.int64) << (21 * k)
        sound &= (x == 0) | (lookup[x] > 0)
    return np.where(sound, out, -1)


@dataclass
class Model:
    """Landmarks' n-grams, the presence of each in each landmark over the root of the landmark's size, and dual weights.

    letters are the landmarks' characters, the most telling first; n-grams are those of their classes. A text of whose
    n-grams a smaller share than least is known is unlike all that was learned.
    """

    langs: list[str]
    vocabulary: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    letters: np.ndarray
    least: float = 0.0

    def prepare(self) -> None:
        self.lookup = classes(self.letters)
        self.alphabet = {x for x in (chr(code - 1) for code in self.letters.tolist()) if x.isalpha()}
        self.size = min(len(self.letters), ALPHABET) + 1
        n = np.arange(len(self.vocabulary), dtype=np.int32)
        self.tables = []
        for order, (low, high) in enumerate(((0, 1 << 21), (1 << 21, 1 << 42), (1 << 42, 1 << 63)), 1):
            t = np.full(self.size**order, len(self.vocabulary), np.int32)
            here = (self.vocabulary >= low) & (self.vocabulary < high)
            code = np.zeros(here.sum(), np.int64)
            for k in reversed(range(order)):
                code = code * self.size + (self.vocabulary[here] >> (21 * k) & 0x1FFFFF)
            t[code] = n[here]
            self.tables.append(t)

    def presence(self, texts: list[str]) -> np.ndarray:
        """One row per text: 1 where an n-gram of the vocabulary occurs. The last place, for all others, is cut off."""
        out = np.zeros((len(texts), len(self.vocabulary) + 1), np.float32)
        k = self.size
        for row, text in zip(out, texts, strict=True):
            for at in range(0, max(len(text), 1), STRETCH):
                x = self.lookup[characters(text[at : at + STRETCH + 2]) + 1].astype(np.int64)
                two = x[:-1] * k + x[1:]
                row[self.tables[0][x]] = 1
                row[self.tables[1][two]] = 1
                row[self.tables[2][two[:-1] * k + x[2:]]] = 1
        return out[:, :-1]

    def known(self, text: str) -> float:
        """The share of the n-grams of letters alone in a text, each as often as it occurs, that the vocabulary has."""
        k, some, total = self.size, 0, 0
        for at in range(0, max(len(text), 1), STRETCH):
            points = characters(text[at : at + STRETCH + 2]) + 1
            x = self.lookup[points].astype(np.int64)
            two = x[:-1] * k + x[1:]
            for table, codes, where in zip(self.tables, (x[:STRETCH], two[:STRETCH], two[:-1] * k + x[2:]), lettered(points), strict=True):
                some += int((table[codes[where]] < len(self.vocabulary)).sum())
                total += int(where.sum())
        return some / max(total, 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The classes' scores, as two matrix products by way of kernel rows against all landmarks. The kernel is that of the
        n-grams in the vocabulary, those of the landmarks: the inner product of two texts' presence of them, over the roots
        of how many each has."""
        x = self.presence(texts)
        size = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return (x @ self.landmarks / size) @ self.weights


def fit(docs: DataFrame, n_train: int = 1200, n_landmarks: int = 128, ridge: float = 1e-3) -> Model:
    """Learn from a bounded sample: about n_train rows, the same number from each language (all of a rarer one).

    docs has doc_id (for the choice of rows only), text and lang. Only the sampled rows' distinct n-grams reach the driver.
    """
    labelled = docs.where("doc_id is not null and lang is not null and text is not null")
    counts = {x["lang"]: x["n"] for x in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.int64))
    langs = sorted(counts)
    each = max(1, n_train // len(langs))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.element_at(F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1 << 30, -(-(each << 30) // counts[lang]))))), F.col("lang"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for draw, lang, text in zip(column(batch, "draw"), column(batch, "lang"), column(batch, "text"), strict=True):
                whole = text.decode("utf-8", "replace")
                found = (pa.array([x.tobytes()], pa.binary()) for x in (grams(whole), *counted(whole)))
                yield pa.RecordBatch.from_arrays([pa.array([draw], pa.int64()), pa.array([lang], pa.string()), *found], names=["draw", "lang", "grams", "words", "counts"])

    rows = labelled.where(draw < share).select(draw.alias("draw"), "lang", as_bytes().alias("text")).mapInArrow(reduce, "draw long, lang string, grams binary, words binary, counts binary").collect()
    rows.sort(key=lambda x: (x["draw"], x["lang"]))
    order: dict[str, int] = {}
    place = []
    for x in rows:
        place.append(order.setdefault(x["lang"], 0))
        order[x["lang"]] += 1
    chosen = sorted(range(len(rows)), key=lambda k: (place[k], rows[k]["lang"], k))[:n_landmarks]
    codes = [np.frombuffer(x["grams"], np.int64) for x in rows]
    single, n = np.unique(np.concatenate([codes[k][codes[k] < 1 << 21] for k in chosen]), return_counts=True)
    # First those that tell a language from the others, in turn for each language.
    share = np.zeros((len(langs), len(single)))
    for code, row in zip(codes, rows, strict=True):
        share[langs.index(row["lang"])] += np.isin(single, code) / order[row["lang"]]
    ranks = np.argsort(np.argsort(share.mean(axis=0) - share, axis=1, kind="stable"), axis=1, kind="stable")
    letters = single[np.lexsort((-n, ranks.min(axis=0)))]
    lookup = classes(letters)
    codes = [np.unique(x[x >= 0]) for x in (classed(code, lookup) for code in codes)]
    vocabulary, found = np.unique(np.concatenate([codes[k] for k in chosen]), return_counts=True)
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    shares = np.zeros(len(rows))
    held = np.isin(np.arange(len(rows)), chosen, invert=True)
    place_of = lambda code: np.minimum(np.searchsorted(vocabulary, code), len(vocabulary) - 1)
    for k, (row, code) in enumerate(zip(x, codes, strict=True)):
        at = place_of(code)
        row[at[vocabulary[at] == code]] = 1
        # What a landmark alone brought into the vocabulary doesn't count for it: it is held out from the others.
        code, n = classed(np.frombuffer(rows[k]["words"], np.int64), lookup), np.frombuffer(rows[k]["counts"], np.int64)
        at = place_of(code)
        shares[k] = n[(vocabulary[at] == code) & (held[k] | (found[at] > 1))].sum() / max(n.sum(), 1)
    some = np.array([len(x["counts"]) > 0 for x in rows])
    least = LIKE * float(np.quantile(shares[some], LEAST_LIKE, method="lower")) if some.any() else 0.0
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    landmarks = np.ascontiguousarray(x[chosen].T)
    kernel = (x @ landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    keep = values > 1e-8 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    targets = np.where(np.array([x["lang"] for x in rows])[:, None] == np.array(langs)[None], 1.0, -1.0)
    # Each language weighs the same, however many rows it has.
    weight = np.array([1 / order[x["lang"]] for x in rows])[:, None]
    solved = np.linalg.solve(features.T @ (weight * features) + ridge * np.eye(features.shape[1]), features.T @ (weight * targets))
    return Model(langs, vocabulary, landmarks, (root @ solved).astype(np.float32), letters, least)


def identify(docs: DataFrame, train: DataFrame, keep: list[str] | None = None, n_train: int = 1200, n_landmarks: int = 128, ridge: float = 1e-3, like: bool = False) -> DataFrame:
    """The columns of docs (those in keep, if given) with lang_pred and score (0 to 1), predicted from the whole text alone.

    The class with the largest regression value wins, the first by name on ties; the score carries that value from
    -1..1 to 0..1. A text that is null or has no letter gets `und` and 0, as all do if no labelled row could be learned
    from. Rows without a label, text or id aren't learned from. Repeated rows are predicted each for itself; other
    columns pass through, but for those named lang_pred or score, which are replaced. Nothing of docs is shuffled.

    The score tells languages apart, not texts from what is none; but one of whose letters the model knows none has 0 (and
    the class that wins by its other n-grams, or by name). If like, a column
    of that name (replaced, too) says whether enough of the n-grams of its letters are known: a share of at least LIKE times
    that which all but LEAST_LIKE of the labelled rows reach when held out. A few words can reach it by chance.
    """
    model = fit(train, n_train, n_landmarks, ridge)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["lang_pred", "score", *(["like"] if like else [])]
    names = [x for x in keep or docs.columns if x not in added]

    def predict(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model.langs and not hasattr(model, "tables"):
            model.prepare()
        for batch in small(texts):
            row = batch.column(0)
            whole = (row.field(names.index("text")).cast(pa.binary()) if "text" in names else batch.column(1)).to_pylist()
            preds, scores, alike = [UNKNOWN] * len(whole), np.zeros(len(whole)), [False] * len(whole)
            for at in range(0, len(whole), BATCH) if model.langs else ():
                part = [(x or b"").decode("utf-8", "replace") for x in whole[at : at + BATCH]]
                some = [k for k, x in enumerate(part) if any(map(str.isalpha, x))]
                if not some:
                    continue
                values = model.scores([part[k] for k in some])
                best = values.argmax(axis=1)
                for k, b, value in zip(some, best, values.max(axis=1), strict=True):
                    preds[at + k] = model.langs[b]
                    if not model.alphabet.isdisjoint(part[k].lower()):
                        scores[at + k] = min(1.0, max(0.0, (float(value) + 1) / 2))
                        alike[at + k] = like and model.known(part[k]) >= model.least
            yield pa.RecordBatch.from_arrays([row, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(alike, pa.bool_())][: 1 + len(added)], names=["_row", *added])

    carried = docs.select(F.struct(*(F.col(f"`{x}`") for x in names)).alias("_row"), *([] if "text" in names else [as_bytes().alias("text")]))
    types = T.StructType([carried.schema["_row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("like", T.BooleanType())] if like else [])])
    return carried.mapInArrow(predict, types).select("_row.*", *added)
