"""Token counts under a unigram model by dynamic programming over a shared trie."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import as_bytes, column, small

#: Trie nodes and distinct pre-tokens that a worker keeps; then it starts afresh.
NODES, REMEMBERED = 500_000, 500_000
WORD_START = "▁"
#: Pre-tokens with more characters don't enter the trie.
LONG = 200
#: Scores are whole numbers of 2**-20 nats, so that sums are exact and ties are ties.
UNIT = 1 << 20


def unigram_scores(path: str, offset: float = 2.7) -> dict[str, int]:
    """Log-probabilities of the public vocabulary's pieces by the Zipf-Mandelbrot law on their rank; nothing is trained.

    Byte pieces <0x00> .. <0xFF> stand for characters that no piece covers.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]
    total = math.log(sum(1 / (rank + offset) for rank in range(len(pieces))))
    return {piece: round((-math.log(rank + offset) - total) * UNIT) for rank, piece in enumerate(pieces)}


class Trie:
    """Distinct pre-tokens; each node holds the best (score, tokens) of its prefix, computed once from its ancestors."""

    def __init__(self, scores: dict[str, int]):
        marks = [f"<0x{x:02X}>" for x in range(256)]
        self.fallback = [scores.get(x, -30 * UNIT) for x in marks]
        self.scores = scores = {piece: score for piece, score in scores.items() if piece not in set(marks)}
        self.longest = max(map(len, scores), default=1)
        # Endings of pieces: a score if the ending is itself a piece, else None. A string that isn't among them, nor
        # any longer one with that end, is no piece.
        self.endings: dict[str, int | None] = {piece[k:]: None for piece in scores for k in range(1, len(piece))} | scores
        self.terminal: dict[bytes, int] = {}
        self.reset()

    def reset(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.score = [0]
        self.tokens = [0]

    def counts(self, words: list[bytes]) -> int:
        """Tokens of all the words; those not seen before enter the trie in sorted order."""
        known = self.terminal
        if len(known) > REMEMBERED:
            known.clear()
        for new in sorted({x for x in words if x not in known}):
            if len(self.score) > NODES:
                self.reset()
            known[new] = self.count(WORD_START + new.decode("utf-8", "replace"))
        return sum(map(known.__getitem__, words))

    def count(self, word: str) -> int:
        """Tokens of the best segmentation: highest score, then fewest tokens."""
        if len(word) > LONG:
            return self.count_apart(word)
        node, path, children = 0, [0], self.children
        score, tokens, endings = self.score, self.tokens, self.endings
        for end, char in enumerate(word, 1):
            step = (node, char)
            before = node
            node = children.get(step, 0)
            if not node:
                node = children[step] = len(score)
                best = fewest = None
                for start in range(end - 1, -1, -1):
                    s = endings.get(word[start:end], -1)
                    if s == -1:
                        break
                    if s is not None:
                        s += score[path[start]]
                        if best is None or s > best or s == best and tokens[path[start]] + 1 < fewest:
                            best, fewest = s, tokens[path[start]] + 1
                # A character that is no piece may go as its bytes.
                if endings.get(char) is None:
                    raw = char.encode("utf-8", "surrogatepass")
                    s = score[before] + sum(map(self.fallback.__getitem__, raw))
                    if best is None or s > best or s == best and tokens[before] + len(raw) < fewest:
                        best, fewest = s, tokens[before] + len(raw)
                score.append(best)
                tokens.append(fewest)
            path.append(node)
        return tokens[node]

    def count_apart(self, word: str) -> int:
        """The same for a very long pre-token, which is hardly ever repeated: without nodes."""
        score, tokens = [0], [0]
        for end, char in enumerate(word, 1):
            ways = [(s + score[start], -tokens[start] - 1) for start in range(max(0, end - self.longest), end) if (s := self.scores.get(word[start:end])) is not None]
            if self.scores.get(char) is None:
                raw = char.encode("utf-8", "surrogatepass")
                ways.append((score[-1] + sum(map(self.fallback.__getitem__, raw)), -tokens[-1] - len(raw)))
            best, fewest = max(ways)
            score.append(best)
            tokens.append(-fewest)
        return tokens[-1]


@cache
def trie_of(path: str) -> Trie:
    """One trie for each Python worker, whatever the number of its tasks."""
    return Trie(unigram_scores(path))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Pre-tokens and unigram tokens of each whole text: doc_id, n_pretokens, n_tokens.

    A pre-token is a run of characters other than the ASCII white space, led by the vocabulary's word mark. The public
    vocabulary has ranks but no probabilities, and none are trained here, so pieces have those of the Zipf-Mandelbrot law on
    their ranks: counts are those of the best segmentation under that model, not those of the vocabulary's own tokenizer.
    A pre-token of more than LONG characters has the same sums without a place in the trie.

    A null or blank text has none of either. A null doc_id stays null, repeated rows are counted each for itself, an empty
    table gives no rows, other columns are ignored. The vocabulary's file is read on every worker; nothing is shuffled.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(vocabulary)
        for batch in small(batches):
            n_words, n_tokens = [], []
            for text in column(batch, "text"):
                words = (text or b"").split()
                n_words.append(len(words))
                n_tokens.append(trie.counts(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")).mapInArrow(counts, "doc_id long, n_pretokens long, n_tokens long")
