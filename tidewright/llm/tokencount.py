"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

Pre-tokens are runs of what isn't ASCII white space, each with the model's word mark before it. A task inserts the distinct pre-tokens of its rows in a
trie and computes the best score and the token count of the best segmentation of a prefix once, at the node that all pre-tokens with that prefix share.
The counts at the ends of pre-tokens are what texts add up. A trie that has reached NODES nodes or WORD_BYTES of whole words is dropped and begun anew, and
only the first SHARED characters of a pre-token go into it: from there on the scores of the last characters are carried along without nodes. So memory is
bounded for any text; counts don't depend on it.

Scores: the vocabulary's order is taken for a frequency order, and log p = -log(rank + 1) (no model is trained). Of segmentations of equal score that
of the fewest tokens counts. A character that no piece covers costs what a piece of rank 2 * |vocabulary| costs, and is one token.

Defined cases: null and empty texts have 0 pre-tokens and 0 tokens. Every row has its own result.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of
from .textsets import tidy

NODES, WORD_BYTES, SHARED, MARK = 600_000, 32 << 20, 256, "▁"


def pieces(path: str) -> dict[str, float]:
    """The ordinary pieces of a SentencePiece model with log p by their order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -math.log(k + 2) for k, i in enumerate(plain)}


class Trie:
    """Nodes in flat lists: the children of each, and the best score and count of its prefix."""

    def __init__(self, scores: dict[str, float], limit: int = NODES) -> None:
        self.scores, self.limit = scores, limit
        self.longest = max(map(len, scores), default=1)
        self.missing = -math.log(2 * len(scores) + 2)
        self.starts = {p[:k] for p in scores for k in range(1, len(p) + 1)}
        self.ends = {p[-k:] for p in scores for k in range(1, len(p) + 1)}  # suffixes of pieces: a longer one that isn't among them ends the search
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = array("d", [0.0]), array("q", [0])
        self.known: dict[bytes, int] = {}
        self.held = 0

    def remember(self, word: bytes, n: int) -> None:
        if len(word) <= SHARED:
            self.held += 120 + len(word)
            if self.held > WORD_BYTES:
                self.known.clear()
                self.held = 0
            self.known[word] = n

    def _step(self, word: str, k: int, scores: array, counts: array, base: int) -> tuple[float, int]:
        """The best score and count of word[: k + 1]; scores and counts hold those of the prefixes from length base on."""
        best, fewest = scores[k - base] + self.missing, counts[k - base] + 1
        for j in range(k, max(-1, k - self.longest), -1):
            part = word[j : k + 1]
            if part not in self.ends:
                break
            s = self.scores.get(part)
            if s is not None:
                s += scores[j - base]
                n = counts[j - base] + 1
                if s > best + 1e-9 or s > best - 1e-9 and n < fewest:
                    best, fewest = max(best, s) if abs(s - best) <= 1e-9 else s, n
        return best, fewest

    def tokens(self, word: str) -> int:
        """How many tokens the best segmentation of word has."""
        if len(self.score) > self.limit:
            self.clear()
        child, score, count = self.child, self.score, self.count
        node, scores, counts = 0, array("d", [0.0]), array("q", [0])
        for k, c in enumerate(word[:SHARED]):
            step = child.get((node, c))
            if step is None:
                best, fewest = self._step(word, k, scores, counts, 0)
                step = len(score)
                child[node, c] = step
                score.append(best)
                count.append(fewest)
            node = step
            scores.append(score[node])
            counts.append(count[node])
        base = 0
        for k in range(SHARED, len(word)):
            best, fewest = self._step(word, k, scores, counts, base)
            scores.append(best)
            counts.append(fewest)
            if len(scores) > 4 * self.longest + SHARED:
                gone = len(scores) - self.longest - 1
                base += gone
                del scores[:gone], counts[:gone]
        return counts[-1]


@cache
def trie(path: str) -> Trie:
    return Trie(pieces(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens and n_tokens for every row of docs."""
    small_batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie(path)
        for part in parts:
            words, tokens = [], []
            for text in part.column(1).to_pylist():
                split = text.split()
                count, known = own.tokens, own.known
                total = 0
                for raw in split:
                    n = known.get(raw)
                    if n is None:
                        n = count(MARK + raw.decode("utf-8", "replace"))
                        own.remember(raw, n)
                    total += n
                words.append(len(split))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
