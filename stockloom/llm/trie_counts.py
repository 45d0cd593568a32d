"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A unigram segmentation of a pre-token is the split into vocabulary pieces of the largest
total score.  Its forward scores at a prefix depend on that prefix alone, so the distinct
pre-tokens share a trie: every node holds the best score of its prefix and the number of
pieces that reach it, computed once for all words that begin alike.  The node where a
pre-token ends has its count; a text's count is the sum over its pre-tokens.

Pre-tokens are the stretches between spaces, each with the word mark in front.  A character
without a piece costs one token per UTF-8 byte (byte fallback).  Equal scores take fewer
tokens.  Scores come with the vocabulary; ``zipf_scores`` makes log-probabilities from ranks.

Null and empty texts count 0.  Whole texts are counted.  A trie is emptied when it reaches
``NODES`` nodes, and a pre-token of more than ``LONG`` characters (text without spaces) shares no
prefixes: the same recurrence runs over a window of scores as long as the longest piece.  Both
bound a worker's memory and change no result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import map_slices, texts

MARK = "▁"
NODES = 300_000
LONG = 2_000
#: Score of one fallback byte, below every piece.
BYTE_SCORE = -20.0


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log-probabilities by Zipf's law from the order of the pieces."""
    total = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
    return {p: -math.log(i + 1) - total for i, p in enumerate(pieces)}


def piece_scores(model_path: str) -> dict[str, float]:
    """Ordinary pieces of a SentencePiece file, most likely first, with Zipf scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    return zipf_scores([model.id_to_piece(i) for i in ids])


class Trie:
    """Prefixes of the pre-tokens seen so far, each with its forward score and count."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=0)
        self.suffixes = {p[i:] for p in scores for i in range(len(p))}
        self.words: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.words.clear()
        self.next: list[dict[str, int]] = [{}]
        self.best, self.count = [0.0], [0]

    def count_of(self, word: str) -> int:
        """Tokens of a pre-token."""
        if len(word) > LONG:
            return self._rolled(word)
        found = self.words.get(word)
        if found is None:
            if len(self.best) >= NODES:
                self.clear()
            found = self.words[word] = self._insert(word)
        return found

    def _rolled(self, word: str) -> int:
        """Tokens of a long pre-token: scores of the last ``longest`` prefixes only."""
        scores, suffixes, keep = self.scores, self.suffixes, self.longest + 1
        best, count = [0.0] * keep, [0] * keep
        for i, symbol in enumerate(word):
            size, before = len(symbol.encode()), i % keep
            top, least = best[before] + size * BYTE_SCORE, count[before] + size
            start = i
            while start >= 0 and i - start < self.longest:
                piece = word[start:i + 1]
                if piece not in suffixes:
                    break
                score = scores.get(piece)
                if score is not None:
                    at = start % keep
                    total, tokens = best[at] + score, count[at] + 1
                    if total > top or total == top and tokens < least:
                        top, least = total, tokens
                start -= 1
            best[(i + 1) % keep], count[(i + 1) % keep] = top, least
        return count[len(word) % keep]

    def _insert(self, word: str) -> int:
        following, best, count, scores, suffixes = self.next, self.best, self.count, self.scores, self.suffixes
        node, path = 0, [0]
        for i, symbol in enumerate(word):
            below = following[node].get(symbol)
            if below is None:
                size = len(symbol.encode())
                top, least = best[node] + size * BYTE_SCORE, count[node] + size
                start = i
                while start >= 0 and i - start < self.longest:
                    piece = word[start:i + 1]
                    if piece not in suffixes:
                        break
                    score = scores.get(piece)
                    if score is not None:
                        at = path[start]
                        total, tokens = best[at] + score, count[at] + 1
                        if total > top or total == top and tokens < least:
                            top, least = total, tokens
                    start -= 1
                below = following[node][symbol] = len(best)
                following.append({})
                best.append(top)
                count.append(least)
            node = below
            path.append(node)
        return count[node]


_tries: dict[str, Trie] = {}


def trie(model_path: str) -> Trie:
    if model_path not in _tries:
        _tries[model_path] = Trie(piece_scores(model_path))
    return _tries[model_path]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words (pre-tokens), n_tokens; no shuffle."""

    def task(batch):
        own = trie(model_path)
        words, tokens = [], []
        for text in texts(batch):
            parts = [w for w in text.split(" ") if w]
            known, missing = own.words.get, own.count_of
            words.append(len(parts))
            tokens.append(sum([known(w) or missing(w) for w in [MARK + p for p in parts]]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(plain, task, "doc_id long, n_words long, n_tokens long")


def op5_trie_counts(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
