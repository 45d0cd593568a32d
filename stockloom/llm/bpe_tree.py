"""Byte-level BPE as a monoid: halves are encoded recursively and neighbours joined.

An encoding of a byte string is right when every pair of neighbouring tokens is itself the
encoding of the pair's bytes (``pair``).  So two encodings are joined by re-encoding a
window around the boundary and testing the two pairs at its rims; while a rim is unstable
the window doubles on that side.  Once both rims are stable, no token outside can change.

The same holds one level up.  No match of the pre-token pattern crosses from non-space to
space, so a text is cut into stretches at those places whatever stands around them.  Of two
cut halves only the last stretch of the left and the first of the right can change; they
are cut again as one window.

Leaves are ``LEAF`` code points of text.  Inside a pre-token the halves are memoised, because
most long words are made of known halves; a string of at most ``BASE`` bytes is merged rank
by rank.  Decoding concatenates up the tree.

Null and empty texts give no tokens and the digests of the empty string.  Whole texts are
encoded, whatever their length.  Special tokens are ordinary text.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import map_slices, texts

LEAF = 2048
BASE = 4
#: From this length on, merging uses a heap.
HEAP = 64
NONE = 1 << 62
#: Entries of a memo table before it is emptied; a memory bound, results do not depend on it.
MEMO = 250_000
#: The characters with the Unicode property White_Space.
SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Stretches: no match of the pattern crosses from non-space to space, so a stretch starts at such a place.
STRETCH = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
#: Marks that form a match of their own after letters at the end of a stretch.
ENDS = frozenset(".,;:!?)")


class TreeCodec:
    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], tuple[int, ...] | None] = {}
        self.chunks: dict[str, tuple[tuple[int, ...], str]] = {}

    # --- bytes of one pre-token -------------------------------------------------------

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Merge the lowest-ranked, leftmost neighbours until none can merge."""
        ranks = self.ranks
        if data in ranks:
            return (ranks[data],)
        if len(data) > HEAP:
            return self._merged_by_heap(data)
        parts = [data[i:i + 1] for i in range(len(data))]
        costs = [ranks.get(data[i:i + 2], NONE) for i in range(len(data) - 1)]
        while costs and (best := min(costs)) != NONE:
            at = costs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = ranks.get(parts[at - 1] + parts[at], NONE)
            if at < len(costs):
                costs[at] = ranks.get(parts[at] + parts[at + 1], NONE)
        return tuple([ranks[p] for p in parts])

    def _merged_by_heap(self, data: bytes) -> tuple[int, ...]:
        """The same for long strings: neighbours in a heap by rank and place, over a linked list of spans."""
        ranks, n = self.ranks, len(data)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n

        def offer(i: int) -> None:
            if after[i] < n and (r := ranks.get(data[i:end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or end[after[i]] != stop:
                continue
            gone = after[i]
            alive[gone], end[i], after[i] = False, stop, after[gone]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return tuple(ranks[data[i:end[i]]] for i in range(n) if alive[i])

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        found = self.pieces.get(data)
        if found is not None:
            return found
        if data in self.ranks:
            found = (self.ranks[data],)
        elif len(data) <= BASE:
            found = self.merged(data)
        else:
            half = len(data) // 2
            found = self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))
        if len(data) <= 2 * BASE:
            if len(self.pieces) >= MEMO:
                self.pieces.clear()
            self.pieces[data] = found
        return found

    def pair(self, a: int, b: int) -> tuple[int, ...] | None:
        """None when two tokens are stable side by side, else the encoding of their bytes."""
        try:
            return self.pairs[a, b]
        except KeyError:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            found = self.merged(self.tokens[a] + self.tokens[b])
            self.pairs[a, b] = found = None if found == (a, b) else found
            return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The monoid's product of two encodings."""
        if not left or not right:
            return left or right
        window = self.pair(left[-1], right[0])
        if window is None:
            return left + right
        i = j = 1
        while True:
            left_rim = i == len(left) or self.pair(left[-i - 1], window[0]) is None
            right_rim = j == len(right) or self.pair(window[-1], right[j]) is None
            if left_rim and right_rim:
                return left[:-i] + window + right[j:]
            i = i if left_rim else min(len(left), 2 * i)
            j = j if right_rim else min(len(right), 2 * j)
            window = self.merged(self.decode(left[-i:]) + self.decode(right[:j]))

    # --- text -------------------------------------------------------------------------

    def chunk(self, text: str) -> tuple[tuple[int, ...], str]:
        """Ids of a stretch that starts at a match start, and the ids as text."""
        word = text[1:] if text[:1] == " " else text
        if word.isalpha():
            ids = self.encode_piece(text.encode())
        elif word[-1:] in ENDS and word[:-1].isalpha():
            ids = self.encode_piece(text[:-1].encode()) + self.encode_piece(text[-1:].encode())
        else:
            ids = ()
            for piece in self.pattern.findall(text):
                ids += self.encode_piece(piece.encode())
        found = ids, ",".join(map(str, ids))
        if len(text) <= 64:
            if len(self.chunks) >= MEMO:
                self.chunks.clear()
            self.chunks[text] = found
        return found

    def join_text(self, left: list[str], right: list[str]) -> list[str]:
        """The product of two cut texts: the stretches that meet are cut again as one window.

        A stretch starts where space follows non-space, so only the last stretch of the
        left half and the first of the right half can change.
        """
        if not left or not right:
            return left or right
        return left[:-1] + STRETCH(left[-1] + right[0]) + right[1:]

    def cut(self, text: str, start: int, end: int) -> list[str]:
        if end - start <= LEAF:
            return STRETCH(text[start:end])
        half = (start + end) // 2
        return self.join_text(self.cut(text, start, half), self.cut(text, half, end))

    def encode(self, text: str) -> list[int]:
        return self.encode_with_text(text)[0]

    def encode_with_text(self, text: str) -> tuple[list[int], str]:
        """Ids, and the decimal ids joined by commas."""
        known = self.chunks.get
        found = [known(part) or self.chunk(part) for part in self.cut(text, 0, len(text))]
        return list(chain.from_iterable([x[0] for x in found])), ",".join([x[1] for x in found])

    def decode(self, ids) -> bytes:
        """Concatenation is the product of decodings, so any tree gives the same bytes."""
        return b"".join([self.tokens[x] for x in ids])


_codecs: dict[tuple[str, str], TreeCodec] = {}


def codec(ranks_path: str, pattern: str) -> TreeCodec:
    key = ranks_path, pattern
    if key not in _codecs:
        _codecs[key] = TreeCodec(*key)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, ids (optional), n_tokens, ids_sha256, decoded_sha256; no shuffle."""

    def task(batch):
        coder = codec(ranks_path, pattern)
        all_ids, counts, hashes, back = [], [], [], []
        for text in texts(batch):
            ids, said = coder.encode_with_text(text)
            counts.append(len(ids))
            hashes.append(hashlib.sha256(said.encode()).hexdigest())
            back.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            if with_ids:
                all_ids.append(ids)
        columns = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
        if with_ids:
            columns["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(plain, task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_ids(rows: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes; a null list decodes to nothing."""

    def task(batches):
        coder = codec(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(task, "doc_id long, data binary")


def op8_bpe_tree(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
