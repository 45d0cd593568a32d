"""Secret scan: fixed patterns, and a linear-chain conditional random field beside them.

Tokens are stretches of letters, digits and ``+/_.-``.  The field tags each as O (outside),
B (begins a secret) or I (inside one).  Features: the token's shape (length, mix of letters
and digits, changes between them, hex only), keywords among the two words before it, what
stands between it and its neighbours (``=`` or ``:``, quotes), the shape of the next token, and of
the file the share of tokens that follow ``=`` or ``:`` and the share of digits.

Training: at most ``SAMPLE`` documents, those with the smallest hash of the id; tokens inside spans
of the fixed patterns are the positive ones.  Their windows, windows around other tokens with
digits, and lines made from ``SEED_LINES`` so that a corpus without any secret also trains,
are fitted by stochastic gradient steps on the conditional likelihood.  A window with a long
mixed token that no pattern covers is left out: its tag is not known.  In training the
keyword is at times hidden, so that shape and surroundings also count.

Decoding is exact Viterbi.  Where O leads by more than twice the spread of the transition
weights, O is on every best path (changing one tag changes two transitions), so a text falls
into short islands between such tokens; emissions are computed in arrays.

Spans of the field that overlap no base span are added as kind ``crf``.  Null and empty texts
have no spans.  Whole texts are scanned; a document of any length counts once.  Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import LOWER_TABLE, map_slices, runs, saved, span_hashes, utf8
from stockloom.llm.middle_cuts import MultibyteIndex

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("key", "token", "secret", "password", "passwd", "pwd", "passphrase", "apikey", "api_key", "auth", "authorization", "bearer", "credential", "credentials", "access", "access_key",
            "private", "private_key", "login", "signature", "client_secret", "access_token", "secret_key")
SEED_LINES = (
    'password = "{}"', "passwd: {}", "api_key={}", "secret_key = '{}'", "Authorization: Bearer {}", "export ACCESS_TOKEN={}", "client secret {} expires soon", "aws key {} in region one",
)
PLAIN_LINES = (
    "the order 12345678 was sent on 2024-01-31", "call +49-30-1234567 or write to info.desk", "see section 4.2.1 and page 117", "version = 1.2.3", "the address is 192.168.0.1",
    "the password was changed and the token is lost", "name: Miller", "card 4111111111111111 is a test number",
    "file report-2024q1v2-final3.pdf is ready", "part B08N5WRWNW in stock", "see https://example.com/a1b2/c3d4e5/page7.html today",
)

SAMPLE = 4000
WINDOWS = 3000
EPOCHS = 12
RATE = 0.3
DECAY = 1e-4
_HEX = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x66 for b in range(256)])
_TOKEN = np.array([chr(b).isalnum() and b < 0x80 or chr(b) in "+/_.-" or b >= 0x80 for b in range(256)])
_DIGIT, _UPPER, _HIGH = (np.array([f(b) for b in range(256)]) for f in (lambda b: 0x30 <= b <= 0x39, lambda b: 65 <= b <= 90, lambda b: b >= 0x80))
_LETTER = np.array([65 <= (b & 0xDF) <= 90 and b < 0x80 for b in range(256)])
_HEXLIKE = np.array([chr(b) in "0123456789abcdefABCDEF" for b in range(256)])
#: Values of each feature: shape, keyword before, separator before, separator after, next shape, file.
SIZES = (6 * 7 * 3, 4, 6, 2, 7, 6)
OFFSETS = np.cumsum([0, *SIZES[:-1]])
N_FEATURES = sum(SIZES)
_key_hashes: list[np.ndarray] = []


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, start and end of the secret itself) of the fixed patterns except hex, in code points."""
    out = []
    low = raw.translate(LOWER_TABLE)
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def features(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (tokens x kinds), byte starts and ends of the tokens, and each row's first token."""
    starts, ends = runs(_TOKEN[data], rows)
    n = len(starts)
    firsts = np.searchsorted(starts, rows)
    if not n:
        return np.zeros((0, len(SIZES)), np.int64), starts, ends, firsts
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(firsts))
    length = ends - starts
    digits, uppers, letters, high, hexes = (_sums(t[data], starts, ends) for t in (_DIGIT, _UPPER, _LETTER, _HIGH, _HEXLIKE))
    change = np.zeros(len(data), bool)
    change[1:] = _DIGIT[data[1:]] != _DIGIT[data[:-1]]
    switches = _sums(change, np.minimum(starts + 1, ends), ends)
    sizes = np.searchsorted(np.array([4, 8, 16, 24, 40]), length, "right")
    mixed = (digits > 0) & (letters > 0)
    kind = np.select(
        [high > 0, mixed & (switches > 4), mixed & (switches > 2), mixed, digits > 0, (uppers > 1) & (uppers < length)], [6, 5, 4, 3, 2, 1], 0)
    odd = np.select([(hexes == length) & mixed, length > letters + digits + high], [2, 1], 0)
    shape = (sizes * 7 + kind) * 3 + odd

    low = np.frombuffer(LOWER_TABLE, np.uint8)[data]
    if not _key_hashes:
        joined, at = np.frombuffer("".join(KEYWORDS).encode(), np.uint8), np.cumsum([0, *map(len, KEYWORDS)])
        _key_hashes.append(np.sort(span_hashes(joined, at[:-1], at[1:])))
    keys, hashes = _key_hashes[0], span_hashes(low, starts, ends)
    is_key = keys[np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)] == hashes

    def behind(values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, values.dtype)
        out[by:] = np.where(row_of[by:] == row_of[:-by], values[:-by], 0)
        return out

    keyword = behind(is_key, 1) + 2 * behind(is_key, 2)
    marks, quotes = (np.isin(data, np.frombuffer(m, np.uint8)) for m in (b"=:", b"\"'"))
    gap_from = np.concatenate([[0], ends[:-1]])
    gap_from = np.where(np.concatenate([[-1], row_of[:-1]]) == row_of, gap_from, rows[row_of])
    equals, quoted = _sums(marks, gap_from, starts) > 0, _sums(quotes, gap_from, starts) > 0
    line = _sums(data == 10, gap_from, starts) > 0
    before = np.where(line, 4 + quoted, equals * 2 + quoted)
    after = np.zeros(n, np.int64)
    after[:-1] = np.where(row_of[1:] == row_of[:-1], equals[1:] | quoted[1:], 0)
    following = np.zeros(n, np.int64)
    following[:-1] = np.where(row_of[1:] == row_of[:-1], kind[1:], 0)
    per_row = np.maximum(np.diff(firsts), 1)
    settings = np.searchsorted(np.array([0.005, 0.05]), np.add.reduceat(np.append(equals, False).astype(float), firsts[:-1])[: len(per_row)] * (np.diff(firsts) > 0) / per_row)
    numeric = (np.add.reduceat(np.append(digits, 0), firsts[:-1])[: len(per_row)] * (np.diff(firsts) > 0) / per_row) > 0.3
    file = (settings + 3 * numeric)[row_of]
    return np.stack([shape, keyword, before, after, following, file], axis=1) + OFFSETS, starts, ends, firsts


class Field:
    """Weights of the features and of the transitions between O, B and I."""

    def __init__(self):
        self.weights = np.zeros((N_FEATURES, 3))
        self.moves = np.zeros((3, 3))

    def emissions(self, numbers: np.ndarray) -> np.ndarray:
        out = self.weights[numbers[:, 0]].copy()
        for k in range(1, numbers.shape[1]):
            out += self.weights[numbers[:, k]]
        return out

    def marginals(self, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag marginals and summed pair marginals, by forward and backward sums scaled at each token."""
        e = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        m, n = np.exp(self.moves), len(e)
        forward, backward = np.empty((n, 3)), np.ones((n, 3))
        forward[0] = e[0] / e[0].sum()
        for t in range(1, n):
            forward[t] = (forward[t - 1] @ m) * e[t]
            forward[t] /= forward[t].sum()
        for t in range(n - 2, -1, -1):
            backward[t] = m @ (e[t + 1] * backward[t + 1])
            backward[t] /= backward[t].sum()
        tags = forward * backward
        tags /= tags.sum(axis=1, keepdims=True)
        pairs = forward[:-1, :, None] * m[None] * (e[1:] * backward[1:])[:, None, :]
        pairs /= pairs.sum(axis=(1, 2), keepdims=True)
        return tags, pairs.sum(axis=0)

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """AdaGrad ascent on the conditional log-likelihood."""
        seen_w, seen_m = np.full(self.weights.shape, 1e-6), np.full((3, 3), 1e-6)
        rng = np.random.default_rng(3)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(sequences)):
                numbers, tags = sequences[i]
                if rng.random() < 0.3:  # hide the keyword
                    numbers = numbers.copy()
                    numbers[:, 1] = OFFSETS[1]
                expected, pairs = self.marginals(self.emissions(numbers))
                error = -expected
                error[np.arange(len(tags)), tags] += 1
                slope = -DECAY * self.weights
                for k in range(numbers.shape[1]):
                    np.add.at(slope, numbers[:, k], error)
                step = -pairs - DECAY * self.moves
                np.add.at(step, (tags[:-1], tags[1:]), 1)
                seen_w += slope**2
                seen_m += step**2
                self.weights += RATE * slope / np.sqrt(seen_w)
                self.moves += RATE * step / np.sqrt(seen_m)

    def best_path(self, emissions: np.ndarray) -> list[int]:
        """Viterbi over one stretch that has O, or an end of the text, on both sides."""
        score, back = emissions[0].copy(), []
        for e in emissions[1:]:
            total = score[:, None] + self.moves
            back.append(total.argmax(axis=0))
            score = total.max(axis=0) + e
        tag = int(score.argmax())
        path = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            path.append(tag)
        return path[::-1]

    def tagged(self, numbers: np.ndarray, row_of: np.ndarray) -> list[tuple[int, int]]:
        """Token ranges (first, behind the last) of the secrets on the best path of every row."""
        if not len(numbers):
            return []
        emissions = self.emissions(numbers)
        spread = 2 * (self.moves.max() - self.moves.min())
        sure = emissions[:, 0] - emissions[:, 1:].max(axis=1) > spread
        out, n, i = [], len(sure), 0
        unsure = np.flatnonzero(~sure)
        for at in unsure.tolist():
            if at < i:
                continue
            i = at
            while i < n and not sure[i] and row_of[i] == row_of[at]:
                i += 1
            first = at - 1 if at and row_of[at - 1] == row_of[at] else at
            last = i + 1 if i < n and row_of[i] == row_of[at] else i
            e = emissions[first:last].copy()
            if first < at:
                e[0, 1:] = -1e18
            if last > i:
                e[-1, 1:] = -1e18
            start = -1
            for place, tag in enumerate([*self.best_path(e), 0], first):
                if tag != 2 and start >= 0:
                    out.append((start, place))
                    start = -1
                if tag == 1 or tag == 2 and start < 0:
                    start = place
        return out


def _tags(starts: np.ndarray, ends: np.ndarray, secrets: list[tuple[int, int]]) -> np.ndarray:
    """B and I for tokens inside byte spans."""
    tags = np.zeros(len(starts), np.int64)
    for a, b in secrets:
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b))
        if j > i:
            tags[i], tags[i + 1:j] = 1, 2
    return tags


def _hex_runs(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = runs(_HEX[data], rows)
    long = ends - starts >= HEX_LEAST
    return starts[long], ends[long]


def _seed() -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(11)
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(12):
        for line in SEED_LINES:
            letters = alphabets[(k + len(line)) % 3]
            secret = "".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(16, 44))))
            at = line.index("{")
            data, rows = np.frombuffer(line.format(secret).encode(), np.uint8), np.array([0, len(line) - 2 + len(secret)])
            numbers, starts, ends, _ = features(data, rows)
            out.append((numbers, _tags(starts, ends, [(at, at + len(secret))])))
        for line in PLAIN_LINES:
            numbers, starts, _, _ = features(np.frombuffer(line.encode(), np.uint8), np.array([0, len(line)]))
            out.append((numbers, np.zeros(len(starts), np.int64)))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on windows of the sampled documents."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = plain.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def task(batch):
        data, rows = utf8(batch)
        numbers, starts, ends, firsts = features(data, rows)
        hex_a, hex_b = _hex_runs(data, rows)
        index = MultibyteIndex(data)
        kept = []
        for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            raw, i, j = data[rows[k]:rows[k + 1]].tobytes(), int(firsts[k]), int(firsts[k + 1])
            found = base_spans(text or "", raw)
            first = int(index.chars(rows[k]))
            secrets = list(zip(*(index.bytes(first + np.array([s[c] for s in found], np.int64)).tolist() for c in (3, 4))))
            inside = slice(*np.searchsorted(hex_a, rows[k:k + 2]))
            tags = _tags(starts[i:j], ends[i:j], secrets + list(zip(hex_a[inside].tolist(), hex_b[inside].tolist())))
            shapes = (numbers[i:j, 0] // 3) % 7
            unknown = (tags == 0) & ((shapes == 4) | (shapes == 5)) & (numbers[i:j, 0] // 21 >= 3)
            centres = np.flatnonzero(tags == 1).tolist() + np.flatnonzero((tags == 0) & (shapes > 1) & (shapes < 6))[:4].tolist() + ([(j - i) // 2] if j > i else [])
            for c in centres:
                a, b = max(0, c - 10), min(j - i, c + 11)
                if unknown[a:b].any():
                    continue
                kept.append((doc, int(tags[c] == 1), numbers[i + a:i + b].astype(np.int32).tobytes(), tags[a:b].astype(np.int8).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["doc_id", "hit", "numbers", "tags"])

    # at most SAMPLE ids, so the broadcast is bounded; windows of each kind are bounded too
    windows = saved(map_slices(plain.join(F.broadcast(ids), "doc_id").select("doc_id", "text"), task, "doc_id long, hit int, numbers binary, tags binary"))
    order = [F.xxhash64("doc_id", "numbers"), "doc_id", "numbers", "tags"]
    rows = [r for hit in (1, 0) for r in windows.filter(F.col("hit") == hit).orderBy(*order).limit(WINDOWS // (2 - hit) // 2).toArrow().to_pylist()]
    field = Field()
    field.fit(_seed() + [(np.frombuffer(r["numbers"], np.int32).reshape(-1, len(SIZES)).astype(np.int64), np.frombuffer(r["tags"], np.int8).astype(np.int64)) for r in rows])
    return field


def _said(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts per kind, base_sha256, spans; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def task(batch):
        data, rows = utf8(batch)
        numbers, starts, ends, firsts = features(data, rows)
        row_of = np.repeat(np.arange(len(rows) - 1), np.diff(firsts))
        whole, bounds, all_texts = data.tobytes(), rows.tolist(), batch.column(1).to_pylist()
        base: dict[int, list] = {}
        for k, text in enumerate(all_texts):
            if text and (found := base_spans(text, whole[bounds[k]:bounds[k + 1]])):
                base[k] = [s[:3] for s in found]

        index = MultibyteIndex(data)

        def points(k: np.ndarray, a: np.ndarray, b: np.ndarray):
            """Code-point offsets of byte spans inside their rows."""
            origin = index.chars(rows[k])
            return zip(k.tolist(), (index.chars(a) - origin).tolist(), (index.chars(b) - origin).tolist())

        hex_a, hex_b = _hex_runs(data, rows)
        for k, first, last in points(np.searchsorted(rows, hex_a, "right") - 1, hex_a, hex_b):
            base.setdefault(k, []).append((first, 2, last))
        # of the base spans that start before a point, how far the farthest reaches
        reach = {k: (sorted(s[0] for s in spans), np.maximum.accumulate([e for _, e in sorted((s[0], s[2]) for s in spans)]).tolist()) for k, spans in base.items()}
        tagged = np.array(shared.value.tagged(numbers, row_of), np.int64).reshape(-1, 2)
        added: dict[int, list] = {}
        for k, first, last in points(row_of[tagged[:, 0]], starts[tagged[:, 0]], ends[tagged[:, 1] - 1]):
            begins, reached = reach.get(k, ((), ()))
            before = bisect_left(begins, last)
            if not before or reached[before - 1] <= first:
                added.setdefault(k, []).append((first, 3, last))
        n = len(all_texts)
        counts = np.zeros((3, n), np.int64)
        for k, spans in base.items():
            for s in spans:
                counts[s[1], k] += 1
        hashes = [hashlib.sha256(_said(base.get(k, ())).encode()).hexdigest() for k in range(n)]
        said = [_said(base.get(k, []) + added.get(k, [])) for k in range(n)]
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts], pa.array(hashes), pa.array(said)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(plain, task, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3_secret_crf(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
