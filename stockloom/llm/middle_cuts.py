"""Fill-in-middle transformation with a sparse index of the characters that take several bytes.

A text is cut twice, prefix | middle | suffix, and written in prefix-suffix-middle (``psm``) or
suffix-prefix-middle (``spm``) order behind sentinels.  Everything works on UTF-8 bytes; what
must be told in code points, or is given in them, is converted by an index that records only
multibyte characters, their positions and the excess bytes before them: ``searchsorted``
finds how many stand before a cut, and stretches of ASCII between them stay arithmetic.  An
index covers a whole slice of rows at once; a slice holds about a MB, or one longer text.

Units are lines (``[^\\n]*\\n|[^\\n]+``) or code points.  Of n units the prefix ends after
the smaller of ``h1 % (n + 1)`` and ``h2 % (n + 1)``, the middle after the larger, where
h1 to h4 are the first 8-digit groups of the hex SHA-256 of ``<seed>:<id>``.

Null text counts as empty, and an empty text is plain.  A text that contains a sentinel is
plain too, which makes every output reversible.  A null id hashes as ``<seed>:``.  Rows of
one id are cut by the same hash and stay separate rows.  Columns other than id and text are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import map_slices, table, utf8

#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, text string, n long, form string, prefix_chars long, middle_chars long, output string"


class MultibyteIndex:
    """Converts between byte and code-point offsets of UTF-8 data at character boundaries."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate([[0], np.cumsum(excess)]).astype(np.int64)
        self.char_at = self.at - self.before[:-1]

    def chars(self, offsets: np.ndarray) -> np.ndarray:
        return offsets - self.before[np.searchsorted(self.at, offsets)]

    def bytes(self, offsets: np.ndarray) -> np.ndarray:
        return offsets + self.before[np.searchsorted(self.char_at, offsets)]


def line_cuts(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, object]:
    """Lines of every row, and a function from rows' unit counts to byte offsets."""
    ends = np.flatnonzero(data == 10) + 1
    first, last = np.searchsorted(ends, rows[:-1], "right"), np.searchsorted(ends, rows[1:], "right")
    closed = np.zeros(len(rows) - 1, bool)
    full = rows[1:] > rows[:-1]
    closed[full] = data[rows[1:][full] - 1] == 10
    n = last - first + (full & ~closed)

    def cut(units: np.ndarray) -> np.ndarray:
        at = np.clip(first + units - 1, 0, max(len(ends) - 1, 0))
        inside = ends[at] if len(ends) else np.zeros(len(units), np.int64)
        return np.where(units == 0, rows[:-1], np.where(units <= last - first, inside, rows[1:]))

    return n.astype(np.int64), cut


def char_cuts(index: MultibyteIndex, rows: np.ndarray) -> tuple[np.ndarray, object]:
    starts = index.chars(rows)
    return np.diff(starts), lambda units: index.bytes(starts[:-1] + units)


def _checked(sentinels: tuple[str, str, str]) -> list[bytes]:
    """Sentinels that no text without them can imitate next to one of them."""
    marks = [s.encode() for s in sentinels]
    for x in marks:
        for y in marks:
            if not x or x is not y and x in y or any(y.startswith(x[i:]) for i in range(1, len(x))):
                raise ValueError(f"sentinels must not be empty, hold or overlap each other: {sentinels}")
    return marks


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "7", rate: int = 100, spm_rate: int = 50,
                   unit: str = "line", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, text, n (units), form, prefix_chars, middle_chars, output; one row per document, no shuffle.

    ``rate`` and ``spm_rate`` are percentages: texts transformed at all, and of them in spm order.
    """
    mark_p, mark_s, mark_m = marks = _checked(sentinels)
    if unit not in ("line", "char"):
        raise ValueError(f"unknown unit: {unit}")

    def task(batch):
        data, rows = utf8(batch)
        index = MultibyteIndex(data)
        n, cut = line_cuts(data, rows) if unit == "line" else char_cuts(index, rows)
        digests = batch.column(2).to_pylist()
        h = np.array([[int(d[i: i + 8], 16) for i in (0, 8, 16, 24)] for d in digests], np.int64).reshape(-1, 4)
        draws = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
        low, high = cut(draws[:, 0]), cut(draws[:, 1])
        prefix, middle = index.chars(low) - index.chars(rows[:-1]), index.chars(high) - index.chars(low)
        raw = data.tobytes()
        forms, outputs, texts = [], [], []
        for k in range(batch.num_rows):
            a, p, m, b = int(rows[k]), int(low[k]), int(high[k]), int(rows[k + 1])
            texts.append(raw[a:b])
            if a == b or h[k, 2] % 100 >= rate or any(raw.find(x, a, b) >= 0 for x in marks):
                forms.append("plain")
                outputs.append(raw[a:b])
            elif h[k, 3] % 100 < spm_rate:
                forms.append("spm")
                outputs.append(b"".join([mark_s, raw[m:b], mark_p, raw[a:p], mark_m, raw[p:m]]))
            else:
                forms.append("psm")
                outputs.append(b"".join([mark_p, raw[a:p], mark_s, raw[m:b], mark_m, raw[p:m]]))
        plain = np.array([f == "plain" for f in forms], bool)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n), pa.array(forms, pa.string()), pa.array(prefix, mask=plain),
             pa.array(middle, mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())], names=["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"])

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.sha2(key, 256).alias("digest"))
    return map_slices(plain, task, SCHEMA)


def restored(outputs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``outputs`` (with columns output and form) with the exact text rebuilt from these two as ``restored``; a null output gives null."""
    mark_p, mark_s, mark_m = _checked(sentinels)

    def rebuilt(output: bytes | None, form: str | None) -> bytes | None:
        if output is None or form not in ("psm", "spm"):
            return output
        first, second = (mark_p, mark_s) if form == "psm" else (mark_s, mark_p)
        one = output.index(second, len(first))
        two = output.index(mark_m, one + len(second))
        parts = output[len(first): one], output[one + len(second): two]
        before, after = parts if form == "psm" else parts[::-1]
        return b"".join([before, output[two + len(mark_m):], after])

    def task(batch):
        names = batch.schema.names
        texts = batch.column(names.index("output")).cast(pa.binary()).to_pylist()
        forms = batch.column(names.index("form")).to_pylist()
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(map(rebuilt, texts, forms)), pa.binary()).cast(pa.string())], names=[*names, "restored"])

    outputs = outputs.drop("restored")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema.fields)
    return map_slices(outputs, task, f"{fields}, restored string", "output")


def op11_middle_cuts(spark, sf_dir) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents")).drop("text")
    return restored(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || x[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || x[9:16])::BIGINT % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || x[17:24])::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || x[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
    coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c
"""
