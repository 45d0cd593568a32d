"""Document fingerprints as threshold-scaled sketches, in SQL functions only.

The fingerprint of a text is every distinct hash of its five-word shingles below a fixed
fraction (``FRACTION`` / 16) of the hash range, and no other.  Sketches of that kind grow with
the text, merge by union, and estimate containment between documents of very unequal length:
|A ∩ B| / min(|A|, |B|).  A text of n shingles keeps none with a chance of
(1 - FRACTION / 16) ** n; its fingerprint is empty then.  Two empty fingerprints are alike (1)
if the texts are equal, else not (0); an empty and another one are not alike.

The next document in order of id is found without a global sort in one task: rows go to
ranges of ids (coarse quantiles, evenly divided), each range is ordered by itself, and the
first row of every range is also sent to the range before it.  An id that holds several
quantiles has ranges of its own, divided by a hash of the text.  Only texts are shuffled;
sketches are made afterwards.

Null text counts as empty.  Texts of fewer than five words have one shingle.  Rows of equal id
follow each other by MD5 of the text; null ids come first.  Rows alike in id and text are in one
range.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 5
#: Hashes whose first hex digit is below this number are kept.
FRACTION = 8
COARSE = 64
_LOWEST = -(2**63)
_SPACE = " \t\n\x0b\f\r"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column) -> Column:
    """Sorted distinct hashes that the threshold keeps."""

    def of_hashes(hashes: Column) -> Column:
        kept = F.filter(hashes, lambda h: h < f"{FRACTION:x}")
        return F.sort_array(F.array_distinct(F.transform(kept, lambda h: F.substring(h, 1, 16))))

    def of_words(words: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (WIDTH - 1)))
        return bound(F.transform(places, lambda i: F.md5(F.array_join(F.slice(words, i, WIDTH), " "))), of_hashes)

    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(bound(F.split(trimmed, r"[\x20\x09-\x0D]+"), of_words))


def merge(*sketches: Column) -> Column:
    """Sketch of the shingles of several texts taken together."""
    return F.sort_array(F.array_distinct(F.flatten(F.array(*sketches))))


def containment(a: Column, b: Column, equal: Column | bool = True) -> Column:
    """Share of the smaller sketch that the other one has; ``equal`` tells whether the texts of two empty ones are."""
    least = F.least(F.size(a), F.size(b))
    both_empty = (F.size(a) == 0) & (F.size(b) == 0) & (F.lit(equal) if isinstance(equal, bool) else equal)
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.when(both_empty, 1.0).otherwise(0.0))


def _range_of(key: Column, split: Column, starts: list[int], last: int, hot: list[bool], parts: int) -> Column:
    """Number of the id range: the coarse range, evenly divided by id, or by ``split`` where it holds one id."""
    i = F.size(F.filter(F.lit(starts), lambda x: x <= key))
    low = F.element_at(F.lit(starts), i).cast("double")
    high = F.element_at(F.lit([*starts[1:], last]), i).cast("double")
    by_key = (key.cast("double") - low) / F.greatest(high - low, F.lit(1.0))
    by_hash = F.conv(F.substring(split, 1, 8), 16, 10).cast("double") / float(2**32)
    fine = F.floor(F.when(F.element_at(F.lit(hot), i), by_hash).otherwise(by_key) * parts)
    return (i * parts + F.greatest(F.lit(0), F.least(fine, F.lit(parts - 1)))).cast("long")


def with_next(rows: DataFrame, key: str, split: str, carried: list[str], made: dict[str, Column] | None = None) -> DataFrame:
    """Rows with ``next_<column>`` of the row that follows by ``key``, then ``split`` (hex text); the first follows the last.

    ``made`` are columns that are computed behind the shuffle, once for a row and its neighbour.
    """
    made = made or {}
    spark = rows.sparkSession
    edge = rows.agg(F.min(key), F.max(key), F.percentile_approx(key, [k / COARSE for k in range(1, COARSE)], 10_000)).first()
    if edge[0] is None:
        return (rows.withColumns(made) if made else rows).select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    often = {a for a, b in zip([edge[0], *edge[2]], [*edge[2], edge[1]]) if a == b}
    starts = sorted({edge[0], *edge[2], *(h + 1 for h in often if h < edge[1])})
    parts = max(1, -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // len(starts)))
    place = _range_of(F.col(key), F.col(split), starts, edge[1], [x in often for x in starts], parts)
    # one row per range: a number of rows that the session's parallelism sets
    firsts = rows.groupBy(place.alias("range")).agg(F.min(F.struct(F.col(key).alias("k"), F.col(split).alias("s"))).alias("first")).orderBy("range").collect()
    before = [firsts[-1]["range"], *[r["range"] for r in firsts[:-1]]]
    columns = {"first_k": [r["first"]["k"] for r in firsts], "first_s": [r["first"]["s"] for r in firsts], "into": before}
    heads = spark.range(1).select(F.inline(F.arrays_zip(*[F.lit(values).alias(name) for name, values in columns.items()])))
    at = lambda into, ghost: F.struct(into.alias("range"), F.lit(ghost).alias("ghost"))
    own = at(place, 0)
    placed = rows.join(F.broadcast(heads), (rows[key] == heads["first_k"]) & (rows[split] == heads["first_s"]), "left").withColumn(
        "_at", F.explode(F.when(F.col("into").isNull(), F.array(own)).otherwise(F.array(own, at(F.col("into"), 1)))))
    if made:
        placed = placed.repartition(F.col("_at.range")).withColumns(made)
    window = Window.partitionBy("_at.range").orderBy("_at.ghost", key, split)
    return placed.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in carried]).filter("_at.ghost = 0").drop("first_k", "first_s", "into", "_at")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sketch as an array and as text; no shuffle."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), sketch(F.coalesce(F.col(text_col), F.lit(""))).alias("sketch")).withColumn("fingerprint", F.array_join("sketch", ","))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it and to the next text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(_LOWEST)).alias("_key"), "text", F.md5(F.col("text").cast("binary")).alias("_split"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = with_next(rows, "_key", "_split", ["text", "sketch"], {"sketch": sketch(F.col("text"))}).select(
        "doc_id", "text", "next_text", "sketch", "next_sketch", F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    both = edited.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch",
        sketch(F.col("edited")).alias("edited_sketch"), (F.col("text") == F.col("edited")).alias("same_edited"), (F.col("text") == F.col("next_text")).alias("same_next"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("sketch", ",").alias("fingerprint"), F.array_join("edited_sketch", ",").alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch"), F.col("same_edited")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch"), F.col("same_next")).alias("near_next"))


def op2_scaled_sketch(spark, sf_dir) -> DataFrame:
    return edit_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_sketch(text: str) -> str:
    words = f"regexp_split_to_array(trim({text}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+')"
    return (f"CASE WHEN trim({text}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN [] ELSE list_extract(list_transform([{words}], lambda w: list_extract(list_transform("
            f"[list_transform(generate_series(1, greatest(1, len(w) - {WIDTH - 1})), lambda i: md5(array_to_string(w[i:i + {WIDTH - 1}], ' ')))], lambda h: "
            f"list_sort(list_distinct(list_transform(list_filter(h, lambda x: x < '{FRACTION:x}'), lambda x: substr(x, 1, 16))))), 1)), 1) END")


_LIKE = "CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) WHEN len({a}) = len({b}) AND text = {t} THEN 1.0 ELSE 0.0 END"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id, md5(text)), first_value(text) OVER (ORDER BY doc_id, md5(text))) AS next_text FROM d),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM n),
s AS (SELECT *, {_sql_sketch('text')} AS a, {_sql_sketch('edited')} AS b, {_sql_sketch('next_text')} AS c FROM e)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, ',') AS fingerprint, array_to_string(b, ',') AS edited_fingerprint,
  {_LIKE.format(a='a', b='b', t='edited')} AS near_edited, {_LIKE.format(a='a', b='c', t='next_text')} AS near_next FROM s
"""
