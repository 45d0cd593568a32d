"""Names in titles: every name that a text holds as whole words.

A name is filed under its rarest word; a text asks for each of its words once and tests the
names it gets.  So there is one join, however long the names are, and a text is looked at once
however many rows have it.  (A trie walked in a lambda would need its edges in a map column,
whose lookups take time linear in its size.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import text as T


def name_index(names: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """``names`` with ``_word``, the word of their ``key`` that the fewest of them (of equal ``by``) hold."""
    distinct = names.select(*by, key).filter(F.col(key) != "").distinct()
    words = distinct.withColumn("_word", F.explode(F.array_distinct(F.split(key, " "))))
    frequency = words.groupBy(*by, "_word").agg(F.count("*").alias("_df"))
    ranked = words.join(frequency, [*by, "_word"]).groupBy(*by, key).agg(F.min(F.struct("_df", "_word")).alias("_r"))
    return names.join(ranked.select(*by, key, F.col("_r._word").alias("_word")), [*by, key])


def names_in(texts: DataFrame, text: str, names: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct ``by`` and ``text`` of ``texts`` with every row of ``names`` whose ``key`` the text holds.

    Texts and keys are normalised alike, words with one space between.
    """
    asked = texts.select(*by, text).filter(F.col(text) != "").distinct().withColumn("_word", F.explode(F.array_distinct(F.split(text, " "))))
    met = asked.join(name_index(names, key, by), [*by, "_word"])
    return met.filter(T.contains_key(F.col(text), F.col(key))).drop("_word")


def leading_names(names: DataFrame, key: str, value: str) -> DataFrame:
    """_first, _names: names by their first word, the longest first, as an array of (key, value); one lookup finds the longest that begins a text."""
    longest = Window.partitionBy("_first").orderBy(F.length(key).desc(), key)
    ranked = names.filter(F.col(key) != "").withColumn("_first", F.substring_index(key, " ", 1)).withColumn("_rn", F.row_number().over(longest))
    return ranked.groupBy("_first").agg(F.array_sort(F.collect_list(F.struct("_rn", F.col(key).alias("key"), F.col(value).alias("value")))).alias("_names"))
