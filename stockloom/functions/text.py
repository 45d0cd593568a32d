"""Text keys, phrase tests and title clean-up as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockloom.functions.fixed_values import (
    CONSTRUCTION_ALIASES,
    CONSTRUCTION_TITLE_TOKENS,
    FAMILY_SUFFIXES,
    HINT_COLOURS,
    KEY_COLOURS,
    MODEL_KEY_ALIASES,
    POLICY_CONSTRUCTION_ALIASES,
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is computed once, however often the function reads it: a lambda is not inlined."""
    return F.transform(F.array(value), function)[0]


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a small fixed map, or the key itself."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return once(key, lambda k: F.coalesce(F.element_at(F.create_map(*pairs), k), k))


def blank(c: Column | str) -> Column:
    """NULL or empty after trimming."""
    c = col(c)
    return c.isNull() | (F.trim(c.cast("string")) == "")


def clean(c: Column | str) -> Column:
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("")))


def search_text(c: Column | str) -> Column:
    """Lower-case words; keeps the apostrophe so that ``5'11`` stays one word."""
    t = F.lower(F.coalesce(col(c).cast("string"), F.lit("")))
    t = F.translate(t, "’‘\"", "''")
    return F.trim(F.regexp_replace(t, "[^a-z0-9']+", " "))


def text_key(c: Column | str) -> Column:
    """Lower-case words without punctuation, ``&`` spelled out."""
    t = F.lower(F.coalesce(col(c).cast("string"), F.lit("")))
    t = F.replace(t, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def model_key(c: Column | str) -> Column:
    t = F.replace(F.lower(clean(c)), F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(t, r"(?<=\d)\.0\b", "")
    t = F.regexp_replace(t, "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(t, r"\bii\b", "2"))


def tolerant_model_key(c: Column | str) -> Column:
    k = model_key(c)
    k = F.regexp_replace(k, r"\s+by\s+[a-z][a-z ]+$", "")
    k = F.regexp_replace(k, r"\s+(?:" + "|".join(KEY_COLOURS) + ")$", "")
    k = F.trim(F.regexp_replace(k, r"\s+[a-z]{1,4}\d{4,}$", ""))
    return lookup(MODEL_KEY_ALIASES, k)


def catalogue_model_key(model: Column | str, brand: Column | str) -> Column:
    """Model key with a leading brand name removed."""
    k, b = model_key(model), model_key(brand)
    lead = F.concat(b, F.lit(" "))
    return F.when((b != "") & k.startswith(lead), F.substring(k, F.length(lead) + 1, F.length(k))).otherwise(k)


def contains_key(text: Column, phrase: Column) -> Column:
    """Whole-word containment of two already normalised keys."""
    pad = F.lit(" ")
    return (phrase != "") & F.concat(pad, text, pad).contains(F.concat(pad, phrase, pad))


def contains_phrase(text: Column | str, phrase: Column | str) -> Column:
    return contains_key(text_key(text), text_key(phrase))


def phrase_key(*texts: Column | str) -> Column:
    """Words of one or more texts in which an apostrophe is a word of its own."""
    both = search_text(F.concat_ws(" ", *[F.coalesce(col(t), F.lit("")) for t in texts]))
    return F.trim(F.regexp_replace(F.replace(both, F.lit("'"), F.lit(" ' ")), " +", " "))


def title_contains_phrase(title: Column | str, normalised: Column | str, phrase: Column | str) -> Column:
    """Phrase in either title, at letter or digit boundaries; an apostrophe ends a word."""
    return contains_key(phrase_key(title, normalised), phrase_key(phrase))


def model_family(c: Column | str) -> Column:
    """Model name without a leading "the" and without trailing descriptor words."""
    k = F.regexp_replace(search_text(c), "^the ", "")
    return F.regexp_replace(k, r"(?<=\S)(?: (?:" + "|".join(FAMILY_SUFFIXES) + r"))+$", "")


def construction_key(c: Column | str) -> Column:
    return lookup(CONSTRUCTION_ALIASES, text_key(c))


def policy_construction_key(c: Column | str) -> Column:
    return lookup(POLICY_CONSTRUCTION_ALIASES, search_text(c))


def _words(token: str) -> str:
    """A fixed token in the form of a text key."""
    return " ".join(re.findall("[a-z0-9]+", token.lower()))


def construction_tokens(key: Column | str) -> Column:
    """Array of the constructions named in a title; takes its ``text_key``, which is computed once."""

    def named(padded: Column) -> Column:
        found = []
        for name, tokens in CONSTRUCTION_TITLE_TOKENS.items():
            hit = F.lit(False)
            for token in dict.fromkeys(_words(t) for t in tokens):
                hit = hit | padded.contains(f" {token} ")
            found.append(F.when(hit, F.lit(name)))
        return F.array_compact(F.array(*found))

    return F.transform(F.array(F.concat(F.lit(" "), col(key), F.lit(" "))), named)[0]


def clean_model_hint(c: Column | str) -> Column:
    m = clean(c)
    m = F.regexp_replace(m, r"(?is)\s+-\s+(?=(?:[4-9]|1[0-2])\s*['’]\s*\d{1,2}\b).*$", "")
    m = F.regexp_replace(m, r"(?i)\s+by\s+[A-Za-z][A-Za-z .'-]*$", "")
    m = F.regexp_replace(m, r"(?i)\s+(?:" + "|".join(HINT_COLOURS) + ")$", "")
    return F.trim(F.regexp_replace(m, r"[\s\-–—:|,/]+$", ""))


def _strip_lead(value: Column, aliases: Sequence[str], brand: Column) -> Column:
    """Remove one leading brand name, the longest one that fits."""
    tail = r"(?:\s+surfboards?)?\s*[-|:]?\s*"
    fixed = "|".join(re.escape(a) for a in sorted(set(aliases), key=lambda a: (-len(a), a)))
    own = F.trim(F.coalesce(brand, F.lit("")))

    def without(v: Column, hit: Column) -> Column:
        rest = F.substring(v, F.length(hit) + 1, F.length(v))
        return F.when(F.length(hit) > 0, F.regexp_replace(rest, "(?i)^" + tail, "")).otherwise(v)

    def strip(v: Column) -> Column:
        fixed_hit = F.regexp_extract(v, f"(?i)^({fixed})", 1) if fixed else F.lit("")
        own_hit = F.when((own != "") & F.lower(v).startswith(F.lower(own)), own).otherwise(F.lit(""))
        longest = once(F.struct(own_hit.alias("own"), fixed_hit.alias("fixed")), lambda h: F.when(F.length(h["own"]) > F.length(h["fixed"]), h["own"]).otherwise(h["fixed"]))
        return once(longest, lambda hit: without(v, hit))

    return once(value, strip)


def model_hint(title: Column | str, brand: Column | str, aliases: Sequence[str]) -> Column:
    """The part of a listing title that names the model.

    ``aliases`` is the fixed list of brand spellings; the row's own brand name is tried too.
    """
    brand = col(brand)
    return once(clean(title), lambda t: _hint_of(t, brand, aliases))


def _hint_of(title: Column, brand: Column, aliases: Sequence[str]) -> Column:
    """``model_hint`` of a trimmed title."""
    parts = F.filter(F.transform(F.split(title, r"\s+-\s+"), lambda x: F.trim(x)), lambda x: x != "")

    def structured(p: Column) -> Column:
        """The second part, where the first one is a brand before "surfboards"; else NULL."""
        first = F.try_element_at(p, F.lit(1))
        return F.when((F.size(p) >= 2) & first.rlike(r"(?i)^.+?\s+surfboards?$") & ~first.rlike(r"\d\s*['’]"), F.try_element_at(p, F.lit(2)))

    v = F.regexp_replace(title, r"(?i)^PRE\s*ORDER\s*\|\s*", "")
    v = _strip_lead(v, aliases, brand)
    v = F.regexp_replace(v, r"(?i)^surfboards?\s*[-|:]?\s*", "")
    v = _strip_lead(v, aliases, brand)
    v = F.regexp_replace(v, r"^(?:[4-9]|1[0-2])\s*['’]\s*\d{1,2}\s*", "")
    v = F.regexp_replace(
        v,
        r"(?is)\b(?:PU|EPS|SPINE\s*-?\s*TEK|LIGHT\s*SPEED|LIGHTSPEED|HELIUM|IBOLIC|VOLCANIC|LFT|FST|PE|"
        r"TIMBERTEK|THUNDERBOLT|FUTURE\s*FLEX|FUTUREFLEX)\b.*$",
        "",
    )
    v = F.regexp_replace(v, r"(?is)\b(?:round\s+pin|round|squash|swallow|fish|diamond|square)\s+tail\b.*$", "")
    v = F.regexp_replace(v, r"(?is)\s+[-|]\s+(?:white|color|colour).*$", "")
    return F.when(title == "", F.lit("")).otherwise(clean_model_hint(F.coalesce(once(parts, structured), v)))


def word_ngrams(key: Column | str, max_words: int) -> Column:
    """Distinct runs of 1..max_words words: the exact block keys for phrase containment."""

    def runs(words: Column, k: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - k + 1)
        found = F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(F.size(words) >= k, found).otherwise(F.array().cast("array<string>"))

    return once(F.split(col(key), " "), lambda words: F.array_distinct(F.concat(*[runs(words, k) for k in range(1, max_words + 1)])))


def split_tail(name: Column | str, patterns: Sequence[str]) -> Column:
    """(model, tail): the first tail pattern that ends the name is cut off it."""
    name = clean(name)
    rx = r"(?i)\s*[-–]?\s*\b(" + "|".join(patterns) + r")\s*$"
    tail = F.regexp_extract(name, rx, 1)
    return F.struct(
        F.when(tail == "", name).otherwise(F.trim(F.regexp_replace(name, rx, ""))).alias("model"),
        F.when(tail == "", F.lit(None).cast("string")).otherwise(tail).alias("tail"),
    )
