"""Measurements, board lengths, prices and percentages as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockloom.functions.fixed_values import SIXTEENTHS, TOL_THICKNESS, TOL_VOLUME, TOL_WIDTH
from stockloom.functions.text import col, once

DEC = "decimal(12,4)"


def dec(x: float | str) -> Column:
    return F.lit(str(x)).cast(DEC)


def clean_dimension(c: Column | str) -> Column:
    t = F.translate(col(c).cast("string"), "’‘“”×", "''\"\"x")
    return once(F.trim(F.regexp_replace(t, r"\s+", " ")), lambda x: F.when(x != "", x))


def parse_measurement(c: Column | str) -> Column:
    """``18 3/4``, ``77,60L``, ``19"`` → exact decimal; NULL when any part is not a number."""
    t = F.translate(clean_dimension(c), ",\"", ".")
    t = F.regexp_replace(t, r"(?i)\s*(?:in(?:ches?)?|litres?|liters?|l)\s*$", "")
    fractions = F.create_map(*[F.lit(x) for k, v in SIXTEENTHS.items() for x in (k, v)])

    def part(p: Column) -> Column:
        return F.coalesce(F.element_at(fractions, p), p).try_cast(DEC)

    return F.aggregate(F.split(t, " "), dec(0), lambda a, p: (a + part(p)).cast(DEC))


def _groups(c: Column, rx: str, n: int) -> Column:
    """Texts of the ``n`` groups of the first match, empty where there is none; the pattern runs on ``c`` once.

    The groups are taken from the match alone, so ``rx`` must not look at what surrounds it
    but for digits.
    """
    found = F.regexp_extract(c, rx, 0)
    return F.split(F.regexp_replace(found, rx, "\u0001".join(f"${i}" for i in range(1, n + 1))), "\u0001", n)


def length_inches(c: Column | str) -> Column:
    """``5'11``, ``5ft11``, ``5"11`` → inches; NULL when the inches part is 12 or more."""
    feet_first = r"(?i)(?<!\d)(\d+)\s*(?:'|ft|feet)\s*(\d{1,2})?\s*(?:in|\")?"
    quote_first = r"(?<!\d)(\d+)\s*\"\s*(\d{1,2})(?!\d)"

    def inches(g: Column) -> Column:
        rest = F.coalesce(F.get(g, F.lit(1)).try_cast("int"), F.lit(0))
        return F.when(rest < 12, F.get(g, F.lit(0)).try_cast("int") * 12 + rest)

    def either(t: Column) -> Column:
        return once(_groups(t, feet_first, 2), lambda g: F.when(F.get(g, F.lit(0)) != "", inches(g)).otherwise(once(_groups(t, quote_first, 2), inches)))

    return once(clean_dimension(c), either)


def length_text(inches: Column | str) -> Column:
    i = col(inches).cast("int")
    return F.concat(F.floor(i / 12).cast("string"), F.lit("'"), (i % 12).cast("string"))


def title_dimensions(c: Column | str) -> Column:
    """Struct (length, width, thickness, volume) found in a title; NULL fields when absent."""
    t = clean_dimension(c)
    m = r"\d+(?:[\.,]\d+)?(?:\s+\d+\s*/\s*\d+)?"
    rx = (
        r"(?i)(\d+\s*(?:'|ft)\s*\d{1,2}\s*\"?)\s*[x×]\s*(" + m + r")\s*\"?\s*[x×]\s*(" + m
        + r")\s*\"?(?:\s*[x×-]\s*(\d+(?:[\.,]\d+)?)\s*l)?"
    )

    names = ("length", "width", "thickness", "volume")
    return once(_groups(t, rx, 4), lambda g: F.struct(*[F.nullif(F.get(g, F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(names)]))


def within(a: Column, b: Column, tol: float | str) -> Column:
    """False, never NULL, when a side is missing."""
    return F.coalesce(F.abs(a - b) <= dec(tol), F.lit(False))


def equivalent_dimensions(
    len_a: Column, wid_a: Column, thk_a: Column, vol_a: Column,
    len_b: Column, wid_b: Column, thk_b: Column, vol_b: Column,
) -> Column:
    """Equal inches and all three measurements present and within tolerance."""
    return (
        len_a.eqNullSafe(len_b)
        & within(wid_a, wid_b, TOL_WIDTH)
        & within(thk_a, thk_b, TOL_THICKNESS)
        & within(vol_a, vol_b, TOL_VOLUME)
    )


def slug_dimensions(c: Column | str) -> Column:
    """Dash text such as ``510-19-1-4-2-3-8-28-5l``, or ``5'10 | 19 1/2 | 2 1/2 | 30L`` → struct
    (length, width, thickness, volume).

    In dash text feet and inches are one token (``510``) or two (``5-10``); width and
    thickness are a whole number, with a fraction where two tokens make a proper one in
    halves to sixteenths, else with one decimal token; the volume ends in ``l``.
    """
    t = F.lower(F.trim(col(c)))
    dash = F.regexp_replace(t, r"[|/_\s]+", "-")
    fraction = r"(?:-(\d{1,2})-(2|4|8|16)|-(\d{1,2}))?"
    sizes = r"(?:^|-)([4-9])-?(\d{1,2})-(\d{2})" + fraction + r"-([1-4])" + fraction
    # with the volume first: it tells where the thickness ends
    whole, short = sizes + r"-(\d{2,3}(?:-\d{1,2})?)-?l(?:itres?|iters?)?(?:-|$)", sizes + "(?:-|$)"
    lone = F.regexp_extract(dash, r"(?:^|-)(\d{2,3}(?:-\d{1,2})?)-?l(?:itres?|iters?)?(?:-|$)", 1)
    g = lambda i: F.when(dash.rlike(whole), F.regexp_extract(dash, whole, i)).otherwise(F.regexp_extract(dash, short, i) if i < 11 else F.lit(""))
    inch = g(2).try_cast("int")
    ok = (g(1) != "") & (inch < 12)

    def measure(whole: int, top: int, below: int, decimal: int) -> Column:
        proper = g(top).try_cast("int") < g(below).try_cast("int")
        return F.when(g(below) != "", F.when(proper, F.concat(g(whole), F.lit(" "), g(top), F.lit("/"), g(below)))).when(
            g(decimal) != "", F.concat(g(whole), F.lit("."), g(decimal))).otherwise(g(whole))

    parts = F.transform(F.split(t, r"\s*\|\s*"), lambda x: F.trim(x))
    piped = (F.size(parts) >= 3) & length_inches(parts[0]).isNotNull()
    volume = F.when(g(11) != "", g(11)).otherwise(lone)
    stated = F.regexp_extract(F.try_element_at(parts, F.lit(4)), r"^(\d+(?:[.,]\d+)?)\s*l", 1)
    return F.struct(
        F.when(piped, length_text(length_inches(parts[0]))).when(ok, F.concat(g(1), F.lit("'"), inch.cast("string"))).alias("length"),
        F.when(piped, parts[1]).when(ok, measure(3, 4, 5, 6)).alias("width"),
        F.when(piped, parts[2]).when(ok, measure(7, 8, 9, 10)).alias("thickness"),
        F.when(piped, F.when(stated != "", F.replace(stated, F.lit(","), F.lit(".")))).when(volume != "", F.replace(volume, F.lit("-"), F.lit("."))).alias("volume"),
    )


def parse_price(c: Column | str) -> Column:
    """Price text with either separator style → decimal(18,2)."""
    t = F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"[^0-9,.]", "")
    both = t.contains(",") & t.contains(".")
    comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
    european = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.replace(t, F.lit(","), F.lit(""))
    comma_decimal = t.rlike(r",\d{1,2}$")
    v = (
        F.when(both & comma_last, european)
        .when(both, plain)
        .when(t.contains(",") & comma_decimal, F.replace(t, F.lit(","), F.lit(".")))
        .otherwise(plain)
    )
    return v.try_cast("decimal(18,2)")


def pct(n: Column, d: Column, digits: int = 2) -> Column:
    """100 n / d, 0.0 on a zero denominator."""
    return F.when(d > 0, F.round(n * 100.0 / d, digits)).otherwise(F.lit(0.0))


def clamp_pct(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(c, F.lit(0.0))))


def avg_pct(*cols: Column) -> Column:
    """Mean of the non-null values, two decimals; NULL when there are none."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.when(n > 0, F.round(total / n, 2))


def neighbour_lengths(inches: Column | str) -> Column:
    """Labels one and two inches below and above."""
    i = col(inches)
    return F.struct(
        length_text(i - 1).alias("one_down"), length_text(i + 1).alias("one_up"),
        length_text(i - 2).alias("two_down"), length_text(i + 2).alias("two_up"),
    )


def size_label(length: Column, width: Column, thickness: Column, volume: Column) -> Column:
    base = F.concat_ws(" x ", length, width, thickness)
    number = F.regexp_replace(F.regexp_replace(volume.cast("decimal(10,2)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when(volume.isNull(), base).otherwise(F.concat(base, F.lit(" | "), number, F.lit("L")))
