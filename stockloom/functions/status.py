"""Availability, freshness and health bands as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockloom.functions.fixed_values import AVAILABLE_STATUSES
from stockloom.functions.text import col


def is_available_status(c: Column | str, statuses: Sequence[str] = AVAILABLE_STATUSES) -> Column:
    """NULL counts as available; never NULL itself."""
    c = col(c)
    return c.isNull() | F.lower(F.trim(c)).isin(*statuses)


def region_or_null(c: Column | str) -> Column:
    """Blank regions become the text ``<NULL>``."""
    t = F.trim(col(c))
    return F.when(t.isNull() | (t == ""), "<NULL>").otherwise(t)


def in_order(c: Column | str, values: Sequence[str]) -> Column:
    """Position in a fixed order; values outside it come last."""
    out = F.lit(len(values) + 99)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(col(c) == v, F.lit(i)).otherwise(out)
    return out


def age_hours(ts: Column | str, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(col(ts).cast("timestamp"))) / F.lit(3.6e9)


def source_status(applicability, latest, rows, now, green_hours: int = 24, yellow_hours: int = 48) -> Column:
    """Struct (color, label) from applicability, refresh time and row count."""
    a = F.lower(F.trim(F.coalesce(col(applicability), F.lit("expected"))))
    a = F.when(a == "", "expected").otherwise(a)
    latest, rows = col(latest), F.coalesce(col(rows), F.lit(0))
    age = age_hours(latest, now)

    def s(color: str, label: str) -> Column:
        return F.struct(F.lit(color).alias("color"), F.lit(label).alias("label"))

    return (
        F.when(a == "dealer_network_only", s("grey", "dealer_network_only"))
        .when(a == "not_applicable", s("grey", "not_applicable"))
        .when(a.isin("planned", "partial") & (rows > 0) & latest.isNotNull(), s("yellow", "partial"))
        .when(a.isin("planned", "partial"), s("yellow", "planned"))
        .when(latest.isNull(), s("red", "missing"))
        .when(rows <= 0, s("red", "zero_rows"))
        .when(age <= green_hours, s("green", "healthy"))
        .when(age <= yellow_hours, s("yellow", "stale"))
        .otherwise(s("red", "stale"))
    )


def search_health(model_pct, family_pct) -> Column:
    m, f = col(model_pct), col(family_pct)
    return (
        F.when(m.isNull() | f.isNull(), "yellow")
        .when((m >= 85) & (f >= 60), "green")
        .when((m >= 75) & (f >= 40), "yellow")
        .otherwise("red")
    )


SEVERITY = {"red": 3, "yellow": 2, "green": 1, "grey": 0}


def severity(c: Column | str) -> Column:
    out = F.lit(-1)
    for name, n in SEVERITY.items():
        out = F.when(col(c) == name, F.lit(n)).otherwise(out)
    return out


def combine_status(*colors: Column | str) -> Column:
    """The worst colour; grey when none is known."""
    worst = F.greatest(*[severity(c) for c in colors], F.lit(-1))
    out = F.lit("grey")
    for name, n in SEVERITY.items():
        out = F.when(worst == n, name).otherwise(out)
    return out
