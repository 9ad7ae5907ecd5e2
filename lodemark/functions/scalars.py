"""Column builders that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risks and severities in ascending rank; ordering is never alphabetical.
RISKS = ["UNKNOWN", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
ROLE_RANKS = {"viewer": 0, "developer": 1, "reviewer": 2, "admin": 3, "owner": 4}


def half_up(x: Column) -> Column:
    """The whole number nearest to x, halves upwards (so -0.5 gives 0)."""
    return F.floor(x + 0.5)


def risk_rank(risk: Column) -> Column:
    """Place of a risk in RISKS, from 0; unknown names rank lowest."""
    out = F.lit(0)
    for n, name in enumerate(RISKS):
        out = F.when(risk == name, n).otherwise(out)
    return out


def role_rank(role: Column) -> Column:
    out = F.lit(0)
    for name, n in ROLE_RANKS.items():
        out = F.when(role == name, n).otherwise(out)
    return out


def grade(value: Column) -> Column:
    """A to F at .90, .75, .60 and .45."""
    return F.when(value >= 0.90, "A").when(value >= 0.75, "B").when(value >= 0.60, "C").when(value >= 0.45, "D").otherwise("F")


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or ``empty`` where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(a / F.nullif(b, F.lit(0)))


def clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def hours(n: Column) -> Column:
    return F.make_dt_interval(hours=n.cast("int"))


def hours_between(start: Column, end: Column) -> Column:
    seconds = lambda t: F.unix_micros(t.cast("timestamp")) / 1e6
    return (seconds(end) - seconds(start)) / 3600.0


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of a text; 0 for an empty one."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text).cast("double")
    each = F.transform(F.array_distinct(chars), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(F.length(text) == 0, 0.0).otherwise(F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p)))


def upper_median(values: Column) -> Column:
    """The element at floor(n / 2) of the sorted values, which is no percentile built-in.

    ``values`` is an array column; null if it is empty.
    """
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def rolling_hash(text: Column) -> Column:
    """The 31-multiplier hash of a text's code points, in wrapping 32 bits, without its sign."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c)))


def mask_secret(text: Column) -> Column:
    """Tokens of eight or more characters keep their first four."""
    return F.regexp_replace(text, r"([A-Za-z0-9_\-]{4})[A-Za-z0-9_\-]{4,}", "$1••••")
