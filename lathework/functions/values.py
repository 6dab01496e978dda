"""Guards and conversions of single values, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")

# The preference table as (key, kind, low, high, default).
NUMBER_PREFS = (
    ("confidenceThreshold", "number", 0.0, 1.0, 0.6),
    ("previewSize", "number", 512.0, 8192.0, 2048.0),
    ("clusterMaxGapSeconds", "number", 0.0, 30.0, 1.0),
    ("maxConcurrency", "int", 1.0, 50.0, 1.0),
    ("deepExportConcurrency", "int", 1.0, 4.0, 2.0),
    ("writeBatchSize", "int", 0.0, 100000.0, 0.0),
    ("clusterSimilarityThreshold", "int", 0.0, 64.0, 10.0),
)

# Allowed region names, by lower-cased path segment.
REGIONS = {
    "usa": "United States", "united states": "United States", "united kingdom": "United Kingdom",
    "germany": "Germany", "deutschland": "Germany", "canada": "Canada", "australia": "Australia",
    "france": "France", "spain": "Spain", "italy": "Italy", "japan": "Japan",
}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` written once into the plan, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def finite(x: Column) -> Column:
    """Whether a double is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def unit(x: Column) -> Column:
    """Whether a double is finite and within [0, 1]."""
    return finite(x) & x.between(0, 1)


def clamp_number(x: Column, low: float, high: float, default: float) -> Column:
    """NaN and null give the default; an infinity gives the bound on its side."""
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def clamp_int(x: Column, low: float, high: float, default: float) -> Column:
    """Floored, then clamped; null, NaN and infinities give the default."""
    return F.when(~finite(x), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.floor(x).cast("double"))))


def clamp_pref(key: Column, raw: Column) -> Column:
    """A raw number under a preference's own bounds; null for a key that is not in the table."""
    out = F.lit(None).cast("double")
    for name, kind, low, high, default in NUMBER_PREFS:
        clamp = clamp_number if kind == "number" else clamp_int
        out = F.when(key == name, clamp(raw, low, high, default)).otherwise(out)
    return out


def to_bool(text: Column) -> Column:
    """Fail-closed truth of a text: null, blank, false, no, off and 0 are false, all else true."""
    return F.coalesce(~F.lower(F.trim(text)).isin("false", "no", "off", "0", ""), F.lit(False))


def half_up(x: Column) -> Column:
    """Rounded with halves going up, as a whole number."""
    return F.floor(x + 0.5).cast("long")


def region_hint(path: Column) -> Column:
    """The region of the first path segment that names one, else ''.

    Paths of the form //host are not read. "users" and "volumes" are skipped with the segment behind
    them, which is never tested, not even as another such word.
    """
    table = F.create_map(*(F.lit(x) for kv in REGIONS.items() for x in kv))
    lowered = F.transform(F.filter(F.split(path, r"[/\\]"), lambda s: s != ""), lambda s: F.lower(s))
    start = F.struct(F.lit(False).alias("skip"), F.lit("").alias("hit"))

    def step(a: Column, s: Column) -> Column:
        anchor = s.isin("users", "volumes")
        hit = F.when((a["hit"] == "") & ~a["skip"] & ~anchor, F.coalesce(table[F.trim(s)], F.lit(""))).otherwise(a["hit"])
        return F.struct((~a["skip"] & anchor).alias("skip"), hit.alias("hit"))

    unc = path.startswith("//") | path.startswith("\\\\")
    return F.when(path.isNull() | unc, F.lit("")).otherwise(F.aggregate(lowered, start, step, lambda a: a["hit"]))


def cocoa_date(seconds: Column) -> Column:
    """UTC date of seconds since 2001-01-01; null where the value is not finite."""
    return F.when(finite(seconds), F.date_format(F.timestamp_seconds(F.floor(seconds) + 978307200), "yyyy-MM-dd"))


def fixed2(x: Column) -> Column:
    """A number from 0 up with two digits behind the point, rounded by its exact binary value, ties to even; null for null.

    The hundredfold is taken in two parts, p and what p lacks, so that a tie is told from what lies just beside it.
    """
    c = x * 134217729.0
    high = c - (c - x)
    p = x * 100.0
    lacks = (high * 100.0 - p) + (x - high) * 100.0
    whole = F.floor(p)
    beyond = p - whole
    up = (beyond > 0.5) | ((beyond == 0.5) & ((lacks > 0) | ((lacks == 0) & (whole % 2 == 1))))
    cents = whole + F.when(up & ~((beyond == 0.5) & (lacks < 0)), 1).otherwise(0)
    return F.when(x.isNotNull(), F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")))
