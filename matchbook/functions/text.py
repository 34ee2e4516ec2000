"""Column builders for tolerant text handling: casts, flags, labels, keys, tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "no value", words for true and false, for positive and negative
#: labels, and tokens that a key leaves out.
NA_WORDS = ("", "nan", "none", "<na>", "null", "nat")
TRUE_WORDS = ("true", "1", "1.0", "yes", "y", "t", "pass", "passed", "usable")
FALSE_WORDS = ("false", "0", "0.0", "no", "n", "f", "fail", "failed", "unusable")
POSITIVE_WORDS = ("1", "1.0", "positive", "tp", "plume", "release", "release_on", "yes", "true")
NEGATIVE_WORDS = ("0", "0.0", "negative", "tn", "no plume", "no_plume", "no_release", "release_off", "no", "false")
STOP_TOKENS = ("release", "releases", "stack", "stacks", "site", "facility", "controlled", "methane", "source", "test", "station")


def clean_text(c: Column) -> Column:
    """Trimmed text; blanks and words for "missing" become null."""
    t = F.trim(c.cast("string"))
    return F.when(F.lower(t).isin(*NA_WORDS), None).otherwise(t)


def number(c: Column) -> Column:
    """A double, or null where the text is none; NaN and infinities are null too."""
    x = clean_text(c).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def finite(c: Column) -> Column:
    """Whether the value is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def moment(c: Column, formats: Sequence[str] = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")) -> Column:
    """A timestamp by the first format that fits, else null."""
    t = clean_text(c)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats])


def utc_moment(c: Column, zone: str = "UTC") -> Column:
    """A timestamp from ISO text with or without an offset: `Z`, +hh, +hhmm or +hh:mm is taken
    at its word, text without one is the local time of the zone. Fractions of a second are
    kept; null where nothing fits. The session's zone is taken to be UTC."""
    t = F.regexp_replace(clean_text(c), "^(\\d{4}-\\d{2}-\\d{2}) (?=\\d)", "$1T")
    offset = F.regexp_extract(t, "T.*?([Zz]|[+-]\\d{2}(?::?\\d{2})?)$", 1)
    bare = F.when(offset != "", F.substring(t, F.lit(1), F.length(t) - F.length(offset))).otherwise(t)
    local = F.coalesce(F.try_to_timestamp(bare, F.lit("yyyy-MM-dd'T'HH:mm[:ss[.SSSSSS][.SSS]]")), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd")))
    digits = F.regexp_replace(F.substring(offset, 2, 5), ":", "")
    minutes = F.substring(digits, 1, 2).cast("int") * 60 + F.when(F.length(digits) > 2, F.substring(digits, 3, 2).cast("int")).otherwise(0)
    signed = F.when(F.upper(offset) == "Z", 0).when(F.startswith(offset, F.lit("-")), -minutes).otherwise(minutes)
    return F.when(offset != "", F.timestamp_micros(F.unix_micros(local) - signed.cast("long") * 60_000_000)).otherwise(F.to_utc_timestamp(local, zone))


def flag(c: Column, true_words: Sequence[str] = TRUE_WORDS, false_words: Sequence[str] | None = None) -> Column:
    """Two-valued by default (unknown is false); with false_words unknown is null."""
    t = F.lower(F.trim(c.cast("string")))
    yes = F.coalesce(t.isin(*true_words), F.lit(False))
    if false_words is None:
        return yes
    return F.when(yes, True).when(t.isin(*false_words), False)


def label(c: Column) -> Column:
    """1, 0 or null from the usual words."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(*POSITIVE_WORDS), 1).when(t.isin(*NEGATIVE_WORDS), 0)


def token_key(c: Column, stop: Sequence[str] = STOP_TOKENS) -> Column:
    """Lower-case tokens of letters and digits without the stop tokens, joined by blanks; empty
    for texts that mean "no value"."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(clean_text(c)), "[^a-z0-9]+", " ")), " +")
    return F.coalesce(F.array_join(F.filter(tokens, lambda t: ~t.isin(*stop)), " "), F.lit(""))


def synonym(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """The value of the first key that the text contains (any case); else the text."""
    out = F.when(F.lit(False), c)
    for key, value in pairs:
        out = out.when(F.contains(F.lower(c), F.lit(key.lower())), F.lit(value))
    return out.otherwise(c)


def note_value(c: Column, key: str) -> Column:
    """The value of `key=value` in notes parted by ; , or blanks; null if absent."""
    v = F.regexp_extract(c, rf"(?i)\b{key}\s*=\s*([^;,\s]+)", 1)
    return F.when(v != "", v)


def first_present(columns: Sequence[str]) -> tuple[Column, Column]:
    """(first non-null value of the columns, name of the column it came from)."""
    value = F.coalesce(*[F.col(c) for c in columns])
    source = F.when(F.lit(False), "")
    for c in columns:
        source = source.when(F.col(c).isNotNull(), c)
    return value, source


def all_reasons(rules: Sequence[tuple[Column, str]], sep: str = " + ") -> Column:
    """The reasons of all rules that hold, joined; empty if none does."""
    return F.concat_ws(sep, *[F.when(c, r) for c, r in rules])


def first_reason(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The reason of the first rule that holds."""
    out = F.when(F.lit(False), otherwise)
    for c, r in rules:
        out = out.when(c, r)
    return out.otherwise(otherwise)


def binned(c: Column, edges: Sequence[float], names: Sequence[str], closed: str = "right") -> Column:
    """The name of the bin between neighbouring edges; closed right (lo, hi] or left [lo, hi)."""
    out = F.when(F.lit(False), "")
    for lo, hi, name in zip(edges[:-1], edges[1:], names, strict=True):
        inside = (c > lo) & (c <= hi) if closed == "right" else (c >= lo) & (c < hi)
        out = out.when(inside, name)
    return out


def tier(c: Column, limits: Sequence[tuple[float, str]], beyond: str, missing: str = "no_match") -> Column:
    """The name of the first limit that the value does not exceed."""
    out = F.when(c.isNull(), missing)
    for most, name in limits:
        out = out.when(c <= most, name)
    return out.otherwise(beyond)


def content_id(prefix: str, c: Column, digits: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(c), 1, digits))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Whether the text holds any of the words, in any case."""
    escaped = ["".join(x if x.isalnum() or x == " " else "\\" + x for x in w) for w in words]
    return c.rlike("(?i)" + "|".join(escaped))


def coordinate_key(lat: Column, lon: Column, places: int = 3) -> Column:
    """geo_<lat>_<lon> at so many decimals, the key of places given by coordinates alone; null
    if either is null."""
    side = lambda c: F.format_string(f"%.{places}f", F.round(c, places) + 0.0)
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(F.lit("geo_"), side(lat), F.lit("_"), side(lon)))


def ordered_distinct(c: Column) -> Column:
    """The array's values, each once, in the order of their first places; nulls and blanks go."""
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != "")))
