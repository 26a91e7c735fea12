"""Normalisers of raw text values, as column expressions that give null for what is not valid."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_strict(text: Column) -> Column:
    """A signed plain decimal of at most 64 characters as double, else null."""
    ok = F.length(text).between(1, 64) & text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")
    return F.when(ok, text.try_cast("double"))


def acquisition_minutes(raw: Column) -> Column:
    """Minutes of the day of HHMM digits, other characters stripped; 3 or 4 digits, hour to 23, minute to 59."""
    digits = F.regexp_replace(raw, r"\D", "")
    four = F.lpad(digits, 4, "0")
    hour, minute = F.substring(four, 1, 2).try_cast("int"), F.substring(four, 3, 2).try_cast("int")
    return F.when(F.length(digits).between(3, 4) & hour.between(0, 23) & minute.between(0, 59), hour * 60 + minute)


def confidence_code(raw: Column) -> Column:
    """h, n or l from a letter or word, u for a number of 0 to 100, else null."""
    low = F.lower(F.trim(raw))
    word = F.when(low.isin("h", "high"), "h").when(low.isin("n", "nominal"), "n").when(low.isin("l", "low"), "l")
    number = low.try_cast("double")
    return F.coalesce(word, F.when(number.between(0, 100), F.lit("u")))


def js_round(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards positive infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def pressure_hpa(raw: Column) -> Column:
    """Pressure in hPa: values under 100 are inches of mercury."""
    return js_round(F.when(raw < 100, raw * 33.8639).otherwise(raw), 1)


def humanize(token: Column) -> Column:
    """snake_case to words with a capital first letter."""
    words = F.regexp_replace(token, "_", " ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1_000_000))


def elapsed_label(minutes: Column) -> Column:
    """min, h min or d h; a negative time is a clock mismatch."""
    m = F.floor(minutes)
    return (
        F.when(m < 0, "clock mismatch")
        .when(m < 60, F.concat(m.cast("string"), F.lit(" min")))
        .when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit(" h "), (m % 60).cast("string"), F.lit(" min")))
        .otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit(" d "), F.floor(m % 1440 / 60).cast("string"), F.lit(" h")))
    )


def plain_text(html: Column) -> Column:
    """Text of simple HTML: scripts, styles and tags dropped, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))


#: Letters that are a letter and marks when decomposed, by rule from the Unicode tables, and those letters.
MARKED = "".join(c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if len(_bare(c)) == 1 and _bare(c) != c)
PLAIN = "".join(map(_bare, MARKED))


def fold(text: Column) -> Column:
    """Lower case without marks, whether they are part of a letter or stand behind it."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), MARKED, PLAIN)


def title_key(text: Column) -> Column:
    """Folded text of which only letters of a-z, α-ω and digits are left, words apart by one space."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9α-ω]+", " "))


def finite(text: Column) -> Column:
    """A number that is neither NaN nor infinite, else null; blank text is null."""
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def fixed_decimals(x: Column, digits: int) -> Column:
    """x as plain text with so many decimals (15 at most), without a sign for zero: the nearest such number to the exact value of the double, of two the larger size. For
    |x| * 10**digits below 2**52.

    10**digits is exact as a double; the product with x is taken as the sum of two doubles (Dekker), so that what lies just below or above a half is not
    rounded to it first: 1.005 is a little less than it says and gives 1.00.
    """
    size, scale = F.abs(x), float(10**digits)

    def halves(v: Column) -> tuple[Column, Column]:
        c = v * 134217729.0
        high = c - (c - v)
        return high, v - high

    p = size * scale
    (a, b), (c, d) = halves(size), halves(F.lit(scale))
    rest = ((a * c - p) + a * d + b * c) + b * d
    whole = F.floor(p)
    over = (p - whole) + rest  # how far the exact product is above its floor; may be below 0 or above 1 by the rest
    n = F.when(over >= 0.5, whole + 1).when(over < -0.5, whole - 1).otherwise(whole).cast("decimal(20,0)")
    text = F.lpad(n.cast("string"), digits + 1, "0") if digits else n.cast("string")
    text = F.when(F.length(n.cast("string")) > digits, n.cast("string")).otherwise(text)
    text = F.concat(F.substring(text, F.lit(1), F.length(text) - digits), F.lit("."), F.substring(text, F.length(text) - digits + 1, F.lit(digits))) if digits else text
    return F.when((x < 0) & (n > 0), F.concat(F.lit("-"), text)).otherwise(text)


def canonical_url(url: Column) -> Column:
    """An https URL without fragment: lower-case host, single slashes in the path and none at its end, parameters decoded, in order of name and value, and
    encoded as forms are. Null for another scheme, no host, or escapes that can't be decoded."""
    part = lambda pattern: F.regexp_extract(url, pattern, 1)
    host = F.lower(part(r"^(?i:https)://([^/?#]+)"))
    path = F.regexp_replace(part(r"^(?i:https)://[^/?#]+([^?#]*)"), "/+", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise("/")
    pairs = F.filter(F.split(part(r"^[^?#]*\?([^#]*)"), "&"), lambda x: x != "")
    decoded = lambda v: F.try_url_decode(v)
    named = F.transform(pairs, lambda x: F.struct(decoded(F.substring_index(x, "=", 1)).alias("k"), decoded(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    broken = F.exists(named, lambda e: e["k"].isNull() | e["v"].isNull())
    said = F.array_join(F.transform(F.array_sort(named), lambda e: F.concat(F.url_encode(e["k"]), F.lit("="), F.url_encode(e["v"]))), "&")
    return F.when((host != "") & ~broken, F.concat(F.lit("https://"), host, path, F.when(said != "", F.concat(F.lit("?"), said)).otherwise("")))
