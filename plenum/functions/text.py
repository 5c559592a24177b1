"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_or(text: Column, other: Column) -> Column:
    """text, or other where text is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), other)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def listed(text: Column) -> Column:
    """The non-empty, stripped items of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def joined(separator: str, *parts: Column) -> Column:
    """The parts that are neither null nor empty."""
    return F.concat_ws(separator, *(F.nullif(p, F.lit("")) for p in parts))


def price_range(text: Column) -> Column:
    """(low, high): the first and last whole number of a text; 0 where there is none."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*)"), F.lit(1))
    at = lambda i: F.coalesce(F.regexp_replace(F.try_element_at(found, F.lit(i)), ",", "").try_cast("long"), F.lit(0))
    return F.struct(at(1).alias("low"), at(-1).alias("high"))


def country_and_venue(text: Column) -> Column:
    """``Country (Venue)`` in two; without brackets all of it is the country and the venue is null."""
    pattern = r"^\s*(.*?)\s*\(([^)]+)\)\s*$"
    venue = F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))
    return F.struct(F.when(venue.isNull(), strip(text)).otherwise(F.regexp_extract(text, pattern, 1)).alias("country"), strip(venue).alias("venue"))


def slug(text: Column, mark: str = ".") -> Column:
    """Lower case, runs of anything but letters and digits as one mark, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", mark), F.lit(mark))


def clipped(text: Column, most: int = 220) -> Column:
    """The first characters and an ellipsis where the text is longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def short_code(text: Column) -> Column:
    """The last eight characters, in upper case."""
    return F.upper(F.right(text, F.lit(8)))


def initials(name: Column) -> Column:
    """First letters of the first and the last word, two letters of a single word, ``?`` without any."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != "")
    two = F.concat(F.left(F.try_element_at(words, F.lit(1)), F.lit(1)), F.left(F.try_element_at(words, F.lit(-1)), F.lit(1)))
    return F.upper(F.when(F.size(words) == 0, "?").when(F.size(words) == 1, F.left(F.try_element_at(words, F.lit(1)), F.lit(2))).otherwise(two))


def xml_escaped(text: Column) -> Column:
    for mark, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = F.replace(text, F.lit(mark), F.lit(f"&{name};"))
    return text


def hash31(text: Column) -> Column:
    """Polynomial hash to the base 31 over UTF-16 code units, modulo 2**32 (long)."""
    step = lambda h, unit: (h * 31 + unit).bitwiseAND(F.lit(0xFFFFFFFF))

    def add(h: Column, character: Column) -> Column:
        c = F.ascii(character).cast("long")
        pair = step(step(h, F.floor((c - 0x10000) / 0x400) + 0xD800), F.pmod(c, F.lit(0x400)) + 0xDC00)
        return F.when(c < 0x10000, step(h, c)).otherwise(pair)

    characters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(characters, F.lit(0).cast("long"), add)


def certificate_code(text: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(hash31(text))), 16, "0"))


def palette_index(text: Column, colours: int = 8) -> Column:
    """hash31 as a signed 32-bit number, its absolute value modulo the colours."""
    h = hash31(text)
    return F.abs(F.when(h >= 2**31, h - 2**32).otherwise(h)) % colours


def compact(n: Column) -> Column:
    """8412 as 8.4K, 1204000 as 1.2M; whole multiples without a decimal."""

    def short(unit: int, letter: str) -> Column:
        return F.concat(F.when(n % unit == 0, F.format_string("%.0f", n / unit)).otherwise(F.format_string("%.1f", n / unit)), F.lit(letter))

    return F.when(n >= 1_000_000, short(1_000_000, "M")).when(n >= 1000, short(1000, "K")).otherwise(n.cast("string"))


def plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def compact_plain(n: Column) -> Column:
    """As compact(), but rounded before ``.0`` goes, and with thousands separators below 1000."""

    def short(unit: int, letter: str) -> Column:
        return F.concat(F.regexp_replace(F.format_string("%.1f", F.round(n / unit, 1)), r"\.0$", ""), F.lit(letter))

    return F.when(n >= 1_000_000, short(1_000_000, "M")).when(n >= 1000, short(1000, "K")).otherwise(F.format_number(n, 0))


def uri_encoded(text: Column) -> Column:
    """Percent encoding, a space as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def new_id(prefix: str = "") -> Column:
    """A random id for each row; it differs each time a frame is computed, so rows should be written before ids are used."""
    return F.concat(F.lit(prefix), F.uuid())
