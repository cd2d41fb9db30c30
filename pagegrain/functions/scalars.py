"""Scalar functions of the page domain, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Address blocks that a download must not reach (first address, prefix length).
BLOCKED = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]
#: Language codes and the reader's names for them.
LANGUAGES = {"korean": "korean", "ko": "korean", "ch": "ch", "zh": "ch", "en": "en", "ja": "japan", "japan": "japan"}


def extension(url: Column) -> Column:
    """The first of .jpg .jpeg .png .webp at the end of a url without query and fragment; else .jpg."""
    clean = F.lower(F.regexp_extract(url, "^[^?#]*", 0))
    out = F.lit(".jpg")
    for e in (".webp", ".png", ".jpeg", ".jpg"):
        out = F.when(clean.endswith(e), e).otherwise(out)
    return out


def hex_colour(text: Column, default: str) -> Column:
    """#RRGGBB of a 3- or 6-digit colour; the default for `auto` and what isn't a colour."""
    digits = F.regexp_replace(F.trim(text), "^#", "")
    six = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    return F.when(six.rlike("^[0-9a-fA-F]{6}$"), F.concat(F.lit("#"), F.upper(six))).otherwise(default)


def luminance(colour: Column) -> Column:
    """(299 R + 587 G + 114 B) / 1000 of #RRGGBB."""
    part = lambda at: F.conv(F.substring(colour, at, 2), 16, 10).cast("long")
    return (299 * part(2) + 587 * part(4) + 114 * part(6)) / 1000


def page_number(text: Column, pages: Column) -> Column:
    """A 1-based page number as a 0-based index; null if it is no number or no page."""
    n = F.when(text.rlike("^[1-9][0-9]{0,8}$"), F.try_to_number(text, F.lit("999999999")).cast("long"))
    return F.when(n <= pages, n - 1)


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(default))))


def _once(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is computed once, however often it is named: in an array it is a variable, not an expression that is copied."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def ipv4(text: Column) -> Column:
    """A dotted quad as a number, else null."""

    def number(t: Column, parts: Column) -> Column:
        whole = sum((parts[i].cast("long") * 256 ** (3 - i) for i in range(1, 4)), parts[0].cast("long") * 256**3)
        return F.when(t.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$") & F.forall(parts, lambda p: p.cast("int") <= 255), whole)

    return _once(text, lambda t: _once(F.split(t, r"\."), lambda parts: number(t, parts)))


def address_blocked(number: Column) -> Column:
    def inside(n: Column) -> Column:
        out = F.lit(False)
        for base, bits in BLOCKED:
            a, b, c, d = map(int, base.split("."))
            low = ((a * 256 + b) * 256 + c) * 256 + d
            out = out | n.between(low, low + 2 ** (32 - bits) - 1)
        return out

    return _once(number, inside)


def natural_key(text: Column) -> Column:
    """A key under which runs of digits compare as numbers and the rest without case."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda t: F.when(t.rlike(r"^\d"), F.concat(F.lpad(F.length(F.regexp_replace(t, "^0+(?=.)", "")).cast("string"), 6, "0"), F.lit("~"), F.regexp_replace(t, "^0+(?=.)", ""))).otherwise(t)), "")


def language_name(code: Column) -> Column:
    """The name a code stands for; other values pass."""
    out = code
    for short, name in LANGUAGES.items():
        out = F.when(F.lower(code) == short, name).otherwise(out)
    return out


def line_height(ascent: Column, descent: Column, stroke: Column) -> Column:
    return F.floor(F.greatest(ascent + descent, F.lit(8)) * 1.18) + 2 * stroke


def moved(box: tuple[str, str, str, str], dx: Column, dy: Column, w: int, h: int) -> list[Column]:
    """A rectangle moved as far as the page allows."""
    x1, y1, x2, y2 = map(F.col, box)
    dx, dy = F.greatest(-x1, F.least(dx, w - x2)), F.greatest(-y1, F.least(dy, h - y2))
    return [(x1 + dx).alias("x1"), (y1 + dy).alias("y1"), (x2 + dx).alias("x2"), (y2 + dy).alias("y2")]


def reader(lang: Column) -> Column:
    """Which reader of text a language takes, and by which name it knows it."""
    return F.when(lang == "ja", F.struct(F.lit("page").alias("reader"), F.lit(None).cast("string").alias("name"))).otherwise(F.struct(F.lit("lines").alias("reader"), language_name(lang).alias("name")))
