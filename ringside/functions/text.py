"""Text to typed columns. Strict parsers fail the job on junk, lenient ones give null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Divisions that a weight class label may name, and those without a class of weight.
KNOWN_DIVISIONS = (
    "Women's Strawweight",
    "Women's Flyweight",
    "Women's Bantamweight",
    "Women's Featherweight",
    "Strawweight",
    "Flyweight",
    "Bantamweight",
    "Featherweight",
    "Lightweight",
    "Welterweight",
    "Middleweight",
    "Light Heavyweight",
    "Heavyweight",
    "Catch Weight",
    "Open Weight",
)
NON_STANDARD_DIVISIONS = ("Catch Weight", "Open Weight")
# Marks of a missing figure.
DASHES = ("---", "--", "")

#: White space as Python's str.strip() sees it.
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def normalize_text(c: Column) -> Column:
    """Lower case with single spaces; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"(?U){SPACE}+", " "))


def url_id(c: Column) -> Column:
    """The 16 hexadecimal digits that end a path part, in lower case; else null."""
    found = F.lower(F.regexp_extract(strip(c), r"(?i)/([a-f0-9]{16})(?:$|/)", 1))
    return F.nullif(found, F.lit(""))


def synthetic_id(name: Column) -> Column:
    """An id made from a normalized name."""
    return F.concat(F.lit("synthetic_"), F.substring(F.sha2(normalize_text(name), 256), 1, 16))


def canonical_name(name: Column, aliases: dict[str, str]) -> Column:
    """The alias of a name (aliases: normalized name to name), else the stripped name; null becomes empty."""
    own = strip(F.coalesce(name, F.lit("")))
    if not aliases:
        return own
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(known, normalize_text(own)), own)


def full_name(first: Column, last: Column) -> Column:
    """Both parts, stripped, with a space between; missing parts leave no space."""
    return F.trim(F.concat(strip(F.coalesce(first, F.lit(""))), F.lit(" "), strip(F.coalesce(last, F.lit("")))))


def bout_sides(bout: Column) -> tuple[Column, Column]:
    """The two names around the first "vs"; both null unless there are two."""
    parts = F.split(bout, r"(?i)\s+vs\.?\s+", 2)
    two = F.size(parts) == 2
    return F.when(two, strip(F.get(parts, 0))), F.when(two, strip(F.get(parts, 1)))


def outcome_sides(outcome: Column) -> tuple[Column, Column]:
    """The results around "/"; a null outcome gives an empty first and a null second."""
    parts = F.split(F.coalesce(outcome, F.lit("")), "/", -1)
    return strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))


def round_number(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def _strict(c: Column, pattern: str, value: Callable[[Column], Column], what: str, *none: str) -> Column:
    """The value of a text that the pattern matches, stripped; null of null and of what stands for none; else the job fails.

    Most texts match as they are, and only the others are stripped, which takes longer than all the rest.
    """
    s, whole = strip(c), F.lit(f"^(?:{pattern})$")
    missing = s.isNull() | s.isin(*none) if none else s.isNull()
    bad = F.raise_error(F.concat(F.lit(f"not {what}: "), s))
    return F.when(F.rlike(c, whole), value(c)).when(missing, F.lit(None)).when(F.rlike(s, whole), value(s)).otherwise(bad)


def landed_attempted(c: Column) -> tuple[Column, Column]:
    """(landed, attempted) of "X of Y"; null stays null, anything else fails."""
    pattern = r"(\d+)\s+of\s+(\d+)"
    part = lambda k: lambda s: F.regexp_extract(s, pattern, k).try_cast("long")
    return tuple(_strict(c, pattern, part(k), "landed of attempted") for k in (1, 2))


def landed_attempted_lenient(c: Column) -> tuple[Column, Column]:
    """(landed, attempted) as doubles; signs and decimals are taken, everything else gives null."""
    pattern = r"(?i)^\s*([+-]?\d+(?:\.\d+)?)\s+of\s+([+-]?\d+(?:\.\d+)?)\s*$"
    return tuple(F.nullif(F.regexp_extract(c, pattern, k), F.lit("")).try_cast("double") for k in (1, 2))


def percentage(c: Column) -> Column:
    """0 to 100 from "N%"; dashes and null give null, anything else fails."""
    return _strict(c, r"\d+(?:\.\d+)?%", lambda s: F.regexp_extract(s, r"([\d.]+)", 1).try_cast("double"), "a percentage", *DASHES)


def percentage_lenient(c: Column) -> Column:
    """0 to 1 from "N%", or from a bare number (over 1: hundredths); junk gives null."""
    s = strip(c)
    bare = s.try_cast("double")
    return F.when(F.endswith(s, F.lit("%")), F.regexp_replace(s, "%$", "").try_cast("double") / 100).when(bare > 1, bare / 100).otherwise(bare)


def clock_seconds(c: Column) -> Column:
    """Seconds of "M:SS" with SS under 60; dashes and null give null, anything else fails."""
    pattern = r"(\d+):([0-5]\d)"
    part = lambda s, k: F.regexp_extract(s, pattern, k).try_cast("long")
    return _strict(c, pattern, lambda s: part(s, 1) * 60 + part(s, 2), "minutes and seconds", *DASHES)


def clock_seconds_lenient(c: Column) -> Column:
    """Seconds as a double; any numbers around one ":", junk gives null."""
    parts = F.split(strip(c), ":", -1)
    part = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    return F.when(F.size(parts) == 2, part(0) * 60 + part(1))


def ending_seconds(c: Column) -> Column:
    """Seconds of an ending time of whole numbers around one ":"; else null."""
    parts = F.split(strip(c), ":", -1)
    part = lambda k: F.get(parts, F.lit(k)).try_cast("long")
    return F.when(F.size(parts) == 2, part(0) * 60 + part(1))


def division(label: Column) -> Column:
    """The longest known division that the label names, else null."""
    out = F.lit(None).cast("string")
    for name in sorted(KNOWN_DIVISIONS, key=len):
        out = F.when(F.contains(label, F.lit(name)), F.lit(name)).otherwise(out)
    return out


def standard_result(c: Column) -> Column:
    return F.upper(strip(c))
