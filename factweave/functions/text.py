"""Names, slugs, parsed quantities and other scalar text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(c: Column) -> Column:
    """Lower case, words of letters and digits, one space between."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    """P17."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def normalize_source(c: Column, codes: dict[str, str]) -> Column:
    """To canonical codes; unknown ones keep their normalised form."""
    n = F.regexp_replace(F.trim(F.lower(c)), "[^a-z0-9]+", "_")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[n], n)


def strip_phase(c: Column) -> Column:
    """Without a trailing ``Phase II`` or ``Phase-2``."""
    return F.trim(F.regexp_replace(c, r"(?i)[\s,(-]*phase[\s-]*([0-9]+|[ivx]+)\)?\s*$", ""))


#: What ``\\s`` matches.
_SPACE = " \t\n\x0b\f\r"


def _number(found: Column) -> Column:
    """The number of a match of number, spaces and unit: the match is taken once, not by a pattern for each part."""
    return F.rtrim(found, F.lit(_SPACE + "abcdefghijklmnopqrstuvwxyz"))


def _unit(found: Column) -> Column:
    return F.ltrim(found, F.lit(_SPACE + "0123456789.-"))


def parse_amount(c: Column) -> Column:
    """P20: ``1.2 Cr``, ``85 lakh``, ``40k`` to a number."""
    found = F.regexp_extract(F.replace(F.lower(c), F.lit(","), F.lit("")), r"[0-9]+(?:\.[0-9]+)?\s*(?:crore|cr|lakh|lac|l|k)?", 0)
    n, unit = _number(found), _unit(found)
    times = F.when(unit.isin("crore", "cr"), 1e7).when(unit.isin("lakh", "lac", "l"), 1e5).when(unit == "k", 1e3).otherwise(1.0)
    return F.when(n != "", n.cast("double") * times)


def parse_range(c: Column, crore: float = 1.0) -> Column:
    """A struct (lo, hi) of the first and the last number, thousands separators aside; one value gives both, none gives null.

    ``crore`` scales texts that name crores: 100 makes lakhs of them, the unit of prices.
    """
    text = F.replace(F.lower(c), F.lit(","), F.lit(""))
    n = F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    scale = F.when(F.contains(text, F.lit("cr")), crore).otherwise(1.0)
    return F.when(F.size(n) > 0, F.struct((F.get(n, F.lit(0)).cast("double") * scale).alias("lo"), (F.get(n, F.size(n) - 1).cast("double") * scale).alias("hi")))


def parse_distance_km(c: Column) -> Column:
    """Only if exactly one distance with a unit occurs, and it is not negative. A sign before the number counts."""
    pattern = F.lit(r"(?i)-?[0-9]+(?:\.[0-9]+)?\s*(?:kilomet(?:re|er)s?|kms?|met(?:re|er)s?|m)\b")
    found = F.regexp_extract_all(c, pattern, F.lit(0))
    one = F.lower(F.get(found, F.lit(0)))
    km = _number(one).cast("double") / F.when(_unit(one).startswith("k"), 1.0).otherwise(1000.0)
    return F.when((F.size(found) == 1) & (km >= 0), km)


def display_amount(v: Column) -> Column:
    """Crores and lakhs with at most two decimals."""
    trimmed = lambda x: F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", "")
    return F.when(v >= 1e7, F.concat(trimmed(v / 1e7), F.lit(" Cr"))).when(v >= 1e5, F.concat(trimmed(v / 1e5), F.lit(" L"))).otherwise(F.format_string("%.0f", v))


def display_range(lo: Column, hi: Column) -> Column:
    """One amount if both are equal."""
    return F.when(lo == hi, display_amount(lo)).otherwise(F.concat(display_amount(lo), F.lit(" - "), display_amount(hi)))


def render(template: Column, value: Column, precision: int = 1) -> Column:
    """``{value}`` with a precision and without trailing zeros."""
    return F.replace(template, F.lit("{value}"), F.regexp_replace(F.format_string(f"%.{precision}f", value), r"\.?0+$", ""))


def content_id(prefix: str, *cols: Column) -> Column:
    """P25: a prefix and the SHA-256 of the values in order, nulls marked."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols]), 256))


def parse_time(c: Column) -> Column:
    """RFC 3339, then a day, then a month; else null."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.try_to_timestamp(c, F.lit("yyyy-MM")))


#: Contact data and identifiers of persons, each with what takes its place.
PRIVATE: dict[str, str] = {
    r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}": "[mail]",
    r"(?i)\b[a-z]{5}[0-9]{4}[a-z]\b": "[identifier]",
    r"(?i)\b(account|a/c)\s*(no\.?|number)?\s*[:#-]?\s*[a-z0-9-]{6,}\b": "[account]",
    r"(?<![0-9])\+?[0-9][0-9 ()-]{7,}[0-9]": "[phone]",
}


def redact(c: Column, names: list[str] = ()) -> Column:
    """Mail addresses, identifiers, accounts, phone numbers, known names in any case (the longest first, so that no part of one stays),
    and whole lines of address or signature. Null stays null."""
    out = c
    for pattern, instead in PRIVATE.items():
        out = F.regexp_replace(out, pattern, instead)
    for n in sorted({n.strip() for n in names} - {""}, key=lambda n: (-len(n), n)):
        out = F.regexp_replace(out, "(?iu)" + _literal(n), "[name]")
    return F.regexp_replace(out, r"(?im)^[ \t]*((residential )?address[ \t]*:|(signed|signature)[ \t]*(by)?[ \t]*:?).*$", "[line]")


def is_private(c: Column, names: list[str] = ()) -> Column:
    """Whether contact data, an identifier, an account or a known name in any case is left."""
    found = F.lit(False)
    for pattern in [*PRIVATE, *("(?iu)" + _literal(n.strip()) for n in names if n.strip())]:
        found = found | c.rlike(pattern)
    return found


def _literal(n: str) -> str:
    return "".join(x if x.isalnum() else "\\" + x for x in n)


def key_matches(key: Column, pattern: str) -> Column:
    """``*``, ``x*``, ``*x``, ``*x*``."""
    return key.like(pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%"))


def registration_id(c: Column) -> Column:
    """Trimmed, spaces collapsed, upper case; null unless ASCII and not empty."""
    n = F.upper(F.regexp_replace(F.trim(c), r"\s+", " "))
    return F.when((n != "") & ~n.rlike(r"[^\x20-\x7e]"), F.sha2(n, 256))


def contains_phrase(tokens: Column, phrase: list[str]) -> Column:
    """Whether the tokens hold the phrase in a row."""
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(" " + " ".join(phrase) + " "))


def max_tag_value(c: Column) -> Column:
    """The highest of a semicolon list; each value above 1000 is volts and becomes kilovolts first. What is no number, with or without ``kV``, is left out."""
    n = F.transform(F.split(c, ";"), lambda x: F.trim(F.replace(F.lower(x), F.lit("kv"), F.lit(""))).try_cast("double"))
    return F.array_max(F.transform(n, lambda v: F.when(v > 1000, v / 1000).otherwise(v)))
