"""Small text expressions shared by the parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: A noncharacter, which no text holds: parts what one pattern has told apart.
MARK = "\uffff"
#: Case-insensitive by Unicode, Unicode classes, and only a line feed ends a line.
FLAGS = "(?iUd)"
#: What ``\\s`` is among all of Unicode.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends. Only the ends are looked at: a pattern would try each character."""
    return F.trim(c, F.lit(WHITE))


def clean(c: Column) -> Column:
    """Stripped text; null and the placeholders for "no value" become empty."""
    c = strip(F.coalesce(c, F.lit("")))
    return F.when(F.lower(c).isin("-", "null", "n/a", "none", "unknown"), "").otherwise(c)


def or_unknown(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", UNKNOWN).otherwise(c)


def group(c: Column, pattern: str, n: int) -> Column:
    """A capture group; null where the pattern doesn't match, empty where the group took no part."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, n))


def let(value: Column, body) -> Column:
    """``body`` of a value that it names many times, without writing the value's expression out each time."""
    return F.get(F.transform(F.array(value), body), 0)


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normal_header(name: str | None) -> str:
    """A column name without byte order mark, white space, underscores and hyphens, in lower case."""
    return "".join(ch for ch in (name or "").lstrip("\ufeff") if not ch.isspace() and ch not in "_-").lower()
