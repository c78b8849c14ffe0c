"""Column expressions for names, addresses, tags and keywords. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = ""


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(EMPTY))


def first_of(*cs: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def squish(c: Column) -> Column:
    """Trimmed, every run of white space one space; empty becomes null."""
    return blank_to_null(F.trim(F.regexp_replace(c, "(?U)\\s+", " ")))


def title_case(c: Column) -> Column:
    """Squished; each run of letters starts upper and goes on lower, whatever parts the runs (C11)."""
    parts = F.regexp_extract_all(squish(c), F.lit("(\\p{L}+|\\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def name_parts(c: Column) -> Column:
    """Words of a name (C7): the first is the given name, the rest the family name."""
    return F.filter(F.split(F.trim(c), "\\s+"), lambda w: w != EMPTY)


def first_name(c: Column) -> Column:
    return F.get(name_parts(c), 0)


def last_name(c: Column) -> Column:
    return blank_to_null(F.array_join(F.slice(name_parts(c), F.lit(2), F.greatest(F.size(name_parts(c)) - 1, F.lit(0))), " "))


def address(c: Column) -> Column:
    """A mail address: trimmed, lower, what is inside angle brackets if there are any."""
    c = F.lower(F.trim(c))
    return F.coalesce(blank_to_null(F.trim(F.regexp_extract(c, "<([^>]*)>", 1))), blank_to_null(c))


def addresses(c: Column) -> Column:
    """Array of addresses trimmed, lower, distinct, sorted; empties dropped."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != EMPTY))))


def domain(c: Column) -> Column:
    """What follows the first @, lower; null without one."""
    return blank_to_null(F.lower(F.regexp_extract(c, "@(.*)$", 1)))


def slug(c: Column) -> Column:
    """Letters and digits lower, all else an underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]", "_"), F.lit("_"))


def tag(kind: str, c: Column) -> Column:
    """``kind:`` and the value lower with underscores for spaces; null for null."""
    return F.concat(F.lit(f"{kind}:"), F.replace(F.lower(c), F.lit(" "), F.lit("_")))


def keywords(c: Column, most: int = 12, least_length: int = 3) -> Column:
    """The first ``most`` distinct lower-case ASCII words of at least three characters, as first seen."""
    found = F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), lambda x: F.length(x) >= least_length)
    return F.slice(F.array_distinct(found), 1, most)


def header_date(c: Column) -> Column:
    """An RFC 2822 date as a timestamp; without a zone it is UTC; null if it isn't one."""
    c = F.regexp_replace(F.trim(c), "^[A-Za-z]{3},\\s*", "")
    c = F.regexp_replace(F.regexp_replace(c, "\\s+(GMT|UTC|Z)$", " +0000"), "\\s+\\([^)]*\\)$", "")
    zoned = F.when(c.rlike("[+-]\\d{4}$"), c).otherwise(F.concat(c, F.lit(" +0000")))
    return F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z"))
