"""Words and ASCII case as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"  # \x20 and \x09 to \x0D
SPACES_PATTERN = "[ \\t-\\r]+"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, unlike lower(), whose results serve for texts that it leaves alone and for ASCII: they are faster."""
    low = F.lower(c)
    return F.when(low == c, c).when(F.octet_length(c) == F.length(c), low).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """The runs of characters other than ASCII white space; null and blank texts have none."""
    t = F.trim(F.coalesce(c, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES_PATTERN))


def word_count(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACES_PATTERN))).cast("long")
