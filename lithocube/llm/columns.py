"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the contracts, [\x20\x09-\x0D], without the blank itself.
BREAKS = "\t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def word_list(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text in order; empty for null, empty and blank texts."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), BREAKS, " " * len(BREAKS)))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " +"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row. The optimizer may merge projections and so move an array into the
    lambda that indexes it, where it would be made anew for every element; a lambda's variable stays as it is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    """How many words a text has, as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chars_without(text: Column, drop: str) -> Column:
    """Code points of a text that are not in `drop`."""
    return F.length(F.translate(text, drop, "")).cast("long")


def unit_interval(*parts: Column, hex_digits: int = 12) -> Column:
    """A double in (0, 1) from the md5 of the parts joined by colons; any engine with md5 gives the same."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("\x00null")) for p in parts]))
    whole = F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("double")
    return (whole + 0.5) / F.lit(float(16**hex_digits))


def md5_bucket(*parts: Column, buckets: int) -> Column:
    """A bucket 0 .. buckets - 1 from the md5 of the parts joined by colons."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("\x00null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % buckets).cast("int")
