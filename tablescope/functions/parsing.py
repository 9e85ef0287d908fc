"""Text to number, datetime and boolean, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in text.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"

# Date layouts tried in this order (month first, then day first).
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy-M-d H:m:s",
    "yyyy-M-d'T'H:m:s",
    "yyyy/M/d",
    "M/d/yyyy",
    "M/d/yyyy H:m:s",
    "d/M/yyyy",
    "M-d-yyyy",
    "d-M-yyyy",
    "MMM d yyyy",
    "MMM d, yyyy",
    "d MMM yyyy",
    "yyyyMMdd",
)

# The shape a text must have before a layout is tried on it.
DATE_SHAPE = (
    r"^\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?)?"
    r"|\d{1,2}[-/]\d{1,2}[-/]\d{4}( \d{1,2}:\d{1,2}:\d{1,2})?"
    r"|[A-Za-z]{3} \d{1,2},? \d{4}|\d{1,2} [A-Za-z]{3} \d{4}|\d{8})\s*$"
)

# Boolean words.
TRUE_WORDS = ("true", "yes", "1", "t")
FALSE_WORDS = ("false", "no", "0", "f")


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of every kind, not blanks only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def parse_datetime(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    text = strip(c)
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    iso = F.when(text.rlike(r"^\d{4}-"), text.try_cast("timestamp_ntz"))
    return F.when(c.rlike(DATE_SHAPE), F.coalesce(iso, *tries))


def parse_boolean(c: Column) -> Column:
    word = F.lower(c)
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def is_number(c: Column) -> Column:
    return parse_number(c).isNotNull()


def is_date(c: Column) -> Column:
    return parse_datetime(c).isNotNull()
