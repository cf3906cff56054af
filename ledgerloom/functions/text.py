"""Text cleaning expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped from names before two records are compared.
MATCH_STOP_WORDS = ("INC", "LLC", "LTD", "CORP", "CO", "&", "AND", "THE")
# Words dropped when an extracted vendor name is standardised.
VENDOR_STOP_WORDS = ("INC", "LLC", "LTD", "CORP", "CO", "&", "AND")

_EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(col: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(col, _EDGE_SPACE, "")


def words(col: Column) -> Column:
    """Split on runs of white space; a blank string has no words."""
    return F.filter(F.split(strip(col), r"(?U)\s+"), lambda w: w != "")


def word_set(col: Column) -> Column:
    return F.array_distinct(words(col))


def cleaned_words(col: Column) -> Column:
    """Word set of text that is already in match form: single spaces, no blanks at the ends."""
    return F.array_distinct(F.split(col, " "))


def _without(col: Column, stop: tuple[str, ...]) -> Column:
    return F.filter(words(F.upper(col)), lambda w: ~w.isin(*stop))


def clean_text(col: Column) -> Column:
    """Upper case, single spaces, business suffixes removed: the form used for matching."""
    return F.array_join(_without(col, MATCH_STOP_WORDS), " ")


def title_case(col: Column) -> Column:
    """Capitalise every letter that does not follow a letter (``Joe'S``, ``At&T``)."""
    parts = F.split(F.lower(col), r"(?<!\p{L})(?=\p{L})")
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))),
        "",
    )


def standard_vendor(col: Column) -> Column:
    """Vendor display form: business suffixes removed, title case."""
    return title_case(F.array_join(_without(col, VENDOR_STOP_WORDS), " "))


def upper_trim(col: Column) -> Column:
    return strip(F.upper(col))


def contains_pattern(col: Column, pattern: str) -> Column:
    """Case-insensitive regular-expression search that is false for missing text."""
    return F.coalesce(col.rlike("(?iu)" + pattern), F.lit(False))


def bracketed_array(col: Column) -> Column:
    """The text from the first ``[`` to the last ``]``, or null when there is none."""
    start = F.instr(col, "[")
    from_end = F.instr(F.reverse(col), "]")
    end = F.length(col) - from_end + 1
    return F.when(
        (start > 0) & (from_end > 0) & (end >= start), col.substr(start, end - start + 1)
    )
