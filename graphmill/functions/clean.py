"""Cleaning of profile and news columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = "N/A"

# The honorific and legal-form tokens dropped from names.
NAME_TOKENS = [r"Mr\.", r"Mrs\.", r"Ms\.", r"Dr\.", r"Inc\.", r"Corp\.", r"plc", r"Ltd\."]

# Prefix lengths by use.
NODE_DESCRIPTION = 500
VECTOR_DESCRIPTION = 1000
DIGEST = 10000
LABEL_INFO = 300
COMPANY_INFO = 400


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def blank_to_null(c: Column | str) -> Column:
    """Placeholders, empty text and the text of a missing number become null."""
    text = strip(c)
    return F.when(~text.isin(PLACEHOLDER, "", "nan", "NaN"), _col(c))


def clean_number(c: Column | str) -> Column:
    """Text to double; placeholders, unreadable text and NaN become null."""
    number = _col(c).try_cast("double")
    return F.when(~F.isnan(number), number)


def normalise_ticker(c: Column | str) -> Column:
    return F.translate(_col(c), ".", "-")


def prefix(c: Column | str, length: int) -> Column:
    return F.substring(_col(c), 1, length)


def flatten_lines(c: Column | str) -> Column:
    return strip(F.replace(_col(c), F.lit("\n"), F.lit(" ")))


def clean_name(c: Column | str, whole_tokens: bool = False) -> Column:
    """Drop honorifics and legal forms.

    The default pattern closes with a word boundary after the dot, so ``Mr. X`` stays and
    ``Mr.X`` loses its title. ``whole_tokens`` gives the corrected reading: a token counts when
    white space or the end of the text follows it.
    """
    tokens = "|".join(NAME_TOKENS)
    pattern = rf"(?i)\b({tokens})(?=\s|$)" if whole_tokens else rf"(?i)\b({tokens})\b"
    return strip(F.regexp_replace(F.coalesce(_col(c), F.lit("")), pattern, ""))


def parse_news_date(c: Column | str, as_of: Column | str) -> Column:
    """``Jul 8 2020`` to a date; anything else becomes ``as_of``, never the wall clock."""
    fallback = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return F.coalesce(F.try_to_date(strip(c), "MMM d yyyy"), fallback)


def split_list(c: Column | str, separator: str = ";") -> Column:
    """A joined list to an array of trimmed, non-empty items."""
    parts = F.transform(F.split(_col(c), rf"\Q{separator}\E"), strip)
    return F.filter(parts, lambda part: part != "")


def present(c: Column | str) -> Column:
    """True for text that is neither null, empty nor a placeholder."""
    return F.coalesce(blank_to_null(c).isNotNull(), F.lit(False))
