"""Text cleaning as column expressions; everything stays within the row, nothing shuffles."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that go, and lines of page headers and footers (matched from the start of the stripped line).
CONTROL, NON_CHARS, ZERO_WIDTH = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", r"[\x{feff}\x{fffe}\x{ffff}]", r"[\x{200b}-\x{200f}\x{2028}\x{2029}]"
PAGE_LINES = [r"第\s*\d+\s*页.*$", r"Page\s*\d+.*$", r"-\s*\d+\s*-$", r"\d+\s*/\s*\d+$", r"共\s*\d+\s*页.*$"]


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def remove_garbage(c: Column) -> Column:
    for pattern in (CONTROL, NON_CHARS, ZERO_WIDTH):
        c = F.regexp_replace(c, pattern, "")
    return c


def drop_header_footer(c: Column) -> Column:
    page = "(?iU)^(?:" + "|".join(PAGE_LINES) + ")"
    return F.array_join(F.filter(lines(c), lambda x: ~strip(x).rlike(page)), "\n")


def normalize_ws(c: Column) -> Column:
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(F.array_join(F.transform(lines(c), rstrip), "\n"), "\n{4,}", "\n\n\n")
    return F.array_join(F.transform(lines(c), lambda x: F.when(strip(x).startswith("|"), x).otherwise(F.regexp_replace(x, r"[ \t]{2,}", " "))), "\n")


def clean_text(c: Column) -> Column:
    """Garbage, page lines and white space removed; null stays null."""
    return strip(normalize_ws(drop_header_footer(remove_garbage(c))))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def sanitize_text(c: Column, max_length: int = 2000) -> Column:
    """Compatibility-normalised, without other control, format or private characters, at most max_length long."""
    c = F.regexp_replace(_nfkc(c), r"[\p{C}&&[^\n\r\t]]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), "\n{3,}", "\n\n")
    return F.left(strip(c), F.lit(max_length))


def normalize_value(c: Column) -> Column:
    """Full-width digits, point and per cent to half width; no white space."""
    return F.regexp_replace(F.translate(c, "０１２３４５６７８９．％", "0123456789.%"), r"(?U)\s+", "")
