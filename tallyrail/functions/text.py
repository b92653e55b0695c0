"""Fixed-width payload fields and keyword tests."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(payload: str, position: int, length: int) -> Column:
    """A payload field; NULL if the payload ends before it."""
    return F.nullif(F.substring(payload, position, length), F.lit(""))


def field_at(payload: str, position: str, length: str) -> Column:
    """As `field`, with position and length taken from columns."""
    return F.nullif(F.substr(F.col(payload), F.col(position), F.col(length)), F.lit(""))


def has_keywords(payload: str, keywords: Iterable[str], like: bool = False) -> Column:
    """All keywords occur in the payload; a blank keyword meets every non-null payload.

    Keywords are literal text. With `like=True`, `%` and `_` in them are wildcards.
    """
    column = F.col(payload)
    tests = [column.isNotNull()]
    for word in keywords:
        if word:
            tests.append(column.like(f"%{word}%") if like else column.contains(F.lit(word)))
    return reduce(and_, tests)


def amount_text(amount: str) -> Column:
    """Amount for display, with thousands separators and two decimals."""
    return F.format_number(amount, 2)


def category_code(code: str) -> Column:
    """Merchant category code with blanks removed and short numbers padded to four digits."""
    text = F.trim(code)
    return F.when(text.rlike("^[0-9]{1,3}$"), F.lpad(text, 4, "0")).otherwise(text)
