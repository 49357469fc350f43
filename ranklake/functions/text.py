"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean "unknown".
MISSING_WORDS = ("", "-", "--", "unknown", "none", "null", "n/a", "미상", "알 수 없음", "정보 없음")

#: Printable ASCII in its wide form, the wide blank, dashes and a few unit signs, with their plain forms.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000\u00a0\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u223c\u301c"
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)) + "  -------~~"
_BLANK = r"[\s\p{Z}\p{Cf}]"


def fold_width(c: Column) -> Column:
    """Wide characters, typographic dashes and unit signs in plain form; zero-width characters removed."""
    wide = F.translate(c, _WIDE, _PLAIN)
    wide = F.regexp_replace(wide, "[\u200b\u200c\u200d\u2060\ufeff\u00ad]", "")
    wide = F.regexp_replace(F.regexp_replace(wide, "㎏", "kg"), "㎎", "mg")
    return F.when(c.rlike(r"^[\n\r\t -~가-힣]*\z"), c).otherwise(wide)


def trimmed(c: Column) -> Column:
    """Without any kind of blank or invisible character at either end."""
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


def squeezed(c: Column) -> Column:
    return F.regexp_replace(trimmed(c), f"{_BLANK}+", " ")


def is_missing(c: Column, extra: tuple[str, ...] = ()) -> Column:
    """True for null, blank and the words for "unknown", in any case, width and surrounding blanks."""
    folded = F.lower(squeezed(fold_width(c)))
    return c.isNull() | folded.isin(*MISSING_WORDS, *(w.lower() for w in extra))


def known(c: Column, extra: tuple[str, ...] = ()) -> Column:
    """The trimmed value, null where it is missing."""
    return F.when(~is_missing(c, extra), trimmed(c))


def notice_number(c: Column) -> Column:
    """A notice number in full form, ``AB12-2026-00000345``; null where missing.

    Case, width, separators, missing leading zeros and letters typed for digits do not matter. What has not the shape
    of a number is kept in capitals with single dashes, so that equal spellings still meet.
    """
    plain = F.upper(F.regexp_replace(fold_width(c), r"[^0-9A-Za-z]+", "-"))
    plain = F.regexp_replace(plain, r"^-+|-+$", "")
    shape = r"^([A-Z]{2})-?([0-9OIL]{2})-?([0-9OIL]{4})-?([0-9OIL]{1,8})$"
    part = lambda k: F.translate(F.regexp_extract(plain, shape, k), "OIL", "011")
    full = F.concat(
        F.regexp_extract(plain, shape, 1), part(2), F.lit("-"), part(3), F.lit("-"), F.lpad(part(4), 8, "0")
    )
    long_way = F.when(~is_missing(c), F.when(plain.rlike(shape), full).otherwise(F.nullif(plain, F.lit(""))))
    return F.when(c.rlike(r"^[A-Z]{2}[0-9]{2}-[0-9]{4}-[0-9]{8}\z"), c).otherwise(long_way)


def canonical_hash(*cols: Column) -> Column:
    """64-bit hash of a row in which null, empty text and shifted values differ."""
    parts: list[Column] = []
    for c in cols:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)
