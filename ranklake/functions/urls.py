"""Addresses in one form each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranklake.functions.text import trimmed

# Parameters that say how a file is served or who shared it, not which file it is.
SERVING_PARAMETERS = (
    "w", "h", "width", "height", "size", "s", "q", "quality", "v", "ver", "t", "ts", "dpr", "fit", "crop", "auto",
    "fbclid", "gclid", "ref", "share",
)
_SIZE_STEP = r"(?:[whqcf]_[a-z0-9]+(?:,[a-z]+_[a-z0-9]+)*|resize[-_=]?\d+(?:x\d+)?|thumbs?|thumbnails?|\d+x\d+)"
_SIZE_MARK = r"[_-](?:xs|s|m|l|xl|thumb|thumbnail|small|medium|large|\d+x\d+)"
_SHAPE = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^?#]*)(?:\?([^#]*))?"
#: Addresses already in the one form after their scheme: nothing in them is to be folded, dropped or ordered.
_SETTLED = (
    r"^https?://(?:[a-z0-9-]+\.)+[a-z0-9-]*[a-z0-9](?:/(?!(?:thumbs?|thumbnails?|resize\d*(?:x\d+)?|\d+x\d+)/)[a-z0-9]+)+"
    r"(?:\.[a-z0-9]{1,5})?(?:\?(?!(?:" + "|".join(SERVING_PARAMETERS) + r")=)[a-z0-9]+=[A-Za-z0-9]+)?\z"
)


def picture_key(url: Column) -> Column:
    """Host and file of a picture's address, the same however it is written and in whatever size it is served.

    Scheme, user, standard port, fragment, case of host and ending, percent signs, doubled slashes, steps and marks of a
    size in the path, and the parameters for serving and sharing do not matter; other parameters count in any order. Null
    for what is no address.
    """
    text = trimmed(url)
    part = lambda k: F.regexp_extract(text, _SHAPE, k)
    host = F.regexp_replace(F.lower(part(1)), r"\.$", "")
    port = F.regexp_replace(part(2), r"^:(?:80|443)$", "")
    decoded = F.try_url_decode(F.replace(part(3), F.lit("+"), F.lit("%2B")))
    path = F.when(part(3).contains("%"), F.coalesce(decoded, part(3))).otherwise(part(3))
    path = F.regexp_replace(F.regexp_replace(path, r"/(?:\./)+", "/"), r"/{2,}", "/")
    path = F.regexp_replace(path, rf"/{_SIZE_STEP}(?=/)", "")
    ending = F.lower(F.regexp_extract(path, r"\.[A-Za-z0-9]{1,5}$", 0))
    stem = F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", ""), rf"{_SIZE_MARK}$", "")
    kept = F.filter(
        F.split(part(4), "&"),
        lambda p: (p != "")
        & ~F.lower(F.substring_index(p, "=", 1)).isin(*SERVING_PARAMETERS)
        & ~F.lower(p).startswith("utm_"),
    )
    query = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(host, port, stem, ending, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    settled = F.substring_index(url, "://", -1)
    return F.when(url.rlike(_SETTLED), settled).otherwise(F.when(host != "", whole))


_PRIVATE = (
    r"^(?:0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\."
    r"|^(?:22[4-9]|2[3-5]\d)\.|^\[|^localhost$|\.(?:localhost|local|internal|lan|home)$"
)


def safe_link(url: Column, longest: int = 2048) -> Column:
    """The address if it is an absolute http(s) address without credentials, blanks, backslashes or control characters,
    of at most ``longest`` characters and of no local or private host; else null."""
    text = trimmed(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(text, r"^[A-Za-z]+://([^/?#:]*|\[[^\]]*\])", 1)), r"\.$", "")
    shape = text.rlike(r"^(?i:https?)://[^/?#@\s\\]+(?:[/?#][^\s\\\x00-\x1f]*)?\z")
    return F.when(shape & (F.length(text) <= longest) & (host != "") & ~host.rlike(_PRIVATE), text)
