"""Typed columns and predicates of notices, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranklake.functions import vocabulary as V
from ranklake.functions.text import is_missing, known, squeezed, trimmed


def notice_date(c: Column) -> Column:
    """A date written yyyyMMdd, yyyy-MM-dd or yyyy.MM.dd; null for anything else."""
    text = trimmed(c)
    each = [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyyMMdd", "yyyy-MM-dd", "yyyy.MM.dd")]
    return F.coalesce(*each).cast("date")


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    """Whether any term occurs, without regard to case; null text contains nothing."""
    quoted = "|".join(re.escape(t) for t in terms)
    return F.coalesce(c.rlike(f"(?i)(?:{quoted})"), F.lit(False))


def flag(c: Column) -> Column:
    """Three-valued truth from the usual words; null for every other value."""
    text = F.lower(trimmed(c.cast("string")))
    return F.when(text.isin("true", "yes", "y", "1", "active", "검색가능"), True).when(
        text.isin("false", "no", "n", "0", "inactive", "검색불가"), False
    )


def notice_status(state: Column, end: Column, reference: date, searchable: Column | None = None) -> Column:
    """active, closed, expired or unknown at a reference date; the rules hold in this order.

    Closing words close, "adopted" closes unless adoption is still open, an end before the reference date expires, an
    explicit no closes; then active words, an open adoption, an explicit yes or a coming end make it active. ``state`` is
    a cleaned text (null if missing), ``end`` a date.
    """
    text = F.coalesce(state, F.lit(""))
    compact = F.replace(text, F.lit(" "), F.lit(""))
    lowered = F.lower(compact)
    ends = end
    says = searchable if searchable is not None else F.lit(None).cast("boolean")
    adoption_open = contains_any(compact, V.ADOPTION_OPEN_TOKENS)
    return (
        F.when(lowered.isin("closed", "inactive"), "closed")
        .when(lowered == "expired", "expired")
        .when(contains_any(text, V.HARD_CLOSED_TOKENS), "closed")
        .when(text.contains("입양") & ~adoption_open, "closed")
        .when(ends < F.lit(reference), "expired")
        .when(says == F.lit(False), "closed")
        .when((lowered == "active") | adoption_open | contains_any(text, V.ACTIVE_TOKENS) | (says == F.lit(True)), "active")
        .when(ends >= F.lit(reference), "active")
        .otherwise("unknown")
    )


def first_number(c: Column) -> Column:
    """The first number in a text, thousands commas removed."""
    digits = F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"([0-9]+(?:\.[0-9]+)?)", 1)
    return digits.try_cast("double")


def size_bucket(kg: Column) -> Column:
    return F.when(kg <= 3, "tiny").when(kg <= 8, "small").when(kg <= 18, "medium").when(kg.isNotNull(), "large")


def age_bucket(age: Column, reference_year: int) -> Column:
    """puppy, adult or senior from a birth year in the text, else from words; empty if neither is there."""
    text = trimmed(F.coalesce(age, F.lit("")))
    born = F.nullif(F.regexp_extract(text, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")
    years = F.lit(reference_year) - born
    return (
        F.when(born.isNotNull(), F.when(years <= 1, "puppy").when(years >= 8, "senior").otherwise("adult"))
        .when(contains_any(text, ("puppy", "개월", "새끼")), "puppy")
        .when(contains_any(text, ("senior", "노령", "노견")), "senior")
        .when(contains_any(text, ("adult", "성견")), "adult")
        .otherwise("")
    )


def breed_name(c: Column) -> Column:
    """The breed without a bracketed prefix; null for unknown labels and bare codes."""
    name = squeezed(F.regexp_replace(c, r"^\s*\[[^\]]*\]\s*", ""))
    return F.when(~is_missing(name) & ~name.rlike(r"^[0-9]+$"), name)


def listed(c: Column, pattern: str = r"[,;|\n]+") -> Column:
    """The distinct trimmed parts of a delimited text in their order."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), pattern), trimmed)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def matching_labels(c: Column, mapping: dict[str, tuple[str, ...]], broader: tuple[str, str] | None = None) -> Column:
    """The keys any of whose words occurs, in the mapping's order.

    ``broader = (specific, broad)`` drops the broad key where its words occur only inside words of the specific one.
    """
    tests = {key: contains_any(c, terms) for key, terms in mapping.items()}
    if broader:
        specific, broad = broader
        rest = c
        for term in mapping[specific]:
            rest = F.regexp_replace(rest, f"(?i){term}", " ")
        tests[broad] = tests[broad] & (~tests[specific] | contains_any(rest, mapping[broad]))
    return F.filter(F.array(*(F.when(ok, key) for key, ok in tests.items())), lambda x: x.isNotNull())


def first_region(c: Column, regions: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The first region of an ordered list any of whose hints occurs in the text; empty if none does."""
    out = F.lit("")
    for name, hints in reversed(regions):
        hit = F.lit(False)
        for h in hints:
            hit = hit | c.contains(h)
        out = F.when(hit, name).otherwise(out)
    return out


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits and Hangul syllables."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9A-Za-z가-힣]+"), 0)
    return F.transform(found, lambda t: F.lower(t))


def parsed_query(c: Column) -> dict[str, Column]:
    """The conditions a query text names: facets, personality, visibility, least photo quality and key words."""
    text = F.coalesce(c, F.lit(""))
    facets = {name: matching_labels(text, terms, V.BROADER.get(name)) for name, terms in V.FACETS.items()}
    young = text.rlike("어린(?!이)")
    facets["age_hint"] = F.when(young, F.array_union(facets["age_hint"], F.array(F.lit("puppy")))).otherwise(facets["age_hint"])
    facets["personality"] = F.filter(
        F.array(*(F.when(text.contains(t), t) for t in V.PERSONALITY_TERMS)), lambda x: x.isNotNull()
    )
    words = F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*V.STOPWORDS))
    hidden = contains_any(text, ("얼굴 안", "얼굴 가려", "얼굴이 안", "face hidden"))
    shown = contains_any(text, ("얼굴 잘", "얼굴이 잘", "정면", "눈이 잘", "face visible"))
    return facets | {
        "face_visible": F.when(hidden, False).when(shown, True),
        "whole_body_visible": F.when(contains_any(text, ("전신", "몸 전체", "whole body")), True),
        "min_photo_quality": F.when(contains_any(text, ("사진 선명", "사진 잘", "잘 보이는 사진", "고화질")), 0.65),
        "keywords": F.slice(words, 1, 20),
    }


def expanded_query(text: Column, facets: dict[str, Column]) -> Column:
    """The query followed by its labelled conditions."""
    parts = [F.nullif(trimmed(text), F.lit(""))]
    for name, label in V.FACET_LABELS.items():
        parts.append(F.when(F.size(facets[name]) > 0, F.concat(F.lit(f"{label} "), F.array_join(facets[name], " "))))
    parts.append(F.when(facets["face_visible"], "얼굴이 잘 보이는 사진"))
    parts.append(F.when(facets["whole_body_visible"], "전신이 보이는 사진"))
    return F.concat_ws(" ", *parts)


def labelled_text(fields: dict[str, Column]) -> Column:
    """``label value`` of every non-missing field, joined by commas."""
    return F.concat_ws(", ", *(F.concat(F.lit(f"{label} "), known(c)) for label, c in fields.items()))


def asserted(c: Column, hints: Iterable[str], before: str = "안|못|not|no", after: str = "않|없|아니|못") -> Column:
    """Whether a hint occurs without a negation just before it or within 8 characters after it."""
    words = "|".join(hints)
    return F.coalesce(F.lower(c).rlike(rf"(?<!(?:{before})\s{{0,3}})(?:{words})(?!.{{0,8}}\s*(?:{after}))"), F.lit(False))


def whole_word(c: Column, label: Column) -> Column:
    """Whether the label occurs as a whole word, allowing a case particle after it."""
    edge = "[0-9A-Za-z가-힣]"
    quoted = F.regexp_replace(label, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    pattern = F.concat(
        F.lit(f"(?i)(?<!{edge})"), quoted, F.lit(f"(?:으로|로|은|는|이|가|을|를|와|과|도|만|의|에서|에)?(?!{edge})")
    )
    return F.regexp_like(c, pattern)
