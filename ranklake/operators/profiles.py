"""Typed facts about an animal from the fields and texts of its notice, and three-valued comparisons with a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.functions.text import known

# The names under which sources deliver a field, in order of preference.
ALIASES: dict[str, tuple[str, ...]] = {
    "record_id": ("desertionNo", "desertion_no", "dog_id", "notice_id"),
    "age": ("age", "age_text"),
    "weight": ("weight", "weight_kg"),
    "size": ("size", "size_hint"),
    "sex": ("sex", "sexCd"),
    "neuter": ("neuter", "neuterYn", "neutered"),
    "breed": ("breed", "kindNm", "kindCd"),
    "breed_source": ("breed_source",),
    "color": ("color", "colorCd"),
    "happen_date": ("happen_date", "happenDt"),
    "description": ("merged_desc", "desc_full", "desc", "specialMark", "vlm_desc", "description"),
    "behavior_text": ("notice_behavior_text", "specialMark", "desc_full", "desc", "description"),
    "status": ("process_state", "processState", "source_status"),
    "notice_end": ("notice_end", "noticeEdt"),
    "notice_start": ("notice_start", "noticeSdt"),
    "notice_no": ("notice_no", "noticeNo"),
    "last_verified_at": ("last_verified_at", "fetched_at", "collected_at", "received_at"),
    "source_url": ("detail_url", "source_url", "url"),
    "image_text": ("image_urls", "image_url", "popfile", "popfile1"),
    "upstream_updated_at": ("upstream_updated_at", "updTm"),
    "safety_health_note": ("safety_health_note", "sfeHealth"),
    "safety_social_note": ("safety_social_note", "sfeSoci"),
    "behavior_evidence_source": ("behavior_evidence_source",),
    "care_name": ("care_name", "careNm"),
    "care_tel": ("care_tel", "careTel"),
    "care_addr": ("care_addr", "careAddr"),
    "org_name": ("org_name", "orgNm"),
    "happen_place": ("happen_place", "happenPlace"),
    "housing": ("housing_types", "housing_type", "suitable_housing"),
    "photo_quality": ("photo_quality_score",),
}
# Phrases by which a notice says what it asks of a home.
ACTIVITY = {"high": ("활동량 많", "운동량 많"), "low": ("활동량 적", "운동량 적"), "medium": ("활동량 보통", "운동량 보통")}
EXPERIENCE = {"experienced": ("경험자 필요", "경험자 권장", "숙련 보호자"), "none": ("초보 가능", "초보자 가능", "첫 반려견 가능")}
CHILDREN = {True: ("아이와 생활 가능", "아동과 생활 가능", "어린이 친화"), False: ("아이 없는 가정", "아동과 생활 어려움", "어린이 동거 불가")}
OTHER_PETS = {
    True: ("다른 동물과 생활 가능", "다른 반려동물과 생활 가능", "합사 가능"),
    False: ("다른 동물 없는 가정", "합사 불가", "다른 반려동물과 생활 어려움"),
}
HEALTH = ("접종", "심장사상충", "중성화", "건강검진")
ABSENCE = r"혼자\s*([0-9]+(?:[.,][0-9]+)?)\s*시간[^.\n]*(?:가능|괜찮|잘\s*지냄)"
TRUSTED_SOURCES = ("shelter", "official", "rescue_group")


def canonical(df: DataFrame, names: dict[str, tuple[str, ...]] | None = None) -> dict[str, Column]:
    """Each canonical field as the first alias among the columns of ``df`` whose value is known; null if there is none."""
    out = {}
    for field, aliases in (names or ALIASES).items():
        there = [known(F.col(a).cast("string")) for a in aliases if a in df.columns]
        out[field] = F.coalesce(*there) if there else F.lit(None).cast("string")
    return out


def _number(c: Column, pattern: str) -> Column:
    return F.replace(F.regexp_extract(c, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")


def age_years(c: Column, reference_year: int) -> Column:
    """Years of age: from a year of birth, else years or months said, else the words for under 60 days; null if negative."""
    born = F.nullif(F.regexp_extract(c, r"((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")
    since = F.when(born <= reference_year, (F.lit(reference_year) - born).cast("double"))
    years, months = _number(c, r"(-?[0-9]+(?:[.,][0-9]+)?)\s*(?:살|세)"), _number(c, r"(-?[0-9]+(?:[.,][0-9]+)?)\s*개월")
    return (
        F.when(born.isNotNull() & c.contains("년생"), since)
        .when(years.isNotNull(), F.when(years >= 0, years))
        .when(months.isNotNull(), F.when(months >= 0, months / 12))
        .when(c.contains("60일미만"), F.lit(2.0) / 12)
        .otherwise(since)
    )


def said(c: Column, phrases: dict) -> Column:
    """The first key any of whose phrases occurs in the text; null if none does."""
    out = F.lit(None).cast("boolean" if all(isinstance(k, bool) for k in phrases) else "string")
    for key, words in reversed(phrases.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.coalesce(F.lower(c).contains(w), F.lit(False))
        out = F.when(hit, F.lit(key)).otherwise(out)
    return out


def absence_hours(c: Column) -> Column:
    hours = _number(c, ABSENCE)
    return F.when((hours >= 0) & (hours <= 24), hours)


def named_words(c: Column, words: tuple[str, ...]) -> Column:
    """The words of a list that occur in the text, in the list's order."""
    return F.filter(F.array(*(F.when(c.contains(w), w) for w in words)), lambda x: x.isNotNull())


def state(applies: Column, met: Column) -> Column:
    """matched, caution or unknown where a condition applies, null where it does not; ``met`` is null if not known."""
    return F.when(applies, F.when(met.isNull(), "unknown").when(met, "matched").otherwise("caution"))


def place_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def rank_in(c: Column, order: tuple[str, ...]) -> Column:
    return F.nullif(F.array_position(F.array(*(F.lit(x) for x in order)), c), F.lit(0))


def condition_states() -> dict[str, Column]:
    """The state of nine conditions from columns of a profile (``preferred_*``, ``housing``, ``hours``, ``activity``,
    ``experience_of``, ``has_children``, ``has_pets``) and of typed facts as ``typed_facts`` names them."""
    wanted, there = place_key(F.col("preferred_region")), place_key(F.col("region"))
    near = F.when(F.col("region") != "unknown", there.contains(wanted) | wanted.contains(there))
    levels = ("none", "some", "experienced")
    unless_unknown = lambda c: F.when(F.col(c) != "unknown", F.col(c))
    every = F.lit(True)
    return {
        "size_state": state(F.col("preferred_size") != "any", unless_unknown("size") == F.col("preferred_size")),
        "age_state": state(F.col("preferred_age") != "any", unless_unknown("age_group") == F.col("preferred_age")),
        "region_state": state(F.coalesce(wanted, F.lit("")) != "", near),
        "housing_state": state(every, F.when(F.size("housing_types") > 0, F.array_contains("housing_types", F.col("housing")))),
        "activity_state": state(every, F.col("activity_level_hint") == F.col("activity")),
        "absence_state": state(every, F.col("hours") <= F.col("max_absence_hours")),
        "experience_state": state(
            every, rank_in(F.col("experience_of"), levels) >= rank_in(F.col("recommended_experience"), levels)
        ),
        "children_state": state(F.col("has_children"), F.col("children_compatible")),
        "pets_state": state(F.col("has_pets"), F.col("other_pets_compatible")),
    }


def compatibility_of(states: list[str]) -> dict[str, Column]:
    """Share of the conditions that apply which are matched, and share of them about which anything is known."""
    count = lambda *kinds: sum((F.when(F.col(s).isin(*kinds), 1).otherwise(0) for s in states), F.lit(0))
    applies = count("matched", "caution", "unknown")
    return {
        "compatibility": F.coalesce(F.try_divide(count("matched"), applies), F.lit(0.0)),
        "evidence_coverage": F.coalesce(F.try_divide(count("matched", "caution"), applies), F.lit(0.0)),
    }
