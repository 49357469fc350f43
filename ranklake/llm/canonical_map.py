"""Freely typed values mapped to the entries of a reference list.

Every distinct value is normalised into readings; each reading asks a character n-gram inverted index over the names of the
list, which gives the weighted cosine with every name that shares an n-gram. The entry of the highest cosine is taken if it
is above a threshold and leads any other entry by a margin; as an exact check its letters are compared at the end.

The index holds the reference list, whose size is bounded, so every task builds it for itself from the list; the values,
whose number has no bound, are spread over all tasks and never come together.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.operators.ngram_index import edit_distance
from ranklake.session import bounded_rows, small_side

#: Most names (labels and aliases together) that a reference list may have.
MOST_NAMES = 100_000
#: Least cosine of an entry, and its least lead over any other entry.
THRESHOLD, MARGIN = 0.2, 0.02

# Words beside a name that say how sure, where or how much, and endings of places.
BESIDE = frozenset(
    "추정 닮음 종 아마 개 인근 쪽 부근 근처 전체 희망 살아요 거주 위주 계열 털 연한 진한 옅은 밝은 어두운 짙은 엷은 "
    "light dark pale deep bright maybe probably near about".split()
)
BESIDE_PATTERN = re.compile(r"\d+구역|\d+동|중앙동")
PLACE_ENDING = re.compile(r"(?<=[가-힣]{2})(?:시|군|구)$|-(?:si|gun|gu)$")


def plain(value: str) -> str:
    """Composed, in plain width and lower case, without brackets and marks; the words parted by single blanks."""
    text = unicodedata.normalize("NFKC", value).casefold()
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    for enclosed in (r"\[[^\[\]]*\]", r"\([^()]*\)"):
        rest = re.sub(enclosed, " ", text)
        if re.search(r"\w", rest):
            text = rest
    return re.sub(r"[\s_]+", " ", re.sub(r"[^\w\s-]+", " ", text)).strip()


def tight(text: str) -> str:
    return re.sub(r"[\s-]+", "", text)


def readings(value: str, longest: int) -> dict[str, bool]:
    """Texts under which the value may be in the list, best first: all of it, without words beside it, runs of words.

    The first two may be misspelt (True), a run of words must be a name as it is (False); runs longer than the ``longest``
    name, in letters, can be none.
    """
    text = plain(value)
    words = [w for w in re.split(r"[\s-]+" if re.search("[가-힣]", text) else r"\s+", text) if w]
    core = [w for w in words if w not in BESIDE and not BESIDE_PATTERN.fullmatch(w)]
    if len(words) > 1:
        core = [re.sub(r"(?<=[가-힣]{2})에$", "", w) for w in core]
    runs = []
    for a in range(len(core)):
        run = ""
        for b in range(a, len(core)):
            run += tight(core[b])
            if len(run) > longest:
                break
            runs.append((b - a, -a, run))
    out = {tight(text): True, tight("".join(core)): True}
    for *_, run in sorted(runs, reverse=True):
        if len(run) > 1:
            out.setdefault(run, False)
    return {t: near for t, near in out.items() if t}


def jamo(text: str) -> str:
    return unicodedata.normalize("NFD", text)


def other_letter(x: str, y: str) -> float:
    """Cost of one character for another: for syllables 0.8 for each differing part, at most 2."""
    if not ("가" <= x <= "힣" and "가" <= y <= "힣"):
        return 1.0 if x.isascii() and y.isascii() else 2.0
    a, b = ord(x) - 0xAC00, ord(y) - 0xAC00
    return min(2.0, 0.8 * ((a // 588 != b // 588) + (a // 28 % 21 != b // 28 % 21) + (a % 28 != b % 28)))


def letters_apart(a: str, b: str) -> float:
    a, b = unicodedata.normalize("NFC", a), unicodedata.normalize("NFC", b)
    return edit_distance(a, b, swap=0.9, twin=0.9, differs=other_letter)


def grams(text: str, sizes: tuple[int, ...] = (1, 2, 3)) -> Counter:
    """All n-grams of a text between marks for its ends; of size 1, the characters without marks."""
    marked = f"^{text}$"
    out = Counter(text) if 1 in sizes else Counter()
    for n in sizes:
        if n > 1:
            out.update(marked[i : i + n] for i in range(len(marked) - n + 1))
    return out


class NameIndex:
    """The inverted lists of the names of one field: for each n-gram the names that have it, with weights.

    A gram weighs ``ln(1 + N / df)`` over the N names, one that no name has as much as the rarest could.
    """

    def __init__(self, names: list[tuple[str, str]]) -> None:
        self.names = [n for n, _ in names]
        self.entries = [i for _, i in names]
        self.longest = max(map(len, self.names))
        counts = [grams(jamo(n)) for n in self.names]
        df = Counter(g for c in counts for g in c)
        self.idf = {g: float(np.log1p(len(names) / n)) for g, n in df.items()}
        self.unknown = float(np.log1p(len(names)))
        norms = [np.sqrt(sum((tf * self.idf[g]) ** 2 for g, tf in c.items())) for c in counts]
        lists: dict[str, list[tuple[int, float]]] = {}
        for k, c in enumerate(counts):
            for g, tf in c.items():
                lists.setdefault(g, []).append((k, tf * self.idf[g] / norms[k]))
        self.lists = {g: (np.array([k for k, _ in x]), np.array([w for _, w in x])) for g, x in lists.items()}

    def cosines(self, text: str, only_exact: bool) -> np.ndarray | None:
        """The weighted cosine of a text with each name; ``only_exact`` stops at the first gram that no name has."""
        asked = grams(jamo(text))
        if only_exact and any(g not in self.idf for g in asked):
            return None
        total, ids, weights = 0.0, [], []
        for g, tf in asked.items():
            w = tf * self.idf.get(g, self.unknown)
            total += w * w
            if g in self.lists:
                k, v = self.lists[g]
                ids.append(k)
                weights.append(v * w)
        if not ids:
            return None
        return np.bincount(np.concatenate(ids), np.concatenate(weights), len(self.names)) / np.sqrt(total)

    def meaning(self, value: str, threshold: float, margin: float, most_apart: float) -> tuple[str, float | None, float | None]:
        """``ref_id, cosine, apart``: the entry of the highest cosine, "none" if it is too low, too close or too far apart."""
        found: dict[str, list[tuple[float, str, str]]] = {}
        for text, near in readings(value, self.longest).items():
            cosines = self.cosines(text, not near)
            if cosines is None:
                continue
            for k in np.flatnonzero(cosines >= (threshold if near else 1 - 1e-9)):
                if cosines[k] >= 1 - 1e-9 and text == self.names[k]:
                    return self.entries[k], 1.0, 0.0
                if near:
                    found.setdefault(self.entries[k], []).append((float(cosines[k]), text, self.names[k]))
        if not found:
            return "none", None, None
        ranked = sorted(((max(c for c, *_ in x), e) for e, x in found.items()), key=lambda x: (-x[0], x[1]))
        cosine, entry = ranked[0]
        if len(ranked) > 1 and cosine - ranked[1][0] < margin:
            return "none", None, None
        # The exact check: one of the names of the entry has nearly the same letters.
        spare = lambda name: max(most_apart, len(jamo(name)) // 16)
        close = [
            letters_apart(t, n) for _, t, n in found[entry] if abs(len(jamo(t)) - len(jamo(n))) <= 3 * spare(n)
            and letters_apart(t, n) <= spare(n)
        ]
        return (entry, cosine, min(close)) if close else ("none", None, None)


_BUILT: dict[tuple, dict[str, NameIndex]] = {}


def _indexes(names: tuple[tuple[str, str, str], ...]) -> dict[str, NameIndex]:
    """The index of each field, built once a process."""
    if names not in _BUILT:
        fields: dict[str, list[tuple[str, str]]] = {}
        for field, name, entry in names:
            fields.setdefault(field, []).append((name, entry))
        _BUILT.clear()
        _BUILT[names] = {f: NameIndex(n) for f, n in fields.items()}
    return _BUILT[names]


def reference_names(refs: DataFrame, place_fields: tuple[str, ...] = ()) -> DataFrame:
    """``field, ref_id, name`` of a reference list ``field_name, ref_id, label, label_en, aliases``.

    Aliases are parted by bars. In ``place_fields`` a name also counts without the ending that tells the kind of place.
    The list is refused beyond MOST_NAMES rows. A name that stands for two entries goes to the one of the lower id.
    """
    rows = bounded_rows(refs.select("field_name", "ref_id", "label", "label_en", "aliases"), MOST_NAMES)
    names: dict[tuple[str, str], str] = {}
    for r in sorted(rows, key=lambda r: (str(r.field_name), str(r.ref_id))):
        if r.field_name is None or r.ref_id is None:
            continue
        for n in [r.label, r.label_en, *(r.aliases or "").split("|")]:
            forms = [plain(n or "")]
            if r.field_name in place_fields:
                forms.append(PLACE_ENDING.sub("", forms[0]))
            for form in forms:
                if tight(form):
                    names.setdefault((r.field_name, tight(form)), r.ref_id)
    return refs.sparkSession.createDataFrame(
        [(f, i, n) for (f, n), i in names.items()], "field string, ref_id string, name string"
    )


def map_to_list(
    values: DataFrame,
    names: DataFrame,
    *,
    threshold: float = THRESHOLD,
    margin: float = MARGIN,
    most_apart: float = 1.0,
) -> DataFrame:
    """The entry of a reference list that each value means: ``field, value, ref_id, cosine, apart``.

    ``values(field, value)`` are deduplicated and normalised; ``names`` as ``reference_names`` gives them. Candidates come
    from a character n-gram inverted index over the letters (Hangul taken apart), scored by weighted cosine. The entry of
    the highest cosine needs a cosine of ``threshold``, a lead of ``margin`` over any other entry, and as an exact check at
    most ``most_apart`` weighted edits (for names of 16 letters or more one for each 16). What has none gets ``ref_id``
    "none". Null values are left out, blank ones get "none"; an empty table gives no rows; repeated values come out once.
    Values in a field without entries get "none".
    """
    spark = values.sparkSession
    listed = tuple(sorted((r.field, r.name, r.ref_id) for r in bounded_rows(names, 3 * MOST_NAMES)))

    def meant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indexes = _indexes(listed)
        for b in batches:
            found = [
                indexes[f].meaning(v, threshold, margin, most_apart) if f in indexes else ("none", None, None)
                for f, v in zip(b.field, b.value, strict=True)
            ]
            yield pd.concat([b, pd.DataFrame(found, columns=["ref_id", "cosine", "apart"], index=b.index)], axis=1)

    distinct = values.where("value IS NOT NULL AND field IS NOT NULL").select("field", "value").distinct()
    # A number of partitions of its own: the values are short, so they would all be put together, but each costs time.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shape = "field string, value string, ref_id string, cosine double, apart double"
    return distinct.repartition(tasks, "value").mapInPandas(meant, shape)


def mapped_rows(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """``rows(field, row_id, value)`` with their entry: ``field, row_id, ref_id``; equal rows come out once.

    The mapping is broadcast only when counted small; else both sides are shuffled and hot values split at run time.
    """
    mapping = small_side(mapping.select("field", "value", "ref_id"))
    return rows.join(mapping, ["field", "value"]).select("field", "row_id", "ref_id").distinct()
