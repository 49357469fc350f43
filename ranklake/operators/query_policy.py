"""Free queries brought to canonical words: typos, aliases, negated clauses, order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.operators.notices import tokens

# Case particles and clause ends of negation.
PARTICLES = ("으로", "에서", "이랑", "로", "은", "는", "이", "가", "을", "를", "와", "과", "도", "만", "의", "에")
NEGATION = r"(?:말고|빼고|제외하고|제외|아닌|않은|싫어|없는)"


@dataclass(frozen=True)
class Lexicon:
    """``canonical``: words in their order of assembly; ``aliases``: other spellings; ``phrases``: patterns rewritten first."""

    canonical: tuple[str, ...]
    aliases: dict[str, str] = field(default_factory=dict)
    phrases: dict[str, str] = field(default_factory=dict)
    least_typo: int = 3


def bare(word: Column) -> Column:
    """The word without one case particle at its end, if two characters or more remain."""
    return F.regexp_replace(word, rf"(?<=..)(?:{'|'.join(PARTICLES)})$", "")


def _mapping(pairs: dict[str, str]) -> Column:
    return F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))))


def normalised_queries(queries: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``query_id, canonical, corrected, removed, unknown`` of ``queries(query_id, query_text)``.

    Phrases are rewritten, clauses with a negation are taken out and reported, words are looked up as they are, without a
    particle, and as aliases; a word of at least ``least_typo`` characters that is one substitution away from exactly one
    known word is corrected. The canonical words come once each, in the lexicon's order; nothing is guessed for others. Null
    and blank texts give empty lists. The lexicon is bounded by being given in code; it is looked up inside the JVM.
    """
    text = F.lower(F.coalesce(F.col("query_text"), F.lit("")))
    for pattern, to in lexicon.phrases.items():
        text = F.regexp_replace(text, pattern, to)
    clause = rf"[^\s,.]+\s*{NEGATION}"
    removed = F.regexp_extract_all(text, F.lit(clause), 0)
    words = tokens(F.regexp_replace(text, clause, " "))
    known = {w: w for w in lexicon.canonical} | lexicon.aliases
    lookup = _mapping(known)
    masked: dict[str, set[str]] = {}
    for w in known:
        if len(w) >= lexicon.least_typo:
            for i in range(len(w)):
                masked.setdefault(f"{w[:i]}\x00{w[i + 1 :]}", set()).add(known[w])
    typos = _mapping({m: min(v) for m, v in masked.items() if len(v) == 1} or {"\x00": ""})

    def masks(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.overlay(w, F.lit("\x00"), i, F.lit(1)))

    def read(w: Column) -> Column:
        stem = bare(w)
        direct = F.coalesce(F.try_element_at(lookup, w), F.try_element_at(lookup, stem))
        near = F.array_distinct(
            F.filter(F.transform(masks(stem), lambda m: F.try_element_at(typos, m)), lambda x: x.isNotNull())
        )
        fixed = F.when((F.length(stem) >= lexicon.least_typo) & (F.size(near) == 1), near[0])
        return F.struct(
            w.alias("word"), F.coalesce(direct, fixed).alias("to"), (direct.isNull() & fixed.isNotNull()).alias("fixed")
        )

    read_words = queries.select("query_id", removed.alias("removed"), F.transform(words, read).alias("r"))
    has = lambda w: F.exists("r", lambda x: x["to"] == w)
    assembled = F.filter(F.array(*(F.when(has(w), w) for w in lexicon.canonical)), lambda x: x.isNotNull())
    pick = lambda cond: F.transform(F.filter("r", cond), lambda x: x["word"])
    return read_words.select(
        "query_id",
        assembled.alias("canonical"),
        pick(lambda x: x["fixed"]).alias("corrected"),
        "removed",
        pick(lambda x: x["to"].isNull()).alias("unknown"),
    )


def evidence_label(c: Column, positive: str, negative: str, window: int = 12) -> Column:
    """1 or -1 from asserted evidence in a text, 0 where there is none or both: a match followed within ``window``
    characters by a negation counts for the other side."""
    turned = rf"(?:(?!(?:않|없|아니|못|not|n't)).){{0,{window}}}(?:않|없|아니|못|not|n't)"
    says = lambda p: F.coalesce(c.rlike(rf"(?i)(?:{p})(?!{turned})"), F.lit(False))
    denies = lambda p: F.coalesce(c.rlike(rf"(?i)(?:{p}){turned}"), F.lit(False))
    yes, no = says(positive) | denies(negative), says(negative) | denies(positive)
    return F.when(yes & ~no, 1).when(no & ~yes, -1).otherwise(0)
