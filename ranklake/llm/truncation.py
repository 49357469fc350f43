"""Texts that lost their end to a field limit or a broken transfer.

First the lengths of all texts are recomputed as a store might count them: characters, UTF-8 and double-byte bytes, with
entities or JSON escapes, with CR LF for new lines. Grouped by source and length, a hidden limit shows as a heap of texts
just at it and few beyond. Then the endings are inspected. Some show by themselves that they are cut: half a character,
half a tag or entity, a comma. For the others the corpus itself tells whether a writer stops there: of all places where
the last two words occur within texts, how often does a sentence, line or item end after them, and how often do more
words or more letters of the same word follow. A text at a limit needs less evidence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklake.session import cut, small_side, stored

_STOP, _PAUSE, _START, _ANY = "\x02", "\x03", "\x01", "\x04"
#: Sorts after every text that begins with the text before it.
_LAST = "\U0010ffff"
_BLANKS = r"[\s\p{Z}\p{Cf}]"
#: Places where the last two words must occur before their own evidence counts, and for the last word alone words before.
LEAST_PLACES, LEAST_PLACES_WORD = 5, 3
#: Share of all places of two words that ends of other texts must be before they count beside places within texts.
ENDS_COUNT_FROM = 0.1
#: Share of places with a stop below which an ending is cut, and the same for a text at a limit.
CUT_BELOW, CUT_BELOW_AT_LIMIT = 0.1, 0.3
#: A limit leaves at most so many units unused: the rest of a character, or a word.
SLACK = 5
#: Nothing is as short as to lie before a heap of up to so many units, so none can be told from short texts.
LEAST_LIMIT = 2 * (SLACK + 1)
#: The ways in which a store may count the length of a text.
MEASURES = (
    "characters", "utf8_bytes", "double_byte", "entities", "entities_utf8", "json", "json_ascii", "crlf", "crlf_utf8",
)

_TAG_OPEN = re.compile(r"/?[a-z][a-z0-9]*(?:\s+[\w:-]+(?:=(?:\"[^\"]*\"?|'[^']*'?|[^\s\"'>]*))?)*\s*/?|/?", re.I)
_TAG = re.compile(r"</?[a-z][a-z0-9]*\s*/?>", re.I)
_ENTITY_OPEN = re.compile(r"#?[a-z0-9]{0,8}", re.I)
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")


def _blank(c: str) -> bool:
    return c in " \t\n\x0b\f\r" or unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cf")


def _word_character(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def tail_of(text: str) -> str:
    """Without blanks at the end."""
    end = len(text)
    while end and _blank(text[end - 1]):
        end -= 1
    return text[:end]


def bare_of(text: str) -> str:
    """Without blanks at the end and without the dots that a cut may have left there; a single full stop stays."""
    end, dots = len(text), False
    while end:
        c = text[end - 1]
        if c == "." and (dots or text[max(0, end - 2)] == "." and end > 1):
            dots = True
        elif c != "…" and not _blank(c):
            break
        end -= 1
    return text[:end]


def sizes_of(text: str) -> list[int]:
    """The length of a text as different stores count it, in the order of MEASURES; half a character at the end is none."""
    text = text.rstrip("�")
    n, octets = len(text), len(text.encode("utf-8", "surrogatepass"))
    wide = n - len(text.encode("ascii", "ignore"))
    quotes, breaks, returns = text.count('"'), text.count("\n"), text.count("\r")
    entities = 4 * text.count("&") + 3 * (text.count("<") + text.count(">")) + 5 * (quotes + text.count("'"))
    escapes = quotes + text.count("\\") + breaks + returns + text.count("\t")
    added = breaks - returns
    return [
        n, octets, n + wide, n + entities, octets + entities, n + escapes, n + escapes + 5 * wide, n + added, octets + added,
    ]


def ending_of(text: str) -> str | None:
    """How the whole text ends: what shows a cut by itself, "open" where the corpus has to tell, null where it is whole."""
    tail, bare = tail_of(text), bare_of(text)
    if not tail:
        return None
    if tail[-1] == "�" or "ᄀ" <= tail[-1] <= "ᇿ":
        return "character"
    at = tail.rfind("<")
    if at >= 0 and ">" not in tail[at:] and _TAG_OPEN.fullmatch(tail, at + 1):
        return "markup"
    at = tail.rfind("&", len(tail) - 10)
    if at >= 0 and _ENTITY_OPEN.fullmatch(tail, at + 1):
        return "markup"
    dotted = len(bare) < len(tail)
    in_address = lambda t: t.rsplit(None, 1)[-1].find("://") > 0 if t else False
    closed = tail.rstrip("\"'”’)]")
    if not dotted and closed and not in_address(tail):
        if closed[-1] in "!?~。" or (closed[-1] == "." and not (len(closed) > 1 and closed[-2] in "0123456789")):
            return None
    if not bare:
        return "open"
    last, before = bare[-1], bare[-2:-1]
    if last in ",:;" and (not before or _word_character(before) or before in " \t\n\x0b\f\r"):
        return "pause"
    at = max(bare.rfind(c) for c in "()[]\n")
    if 0 <= at < len(bare) - 1 and bare[at] in "([" and (at == 0 or bare[at - 1] in " \t\n\x0b\f\r"):
        return "markup"
    if last in "-‐–" and before and _word_character(before):
        return "word"
    if last == ">" and _TAG.fullmatch(bare, max(0, bare.rfind("<"))):
        return None
    if not dotted and last != "." and not _word_character(last) and not in_address(bare):
        return None
    return "open"


def text_digest(bare: str) -> int:
    """64 bits that stand for a text without its blanks."""
    squeezed = "".join(_UNSEEN.sub("", bare).split())
    return xxhash.xxh64_intdigest(squeezed.encode("utf-8", "surrogatepass")) - (1 << 63)


def read_texts(c: Column) -> Column:
    """``text, n_bare, sizes, reason, digest`` of each text in one pass; ``text`` only where composing changed it."""

    @F.pandas_udf("text string, n_bare int, sizes array<int>, reason string, digest long")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                t = t or ""
                nfc = None if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)
                t = t if nfc is None else nfc
                bare = bare_of(t)
                rows.append((nfc, len(bare), sizes_of(t), ending_of(t), text_digest(bare)))
            yield pd.DataFrame(rows, columns=["text", "n_bare", "sizes", "reason", "digest"])

    return read(c)


def measured_sizes(c: Column) -> Column:
    """The lengths of each text, in the order of MEASURES."""

    @F.pandas_udf("array<int>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else sizes_of(t))

    return measure(c)


def _by_measure(sizes: Column) -> Column:
    return F.map_from_arrays(F.array(*(F.lit(m) for m in MEASURES)), sizes)


def hidden_limits(docs: DataFrame) -> DataFrame:
    """``source, measure, size_limit, n_at, n_before, n_beyond``: lengths at which a source's texts heap up.

    ``n_at`` texts lie within SLACK units below the limit, ``n_before`` is what as many units held on average just below,
    ``n_beyond`` how many lie in the ten units beyond. A limit needs 8 texts, three times those before, and at most a
    third as many beyond. Every heap has its limit: of sizes within SLACK that see the same heap, one remains if none above
    holds as many texts itself and none below over three times as many, so texts that leave a character unused do not hide
    those that fill the limit. The table of lengths has one row per source, measure and length, whatever the number of texts.
    """
    sized = docs.where("text IS NOT NULL").select("source", measured_sizes(F.col("text")).alias("sizes"))
    return _heaps(sized.select("source", F.explode(_by_measure(F.col("sizes"))).alias("measure", "size")))


def _heaps(measured: DataFrame) -> DataFrame:
    sizes = measured.groupBy("source", "measure", "size").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source", "measure").orderBy("size")
    near = F.sum("n").over(order.rangeBetween(-SLACK, 0))
    before = F.coalesce(F.sum("n").over(order.rangeBetween(-8 * (SLACK + 1), -2 * (SLACK + 1) - 1)), F.lit(0)) / 6
    beyond = F.coalesce(F.sum("n").over(order.rangeBetween(1, 10)), F.lit(0))
    heaps = sizes.select(
        "source", "measure", F.col("size").alias("size_limit"), near.alias("n_at"), before.alias("n_before"),
        beyond.alias("n_beyond"), "n",
    ).where("n_at >= 8 AND n_at >= 3 * n_before AND n_beyond * 3 <= n_at")
    heaps = heaps.where(F.col("size_limit") > LEAST_LIMIT)
    order = Window.partitionBy("source", "measure").orderBy("size_limit")
    below = F.coalesce(F.max("n").over(order.rangeBetween(-SLACK, -1)), F.lit(0))
    above = F.coalesce(F.max("n").over(order.rangeBetween(1, SLACK)), F.lit(0))
    seen = heaps.withColumns({"below": below, "above": above})
    return seen.where("below <= 3 * n AND above < n").drop("n", "below", "above")


def words(c: Column) -> Column:
    """The words of a text, with a mark where a sentence, line or item ends and one where it pauses; digits are all 0."""
    c = F.when(c.contains("<"), F.regexp_replace(c, r"(?i)</?[a-z][a-z0-9]*\s*/?>", "\n")).otherwise(c)
    c = F.regexp_replace(c, r"[0-9]", "0")
    c = F.regexp_replace(c, r"[\[\]()\"'“”‘’<>{}]", " ")
    c = F.regexp_replace(c, rf"[.!?~…。;♥]+(?=\s|\z)|(?<=\s|^)[^\p{{L}}\p{{N}}\s#,:{_STOP}]+(?=\s|\z)|[\n\r]+", f" {_STOP} ")
    c = F.regexp_replace(c, r"[,:]+(?=\s|\z)", f" {_PAUSE} ")
    every = F.filter(F.split(c, rf"{_BLANKS}+"), lambda w: w != "")
    return F.transform(every, lambda w: F.when(w.startswith("http"), F.translate(w, "abcdef", "000000")).otherwise(w))


def _single_stops(every: Column) -> Column:
    """Of several stops in a row the first."""
    return F.filter(every, lambda w, i: (w != _STOP) | (i == 0) | (F.get(every, i - 1) != _STOP))


def _places(docs: DataFrame) -> DataFrame:
    """``before, word, stops, goes_on, ends``: every pair of words of the corpus and how often what follows it.

    Copies of a text end there once: ``ends`` counts distinct ``digest``, the others count places.
    """
    at = lambda i: F.get("words", i)
    place = F.transform(
        "words",
        lambda w, i: F.struct(
            F.coalesce(F.when(i > 0, at(i - 1)), F.lit(_START)).alias("before"),
            w.alias("word"),
            at(i + 1).alias("next"),
        ),
    )
    # After a label, as in "contact: name", what matters is whether any word goes on, so these places count once more.
    labels = F.transform(
        F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"] == _PAUSE),
        lambda x: F.struct(
            F.concat(F.coalesce(at(x["i"] - 1), F.lit("")), F.lit(_PAUSE)).alias("before"),
            F.when(at(x["i"] + 1).isNotNull(), _ANY).otherwise(_STOP).alias("word"),
            at(x["i"] + 2).alias("next"),
        ),
    )
    place = F.concat(place, labels)
    rows = docs.select("digest", F.explode(F.filter(place, lambda p: ~p["word"].isin(_STOP, _PAUSE))).alias("p"))
    rows = rows.select("digest", "p.*")
    rows = rows.withColumn("before", F.when(F.col("before") == _STOP, _START).otherwise(F.col("before")))
    follows = F.col("next")
    # One row a distinct text that ends there, and one for all places where more follows.
    each = rows.groupBy("before", "word", F.when(follows.isNull(), F.col("digest")).alias("ending")).agg(
        F.count(F.when(follows == _STOP, 1)).alias("stops"),
        F.count(F.when(follows.isNotNull() & ~follows.isin(_STOP, _PAUSE), 1)).alias("goes_on"),
        F.count(F.lit(1)).alias("n"),
    )
    return each.groupBy("before", "word").agg(
        F.sum("stops").alias("stops"),
        F.sum("goes_on").alias("goes_on"),
        F.count("ending").alias("ends"),
        F.sum("n").alias("n"),
    )


def _longer(keys: list[str], at: DataFrame, wanted: DataFrame) -> DataFrame:
    """``keys, longer``: what the places of all words that go on after a wanted word sum up to.

    Words that begin with a wanted word follow it in order. So both are sorted together and the sum up to the wanted word
    is taken from the sum up to the last word that may begin with it. No prefixes are made, so a word of a million letters
    costs what it is long. Sorted apart by what stands before and by the first letter, only where a word is wanted.
    """
    ahead, first = keys[:-1], F.substring("word", 1, 1).alias("first")
    wanted = wanted.withColumn("first", first)
    rows = at.select(*keys, first, "n").join(wanted.select(*ahead, "first").distinct(), [*ahead, "first"], "left_semi")
    rows = rows.select(*ahead, "first", F.col("word").alias("sorted"), F.lit(0).alias("kind"), "n")
    edge = lambda end, kind: wanted.select(
        *ahead, "first", F.concat("word", F.lit(end)).alias("sorted"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("n")
    )
    order = Window.partitionBy(*ahead, "first").orderBy("sorted", "kind").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.unionByName(edge("", 1)).unionByName(edge(_LAST, 2)).withColumn("upto", F.sum("n").over(order))
    word = F.when(F.col("kind") == 2, F.substring("sorted", 1, F.length("sorted") - 1)).otherwise(F.col("sorted"))
    spans = summed.where("kind > 0").select(*ahead, "first", word.alias("word"), "kind", "upto")
    return spans.groupBy(*ahead, "first", "word").agg(
        (F.max(F.when(F.col("kind") == 2, F.col("upto"))) - F.max(F.when(F.col("kind") == 1, F.col("upto")))).alias("longer")
    ).drop("first")


def _stop_share(tails: DataFrame, places: DataFrame) -> DataFrame:
    """``before, word, label, stop_share`` of the distinct tails; null where the corpus does not tell."""

    def counted(keys: list[str], at: DataFrame) -> DataFrame:
        wanted = tails.select(*keys).distinct()
        own = at.join(wanted, keys, "left_semi").select(*keys, "stops", "goes_on", "ends")
        return wanted.join(own, keys, "left").join(_longer(keys, at, wanted), keys, "left").na.fill(0)

    # Of a word alone not places count but the words before it, so that one frequent phrase does not speak for all.
    only_ends = (F.col("ends") > 0) & (F.col("stops") == 0) & (F.col("goes_on") == 0)
    labels = places.where(F.col("word") == _ANY).select(
        F.col("before").alias("label"), (F.col("stops") + F.col("ends")).alias("l_stops"), F.col("goes_on").alias("l_on")
    )
    places = places.where(F.col("word") != _ANY)
    words_alone = places.groupBy("word").agg(
        F.count(F.when(F.col("stops") > 0, 1)).alias("stops"),
        F.count(F.when(F.col("goes_on") > 0, 1)).alias("goes_on"),
        F.count(F.when(only_ends, 1)).alias("ends"),
        F.count(F.lit(1)).alias("n"),
    )
    pair = tails.join(counted(["before", "word"], places), ["before", "word"])
    pair = pair.join(labels, "label", "left").na.fill(0, ["l_stops", "l_on"])
    alone = counted(["word"], words_alone).select(
        "word", *(F.col(c).alias(f"w_{c}") for c in ("stops", "goes_on", "ends", "longer"))
    )
    on = F.col("goes_on") + F.col("longer")
    w_on = F.col("w_goes_on") + F.col("w_longer")
    # The text itself is one of those that end there.
    w_ends = F.greatest(F.col("w_ends") - 1, F.lit(0))
    w_stop = F.col("w_stops") + w_ends
    # Other texts that end there are evidence only as a share of all places: cuts fall anywhere, so few fall there.
    others = F.greatest(F.col("ends") - 1, F.lit(0))
    told = F.col("stops") + F.when(others >= ENDS_COUNT_FROM * (F.col("stops") + on + others), others).otherwise(0)
    share = (
        F.when(F.col("stops") + on >= LEAST_PLACES, told / (told + on))
        .when((others > 0) & (on == 0), F.lit(1.0))
        .when((F.col("l_stops") >= LEAST_PLACES) & (10 * F.col("l_on") <= F.col("l_stops")) & (F.col("w_longer") == 0), F.lit(1.0))
        .when((F.col("w_stops") + w_on >= LEAST_PLACES_WORD) | (w_stop >= LEAST_PLACES_WORD), w_stop / (w_stop + w_on))
    )
    return pair.join(alone, "word").select("before", "word", "label", share.alias("stop_share"))


def endings(docs: DataFrame) -> DataFrame:
    """``doc_id, source, is_cut, reason, at_limit`` of every text, ``docs(doc_id, source, text)``.

    Null and empty texts are whole, as are texts without any word. Texts are read whole, however long; rows that are
    repeated come out repeated, but all copies of a text, blanks and a mark of the cut apart, are one text that ends
    there. An empty table gives no rows; a null source is a source.
    """
    read = docs.select("doc_id", "source", "text", read_texts(F.col("text")).alias("r"))
    read = read.select(
        "doc_id", F.coalesce(F.col("source"), F.lit("")).alias("source"), F.col("source").isNull().alias("no_source"),
        "r.sizes", "r.reason", "r.digest",
        words(F.substring(F.coalesce("r.text", "text", F.lit("")), F.lit(1), F.col("r.n_bare"))).alias("words"),
    )
    read = read.withColumn("words", _single_stops(F.col("words")))
    read = stored(read, "texts")
    sized = read.select("source", F.explode(_by_measure(F.col("sizes"))).alias("measure", "size"))
    # The sizes at a limit, one row a source: the limits of a source are few, whatever the number of its texts.
    within = F.explode(F.sequence(F.col("size_limit") - SLACK, F.col("size_limit"))).alias("size")
    limits = _heaps(sized).select("source", "measure", within)
    limits = limits.groupBy("source").agg(F.collect_set(F.struct("measure", "size")).alias("limits"))
    limits = small_side(limits)
    own = F.transform(F.map_entries(_by_measure(F.col("sizes"))), lambda e: F.struct(e["key"].alias("measure"), e["value"].alias("size")))
    at_limit = F.coalesce(F.arrays_overlap(own, F.col("limits")), F.lit(False))
    judged = read.join(limits, "source", "left").select(
        "doc_id", "source", "no_source", "reason", at_limit.alias("at_limit"),
        F.try_element_at("words", F.lit(-1)).alias("word"),
        F.coalesce(F.try_element_at("words", F.lit(-2)), F.lit(_START)).alias("before"),
        F.concat(F.coalesce(F.try_element_at("words", F.lit(-3)), F.lit("")), F.lit(_PAUSE)).alias("label"),
    )
    judged = judged.withColumn("label", F.when(F.col("before") == _PAUSE, F.col("label")).otherwise(""))
    judged = judged.withColumn("before", F.when(F.col("before") == _STOP, _START).otherwise(F.col("before")))
    is_open = (F.col("reason") == "open") & F.col("word").isNotNull() & ~F.col("word").isin(_STOP, _PAUSE)
    places = cut(_places(read))
    tails = cut(judged.where(is_open).select("before", "word", "label").distinct())
    shares = small_side(_stop_share(tails, places))
    judged = judged.join(shares, ["before", "word", "label"], "left")
    at, share = F.col("at_limit"), F.col("stop_share")
    ends_open = is_open & (
        (share < CUT_BELOW) | (at & (share < CUT_BELOW_AT_LIMIT)) | (at & share.isNull())
    )
    shown = F.col("reason").isNotNull() & (F.col("reason") != "open")
    is_cut = F.coalesce(shown | ends_open, F.lit(False))
    return judged.select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("source")).alias("source"),
        is_cut.alias("is_cut"),
        F.when(shown, F.col("reason")).when(is_cut, "sentence").alias("reason"),
        at.alias("at_limit"),
    )


def cut_rates(ends: DataFrame) -> DataFrame:
    """How often each source cuts: ``source, n_docs, n_cut, n_at_limit, cut_share``."""
    return ends.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count(F.when(F.col("is_cut"), 1)).alias("n_cut"),
        F.count(F.when(F.col("is_cut") & F.col("at_limit"), 1)).alias("n_at_limit"),
        F.round(F.avg(F.col("is_cut").cast("int")), 6).alias("cut_share"),
    )
