"""Several values packed in one text field: one row per value, with its place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.functions.text import fold_width, is_missing, trimmed

#: Private-use characters that stand for a part of the text while it is taken apart.
_QUOTE, _PART, _EDGE = "\ue000", "\ue001", "\ue002"
_BLANK = "\ue003"

# Words that only qualify the colour that follows them.
COLOR_QUALIFIERS = (
    "연한", "진한", "옅은", "밝은", "어두운", "짙은", "엷은", "흐린", "탁한", "light", "dark", "pale", "deep", "bright",
)


@dataclass(frozen=True)
class Packing:
    """How a field packs its values.

    ``delimiters`` is a pattern for what parts values outside quotes; ``names`` are the words of which each alone names
    a value, so that a blank between two of them parts values too (none: blanks part nothing); ``qualifiers`` belong to
    the name that follows them; ``brackets`` tells whether text in round brackets stays with its value.
    """

    delimiters: str
    names: tuple[str, ...] = ()
    qualifiers: tuple[str, ...] = ()
    brackets: bool = False


def color_packing(names: list[str]) -> Packing:
    parts = r"[,，、;；/|&+·ㆍ・\r\n\t]|\s및\s|\sand\s"
    return Packing(parts, tuple(sorted({n.lower() for n in names})), COLOR_QUALIFIERS, brackets=True)


#: Addresses contain commas, semicolons and bars, so these part only before the scheme of the next address.
URL_PACKING = Packing(r"[,;|]*\s[\s,;|]*|[,;|]+(?=(?i:[a-z][a-z0-9+.\-]*:)?//|$)|^[,;|]+")


def _outside_brackets(c: Column, pattern: str, to: str) -> Column:
    """``c`` with ``pattern`` replaced, but for what stands in round brackets; linear in the length of the text."""
    runs = F.regexp_extract_all(c, F.lit(r"[(（][^()（）]*[)）]|[^()（）]+|[()（）]"), 0)
    return F.array_join(
        F.transform(
            runs, lambda r: F.when(r.rlike(r"(?s)^[(（].*[)）]$"), r).otherwise(F.regexp_replace(r, pattern, to))
        ),
        "",
    )


def packed_values(c: Column, packing: Packing) -> Column:
    """The values in the text ``c``, an array of trimmed texts in their order; empty for missing text.

    The text is split at its quote characters: pieces at odd places are literals, pieces at even places are split at the
    delimiters. An empty even piece between two literals is a doubled, that is an escaped, quote. Quotes that enclose a
    whole value vanish, others stay. A quote without partner is an ordinary character. A list in JSON brackets counts
    as its content. Empty places do not count, repeated values stay.
    """
    text = F.when(is_missing(c), "").otherwise(trimmed(c))
    text = F.regexp_replace(text, f"[{_QUOTE}{_PART}{_EDGE}{_BLANK}]", "")
    text = F.when(text.rlike(r"(?s)^\[.*\]$"), F.regexp_replace(text, r"(?s)^\[(.*)\]$", "$1")).otherwise(text)
    text = F.replace(F.replace(text, F.lit("\\/"), F.lit("/")), F.lit('\\"'), F.lit(_QUOTE))
    pieces = F.split(text, '"')
    count = F.size(pieces)
    lonely = count % 2 == 0
    pieces = F.when(
        lonely,
        F.concat(
            F.slice(pieces, 1, F.greatest(count - 2, F.lit(0))),
            F.array(F.concat(F.element_at(pieces, -2), F.lit(_QUOTE), F.element_at(pieces, -1))),
        ),
    ).otherwise(pieces)
    last = F.size(pieces) - 1

    def piece(x: Column, i: Column) -> Column:
        literal = F.concat(F.lit(_EDGE), x, F.lit(_EDGE))
        escaped = (x == "") & (i > 0) & (i < last)
        return (
            F.when(i % 2 == 1, literal)
            .when(escaped, F.lit(_QUOTE))
            .otherwise(
                _outside_brackets(x, packing.delimiters, _PART)
                if packing.brackets
                else F.regexp_replace(x, packing.delimiters, _PART)
            )
        )

    marked = F.array_join(F.transform(pieces, piece), "")
    marked = F.replace(marked, F.lit(_EDGE + _QUOTE + _EDGE), F.lit(_QUOTE))
    values = F.transform(F.split(marked, _PART), trimmed)
    if packing.names:
        values = F.flatten(
            F.transform(
                values,
                lambda v: F.when(v.contains(_EDGE) | v.contains(_QUOTE), F.array(v)).otherwise(_at_blanks(v, packing)),
            )
        )
    whole = f"^{_EDGE}([^{_EDGE}]*){_EDGE}$"
    values = F.transform(
        values,
        lambda v: trimmed(
            F.translate(
                F.when(v.rlike(whole), F.regexp_replace(v, whole, "$1")).otherwise(v), _EDGE + _QUOTE, '""'
            )
        ),
    )
    return F.filter(values, lambda v: v != "")


def _at_blanks(v: Column, packing: Packing) -> Column:
    """``v`` parted at the blanks where what stands on each side alone names a value."""
    words = F.split(_outside_brackets(v, r"\s+", _BLANK), _BLANK)
    bare = lambda w: F.lower(F.regexp_replace(fold_width(w), r"\([^()]*\)", ""))
    names = F.array(*(F.lit(n) for n in packing.names))
    qualifiers = F.array(*(F.lit(q) for q in packing.qualifiers))

    def fold(state: Column, w: Column) -> Column:
        is_name = F.array_contains(names, bare(w))
        waits = ~is_name & F.array_contains(qualifiers, bare(w))
        held = F.concat_ws(" ", F.nullif(state["held"], F.lit("")), w)
        parts = is_name & state["named"]
        joined = F.concat_ws(" ", F.nullif(state["open"], F.lit("")), held)
        done = F.when(parts, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        return F.struct(
            done.alias("done"),
            F.when(waits, state["open"]).when(parts, held).otherwise(joined).alias("open"),
            F.when(waits, held).otherwise(F.lit("")).alias("held"),
            (state["named"] | is_name).alias("named"),
        )

    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("open"),
        F.lit("").alias("held"),
        F.lit(False).alias("named"),
    )
    end = lambda s: F.concat(
        s["done"], F.array(F.concat_ws(" ", F.nullif(s["open"], F.lit("")), F.nullif(s["held"], F.lit(""))))
    )
    return F.when(F.size(words) < 2, F.array(v)).otherwise(F.aggregate(words, start, fold, end))


def unpacked(df: DataFrame, row_id: Column, fields: dict[str, tuple[Column, Packing]]) -> DataFrame:
    """One row per packed value: ``row_id, field_name, item_no, item_value, n_values``, in one pass and no shuffle.

    Missing values and empty lists give no row; rows that are repeated in ``df`` come out repeated.
    """
    each = [
        F.struct(F.lit(name).alias("field_name"), packed_values(c, p).alias("item_values"))
        for name, (c, p) in fields.items()
    ]
    lists = df.select(row_id.alias("row_id"), F.explode(F.array(*each)).alias("f"))
    return lists.select(
        "row_id",
        F.col("f.field_name").alias("field_name"),
        F.size("f.item_values").alias("n_values"),
        F.posexplode("f.item_values").alias("pos", "item_value"),
    ).select("row_id", "field_name", (F.col("pos") + 1).cast("int").alias("item_no"), "item_value", "n_values")
