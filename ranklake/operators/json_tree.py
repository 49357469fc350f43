"""JSON texts as trees: sorted, walked, counted and merged at every depth."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _tree(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except (json.JSONDecodeError, RecursionError):
        return None


def blank(x) -> bool:
    """Null, an empty text, list or object; false and zero are values."""
    return x is None or (isinstance(x, str | list | dict) and not x) or (isinstance(x, str) and not x.strip())


def leaves(x, path: str = "$") -> Iterator[tuple[str, object]]:
    """The path and value of every leaf, without recursion; members in order of name."""
    todo = [(path, x)]
    while todo:
        at, node = todo.pop()
        if isinstance(node, dict):
            todo += [(f"{at}.{k}", node[k]) for k in sorted(node, reverse=True)]
        elif isinstance(node, list):
            todo += [(f"{at}[{i}]", node[i]) for i in reversed(range(len(node)))]
        else:
            yield at, node


def filled(base, other):
    """``base`` with blanks filled from ``other``, at every depth of objects."""
    if isinstance(base, dict) and isinstance(other, dict):
        return {k: filled(base.get(k), other.get(k)) for k in base.keys() | other.keys()}
    return other if blank(base) else base


def overlaid(base, other):
    """``base`` overlaid by what is not blank in ``other``, at every depth of objects."""
    if isinstance(base, dict) and isinstance(other, dict):
        return {k: overlaid(base.get(k), other.get(k)) for k in base.keys() | other.keys()}
    return base if blank(other) else other


def _text(x) -> str | None:
    return None if x is None else json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _each(make: Callable, kind: str, *cols: Column) -> Column:
    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in batches:
            yield pd.Series([make(*(_tree(t) for t in row)) for row in zip(*parts, strict=True)], dtype=object)

    return run(*cols)


def canonical(c: Column) -> Column:
    """The same tree with the members of all objects in order of name and no blanks; null for what is no JSON."""
    return _each(lambda x, _: _text(x), "string", c, c)


def leaf_values(c: Column) -> Column:
    """``array<struct<path, value>>`` of all leaves; values as JSON texts."""
    return _each(lambda x, _: [{"path": p, "value": _text(v)} for p, v in leaves(x)] if x is not None else [], "array<struct<path:string,value:string>>", c, c)


def known_leaves(c: Column) -> Column:
    """How many leaves are not blank."""
    return _each(lambda x, _: sum(not blank(v) for _, v in leaves(x)), "int", c, c)


def fill_blanks(base: Column, other: Column) -> Column:
    return _each(lambda a, b: _text(filled(a, b)), "string", base, other)


def overlay(base: Column, other: Column) -> Column:
    return _each(lambda a, b: _text(overlaid(a, b)), "string", base, other)
