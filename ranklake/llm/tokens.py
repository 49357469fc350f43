"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabulary file lies on every machine; a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how text is split before merging, for rank files.
RANK_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts, by the kind of vocabulary file; loaded once a process."""
    if path not in _LOADED:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            bpe = tiktoken.Encoding(path, pat_str=RANK_PATTERN, mergeable_ranks=ranks, special_tokens={})
            _LOADED[path] = lambda texts: [len(bpe.encode_ordinary(t)) for t in texts]
        elif path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            loaded = Tokenizer.from_file(path)
            loaded.encode_special_tokens = True
            _LOADED[path] = lambda texts: [len(x.ids) for x in loaded.encode_batch(texts, add_special_tokens=False)]
    return _LOADED[path]


def n_tokens(c: Column, path: str = TOKENIZER) -> Column:
    """Number of tokens of each text, whole texts, 0 for null; Arrow batches, the vocabulary is never copied."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        number = counter(path)
        for texts in batches:
            yield pd.Series(number(texts.fillna("").tolist()), dtype="int64")

    return count(c)
