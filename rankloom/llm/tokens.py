"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import spread

#: Where the ranks of a byte-level BPE lie on every node; a parameter of each operator.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to these ranks (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(ranks: str, pattern: str):
    """The tokenizer, read once per Python worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _counter(ranks: str, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(ranks, pattern)
        for pdf in batches:
            texts = pdf.pop("_text").fillna("")
            heads = texts.str.split("\n", n=1).str[0]
            pdf["tokens"] = [len(x) for x in enc.encode_ordinary_batch(list(texts), num_threads=1)]
            pdf["head_tokens"] = [len(x) for x in enc.encode_ordinary_batch(list(heads), num_threads=1)]
            yield pdf

    return run


def token_sizes(df: DataFrame, text_col: str, keep: list[str], ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """The kept columns with ``tokens`` of the whole text and ``head_tokens`` of its first line; null text has none.

    Narrow: the text leaves with this step, so that later shuffles carry sizes only.
    """
    kept = df.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", tokens long, head_tokens long"
    return spread(kept).mapInPandas(_counter(ranks, pattern), schema)
