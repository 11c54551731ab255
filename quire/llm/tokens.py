"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The tokenizer of a rank file, loaded once per worker."""
    import tiktoken

    # Fixed value: the published pattern that splits text before the merges of these vocabularies.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    lines = Path(folder, vocabulary).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counts(texts: list[str | None], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> list[int]:
    """Tokens of each text; 0 for null. Strings of special tokens count as ordinary text."""
    return [len(t) for t in encoder(folder, vocabulary).encode_ordinary_batch([t or "" for t in texts], num_threads=1)]


def token_counts(rows: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) and the columns of `keep` for every row; the text itself is dropped on the way out."""
    rest = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                n = pa.array(counts(part.column(len(rest)).to_pylist(), folder, vocabulary), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(rest))), n], names=[*rest, "n_tokens"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", n_tokens bigint"
    return rows.select(*rest, text).mapInArrow(run, schema)
