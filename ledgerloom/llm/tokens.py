"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import spread

#: A rank file that every executor can read. It is a parameter everywhere and never part of this package.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE of this family splits a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, keep..., tokens): one row for each row of `documents`; null and empty texts have 0 tokens.

    Whole texts are encoded, one Arrow batch at a time; only the size leaves the worker.  Strings of
    special tokens in a text are ordinary text.
    """
    columns = [key, *keep]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoding(tokenizer)
        for batch in batches:
            sizes = [len(code.encode_ordinary(t)) if t else 0 for t in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*columns, "tokens"])

    picked = documents.select(*columns, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in picked.dtypes[:-1])
    return spread(picked).mapInArrow(count, f"{kinds}, tokens bigint")
