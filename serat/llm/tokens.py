"""Token counts of texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on every executor; only its path is a parameter, the file isn't part of this repository.
VOCABULARY = os.environ.get("SERAT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pre-tokenisation pattern published with that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("serat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    """Tokens of a whole text; strings of special tokens are ordinary text."""
    return len(encoding(path).encode_ordinary(text.encode("utf-8", "replace").decode("utf-8")))


def with_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, and the columns after the second) of (id BIGINT, text STRING, ...): 0 tokens for null and empty texts.

    Whole texts are encoded, each once.
    """
    more = docs.columns[2:]
    docs = docs.toDF("id", "text", *more)
    schema = docs.select("id", F.lit(0).cast("long").alias("n_tokens"), *more).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count_tokens(t.as_py(), path) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *batch.columns[2:]], ["id", "n_tokens", *more])

    return docs.mapInArrow(run, schema)
