"""Sizes of texts in tokens of a public tokenizer; the vocabulary file's path is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The vocabulary used by the queries; the folder can be named by the environment.
TOKENIZER = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Fixed value: how byte-level vocabularies of this kind split a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def counter(path: str):
    """A function from texts to their sizes, for a ``.tiktoken``, ``.json`` or ``.model`` file."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tok.encode_batch(list(texts), add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in sp.encode(list(texts), num_threads=1)]


def with_tokens(df: DataFrame, text: str = "text", path: str = TOKENIZER, name: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all but ``text``) with the size of ``text``; a null text has size 0. Texts are counted whole."""
    keep = [c for c in df.columns if c not in (text, name)] if keep is None else list(keep)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(count(texts), pa.int64())], names=schema.names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
