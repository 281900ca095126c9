"""Tokens of a public tokenizer, read from its rank file."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: Where the public vocabularies lie; a parameter of every function that needs one.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-splitting pattern that belongs to the vocabulary, from its public description.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a rank file, read once per worker process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def shipped(spark: SparkSession, path: str) -> Callable[[], str]:
    """Hands a file of the driver to all executors; gives what finds it there."""
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)
    return lambda: SparkFiles.get(name)


def token_size(path: str) -> Callable[[str], int]:
    """Tokens of a text by a rank file; words repeat, so counts are remembered (a million at most)."""
    enc = encoding(path)
    known: dict[str, int] = {}

    def size(part: str) -> int:
        got = known.get(part)
        if got is None:
            if len(known) > 1_000_000:
                known.clear()
            got = known[part] = len(enc.encode_ordinary(part))
        return got

    return size
