"""Token counts of texts with a public tokenizer whose files lie outside the repository."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from sievelark.session import fan_out

#: The folder of the vocabulary files, and the byte-level vocabulary used unless another is named.
FOLDER = os.environ.get("SIEVELARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The split into words before merging: letters with an optional leading space, digits, other signs, space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are counted in pieces of at least this many characters, cut before a single space between other characters: the split into words has a border there too.
PIECE = 200_000
_BORDER = re.compile(r"(?<=\S) (?=\S)")


@cache
def encoding(folder: str, vocabulary: str):
    """The tokenizer, once a Python worker."""
    import tiktoken

    lines = (Path(folder) / vocabulary).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> int:
    """The number of tokens; special tokens' names are ordinary text."""
    enc, n, at = encoding(folder, vocabulary), 0, 0
    while at < len(text):
        border = _BORDER.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = border.start() if border else len(text)
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def token_counts(docs: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of documents (doc_id, source, text); null texts are left out, empty ones have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filter(len, batches):
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": [count(t, folder, vocabulary) for t in b["text"]]})

    return fan_out(docs.select("doc_id", "source", "text").where("text is not null")).mapInPandas(run, "doc_id bigint, source string, n_tokens bigint")
