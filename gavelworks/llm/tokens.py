"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizers' vocabulary files; a parameter of every function here.
FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
#: The vocabulary file that is used for a tokenizer named in the data. The 100k one isn't among the files, so the byte-level one for many languages stands in.
FILES = {"cl100k_base": "byte_bpe_multi_50k.tiktoken"}
#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(file: str, folder: str):
    import tiktoken

    with open(os.path.join(folder, file), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_col: str, text_col: str, tokenizer: str, keep: tuple[str, ...] = (), folder: str = FOLDER) -> DataFrame:
    """(id_col, *keep, n_tokens) of each document; null text has 0 tokens. Documents without an id are left out."""
    file = FILES.get(tokenizer, tokenizer)
    own = documents.where(F.col(id_col).isNotNull()).select(id_col, *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop("_text").schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoding(file, folder).encode_ordinary
        for batch in batches:
            sizes = np.fromiter((len(count(t)) for t in batch.column("_text").to_pylist()), np.int64, batch.num_rows)
            rest = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(sizes)], [*rest, "n_tokens"])

    return own.mapInArrow(run, ", ".join([*fields, "n_tokens long"]))
