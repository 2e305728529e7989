"""Encoding of whole texts with a public tokenizer: tiktoken on a local rank file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the published pre-splitting pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts longer than this many characters are encoded in pieces cut at safe boundaries.
PIECE_CHARS = 1 << 16


#: Ids that a Python worker holds before it hands them on, about.
MOST_HELD = 400_000


def default_tokenizer_dir() -> str:
    """Folder of the public vocabulary files; a parameter of every operator that reads one."""
    return os.environ.get("LODESTAT_TOKENIZERS", "/opt/tokenizers")


@lru_cache(maxsize=4)
def encoding(folder: str, name: str):
    """The tiktoken encoding of a rank file ``name`` in ``folder``, or as sent with the application; loaded once in each Python worker."""
    import tiktoken

    path = f"{folder}/{name}.tiktoken"
    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(f"{name}.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text where the pattern always starts a new match, so pieces encode as the whole does.

    A cut lies before one blank that follows a letter or digit and precedes a
    letter: the match before it ends there whatever follows, and the blank begins
    the next one. A run without such a place stays whole.
    """
    start, n = 0, len(text)
    while n - start > most:
        at = start + most
        while at < n - 1 and not (text[at] == " " and text[at - 1].isalnum() and text[at + 1].isalpha()):
            at += 1
        if at >= n - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def encode_text(enc, text: str | None) -> list[int]:
    """Ids of a text without special tokens; an empty list for null and empty."""
    if not text:
        return []
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    return [i for piece in safe_pieces(text) for i in enc.encode_ordinary(piece)]


def decode_ids(enc, ids: list[int]) -> str:
    """The text of ids, joined as raw bytes before UTF-8 decoding, since one character may span several tokens."""
    return b"".join(enc.decode_tokens_bytes(ids)).decode("utf-8", errors="replace")


def encode_column(docs: DataFrame, key: str, text: str, *, folder: str | None = None, name: str = "byte_bpe_50k", counts_only: bool = False) -> DataFrame:
    """(``key``, ``ids``), or (``key``, ``n_tokens``) with ``counts_only``, of each row, in one Arrow-batched pass.

    Null and empty texts give an empty list (0 tokens). Text that looks like a
    special token is ordinary text. Rows keep their number and repeat as they do
    in the input; no shuffle takes place. The rank file is sent to executors that
    do not have its folder.
    """
    where = folder or default_tokenizer_dir()
    docs.sparkSession.sparkContext.addFile(f"{where}/{name}.tiktoken")  # for executors without the folder
    kind = docs.schema[key].dataType
    field = T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(where, name)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            start, held, ids = 0, 0, []
            for i in range(b.num_rows):
                found = encode_text(enc, texts[i].as_py())
                ids.append(len(found) if counts_only else found)
                held += 1 if counts_only else len(found)
                if held >= MOST_HELD or i + 1 == b.num_rows:
                    out = pa.array(ids, pa.int64() if counts_only else pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys[start : i + 1], out], [key, field.name])
                    start, held, ids = i + 1, 0, []

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, T.StructType([T.StructField(key, kind), field]))
