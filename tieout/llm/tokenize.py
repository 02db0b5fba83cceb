"""Encoding a corpus with a public byte-level BPE tokenizer.

The tokenizer is tiktoken over a local rank file, whose path is a parameter; nothing is trained or
copied. Texts pass through in Arrow batches, one encoder per Python worker. A long text is cut where
the tokenizer's own splitting pattern always has a boundary: between a character that isn't white
space and white space after it. No pattern alternative has white space after anything else, so
pieces on either side are split exactly as in the whole text and the ids are the same; the
encoder then sees little more than ``CHUNK`` characters at once, however long the text, save where a text has no
white space: such a run has no boundary that is always safe and goes to the encoder whole.

Defined results: null and empty texts have an empty list of ids, never null; strings that look
like special tokens are ordinary text; decoding joins the raw bytes of all ids before reading them
as UTF-8, so characters spread over several tokens come back whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The rank file used unless another path is given.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern of the 50k byte-level vocabulary. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 1 << 16
#: Rows encoded at once, so a batch's ids don't pile up in a worker.
ROWS = 512
# narrower than any notion of white space: the libraries disagree on some control characters
_BOUNDARY = re.compile(r"(?<=[\w.,;:!?)])(?=[ \n])")


@lru_cache(maxsize=4)
def encoder(path: str = RANKS):
    """The encoder of a rank file, made once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = CHUNK) -> list[str]:
    """The text cut at safe boundaries, each piece at least ``size`` long where the text has a boundary."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        m = _BOUNDARY.search(text, start + size)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def encode(text: str | None, path: str = RANKS) -> list[int]:
    if not text:
        return []
    e = encoder(path)
    if len(text) <= CHUNK:
        return e.encode_ordinary(text)
    return [i for p in pieces(text) for i in e.encode_ordinary(p)]


def decode(ids: list[int], path: str = RANKS) -> str:
    return encoder(path).decode_bytes(ids).decode("utf-8", errors="replace")


def _encode_column(texts: pa.ChunkedArray | pa.Array, path: str) -> list[list[int]]:
    return [encode(t, path) for t in texts.to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """(id, ids array<int>) of every row, null and empty texts too. No shuffle: map only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            ids = _encode_column(b.column(1), path)
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            flat = pa.array(np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)], names=["doc_id", "ids"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text_col: str = "text", path: str = RANKS) -> DataFrame:
    """``keep`` columns and ``n_tokens``; the text itself doesn't leave the map task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            n = pa.array([len(encode(t, path)) for t in b.column(len(keep)).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), n], names=[*keep, "n_tokens"])

    kinds = dict(df.dtypes)
    return df.select(*keep, text_col).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens bigint")


def round_trips(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """(id, n_tokens, exact): whether decoding a text's ids gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts = b.column(1).to_pylist()
            ids = [encode(t, path) for t in texts]
            same = [decode(i, path) == (t or "") for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) for i in ids], type=pa.int64()), pa.array(same, type=pa.bool_())], names=["doc_id", "n_tokens", "exact"])

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {dict(df.dtypes)[id_col]}, n_tokens bigint, exact boolean")
