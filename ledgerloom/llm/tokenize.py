"""Encoding a corpus with a public byte-level BPE vocabulary through a sentencepiece model built from it.

No tokenizer is trained: the ranks of the vocabulary are written as a sentencepiece BPE model whose
pieces are the byte-mapped tokens, scored by their negative rank, with an identity normaliser. Both
algorithms merge the adjacent pair of best rank first, so a pre-token gets the same ids.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerloom.functions.spread import spread

#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Encoded pre-tokens a worker remembers; at the bound it starts anew. It bounds memory only.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def ranks(path: str) -> list[bytes]:
    """The tokens of a ``.tiktoken`` file by id."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model (protobuf) with the tokens as its pieces, ids kept, and one unknown piece after them."""
    letters = byte_letters()
    out = bytearray()
    for i, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(i)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))
    no = {n: _field(n, (1 << 64) - 1) for n in (41, 42, 43)}
    out += _field(2, _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(no.values()))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class PieceEncoder(dict):
    """Ids of pre-tokens, found once each; call it with a text for its ids."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        self.tokens = ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.letters = byte_letters()
        self.parts = regex.compile(PATTERN).findall

    def __missing__(self, part: str) -> list[int]:
        if len(self) >= REMEMBERED:
            self.clear()
        mapped = "".join([self.letters[b] for b in part.encode("utf-8", "replace")])
        ids = self[part] = self.model.encode_as_ids(mapped)
        return ids

    def __call__(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.parts(text):
            ids += self[part]
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: pieces back to bytes."""
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One per worker process and vocabulary."""
    return PieceEncoder(path)


def encode_corpus(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)``: ids of each row's whole text, without special tokens.

    ``vocabulary`` is the path of the ``.tiktoken`` file, readable on every executor. A null or empty text
    gives an empty list; strings of special tokens are ordinary text. Rows stay as they are, repeated or
    with a null key; other columns are never read. Without a shuffle.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            ids = [np.array(encode(t), dtype=np.int32) if t else _NONE for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.array(np.concatenate([_NONE, *ids]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    return spread(documents.select(key, text)).mapInArrow(run, f"doc_id {kind}, ids array<int>")


_NONE = np.zeros(0, dtype=np.int32)


def decode_corpus(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, text)``: the inverse of ``encode_corpus``; an empty or null list gives an empty text."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(vocabulary).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(key, ids).mapInArrow(run, f"doc_id {kind}, text string")
