"""Byte-level BPE through a sentencepiece model made from a rank file.

The vocabulary's pieces are written as a sentencepiece BPE model: each byte becomes one printable
character, a piece's score is its negative rank and the normaliser changes nothing. For each
pre-token the model then merges the adjacent pair whose union has the lowest rank, the leftmost
first, which is byte-level BPE by ranks. Ids are decoded by the inverse mapping of pieces to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from aeroflow.llm.chunk_cache import ChunkCache
from aeroflow.llm.frames import groups, table


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else one from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_CHARACTERS = dict(enumerate(byte_characters()))


def mapped(token: str) -> str:
    """A string's bytes as printable characters."""
    if token.isascii() and token.isprintable():
        return token.replace(" ", _CHARACTERS[32])
    return token.encode().decode("latin-1").translate(_CHARACTERS)


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a rank file: a base64 piece and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(bytes.strip, lines))}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _nested(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose n-th piece is the vocabulary's n-th by rank."""
    out = bytearray()
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        name = piece.decode("latin-1").translate(_CHARACTERS).encode()
        out += _nested(1, _nested(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, 1))
    unknown = b"<unk>"
    out += _nested(1, _nested(1, unknown) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))
    out += _nested(2, _number(3, 2) + _number(4, len(ranks) + 1) + _number(40, len(ranks)))
    out += _nested(3, _nested(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class ByteBpe:
    """Encoder and decoder for one vocabulary.

    ``pattern`` cuts a text into pre-tokens; each is merged on its own. A vocabulary must hold
    every single byte, so any text can be encoded.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        pieces = sorted(ranks.items(), key=lambda x: x[1])
        self.ids = np.array([rank for _, rank in pieces], "<u4")
        self.identity = bool((self.ids == np.arange(len(pieces))).all())
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.bytes = np.frombuffer(b"".join(p for p, _ in pieces), np.uint8)
        self.lengths = np.zeros(int(self.ids.max()) + 1, np.int64)
        self.lengths[self.ids] = [len(p) for p, _ in pieces]
        self.starts = np.zeros_like(self.lengths)
        self.starts[self.ids] = np.cumsum([0, *(len(p) for p, _ in pieces[:-1])])
        self.cache = ChunkCache(pattern, self.encode_one)

    def encode_one(self, token: str) -> list[int]:
        """The ids of a pre-token."""
        ids = self.model.encode(mapped(token))
        return ids if self.identity else self.ids[ids].tolist()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.cache.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)
        return self.bytes[at].tobytes()


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def _loaded(path: str, pattern: str) -> ByteBpe:
    """One model for each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids.

    Returns one row per input row: the id column, ``ids`` array<int> and ``decoded`` binary (the
    bytes the ids stand for). A null text counts as empty and gives no ids; texts of any length
    are encoded whole; null or repeated ids and repeated rows pass through; further columns are
    left out. ``path`` is the rank file, present on every executor, and ``pattern`` the
    pre-tokenisation. The work is one pass without a shuffle.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            for start, end in groups(texts):
                packed = bpe.encode(texts[start:end])
                ids = [np.frombuffer(x, "<u4") for x in packed]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                values = np.concatenate(ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, end - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array([bpe.decode(x) for x in ids], pa.binary())],
                    names=["id", "ids", "decoded"],
                )

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token counts and digests of :func:`encode_decode`'s rows."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by the rank file and decoded again: doc_id, n_tokens and both digests; null counts as empty, repeated rows stay."""
    import public_tokenizers

    return digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
