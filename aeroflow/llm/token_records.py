"""Token ids in length-delimited binary shards with offset indexes.

A shard is a sequence of records::

    length   unsigned 64-bit    bytes of the payload
    check    unsigned 32-bit    masked CRC-32 of the 8 length bytes
    payload
    check    unsigned 32-bit    masked CRC-32 of the payload

and a payload is ``flags`` (1 byte: bit 0 the document has an id, bit 1 ids take 4 bytes), the
document id (signed 64-bit) and the token ids (unsigned 16- or 32-bit). All integers are
little-endian. The index beside a shard holds, for each record, its offset and its length with
the frame as two unsigned 64-bit integers, so any record can be read on its own.

A checksum is masked by rotating it right by 15 bits and adding a constant, so that a checksum
stored inside checked bytes does not check itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from aeroflow.llm.byte_bpe import mapped
from aeroflow.llm.chunk_cache import ChunkCache
from aeroflow.llm.frames import groups, table
from aeroflow.storage import materialise, new_path

# Fixed values of the record format.
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
LEAD = struct.Struct("<Bq")

#: Records read at once.
READ_BYTES = 4_000_000


def masked(data: bytes) -> int:
    check = zlib.crc32(data)
    return ((check >> 15 | check << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def pack(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    return LEAD.pack((doc_id is not None) | wide << 1, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = LEAD.unpack_from(payload)
    return doc_id if flags & 1 else None, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=LEAD.size).astype("<u4")


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and the place after it; raises on a wrong checksum."""
    length, check = HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"wrong checksum of a length at {at}")
    start = at + HEAD.size
    payload = data[start : start + length]
    if masked(payload) != struct.unpack_from("<I", data, start + length)[0]:
        raise ValueError(f"wrong checksum of a record at {at}")
    return payload, start + length + 4


_LOADED: dict[tuple[str, str], tuple[Callable[[list[str]], list[bytes]], bool]] = {}


def _loaded(path: str, pattern: str) -> tuple[Callable[[list[str]], list[bytes]], bool]:
    """One encoder of texts for each Python worker, and whether its ids need 4 bytes.

    Pre-tokens go to the library's BPE model one by one, so a pre-token that came before costs no
    call and the library builds no offsets; ids are those of the library's encoding of the text.
    The library cuts texts at the tokens added to the model before anything else; texts that hold
    such a token's string are encoded by it as a whole.
    """
    if (path, pattern) not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        cut = tokenizer.model.tokenize
        cache = ChunkCache(pattern, lambda token: [x.id for x in cut(mapped(token))])
        added = [x.content for x in tokenizer.get_added_tokens_decoder().values() if x.content]

        def encode(texts: list[str]) -> list[bytes]:
            out = cache.encode([None if any(x in text for x in added) else text for text in texts])
            for i, text in enumerate(texts):
                if any(x in text for x in added):
                    out[i] = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            return out

        _LOADED[path, pattern] = encode, tokenizer.get_vocab_size() > 65536
    return _LOADED[path, pattern]


def write_token_records(docs: DataFrame, tokenizer_path: str, pattern: str, out: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and write the ids in ascending order of the id column.

    ``tokenizer_path`` is a file of a byte-level BPE tokenizer without a normaliser and ``pattern``
    its pre-tokenisation; the strings of its added tokens become those tokens, as in the library.
    Each document's ids end with ``end_id``. Rows are dealt out by ranges of (id, hash of the text),
    and each range becomes one shard ``shard-NNNNN.tokens`` with its index ``.index`` in the
    folder ``out``. A null text counts as empty; null ids come first; rows that share an id are
    all written, in the order of their texts; further columns are left out; an empty table makes
    no shard. Shards are written under a name of their attempt and then renamed, so a repeated
    task leaves the same files.

    Returns the manifest, one row per shard: shard int, path string, n_docs, n_tokens, n_bytes.
    """
    order = ["id", "h", "text"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = kept.repartitionByRange(parts, "id", "h").sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        encode, wide = _loaded(tokenizer_path, pattern)
        end = np.array([end_id], "<u4")
        store, root = fs.FileSystem.from_uri(out)
        name = f"{root}/shard-{shard:05d}"
        docs_done = tokens = at = 0
        streams = None
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in groups(texts):
                if streams is None:
                    store.create_dir(root, recursive=True)
                    streams = [store.open_output_stream(f"{name}.{kind}-{attempt}") for kind in ("tokens", "index")]
                records, index = [], []
                for doc_id, packed in zip(ids[i:j], encode(texts[i:j])):
                    tokens_of = np.concatenate([np.frombuffer(packed, "<u4"), end])
                    record = frame(pack(doc_id, tokens_of, wide or end_id > 65535))
                    index += (at, len(record))
                    at += len(record)
                    tokens += len(tokens_of)
                    records.append(record)
                docs_done += len(records)
                streams[0].write(b"".join(records))
                streams[1].write(np.array(index, "<u8").tobytes())
        if streams is not None:
            for stream, kind in zip(streams, ("tokens", "index")):
                stream.close()
                store.move(f"{name}.{kind}-{attempt}", f"{name}.{kind}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{out}/shard-{shard:05d}"], "n_docs": [docs_done], "n_tokens": [tokens], "n_bytes": [at]})

    return materialise(dealt.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long, n_bytes long"), "token-manifest")


def read_token_records(manifest: DataFrame) -> DataFrame:
    """Read all shards of a manifest back, one task for each shard.

    Returns one row per document: doc_id, shard, start long (ids of all documents before it, in
    the order of the shards), ids array<int>. Checksums are verified and a wrong one raises.
    """
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, not for each document
    shards = manifest.select("shard", "path", "n_bytes", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    shards = shards.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(f"{path}.index") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
                start = row["start"]
                with store.open_input_file(f"{path}.tokens") as f:
                    first = 0
                    while first < len(index):
                        last = max(first + 1, int(np.searchsorted(index[:, 0], index[first, 0] + READ_BYTES)))
                        f.seek(int(index[first, 0]))
                        data = f.read(int(index[last - 1].sum() - index[first, 0]))
                        found, at = [], 0
                        while at < len(data):
                            payload, at = unframe(data, at)
                            found.append(unpack(payload))
                        sizes = np.array([len(ids) for _, ids in found])
                        ends = np.cumsum(sizes)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([d for d, _ in found], pa.int64()),
                                pa.array([row["shard"]] * len(found), pa.int32()),
                                pa.array(start + ends - sizes, pa.int64()),
                                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate([ids for _, ids in found]).astype(np.int32))),
                            ],
                            names=["doc_id", "shard", "start", "ids"],
                        )
                        start += int(ends[-1])
                        first = last

    return shards.mapInArrow(run, "doc_id long, shard int, start long, ids array<int>")


def read_record(path: str, n: int) -> tuple[int | None, np.ndarray]:
    """The n-th record of a shard, found through the index: the read of a shuffled epoch."""
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{root}.index") as f:
        f.seek(16 * n)
        offset, length = struct.unpack("<QQ", f.read(16))
    with store.open_input_file(f"{root}.tokens") as f:
        f.seek(offset)
        return unpack(unframe(f.read(length), 0)[0])


def digests(records: DataFrame) -> DataFrame:
    """Start, length and checksum of each document's ids as read from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            offsets = ids.offsets.to_numpy()
            values = ids.values.to_numpy().astype("<u4")
            checks = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(checks, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return records.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token records and read back: start, n_tokens and checksum of each."""
    import public_tokenizers

    manifest = write_token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, new_path(spark, "tokens"))
    return digests(read_token_records(manifest))
