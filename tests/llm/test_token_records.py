import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from aeroflow.llm import token_records as T
from aeroflow.storage import new_path

from test_byte_bpe import odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_rows_and_files(spark):
    texts = [*odd_texts(80, 11), "", None, "word " * 5000, "a <|endoftext|> b", "<|endoftext|><|endoftext|>", " <|endoftext| > x"]
    rows = [(997 * i % 83, x, 1, "z") for i, x in enumerate(texts)] + [(None, "no id", 1, "z"), (5, "again", 1, "z"), (5, "again", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, ids string")
    manifest = T.write_token_records(docs, PATH, public_tokenizers.PATTERN, new_path(spark, "t"))
    records = T.read_token_records(manifest)
    got = sorted(T.digests(records).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(PATH)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    start, left = 0, [(r[0], r[1] or "") for r in rows]
    for r in got:
        match = next(x for x in left if x[0] == r.doc_id and zlib.crc32(np.array([*library.encode(x[1], add_special_tokens=False).ids, 0], "<u4").tobytes()) == r.ids_crc32)
        left.remove(match)
        assert r.start == start
        start += r.n_tokens
    assert not left
    shard = manifest.orderBy("shard").first()
    n = shard.n_docs - 1
    doc_id, ids = T.read_record(shard.path, n)
    same = [r for r in records.where(f"shard = {shard.shard}").collect() if r.doc_id == doc_id and r.ids == ids.tolist()]
    assert same


def test_empty_table(spark):
    manifest = T.write_token_records(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN, new_path(spark, "t"))
    assert T.digests(T.read_token_records(manifest)).collect() == []


def test_damage_is_found():
    record = bytearray(T.frame(T.pack(7, np.array([1, 70000]), True)))
    assert T.unpack(T.unframe(bytes(record), 0)[0])[1].tolist() == [1, 70000]
    for at in (3, 14, len(record) - 6):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            T.unframe(bytes(broken), 0)
