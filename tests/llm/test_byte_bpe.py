import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from aeroflow.llm.byte_bpe import _CHARACTERS, ByteBpe, digests, encode_decode, read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def odd_texts(n=300, seed=5):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", "　", "the", "Don't", "'s", "123", "é", "日本", "🙂", "<|endoftext|>", "&&&", "a", "word.", "x,'s", "end?!", ". ", "b.c", "\x00", "é", "ſ", "²"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_every_piece_encodes_to_itself():
    bpe = ByteBpe(RANKS, public_tokenizers.PATTERN)
    names = [p.decode("latin-1").translate(_CHARACTERS) for p in RANKS]
    assert bpe.model.encode(names, num_threads=1) == [[i] for i in RANKS.values()]


def test_same_ids_as_the_library_and_round_trip():
    bpe = ByteBpe(RANKS, public_tokenizers.PATTERN)
    texts = odd_texts() + ["", None, " ", "a ", " a", "x" * 20000, "long " * 30000]
    for text, packed in zip(texts, bpe.encode(texts)):
        ids = np.frombuffer(packed, "<u4")
        assert ids.tolist() == LIBRARY.encode_ordinary(text or ""), repr(text)
        assert bpe.decode(ids) == (text or "").encode()


def test_a_full_cache_changes_nothing():
    bpe = ByteBpe(RANKS, public_tokenizers.PATTERN)
    bpe.cache.max_entries = 2
    for text in odd_texts(60, 6):
        assert np.frombuffer(bpe.encode([text])[0], "<u4").tolist() == LIBRARY.encode_ordinary(text)


def test_rows(spark):
    texts = [*odd_texts(40, 7), None, ""]
    rows = [(i, x, "a", "b") for i, x in enumerate(texts)] + [(None, "x y", "", ""), (1, texts[1], "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")
    got = digests(encode_decode(docs, PATH, public_tokenizers.PATTERN)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text, _, _ in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        assert by_id[i].n_tokens == len(ids)
        assert by_id[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert by_id[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(spark):
    assert digests(encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN)).count() == 0
