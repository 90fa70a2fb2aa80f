import random
import re
from collections import Counter

import duckdb
import pytest

from aeroflow.llm import quality_rules as Q


def plain(text):
    """The base counts by direct loops."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def texts(rng):
    def some(n, words):
        return " ".join(rng.choice(words) for _ in range(n))

    many = [f"word{i}" for i in range(300)] + ["the"] * 90 + ["of"] * 60
    out = [None, "", " \n\t ", "a", "*** $$$", "x\n\nx\n x\nx", "é b\x85c\x1cd", some(7, many), some(8, many)]
    out += [some(rng.randrange(9, 120), ["a", "b"]) for _ in range(20)]
    out += [some(rng.randrange(60, 400), many) for _ in range(60)]
    out += [" ".join(w + "***" for w in some(80, many).split()), some(200, many) + "\n" + " ".join(["one", "two", "three"] * 9), "\x0b" + some(30, many) + "\r\n"]
    block = some(12, many)
    return out + ["\n".join([block] * 3), block + " " + some(40, many) + " " + block, some(30000, many)]


@pytest.fixture(scope="module")
def rows():
    found = texts(random.Random(1))
    made = [(i, x, rng_lang(i), "keep", 5) for i, x in enumerate(found)]
    return made + [(None, found[40], "en", "keep", 5), (3, found[41], "en", "keep", 5), (3, found[41], "en", "keep", 5)]


def rng_lang(i):
    return None if i % 17 == 0 else "en"


COLUMNS = "doc_id long, text string, lang string, kept string, words int"


def test_base_counts(spark, rows):
    got = Q.judged(spark.createDataFrame(rows, COLUMNS)).collect()
    key = lambda r: (str(r[0]), r[1:])
    want = sorted([(r[0], *plain(r[1])) for r in rows], key=key)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=key) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_symbols_are_rejected_and_prose_is_kept(spark, rows):
    verdicts = {r.doc_id: r for r in Q.judged(spark.createDataFrame(rows, COLUMNS)).where("doc_id is not null").collect()}
    symbolic = [i for i, x, *_ in rows if x and x.count("***") > 50]
    assert symbolic and not any(verdicts[i].kept for i in symbolic)
    prose = [i for i, x, *_ in rows if i is not None and x and len(x.split()) > 60 and "word" in x and "***" not in x and not verdicts[i].base_failed]
    assert len(prose) > 50 and all(verdicts[i].kept for i in prose)


def test_a_wrong_label_is_no_reason(spark):
    rng = random.Random(3)
    bag = {"en": ["the"] * 40 + ["of"] * 30 + [f"en{i}" for i in range(200)], "fr": ["le"] * 40 + ["de"] * 30 + [f"fr{i}é" for i in range(200)]}
    rows = [(i, " ".join(rng.choice(bag[x]) for _ in range(120)), x) for i, x in enumerate(["en", "fr"] * 40)]
    rows.append((1000, " ".join(rng.choice(bag["en"]) for _ in range(120)), "fr"))
    got = {r.doc_id: r for r in Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(r.kept for r in got.values())
    assert got[1000].word_distance > Q.MAX_WORD_DISTANCE + Q.LENGTH_ALLOWANCE / 120**0.5


def test_same_as_sql(spark, rows):
    # This DuckDB version counts \x0b and \r as word characters in the nested query; test_base_counts covers them.
    plain_rows = [r for r in rows if r[0] is not None and "\x0b" not in (r[1] or "")][:-2]
    docs = spark.createDataFrame(plain_rows, COLUMNS).cache()
    db = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    want = db.execute(Q.OP8_SQL.replace("FROM documents", "FROM (SELECT * FROM documents)")).fetchall()
    names = [x[0] for x in db.description]
    got = Q.judged(docs).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_documents_kept_with_all_columns(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = Q.good_documents(docs)
    assert kept.columns == docs.columns
    want = Q.judged(docs, keep=["text", "words"]).where("kept").collect()
    assert want and sorted((str(r.doc_id), r.text, r.words) for r in kept.collect()) == sorted((str(r.doc_id), r.text, r.words) for r in want)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert Q.judged(docs).collect() == []
    assert Q.good_documents(docs).collect() == []
