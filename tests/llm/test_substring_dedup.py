import random

import numpy as np

from aeroflow.llm import substring_dedup as D


def prose(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def documents(seed=3):
    rng = random.Random(seed)
    docs = {i: [prose(rng, rng.randrange(20, 90)) for _ in range(rng.randrange(1, 6))] for i in range(120)}
    passages = {}
    for k in range(8):  # set into the middle of other paragraphs
        text = prose(rng, 51 + 7 * k)
        passages[k] = [k * 10 + j for j in range(2 + k % 3)]
        for i in passages[k]:
            words = docs[i][0].split()
            at = rng.randrange(len(words))
            docs[i][0] = " ".join(words[:at] + [text] + words[at:])
    base = prose(rng, 80).split()
    near = [90, 91, 92]
    for i in near:  # near copies of a paragraph, no run of 49 equal words
        words = list(base)
        words[39 if i == 90 else 40] = f"x{i}"
        docs[i].append(" ".join(words))
    return docs, passages, near


def rows_of(docs):
    return [(i, "\n".join(x), "q", 1) for i, x in docs.items()]


SCHEMA = "doc_id long, text string, spans string, key int"


def test_planted_passages_and_clean_documents(spark):
    docs, passages, near = documents()
    got = {r.id: r for r in D.repeated_passages(spark.createDataFrame(rows_of(docs), SCHEMA)).collect()}
    dirty = {i for ids in passages.values() for i in ids} | set(near)
    assert set(got) == dirty
    for ids in [*passages.values(), near]:
        assert {got[i].class_id for i in ids} == {min(ids)}
        assert got[min(ids)].n_removed == 0
        words = 80 if ids is near else 51 + 7 * ids[0] // 10
        assert all(got[i].n_removed >= words for i in ids[1:])
    for i in near[1:]:
        assert got[i].n_removed == 80


def test_shared_runs_from_49_words_are_found(spark):
    rng = random.Random(7)
    rows = []
    for k in range(60):
        text = prose(rng, 49)
        rows += [(2 * k + j, f"{prose(rng, rng.randrange(60))} {text} {prose(rng, rng.randrange(60))}", "q", 1) for j in range(2)]
    assert D.repeated_passages(spark.createDataFrame(rows, SCHEMA)).count() == 120


def shingle_set(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def links_of(spark, paragraphs):
    """Links between the texts, as places in ``paragraphs``, that banding finds."""
    rows = []
    for i, text in enumerate(paragraphs):
        u = D.units(text)
        rows.append((i, 0, text, int(u.keys.view(np.int64)[0]), int(u.starts[0]), int(u.sizes[0]), u.bands.view(np.int64)[0].tolist()))
    df = spark.createDataFrame(rows, "id long, h long, text string, key long, start int, n int, bands array<long>")
    at = {r[3]: r[0] for r in rows}
    return {tuple(sorted(at[x] for x in r)) for r in D.similar_paragraphs(df.select("id", "h", "text"), df.drop("text").withColumn("doc", df.id)).collect()}


def groups(links, n):
    label = list(range(n))
    for i, j in links:
        label = [label[j] if x == label[i] else x for x in label]
    return {frozenset(i for i, x in enumerate(label) if x == y) for y in label}


def test_banding_finds_similar_pairs(spark):
    rng = random.Random(5)
    paragraphs = []
    for k in range(300):
        words = prose(rng, 70).split()
        other = list(words)
        for at in rng.sample(range(5, 65), rng.randrange(1, 4)):
            other[at] = f"y{k}"
        paragraphs += [" ".join(words), " ".join(other)]
    sets = [shingle_set(x) for x in paragraphs]
    want = {(i, i + 1) for i in range(0, len(sets), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    got = links_of(spark, paragraphs)
    assert want and got <= want and len(got) >= 0.99 * len(want)


def test_a_bucket_in_blocks_loses_no_group(spark, monkeypatch):
    rng = random.Random(41)
    paragraphs = []
    for _ in range(6):  # chains of edited copies, whose ends are not alike
        now = prose(rng, 70).split()
        for k in range(14):
            paragraphs.append(" ".join(now))
            now[rng.randrange(70)] = f"z{k}"
    sets = [shingle_set(x) for x in paragraphs]
    alike = {(j, i) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if len(x & y) >= 0.8 * len(x | y)}
    monkeypatch.setattr(D, "BLOCK", 3)
    got = links_of(spark, paragraphs)
    assert got <= alike and groups(got, len(sets)) == groups(alike, len(sets))


def test_equal_buckets_are_one(spark, monkeypatch):
    rng = random.Random(43)
    words = prose(rng, 70).split()
    met, write = {}, D.materialise
    monkeypatch.setattr(D, "materialise", lambda df, label: met.setdefault(label, write(df, label)))
    monkeypatch.setattr(D, "release", lambda *tables: None)
    assert links_of(spark, [" ".join(words), " ".join([*words[:-1], "y"]), prose(rng, 70)]) == {(0, 1)}
    assert met["dedup-members"].count() == 2  # though the pair shares several bands


def test_odd_rows(spark):
    rng = random.Random(1)
    text, other = prose(rng, 300), prose(rng, 20000)
    inside = prose(rng, 60)
    rows = [(1, text, "q", 1), (1, text, "q", 1), (None, text.upper(), "q", 1), (2, None, "q", 1), (3, "", "q", 1), (4, "short text", "q", 1), (5, other, "q", 1), (6, f"{inside} and {inside}", "q", 1), (7, "a " * 3000, "q", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r for r in D.repeated_passages(docs).collect()}
    assert set(got) == {1, None}
    assert got[1].n_removed == 0 and got[None].n_removed > 200
    assert D.repeated_passages(docs.limit(0)).collect() == []


def test_documents_without_repeats(spark):
    docs, passages, near = documents()
    rows = [(*r, 5) for r in rows_of(docs)] + [(500, None, "q", 1, 0)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA + ", n_chars int, _id string, _new string")
    out = D.without_repeats(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    after = {r.doc_id: r for r in out.collect()}
    before = {r[0]: r[1] for r in rows}
    changed = {i for ids in [*passages.values(), near] for i in ids[1:]}
    assert set(after) == set(before)
    for i, text in before.items():
        if i not in changed:
            assert after[i].text == text and after[i].n_chars == dict((r[0], r[4]) for r in rows)[i]
        else:
            assert len(after[i].text.split()) <= len(text.split()) - 25 and after[i].n_chars == len(after[i].text)


def test_cut_keeps_lines_and_spaces():
    assert D.cut("a b c\nd e f", [{"start": 1, "end": 3}]) == "a\nd e f"
    assert D.cut("a b c d", [{"start": 1, "end": 2}, {"start": 3, "end": 4}]) == "a c"
    assert D.cut("a b", [{"start": 0, "end": 2}]) == ""


def test_no_word_of_a_passage_is_left(spark):
    rng = random.Random(23)
    rows, passages = [], {}
    for k in range(40):
        text = [f"p{k}x{j}" for j in range(49 + rng.randrange(60))]
        for j in range(3):
            passages[3 * k + j] = text
            rows.append((3 * k + j, f"{prose(rng, rng.randrange(60))} {' '.join(text)} {prose(rng, rng.randrange(60))}", "q", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r for r in D.repeated_passages(df).collect()}
    left = {r.doc_id: r.text.split() for r in D.without_repeats(df).collect()}
    before = {r[0]: r[1].split() for r in rows}
    for i, text in passages.items():
        assert got[i].n_words == len(text) and got[i].n_removed == (len(text) if i % 3 else 0)
        if i % 3:
            assert left.get(i, []) == [w for w in before[i] if w not in set(text)]
        else:
            assert left[i] == before[i]


def test_a_run_goes_as_far_as_any_earlier_text(spark):
    rng = random.Random(29)
    text = prose(rng, 90).split()
    part = text[7:80]  # the first document has less of the passage than the next two share
    rows = [(i, " ".join([prose(rng, 40), *words, prose(rng, 40)]), "q", 1) for i, words in enumerate([part, text, text])]
    got = {r.id: r for r in D.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(got[i].n_words, got[i].n_removed) for i in range(3)] == [(73, 0), (90, 73), (90, 90)]


def test_links_of_a_bucket_lose_no_group():
    rng = random.Random(31)
    for _ in range(30):
        sets = []
        for _ in range(4):  # chains of edited copies
            now = rng.sample(range(10**9), 60)
            for _ in range(15):
                sets.append(frozenset(now))
                for at in rng.sample(range(60), 4):
                    now[at] = rng.randrange(10**9)
        rng.shuffle(sets)
        alike = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if len(x & y) >= 0.8 * len(x | y)}
        bucket = D._Bucket()
        got = {(i, j) for i, x in enumerate(sets) for j in bucket.add(i, np.array(sorted(x), "<u8").tobytes())}

        assert got <= alike and groups(got, len(sets)) == groups(alike, len(sets))


def test_ids_of_any_type(spark):
    rng = random.Random(2)
    text = prose(rng, 60)
    rows = [("b", f"{prose(rng, 30)} {text}"), ("a", f"{text} {prose(rng, 30)}"), ("c", prose(rng, 90))]
    got = {r.id: r for r in D.repeated_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert set(got) == {"a", "b"} and got["b"].class_id == "a" and got["b"].n_removed == 60 and got["a"].n_removed == 0


def test_near_copies_of_wrapped_paragraphs(spark):
    rng = random.Random(37)
    base = [prose(rng, 11) for _ in range(9)]
    other = [" ".join(["new", *line.split()[1:]]) if i in (2, 5) else line for i, line in enumerate(base)]
    rows = [(i, f"{prose(rng, 30)}\n\n" + "\n".join(lines) + f"\n\n{prose(rng, 30)}", "q", 1) for i, lines in enumerate((base, other))]
    got = {r.id: r for r in D.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].n_removed == 0 and got[1].n_removed == 99


def test_a_bucket_compares_no_pair_again_and_again(monkeypatch):
    rng = random.Random(47)
    common, read = rng.sample(range(10**9), 60), []
    monkeypatch.setattr(D.np, "frombuffer", lambda *x, real=np.frombuffer: read.append(0) or real(*x))
    bucket, links = D._Bucket(), set()
    heads = [[*common, *rng.sample(range(10**9), 30)] for _ in range(4)]  # alike by less than 0.8 from group to group
    for i in range(200):
        links |= {(i, j) for j in bucket.add(i, np.array(sorted([*heads[i % 4], i]), "<u8").tobytes())}
    assert groups(links, 200) == {frozenset(range(k, 200, 4)) for k in range(4)}
    assert len(read) <= 8 * 200


def test_texts_together_give_the_units_of_each():
    rng = random.Random(53)
    texts = ["", "\n", "a b", *("\n".join(prose(rng, rng.randrange(70)) for _ in range(rng.randrange(1, 5))) for _ in range(40)), *(" ".join("ab"[rng.randrange(2)] for _ in range(n)) for n in range(20, 60)), " É\tx\n"]
    rng.shuffle(texts)
    whole, alone = D.units(*texts), [D.units(x) for x in texts]
    for name in ("windows", "window_keys", "window_starts", "paragraphs", "keys", "starts", "sizes", "bands"):
        assert np.array_equal(getattr(whole, name), np.concatenate([getattr(x, name) for x in alone])), name
    assert whole.windows.sum() > 40 and whole.paragraphs.sum() > 10
