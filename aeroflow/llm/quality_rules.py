"""Quality rules for documents, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from aeroflow.llm.frames import let, table
from aeroflow.storage import materialise

SPACES = " \t\n\x0b\x0c\r"

#: Character classes beside white space and characters beyond ASCII.
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
MARKS = ".,;:!?'\"()-"

WINDOW_WORDS = 8

#: Words whose shares make a language's word histogram.
COMMON_WORDS = 16

#: A document or a language reference with fewer words is not judged by divergence.
MIN_DOC_WORDS = 50
MIN_REFERENCE_WORDS = 2000

#: Largest Jensen-Shannon distances (0 to 1) of a document's histograms from its language's, each
#: raised by LENGTH_ALLOWANCE / sqrt(words), as shares over few words scatter.
MAX_CLASS_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.26
LENGTH_ALLOWANCE = 0.6

#: A document far from its own language's reference is also compared with other languages': those
#: of so many languages with the most words (of equal ones the first). This bounds what is sent
#: to every task; a language's own documents always meet its own reference.
OTHER_REFERENCES = 256


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than the six ASCII white-space ones.

    Commas in words are written as vertical tabs, which no word holds otherwise, so that lists of
    words can be joined by commas.
    """
    coded = F.replace(F.replace(text, F.lit("\x0b"), F.lit(" ")), F.lit(","), F.lit("\x0b"))
    return F.array_remove(F.split(coded, "[ \t\n\x0c\r]", -1), "")


def _without(text: Column, characters: str) -> Column:
    listed = "".join("\\" + c if c in "&-[]^\\" else c for c in characters)
    return F.regexp_replace(text, f"[{listed}]+", "")


def _only(text: Column, characters: str) -> Column:
    listed = "".join("\\" + c if c in "&-[]^\\" else c for c in characters)
    return F.regexp_replace(text, f"[^{listed}]+", "")


def windows_of(words: Column) -> Column:
    """A hash of each window of 8 words: the XOR of the words' hashes, each shifted by its place."""
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    pair = lambda x, gap: F.transform(x, lambda a, i: a.bitwiseXOR(F.shiftleft(F.get(x, i + gap), gap)))
    eight = let(hashes, lambda h: let(pair(h, 1), lambda h2: let(pair(h2, 2), lambda h4: pair(h4, 4))))
    windows = F.slice(eight, 1, F.size(words) - WINDOW_WORDS + 1)
    return F.when(F.size(words) > WINDOW_WORDS, windows).otherwise(F.array().cast("array<long>"))


def repeated_window_words(windows: Column) -> Column:
    """Words that stand in a window found twice or more, from the hashes of all windows in order.

    Only texts with a repeated window go on: their windows are sorted as longs of a hash's upper
    bits and the window's place, neighbours are compared by whole hashes, and the places of equal
    ones, in order, give the words covered.
    """

    def covered(h: Column, mask: Column) -> Column:
        place = lambda x: x.bitwiseAND(mask).cast("int")
        same = lambda x, y: F.coalesce(F.get(h, place(x)) == F.get(h, place(y)), F.lit(False))
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))
        twice = let(packed, lambda s: F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | same(x, F.get(s, j - 1))))
        places = F.sort_array(F.transform(twice, place))
        steps = let(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW_WORDS)))))
        return F.aggregate(steps, F.lit(0), lambda total, n: total + n)

    bits = F.ceil(F.log2(F.size(windows) + 1)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(mask, lambda m: covered(windows, m))).otherwise(0).cast("long")


def jensen_shannon_distance(p: Column, q: Column) -> Column:
    """The distance (base 2, 0 to 1) of two arrays of shares with equal length."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)))


def _shares(counts: Column) -> Column:
    return let(F.aggregate(counts, F.lit(0).cast("long"), lambda x, y: x + y), lambda n: F.transform(counts, lambda c: c / F.greatest(n, F.lit(1))))


def _features(docs: DataFrame, id_col: str, text_col: str, lang_col: str, carried: str | None = None) -> DataFrame:
    """id, language key, text, words, base counts and character-class counts of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), key.alias("key"), text.alias("text"), (F.col(carried) if carried else F.lit(None)).alias("carried"))
    measured = base.select(
        "*",
        words_of(F.col("text")).alias("words"),
        F.length("text").cast("long").alias("chars"),
        reduce(lambda x, y: x + y, (F.size(F.split("text", c, -1)) - 1 for c in SPACES)).cast("long").alias("white"),
        _only(F.col("text"), SYMBOLS + UPPER + DIGITS + MARKS).alias("special"),
    )
    left = lambda *gone: F.length(_without(F.col("special"), "".join(gone))).cast("long")
    counted = measured.select(
        "*",
        F.length("special").cast("long").alias("n_special"),
        left(SYMBOLS).alias("a"),
        left(SYMBOLS, UPPER).alias("b"),
        left(SYMBOLS, UPPER, DIGITS).alias("c"),
        F.least(F.octet_length("text") - F.col("chars"), F.col("chars")).cast("long").alias("wide"),
    )
    symbols, upper, digits = F.col("n_special") - F.col("a"), F.col("a") - F.col("b"), F.col("b") - F.col("c")
    rest = F.greatest(F.lit(0).cast("long"), F.col("chars") - F.col("n_special") - F.col("wide") - F.col("white"))
    return counted.select("id", "key", "text", "carried", "words", F.size("words").cast("long").alias("n_words"), (F.col("chars") - F.col("white")).alias("word_chars"), symbols.alias("n_symbols"), F.array(symbols, upper, digits, F.col("c"), F.col("wide"), F.col("white"), rest).alias("classes"))


def references(features: DataFrame) -> DataFrame:
    """Per language: its words, common words, their shares and the shares of character classes.

    All documents count. Common words are the most frequent, of equally frequent ones the first.
    """
    classes = features.groupBy("key").agg(*(F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(7)))
    counts = features.select("key", F.explode("words").alias("word")).groupBy("key", "word").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), F.replace("word", F.lit("\x0b"), F.lit(","))))).where(F.col("rank") <= COMMON_WORDS)
    common = ranked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))  # 16 rows a language
    totals = counts.groupBy("key").agg(F.sum("n").alias("reference_words"))
    found = classes.join(common, "key").join(totals, "key")
    words = F.transform("top", lambda x: x["n"])
    other = F.col("reference_words") - F.aggregate(words, F.lit(0).cast("long"), lambda x, y: x + y)
    common = F.transform("top", lambda x: x["word"])
    return found.select(
        "key",
        "reference_words",
        common.alias("common"),
        F.array_join(common, ",").alias("common_list"),
        F.array_max(F.transform(common, lambda x: F.octet_length(x))).alias("longest"),
        _shares(F.array_append(words, other)).alias("word_shares"),
        _shares(F.array(*(F.col(f"c{i}") for i in range(7)))).alias("class_shares"),
    )


def _word_shares(words: Column, reference: Column) -> Column:
    """Shares in ``words`` of a reference's common words and of all others."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    hits = F.filter(words, lambda w: (F.octet_length(w) <= reference["longest"]) & (F.find_in_set(w, reference["common_list"]) > 0))
    counts = let(hits, lambda h: F.transform(reference["common"], lambda c: (F.size(h) - F.size(F.array_remove(h, c))).cast("long")))
    return let(counts, lambda c: _shares(F.array_append(c, F.size(words) - total(c))))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Base counts, divergences and the verdict for every row.

    A document's shares of character classes (symbols, upper case, digits, marks, bytes beyond
    ASCII, white space, the rest) and of its language's common words are compared with those of
    all documents of the language by Jensen-Shannon distance. It is rejected by the base rules
    (under 20 words, or over 30 % of the words in repeated windows of 8), or if a distance is too
    large for its length, both sides have enough words to tell, and no reference of the
    OTHER_REFERENCES largest languages is near, as a wrong language label is no lack of quality.

    Returns one row per input row: the id column, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, class_distance and word_distance (null where not judged), base_failed and
    kept; then the columns named in ``keep``. A null text counts as empty; documents without a
    language are a language; null and repeated ids and repeated rows pass through; an empty table
    gives no rows; further columns are left out.
    """
    carried = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None)
    known = materialise(references(_features(docs, id_col, text_col, lang_col)).where(F.col("reference_words") >= MIN_REFERENCE_WORDS), "quality-references")
    reference = F.struct("common", "common_list", "longest", "word_shares", "class_shares")
    most = known.orderBy(F.desc("reference_words"), "key").limit(OTHER_REFERENCES)
    others = most.agg(F.collect_list(reference).alias("others")).scalar()
    features = _features(docs.withColumn("_carried", carried), id_col, text_col, lang_col, "_carried").join(known.select("key", reference.alias("own")), "key", "left")
    with_line = lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0
    dup_lines = let(F.filter(F.split("text", "\n", -1), with_line), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    measured = features.select(
        "id",
        "carried",
        "words",
        "n_words",
        "word_chars",
        "n_symbols",
        dup_lines.alias("n_dup_lines"),
        windows_of(F.col("words")).alias("windows"),
        _shares(F.col("classes")).alias("class_shares"),
        F.when(F.col("n_words") >= MIN_DOC_WORDS, F.col("own")).alias("own"),
    )
    class_distance = lambda r: jensen_shannon_distance(F.col("class_shares"), r["class_shares"])
    word_distance = lambda r: jensen_shannon_distance(_word_shares(F.col("words"), r), r["word_shares"])
    placed = measured.withColumn("n_repeat_words", repeated_window_words(F.col("windows"))).drop("windows").select(
        "*",
        F.when(F.col("own").isNotNull(), class_distance(F.col("own"))).alias("class_distance"),
        F.when(F.col("own").isNotNull(), word_distance(F.col("own"))).alias("word_distance"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        (LENGTH_ALLOWANCE / F.sqrt(F.greatest("n_words", F.lit(1)))).alias("more"),
    )
    near = lambda c, w: (c <= MAX_CLASS_DISTANCE + F.col("more")) & (w <= MAX_WORD_DISTANCE + F.col("more"))
    far = ~F.col("base_failed") & F.col("own").isNotNull() & ~near(F.col("class_distance"), F.col("word_distance"))
    met = placed.select("*", F.when(far, others).alias("others"))
    like_another = F.exists("others", lambda r: near(class_distance(r), word_distance(r)))
    kept = ~F.col("base_failed") & (F.col("others").isNull() | like_another)
    out = met.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", kept.alias("kept"), "carried")
    return out.select(*out.columns[:-1], *(F.col("carried")[c].alias(c) for c in keep or []))


def good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    at = dict(zip(docs.columns, names))
    found = judged(held, at[id_col], at[text_col], at[lang_col], keep=names)
    places = [f"p{i}" for i in range(len(found.columns))]
    verdict = places[found.columns.index("kept")]
    # pushed below the rules, the filter would repeat their expressions inside their own loops; it
    # can't pass a column that is not deterministic
    fixed = found.toDF(*places).withColumn("row", F.monotonically_increasing_id())
    return fixed.where(F.col(verdict) & (F.col("row") >= 0)).select(*places[-len(names) :]).toDF(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict for every whole text; null texts fail the base rules."""
    return judged(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def _sql_distance(p: str, q: str) -> str:
    part = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, sum(({part(p)} + {part(q)}) / 2)))"


OP8_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce('=' || lang, '') AS key, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM texts),
base AS (
  SELECT doc_id, key, text, words, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines
  FROM split),
counts AS (
  SELECT doc_id, key, [n_symbols, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')), length(text) - length(regexp_replace(text, '[0-9]', '', 'g')),
         length(text) - length(regexp_replace(text, '[.,;:!?''"()-]', '', 'g')), least(strlen(text) - length(text), length(text)), length(text) - word_chars] AS parts, length(text) AS chars FROM base),
classes AS (SELECT doc_id, key, unnest(list_append(parts, greatest(0, chars - list_sum(parts)))) AS n, generate_subscripts(list_append(parts, 0), 1) AS i FROM counts),
class_doc AS (SELECT doc_id, i, n / greatest(1, sum(n) OVER (PARTITION BY doc_id)) AS p FROM classes),
class_ref AS (SELECT key, i, n / greatest(1, sum(n) OVER (PARTITION BY key)) AS q FROM (SELECT key, i, sum(n) AS n FROM classes GROUP BY ALL)),
tokens AS (SELECT doc_id, key, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM base),
frequent AS (SELECT key, word, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, word) AS rank FROM (SELECT key, word, count(*) AS n FROM tokens GROUP BY ALL) QUALIFY rank <= 16),
totals AS (SELECT key, sum(n_words) AS total, row_number() OVER (ORDER BY sum(n_words) DESC, key) AS place FROM base GROUP BY key HAVING sum(n_words) >= 2000),
word_ref AS (
  SELECT key, rank, word, n / total AS q FROM frequent JOIN totals USING (key)
  UNION ALL SELECT key, 0, NULL, (total - sum(n)) / total FROM frequent JOIN totals USING (key) GROUP BY key, total),
hits AS (SELECT t.doc_id, f.key, f.rank, count(*) AS n FROM tokens t JOIN frequent f USING (word) GROUP BY ALL),
docs AS (SELECT doc_id, key AS own, n_words, 0.6::DOUBLE / sqrt(greatest(1, n_words)) AS more FROM base WHERE n_words >= 50),
word_doc AS (
  SELECT d.doc_id, r.key, r.q, CASE WHEN r.rank > 0 THEN coalesce(h.n, 0) ELSE d.n_words - coalesce(sum(h.n) OVER (PARTITION BY d.doc_id, r.key), 0) END / d.n_words AS p
  FROM docs d CROSS JOIN word_ref r LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.key = r.key AND h.rank = r.rank),
word_far AS (SELECT doc_id, key, {_sql_distance("p", "q")} AS w FROM word_doc GROUP BY ALL),
class_far AS (SELECT d.doc_id, r.key, {_sql_distance("d.p", "r.q")} AS c FROM class_doc d JOIN class_ref r USING (i) GROUP BY ALL),
verdicts AS (
  SELECT d.doc_id, count(*) FILTER (t.key = d.own) = 0 OR bool_or((t.key = d.own OR t.place <= 256) AND w <= 0.26 + more AND c <= 0.22 + more) AS near
  FROM docs d LEFT JOIN totals t ON true LEFT JOIN word_far w ON w.doc_id = d.doc_id AND w.key = t.key LEFT JOIN class_far c ON c.doc_id = d.doc_id AND c.key = t.key GROUP BY d.doc_id),
windows AS (SELECT doc_id, i, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), ' ') AS w, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM tokens),
twice AS (SELECT doc_id, i FROM windows WHERE n = 8 QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
repeated AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + k AS i FROM twice, range(8) t(k)) GROUP BY doc_id),
rules AS (SELECT b.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM base b LEFT JOIN repeated USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(near, true) AS kept
FROM rules LEFT JOIN verdicts USING (doc_id)
"""
