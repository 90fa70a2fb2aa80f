"""How the sources of a language differ in their words: exact distances and over-used terms."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from aeroflow.llm.frames import table
from aeroflow.storage import materialise

#: Terms counted in a task before their counts are handed on, and bytes of a text split at once.
HELD_TERMS = 300_000
PIECE = 1_000_000

#: Profiles evaluated at once, and cells of the matrix they make.
PROFILES = 2048
CELLS = 4_000_000

_SPACED = bytes((c | 0x20 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, of a bounded number of bytes at a time."""
    spaced, start = text.translate(_SPACED), 0
    while len(spaced) - start > PIECE:
        end = spaced.rfind(b" ", start, start + PIECE)
        if end < 0:
            end = spaced.find(b" ", start + PIECE)
        if end < 0:
            break
        yield spaced[start:end].split()
        start = end + 1
    yield spaced[start:].split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of terms and documents that hold them by (lang, source); a row without a term for each group."""
    uses, docs = defaultdict(Counter), defaultdict(Counter)

    def held() -> Iterator[pa.RecordBatch]:
        for (lang, source), counted in uses.items():
            terms, n = list(counted), len(counted)
            in_docs = docs[lang, source]
            columns = [pa.array([x] * (n + 1)) for x in (lang, source)]
            columns += [pa.array([*terms, None], pa.binary()).cast(pa.string()), pa.array([*counted.values(), 0], pa.int64()), pa.array([*map(in_docs.__getitem__, terms), 0], pa.int64())]
            yield from pa.Table.from_arrays(columns, schema=_COUNTS).to_batches(max_chunksize=20_000)
        uses.clear()
        docs.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
            counted, found, was = uses[lang, source], set(), len(uses[lang, source])
            for terms in _pieces(text.as_py()):
                counted.update(terms)
                found.update(terms)
            docs[lang, source].update(found)
            size += len(counted) - was
            if size > HELD_TERMS:
                yield from held()
                size = 0
    yield from held()


def _share(count: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * n_terms)), exactly."""
    return F.call_function("div", ((count + 5).cast("decimal(19,0)") * F.lit(1_000_000_000)), (total + 5 * n_terms).cast("decimal(19,0)")) + 1


def _distances(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of profiles and each source a, the distances of a to the sources after it."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("values", pa.list_(pa.int64()))])
    for batch in rows:
        for row in range(batch.num_rows):
            lang, zeros = batch["lang"][row].as_py(), np.array(batch["zeros"][row].values)
            block = batch["block"][row].values
            weights, entries = np.array(block.field("m")), block.field("profile")
            bounds = np.array(entries.offsets)
            at, share = (np.array(entries.values.field(k)) for k in ("at", "p"))
            step = max(1, CELLS // len(zeros))
            for start in range(0, len(weights), step):
                end = min(start + step, len(weights))
                own = slice(bounds[start], bounds[end])
                cells = np.tile(zeros, (end - start, 1))
                cells[np.repeat(np.arange(end - start), np.diff(bounds[start : end + 1])), at[own]] = share[own]
                sums = [weights[start:end] @ np.abs(cells[:, a + 1 :] - cells[:, a : a + 1]) for a in range(len(zeros) - 1)]
                if sums:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums)), pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.list_(pa.int64()))], schema=schema)


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and value of each two sources of a language.

    A term's profile is its share in each source that uses it. Terms of equal profiles are one
    cell with a multiplicity; cells are evaluated in blocks of about ``PROFILES``, and a block gives a
    sum for each pair of sources. Nothing is emitted for a pair and a term.
    """
    shares = kept.join(groups.select("lang", "source", "at", "total", "n_terms", "blocks"), ["lang", "source"])
    shares = shares.select("lang", "term", "blocks", F.struct("at", _share(F.col("n"), F.col("total"), F.col("n_terms")).alias("p")).alias("entry"))
    profiles = shares.groupBy("lang", "term").agg(F.max("blocks").alias("blocks"), F.sort_array(F.collect_list("entry")).alias("profile"))
    cells = profiles.groupBy("lang", "profile").agg(F.max("blocks").alias("blocks"), F.count("*").alias("m"))
    blocks = cells.groupBy("lang", F.pmod(F.xxhash64("profile"), F.col("blocks")).alias("b")).agg(F.collect_list(F.struct("m", "profile")).alias("block"))
    zeros = groups.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "zero"))), lambda x: x.zero).alias("zeros"))
    parts = blocks.join(zeros, "lang").select("lang", "block", "zeros").mapInArrow(_distances, "lang string, a int, values array<bigint>")
    sums = parts.select("lang", F.col("a").alias("at"), F.posexplode("values").alias("gap", "v")).groupBy("lang", "at", (F.col("at") + F.col("gap") + 1).alias("other")).agg(F.sum("v").alias("v"))
    both = sums.unionByName(sums.select("lang", F.col("other").alias("at"), F.col("at").alias("other"), "v"))
    names = groups.select("lang", "at", "source")
    pairs = names.join(names.select("lang", F.col("at").alias("other"), F.col("source").alias("item")), "lang").where("at <> other")
    return pairs.join(both, ["lang", "at", "other"], "left").select("lang", "source", "item", F.coalesce("v", F.lit(0).cast("long")).alias("value"))


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The ``top`` terms of each group by how far their share is above the language's.

    Terms with equal counts in group and language are a cell with one value. Cells of equal value
    are merged; at most ``top`` values, and of these only those that begin within ``top`` terms by
    cumulative multiplicity, are expanded to terms, in UTF-8 order.
    """
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("m"))
    cells = cells.join(groups.select("lang", "source", "total", "n_terms", "lang_total"), ["lang", "source"])
    value = _share(F.col("n"), F.col("total"), F.col("n_terms")) - _share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"))
    cells = materialise(cells.select("lang", "source", "n", "lang_n", "m", value.alias("value")).where("value > 0"), "audit-cells")
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    merged = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    merged = merged.withColumn("row", F.row_number().over(by_value)).where(F.col("row") <= top)
    merged = merged.withColumn("ahead", F.coalesce(F.sum("m").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("ahead") < top)
    wanted = cells.join(merged.select("lang", "source", "value", "ahead"), ["lang", "source", "value"]).drop("m")
    terms = kept.join(wanted, ["lang", "source", "n", "lang_n"])
    by_term = Window.partitionBy("lang", "source", "value").orderBy("term")
    terms = terms.withColumn("row", F.row_number().over(by_term)).where(F.col("row") <= top)
    return terms.withColumn("rank", (F.col("ahead") + F.col("row")).cast("int")).where(F.col("rank") <= top).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def source_divergence(
    docs: DataFrame,
    min_docs: int = 30,
    top: int = 50,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Distances between the sources of each language, and the terms that a source over-uses.

    Null text, lang and source are empty strings. Terms are runs of ASCII letters and characters
    beyond ASCII, with A-Z lower-cased; a language keeps those in ``min_docs`` of its documents.
    Returned: lang, source, part (``pair`` or ``term``), item, value and rank, as the contract of the
    query states. Repeated rows count as often as they occur. An empty table gives no rows; a group
    without kept terms has pairs, of value 0 where its language keeps none. All shares are
    computed from exact integers.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = (F.coalesce(F.col(names[docs.columns.index(c)]).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text")))
    counts = docs.toDF(*names).select(*own).mapInArrow(_count, "lang string, source string, term string, n long, n_docs long")
    counts = materialise(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")), "audit-counts")
    common = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"))
    common = materialise(common.where(F.col("n_docs") >= min_docs).drop("n_docs"), "audit-common")
    kept = materialise(counts.drop("n_docs").join(common, ["lang", "term"]), "audit-kept")
    langs = common.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "n_terms", "lang_total"])
    groups = groups.withColumn("at", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int"))
    groups = groups.withColumn("zero", F.when(F.col("n_terms") > 0, _share(F.lit(0), F.col("total"), F.col("n_terms"))).otherwise(0))
    groups = materialise(groups.withColumn("blocks", F.ceil(F.col("n_terms") / PROFILES)), "audit-groups")
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = _pairs(kept, groups).withColumn("rank", F.row_number().over(by_value))
    columns = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return pairs.select(*columns("pair")).unionByName(_terms(kept, groups, top).select(*columns("term")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents: every pair of sources of a language, 50 terms of each group."""
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
uses AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM uses GROUP BY ALL),
common AS (SELECT lang, term, count(*) AS lang_n FROM uses GROUP BY ALL HAVING count(DISTINCT id) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM common GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, sum(n) AS total FROM counts JOIN common USING (lang, term) GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, c.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (c.lang_n + 5)) // (l.lang_total + 5 * l.v) AS q
  FROM groups g JOIN common c ON c.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source LEFT JOIN counts n ON n.lang = g.lang AND n.source = g.source AND n.term = c.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value::BIGINT, rank::INT FROM terms WHERE rank <= 50
"""
