"""Mix sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from aeroflow.llm.frames import WORD, table
from aeroflow.storage import materialise, scratch

#: Documents that share one step of the prefix sums, about.
PER_BUCKET = 4000

#: Characters that lower a document's quality weight.
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """1 for a text without symbols down to 0.05 where a quarter of the characters are symbols."""
    symbols = F.size(F.split(text, f"[{SYMBOLS}]", -1)) - 1
    return F.greatest(F.lit(0.05), 1 - 4.0 * symbols / F.greatest(F.length(text), F.lit(1)))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """Target sizes of sources by weight, none above ``max_epochs`` times its source's size.

    ``sizes``: source, source_size (one row per source). What a capped source can't take goes to
    the others by weight, until none is above its cap. With the sources ordered by cap over
    weight, the level at which uncapped sources end is the highest of the levels that follow from
    capping the first 0, 1, 2... sources.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*map(F.lit, map(float, weights)))
    cap = F.col("source_size") * float(max_epochs)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source, not per document
    before = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    out = out.withColumn("left", F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
    out = out.withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    out = out.withColumn("level", F.max(F.col("left") / F.col("weights_left")).over(everything))
    return out.select("source", "source_size", "n_docs", F.least(cap, F.col("level") * F.col("weight")).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Decide how often a mix takes each document.

    Sources, in code-point order with null last, have ``weights`` in turn; together they supply
    ``share`` times all words, none more than ``max_epochs`` times its own. A source first gives
    complete epochs. For the rest its documents are ordered by Efraimidis-Spirakis keys
    (-ln u / w, with u from a hash of the id and w the quality weight of the text) and taken
    whole from the front as long as that brings the words nearer the target, so a source misses
    its target by half a document at most. The same input gives the same mix.

    The prefix sums run over buckets of keys, then within each bucket, so a source of any size is
    spread over many tasks. On a scale of log2 key no range of 1 / n holds more than 0.26 / n of
    a source's documents on average, whatever their weights, as a key's logarithm has a density of
    at most 1 / e; so buckets are even enough.

    Returns one row per input row: the id column, ``text_hash``, ``size`` (words; null text: 0),
    ``source_size``, ``target``, ``epochs`` int (times the document is taken) and ``taken``. A
    null source is a source; without an id, u comes from the text's hash; rows that repeat an id
    are documents of their own; an empty table gives no rows; further columns are left out.
    """
    names = {id_col: "id", text_col: "text", source_col: "source"}
    placed, _ = _placed(docs.select(*(F.col(c).alias(n) for c, n in names.items())), weights, share, max_epochs, seed)
    return placed.select(F.col("id").alias(id_col), "text_hash", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def _drawn(docs: DataFrame, seed: int) -> DataFrame:
    """All columns with text_hash, size, s (the source, never null) and the key of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.withColumn("text_hash", F.xxhash64(text))
    own = F.coalesce(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), F.concat(F.lit(f"{seed}:#"), F.col("text_hash").cast("string")))
    u = (F.conv(F.substring(F.md5(own), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return named.withColumns(
        {
            "s": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")),
            "size": F.regexp_count(text, F.lit(WORD)).cast("long"),
            "key": -F.log(u) / quality_weight(text),
        }
    )


def _placed(docs: DataFrame, weights: Sequence[float], share: float, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` (id, text, source) with its epochs, and the targets of the sources."""
    base = materialise(_drawn(docs, seed).select("id", "text_hash", F.col("source").cast("string").alias("source"), "s", "size", "key"), "mix-sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    wanted = targets(sizes, weights, share, max_epochs)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = wanted.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("s"), "source_size", "n_docs", "target", full.alias("full"))
    wanted = materialise(wanted, "mix-targets")
    scale = F.log2(F.greatest(F.col("key"), F.lit(1e-300)))
    keyed = base.drop("source").join(wanted, "s").withColumn("bucket", F.floor(scale * F.ceil(F.col("n_docs") / PER_BUCKET)))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    steps = keyed.groupBy("s", "bucket").agg(F.sum("size").alias("words")).select("s", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("s", "bucket").orderBy("key", "id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(steps, ["s", "bucket"]).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    rest = F.col("target") - F.col("full") * F.col("source_size")
    out = out.withColumn("epochs", (F.col("full") + F.when(2 * F.col("before") + F.col("size") <= 2 * rest, 1).otherwise(0)).cast("int"))
    return out.withColumn("epochs", F.least(F.col("epochs"), F.lit(max_epochs))), wanted


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, with all their columns.

    What a source gives beyond its complete epochs is the front of its order, up to one document;
    so each row is held against the last document taken of its source, and no text is shuffled.
    Rows that agree with that document in id, text and source are counted, and as many of them are
    taken once more as the plan has it, the first by the other columns.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    own = {n: names[docs.columns.index(c)] for c, n in ((id_col, "id"), (text_col, "text"), (source_col, "source"))}
    order = F.struct("key", "id", "text_hash", "size")
    with scratch(docs.sparkSession) as keep:
        placed, wanted = _placed(held.select(*(F.col(c).alias(n) for n, c in own.items())), weights, share, max_epochs, seed)
        more = placed.where(F.col("epochs") > F.col("full")).groupBy("s", order.alias("last")).agg(F.count("*").alias("n_last"))
        last = more.groupBy("s").agg(F.max(F.struct("last", "n_last")).alias("m")).select("s", "m.*")
        cuts = keep(materialise(wanted.select("s", "full").join(last, "s", "left"), "mix-cuts"))  # a row for each source
    drawn = _drawn(held.select("*", *(F.col(c).alias(n) for n, c in own.items())), seed).join(cuts, "s")
    at_cut = F.coalesce(order == F.col("last"), F.lit(False))
    epochs = F.col("full") + F.when(order < F.col("last"), 1).otherwise(0)
    copies = drawn.where(~at_cut).withColumn("n", F.least(epochs, F.lit(max_epochs)).cast("long"))
    alike = [c for c, t in held.dtypes if not any(x in t for x in ("map<", "variant"))]
    tied = drawn.where(at_cut).groupBy("s", "full", "n_last", *alike).agg(F.count("*").alias("rows"), *(F.first(c).alias(c) for c in names if c not in alike))
    ahead = F.coalesce(F.sum("rows").over(Window.partitionBy("s").orderBy(*(c for c, t in held.dtypes if c in alike and "interval" not in t)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.least("rows", F.greatest(F.lit(0).cast("long"), F.col("n_last") - ahead))
    tied = tied.withColumn("n", F.least(F.col("rows") * F.col("full") + extra, F.col("rows") * max_epochs).cast("long"))
    out = copies.select(*names, "n").unionByName(tied.select(*names, "n")).where("n > 0")
    some = out.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 1000))))
    each = F.sequence(F.lit(1).cast("long"), F.least(F.lit(1000).cast("long"), F.col("n") - 1000 * F.col("part")))
    return some.select(*names, F.explode(each)).select(*names).toDF(*docs.columns)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by the contract's weights: size, source_size, target and taken words of each row."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH base AS (
  SELECT doc_id, source, length(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g')) - length(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', '', 'g')) AS size,
         -ln((('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
         / greatest(0.05::DOUBLE, 1 - 4.0::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>', ''))) / greatest(length(text), 1)) AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighted AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM weighted WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wanted AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM levels),
placed AS (
  SELECT b.doc_id, b.size, w.source_size, w.target, CASE WHEN w.source_size > 0 THEN floor(w.target / w.source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM base b JOIN wanted w ON b.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * least(2, epochs + CASE WHEN 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
