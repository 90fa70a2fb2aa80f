"""A stored lexical index: inverted lists in buckets, refreshed by content hash, searched for the best k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from aeroflow.storage import materialise

#: Weight of a token by where a document has it, and of the whole phrase.
WEIGHTS = {"title_tokens": 4, "entity_tokens": 3, "text_tokens": 1}
PHRASE = 6

#: Folders of inverted lists; a token's list is in the one of its hash.
BUCKETS = 64


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _weighted(tokens: Column, weight: int) -> Column:
    return F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.struct(t.alias("token"), F.lit(weight).alias("w")))


def index_records(docs: DataFrame) -> DataFrame:
    """Records to index: id, hash of the content, and all (token, weight) with the place of each token.

    ``docs``: id (unique) and some of the columns of WEIGHTS, arrays of distinct tokens; null is none.
    """
    places = [c for c in WEIGHTS if c in docs.columns]
    held = docs.select("id", *(F.sort_array(F.coalesce(F.col(c), F.array().cast("array<string>"))).alias(c) for c in places))
    told = F.concat_ws("\0", *(x for c in places for x in (F.lit(c), F.size(c).cast("string"), F.xxhash64(c).cast("string"), F.col(c))))
    entries = F.concat(*(_weighted(F.col(c), WEIGHTS[c]) for c in places))
    return held.select("id", F.sha2(told, 256).alias("hash"), entries.alias("entries"))


def _lists(held: DataFrame) -> DataFrame:
    """token, id and weight (of all places together) with the bucket, dealt by bucket."""
    each = held.select("id", F.explode("entries").alias("e")).select("id", "e.token", "e.w").withColumn("bucket", _bucket(F.col("token")))
    return each.repartition("bucket").groupBy("bucket", "token", "id").agg(F.sum("w").cast("int").alias("weight"))


class LexicalIndex:
    """An index below ``folder``.

    ``lists/bucket=n`` holds token, id and weight; ``documents/part=n`` id, hash and the buckets that a
    document's tokens are in. A refresh rewrites only folders that a changed document is or was
    in; all others keep their files.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def lists(self, kind: str = "bigint") -> DataFrame:
        return self._read("lists", f"token string, id {kind}, weight int, bucket int")

    def documents(self, kind: str = "bigint") -> DataFrame:
        return self._read("documents", f"id {kind}, hash string, buckets array<int>, part int")

    def refresh(self, held: DataFrame) -> dict[str, int]:
        """Bring the index up to date with all records (see ``index_records``); returns how many documents
        were added, changed, removed and kept, and how many folders of lists were rewritten."""
        kind = dict(held.dtypes)["id"]
        new = materialise(held, "index-records")
        old = self.documents(kind).select("id", F.col("hash").alias("old_hash"), F.col("buckets").alias("old_buckets"))
        met = new.select("id", "hash", F.array_distinct(F.transform("entries", lambda e: _bucket(e["token"]))).alias("buckets")).join(old, "id", "full")
        state = F.when(F.col("old_hash").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("hash") != F.col("old_hash"), "changed").otherwise("kept")
        met = materialise(met.withColumns({"state": state, "part": F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")}), "index-delta")
        counts = {r.state: r["count"] for r in met.groupBy("state").count().collect()}
        moved = met.where("state <> 'kept'")
        none = F.array().cast("array<int>")
        touched = sorted(r.b for r in moved.select(F.explode(F.array_union(F.coalesce("buckets", none), F.coalesce("old_buckets", none))).alias("b")).distinct().collect())  # BUCKETS at most
        parts = sorted(r.part for r in moved.select("part").distinct().collect())
        if touched:
            columns = ["token", "id", "weight", "bucket"]
            if counts.get("added", 0) == sum(counts.values()):  # nothing is there yet
                _lists(new).select(*columns).sortWithinPartitions("bucket", "token", "id").write.partitionBy("bucket").parquet(f"{self.folder}/lists")
            else:
                rest = self.lists(kind).where(F.col("bucket").isin(touched)).join(moved.select("id"), "id", "left_anti")
                fresh = _lists(new.join(moved.where("state <> 'removed'").select("id"), "id", "left_semi"))
                self._overwrite(rest.select(*columns).unionByName(fresh.select(*columns)), "lists", "bucket", touched)
        if parts:
            self._overwrite(met.where(F.col("part").isin(parts) & (F.col("state") != "removed")).select("id", "hash", "buckets", "part"), "documents", "part", parts)
        return {**{s: counts.get(s, 0) for s in ("added", "changed", "removed", "kept")}, "folders": len(touched)}

    def _overwrite(self, rows: DataFrame, name: str, key: str, values: list[int]) -> None:
        """Replace the folders ``values`` of a table: rows are written beside it first, so a failure before the
        move leaves it as it was; folders without rows go."""
        held = materialise(rows, f"index-{name}")  # what is overwritten is also read
        written = held.repartition(F.col(key)).sortWithinPartitions(key, *(["token", "id"] if name == "lists" else ["id"]))
        written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{self.folder}/{name}")
        left = {r[0] for r in held.select(key).distinct().collect()}
        for value in set(values) - left:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{key}={value}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def search(self, queries: DataFrame, phrases: DataFrame | None = None, top: int = 5, least: int = 3, kind: str = "bigint") -> DataFrame:
        """query_id, id, score and place of the best ``top`` documents of each query, ties to the larger id.

        ``queries``: query_id, tokens (distinct); ``phrases``: query_id, id of documents that hold the
        query's phrase. Only folders that the queries' tokens are in are read. No document can
        score more by some tokens than the sum of their largest weights. The rarest third of a
        query's tokens (and its phrase) gives a first kth score; tokens are left out, from the most
        frequent on, while what they could add all together stays below it. A document without
        any other token can't be among the best, so the lists of these tokens only complete the
        scores of documents found by the others.
        """
        asked = queries.select("query_id", F.explode("tokens").alias("token")).withColumn("bucket", _bucket(F.col("token")))
        asked = materialise(asked, "search-asked")
        folders = [r.bucket for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
        lists = self.lists(kind).where(F.col("bucket").isin(folders)) if folders else self.lists(kind).where("false")
        lists = materialise(lists.join(asked.select("bucket", "token").distinct(), ["bucket", "token"], "left_semi").select("token", "id", "weight"), "search-lists")
        stats = lists.groupBy("token").agg(F.count("*").alias("df"), F.max("weight").alias("most"))
        rare = Window.partitionBy("query_id").orderBy("df", "token")
        ranked = asked.join(stats, "token").withColumn("nth", F.row_number().over(rare)).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
        often = Window.partitionBy("query_id").orderBy(F.desc("nth")).rowsBetween(Window.unboundedPreceding, 0)
        ranked = materialise(ranked.withColumn("could_add", F.sum("most").over(often)).select("query_id", "token", "nth", "n", "could_add"), "search-ranked")
        held = phrases.select("query_id", "id").distinct().withColumn("weight", F.lit(PHRASE)) if phrases is not None else lists.select(F.lit(None).cast(dict(queries.dtypes)["query_id"]).alias("query_id"), "id", "weight").where("false")
        points = lambda tokens: lists.join(tokens, "token").select("query_id", "id", "weight").unionByName(held)
        scored = lambda p: p.groupBy("query_id", "id").agg(F.sum("weight").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id"))
        best = lambda p: p.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
        first = best(scored(points(ranked.where(F.col("nth") <= F.ceil(F.col("n") / 3)).select("query_id", "token"))))
        kth = first.groupBy("query_id").agg(F.when(F.count("*") == top, F.min("score")).alias("kth"))
        marked = materialise(ranked.join(kth, "query_id", "left").withColumn("decides", F.col("could_add") >= F.greatest(F.coalesce("kth", F.lit(0)), F.lit(least))), "search-marked")
        found = materialise(scored(points(marked.where("decides").select("query_id", "token"))), "search-found")
        completing = lists.join(marked.where("not decides").select("query_id", "token"), "token").join(found.select("query_id", "id"), ["query_id", "id"], "left_semi")
        total = found.unionByName(completing.select("query_id", "id", F.col("weight").cast("long").alias("score"))).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
        return best(total.where(F.col("score") >= least)).select("query_id", "id", "score", "place")
