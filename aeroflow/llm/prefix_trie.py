"""Prefix trie of conversations: shared openings as nodes, with totals of their subtrees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aeroflow.llm.frames import WORD, table
from aeroflow.operators.scan import PART, before, deal
from aeroflow.storage import materialise

#: Depths of one band: a node reaches at most so many ancestors at once.
BAND = 16

#: Conversation ids whose decimal forms are joined in one row before hashing.
IDS_PER_ROW = 4096

KEY = ["a", "b"]
_NO_IDS = hashlib.sha256(b"").hexdigest()


def _mixed(depth: Column, a: Column, b: Column) -> list[Column]:
    """Two 64-bit values of a turn at a depth. A node's key is the XOR of those on its path."""
    return [F.xxhash64(depth, a, b), F.xxhash64(b, a, depth)]


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, pos (from 1), a, b (128 bits of role and text) and words of each turn, by part."""
    names = [f"c{i}" for i in range(len(conversations.columns))]
    own = {c: F.col(names[conversations.columns.index(c)]) for c in (conv_col, turn_col, role_col, text_col)}
    role, text = F.coalesce(own[role_col], F.lit("")), F.coalesce(own[text_col], F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    held = conversations.toDF(*names).where(own[conv_col].isNotNull()).select(
        own[conv_col].cast("long").alias("conv_id"), own[turn_col].alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    placed = before(deal(held, ["conv_id"], order, "trie-turns"), ["conv_id"], order, {"before": (F.sum, F.lit(1))})
    halves = (F.conv(F.substring("digest", at, 16), 16, -10).cast("long").alias(k) for k, at in (("a", 1), ("b", 17)))
    return placed.select("conv_id", PART, (F.col("before") + 1).alias("pos"), *halves, "words")


def _rebuilt(turns: DataFrame, family: int, most: int) -> DataFrame:
    """A row for each rebuilt conversation and depth (0 too): its node's key, the key above and the words.

    Conversation c starts with the first h turns of conversation c - c % ``family``, where h is the
    CRC-32 of c's decimal form modulo ``most`` + 1, and goes on with its own turns after the first h.
    """
    first = turns.where(F.col("pos") == 1).select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    opening = turns.where((F.col("pos") <= most) & (F.col("conv_id") % family == 0)).groupBy(F.col("conv_id").alias("base"))
    opening = opening.agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("opening"))
    heads = first.join(opening, "base", "left").withColumn("opening", F.slice(F.coalesce("opening", F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,words:bigint>>")), F.lit(1), F.col("h")))
    mixed = F.transform("opening", lambda x: F.struct(*(m.alias(k) for k, m in zip(KEY, _mixed(x.pos, x.a, x.b), strict=True)), x["words"].alias("words")))
    heads = materialise(heads.select("conv_id", "h", mixed.alias("head")), "trie-heads")

    def upto(n: Column | int) -> list[Column]:
        part = F.slice("head", F.lit(1), F.lit(n) if isinstance(n, int) else n)
        return [F.aggregate(F.transform(part, lambda x: x[k]), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)) for k in KEY]  # noqa: B023

    roots = heads.select("conv_id", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(k) for k in (*KEY, "up_a", "up_b", "words")))
    taken = heads.where(F.size("head") > 0).select("*", F.explode(F.sequence(F.lit(1), F.size("head"))).alias("d"))
    (a, b), (up_a, up_b) = upto(F.col("d")), upto(F.col("d") - 1)
    taken = taken.select("conv_id", F.col("d").cast("long").alias("depth"), a.alias("a"), b.alias("b"), up_a.alias("up_a"), up_b.alias("up_b"), F.get("head", F.col("d") - 1)["words"].alias("words"))
    a, b = upto(most)
    own = turns.join(heads.select("conv_id", "h", F.size("head").alias("k"), a.alias("head_a"), b.alias("head_b")), "conv_id").where("pos > h")
    own = own.withColumn("depth", F.col("pos") - F.col("h") + F.col("k"))
    own = own.withColumns(dict(zip(("mix_a", "mix_b"), _mixed(F.col("depth"), F.col("a"), F.col("b")), strict=True)))
    own = before(own, ["conv_id"], [F.col("pos")], {"path_a": (F.bit_xor, F.col("mix_a")), "path_b": (F.bit_xor, F.col("mix_b"))})
    own = own.withColumns({f"up_{k}": F.col(f"path_{k}").bitwiseXOR(F.col(f"head_{k}")) for k in KEY})
    own = own.select("conv_id", "depth", *(F.col(f"up_{k}").bitwiseXOR(F.col(f"mix_{k}")).alias(k) for k in KEY), "up_a", "up_b", "words")
    return materialise(roots.unionByName(taken).unionByName(own), "trie-paths")


def _banded(paths: DataFrame, step: int, band: int) -> DataFrame:
    """The distinct nodes at depths divisible by ``step``, and their ancestors at such depths by band.

    n_convs, conv_id, words and the key above; ``within``: keys from the top of the node's band
    to the node itself; ``over``: for tops of bands, the keys of the whole band above. A band has
    at most ``band`` of these depths, so no array is longer. Conversations that agree to a
    band's end are counted in one row before its nodes are.
    """
    level = (F.col("depth") / step).cast("long")
    own, top = F.floor(level / band), (level % band == 0) & (level > 0)
    rows = paths.where(F.col("depth") % step == 0).select("conv_id", F.struct("depth", "a", "b", "up_a", "up_b", "words").alias("node"), F.explode(F.when(top, F.array(own, own - 1)).otherwise(F.array(own))).alias("band"))
    chains = rows.groupBy("conv_id", "band").agg(F.sort_array(F.collect_list("node")).alias("chain")).withColumn("end", F.element_at("chain", -1))
    chains = chains.groupBy("band", F.col("end.a").alias("end_a"), F.col("end.b").alias("end_b")).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("chain").alias("chain"))
    each = chains.select("band", "n", "least", "chain", F.posexplode("chain").alias("at", "node"))
    inside = F.col("at") < band
    keys = F.transform(F.slice("chain", F.lit(1), F.least(F.col("at") + 1, F.lit(band))), lambda x: F.struct(x.a.alias("a"), x.b.alias("b")))
    each = each.select("node.*", F.when(inside, F.col("n")).alias("n"), F.when(inside, F.col("least")).alias("least"), F.when(inside, keys).alias("within"), F.when(~inside, keys).alias("over"))
    same = (F.max(k).alias(k) for k in ("depth", "up_a", "up_b", "words"))
    nodes = each.groupBy(*KEY).agg(*same, F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.first("within", True).alias("within"), F.first("over", True).alias("over"))
    return materialise(nodes, "trie-nodes")


def _to_all(nodes: DataFrame, over: str, values: list[str]) -> DataFrame:
    """Each node's values summed at every key of its array ``over``."""
    return nodes.select(F.explode(over).alias("at"), *values).groupBy("at.a", "at.b").agg(*(F.sum(v).alias(v) for v in values))


def subtree_totals(paths: DataFrame, nodes: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """For each node the sums of ``values`` over its subtree, its own included.

    ``nodes``: from depths of one band, with the values. Nodes explode to the ancestors inside
    their band. The tops of bands, with the sums of their bands, are the nodes of a tree that is
    ``band`` times lower; it is summed in the same way. The completed totals of the tops then
    go to every node of the band above them. With depth D this takes about log D / log ``band`` rounds
    and at most 2 * ``band`` rows for each node.
    """
    deepest = paths.agg(F.max("depth")).first()[0] or 0
    levels, sums, step = [nodes], [], 1
    while True:
        sums.append(materialise(_to_all(levels[-1], "within", values), "trie-sums"))
        step *= band
        if deepest < step:
            break
        levels.append(_banded(paths, step, band).join(sums[-1], KEY))
    done = sums[-1]
    for level, own in zip(reversed(levels[:-1]), reversed(sums[:-1]), strict=True):
        tops = level.where(F.col("over").isNotNull()).select(*KEY, "over").join(done, KEY)
        done = own.unionByName(_to_all(tops, "over", values)).groupBy(*KEY).agg(*(F.sum(v).alias(v) for v in values))
        done = materialise(done, "trie-totals")
    return done


def _hashes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each key, from its rows in order."""
    key, digest = None, None
    names = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
    for found in rows:
        out = []
        for a, b, ids in zip(*(found[c].to_pylist() for c in ("a", "b", "ids")), strict=True):
            if (a, b) != key:
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([], [], []), names.types, strict=True)], schema=names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, digest.hexdigest()), names.types, strict=True)], schema=names)


def _ends(paths: DataFrame) -> DataFrame:
    """For each node where conversations end, the hash of their ids.

    At most ``IDS_PER_ROW`` ids, those of one range, are joined in a row; the rows of a node are
    hashed in order by a task that holds one of them at a time.
    """
    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", *KEY)).alias("end")).select("conv_id", "end.a", "end.b")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = materialise(last.groupBy(*KEY, F.floor(F.col("conv_id") / IDS_PER_ROW).alias("range")).agg(ids.alias("ids")), "trie-ends")
    per_node = chunks.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("range").alias("first"))
    one = chunks.join(per_node.where("n = 1"), KEY).select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    more = chunks.join(per_node.where("n > 1").select(*KEY), KEY).repartition(*KEY).sortWithinPartitions(*KEY, "range").select(*KEY, "ids")
    return one.unionByName(more.mapInArrow(_hashes, "a long, b long, ends_sha256 string"))


def conversation_trie(
    conversations: DataFrame,
    family: int = 20,
    most: int = 3,
    band: int = BAND,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The nodes of the prefix trie of rebuilt conversations, with totals of their subtrees.

    Turns are ordered by turn, null first; equal turns by role, then by a digest of role and text,
    so repeated rows are turns of their own. Null roles and texts are empty. Rows without a
    conversation id belong to none and are left out. An empty table has no nodes.

    A node is a distinct sequence of the first ``depth`` turns, told apart by 128 bits. Returned:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256 as the contract of the query states. Turns are placed and paths keyed by
    running totals over parts, so one conversation may hold any share of all rows.
    """
    paths = _rebuilt(materialise(_turns(conversations, conv_col, turn_col, role_col, text_col), "trie-placed"), family, most)
    nodes = _banded(paths, 1, band)
    children = nodes.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    nodes = materialise(nodes, "trie-valued")
    totals = subtree_totals(paths, nodes, ["n_leaves", "saved_tokens"], band)
    out = nodes.select(*KEY, "up_a", "up_b", "conv_id", "depth", "n_convs", "n_children").join(totals, KEY).join(_ends(paths), KEY, "left")
    above = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(above, ["up_a", "up_b"], "left")
    parent = F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id")
    return out.select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_IDS)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each opened by turns of the first conversation of its twenty."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(strlen(role) || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(str_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: list_reduce(list_concat([xor(c, x)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM turns),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, sha256(strlen(role) || ':' || role || text) AS one,
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt),
paths AS (
  SELECT conv_id, depth, words, string_agg(one, '') OVER w AS key, coalesce(string_agg(one, '') OVER b, '') AS up FROM placed
  WINDOW w AS (PARTITION BY conv_id ORDER BY depth), b AS (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM convs),
nodes AS (SELECT key, any_value(up) AS up, any_value(depth) AS depth, any_value(words) AS words, count(*) AS n_convs, min(conv_id) AS conv_id FROM paths GROUP BY key),
kids AS (SELECT up AS key, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
valued AS (SELECT n.*, coalesce(k.n, 0) AS n_children, (n_convs - 1) * words AS saved FROM nodes n LEFT JOIN kids k USING (key)),
totals AS (
  SELECT substr(v.key, 1, 64 * d.d) AS key, sum((v.n_children = 0)::INT) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM valued v, LATERAL (SELECT unnest(range(v.depth + 1)) AS d) d GROUP BY 1),
lasts AS (SELECT conv_id, arg_max(key, depth) AS key FROM paths GROUP BY conv_id),
ends AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM lasts GROUP BY key)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves,
  t.saved_tokens::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM valued v JOIN totals t USING (key) LEFT JOIN ends e USING (key) LEFT JOIN nodes p ON v.up = p.key
"""
