"""Queries over the provided tables, one for each operator, and their SQL.

The tables stand in for news items (documents), observations and run logs (events), history
(orders, lineitem) and dimensions; each query keeps its operator's rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from aeroflow.functions import text as T
from aeroflow.operators import briefings as B, gates as G, grouping as P, history as H, ingest as I, metrics as M, tracks as K
from aeroflow.plans.registry import ORACLE_SQL, QUERIES, query
from aeroflow.sources.lexical_index import LexicalIndex, index_records
from aeroflow.storage import new_path

__all__ = ["ORACLE_SQL", "QUERIES"]

AS_OF = "2024-01-20 12:00:00"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _as_of(spark: SparkSession):
    return F.lit(AS_OF).cast("timestamp_ntz")


def _time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as items: the first line is the title, the rest the summary."""
    docs = _read(spark, d, "documents")
    return docs.select("doc_id", "source", "text", T.first_line(F.col("text")).alias("title"), T.rest_of(F.col("text")).alias("summary"))


_ITEMS = "items AS (SELECT doc_id, source, text, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS summary FROM documents)"
_GROUPS = f"""
WITH RECURSIVE {_ITEMS},
sets AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(title || ' ' || substr(summary, 1, 280)), '[a-z0-9]{{5,}}'))) AS t FROM items),
distinct_sets AS (SELECT t, min(doc_id) AS id, len(t) AS n FROM sets WHERE len(t) >= 4 GROUP BY t),
spread AS (SELECT id, n, unnest(t) AS token FROM distinct_sets),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS s, any_value(a.n) AS n, any_value(b.n) AS m FROM spread a JOIN spread b ON a.token = b.token AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) >= 4),
links AS (SELECT a, b FROM shared WHERE s >= 0.55::DOUBLE * least(n, m) OR s >= 0.38::DOUBLE * (n + m - s)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM distinct_sets UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
labels AS (SELECT a AS id, min(b) AS label FROM reach GROUP BY a),
groups AS (SELECT s.doc_id, coalesce(l.label, s.doc_id) AS group_id FROM sets s LEFT JOIN distinct_sets d ON s.t = d.t LEFT JOIN labels l ON l.id = d.id)
"""


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).select(F.col("doc_id").alias("id"), T.tokens(F.concat_ws(" ", "title", F.substring("summary", 1, 280))).alias("tokens"))
    return P.token_groups(items)


@query(_GROUPS.replace("substr(summary, 1, 280)", "summary") + "SELECT doc_id, group_id FROM groups")
def token_groups(spark, d):
    """Groups by the tokens of whole texts."""
    items = _items(spark, d).select(F.col("doc_id").alias("id"), T.tokens(F.concat_ws(" ", "title", "summary")).alias("tokens"))
    return P.token_groups(items).select(F.col("id").alias("doc_id"), "group_id")


def _stories(spark: SparkSession, d: str) -> DataFrame:
    """Items with title keys and event tokens."""
    items = _items(spark, d)
    return items.select(F.col("doc_id").alias("id"), "source", "summary", T.title_key(F.col("title")).alias("title"), P.event_tokens(F.col("title"), F.col("summary")).alias("tokens"))


@query(None)
def event_groups(spark, d):
    """Items of one event by titles, tokens and anchors; the sequence ratio has no SQL form."""
    return P.event_groups(_stories(spark, d)).select(F.col("id").alias("doc_id"), "group_id")


_FACTS = _GROUPS + """,
placed AS (SELECT g.group_id, i.doc_id, i.source, contains(lower(i.title), 'the') AS priority, row_number() OVER (PARTITION BY g.group_id ORDER BY length(i.summary) DESC, i.doc_id) AS place FROM groups g JOIN items i USING (doc_id)),
facts AS (SELECT group_id, count(*) AS n_members, min_by(doc_id, place) AS lead_id, count(DISTINCT source) AS n_sources, bool_or(priority) AS priority, max(doc_id) AS newest_id FROM placed WHERE place <= 6 GROUP BY group_id)
"""


def _facts(spark, d):
    items = _items(spark, d).select(F.col("doc_id").alias("id"), "source", F.length("summary").alias("summary_chars"), F.contains(F.lower("title"), F.lit("the")).alias("priority"))
    return P.group_facts(_grouped(spark, d).join(items, "id"))


@query(_FACTS + "SELECT * FROM facts")
def group_facts(spark, d):
    return _facts(spark, d)


@query(_FACTS + "SELECT *, row_number() OVER (ORDER BY priority DESC, n_sources > 1 DESC, newest_id DESC) AS rank FROM facts QUALIFY rank <= 12")
def group_facts_ranked(spark, d):
    return P.ranked_groups(_facts(spark, d))


_PENDING = _GROUPS.replace("FROM documents)", "FROM documents WHERE doc_id % 160 <= 120)", 1) + """,
sized AS (SELECT g.*, i.source, i.summary, i.title, count(*) OVER (PARTITION BY g.group_id) AS n FROM groups g JOIN items i USING (doc_id)),
notices AS (SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id % 160, doc_id) - 1) // 6 AS chunk, source FROM sized WHERE n = 1 AND regexp_matches(title, '^[A-C]')),
rounds AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY source, chunk) AS first, count(*) OVER (PARTITION BY source, chunk) AS n FROM notices),
kinds AS (SELECT s.doc_id, s.source, s.summary, coalesce(r.first, s.group_id) AS group_id, coalesce(r.n > 1, false) AS roundup FROM sized s LEFT JOIN rounds r USING (doc_id)),
told AS (SELECT *, doc_id % 7 = 0 AS seen FROM kinds),
pending AS (SELECT group_id, bool_or(roundup) AS roundup, bool_or(seen) AS is_update FROM told GROUP BY group_id HAVING NOT bool_and(seen)),
best AS (SELECT t.*, row_number() OVER (PARTITION BY group_id ORDER BY length(summary) DESC, doc_id) AS place FROM told t),
facts AS (SELECT p.group_id, p.roundup, p.is_update, count(*) AS n_members, count(DISTINCT b.source) AS n_sources, arg_min(b.doc_id, b.place) AS lead_id, p.roundup OR bool_or(length(trim(b.summary)) >= 25) AS material, min(b.doc_id % 160) AS newest_h FROM pending p JOIN best b USING (group_id) WHERE b.place <= 6 GROUP BY p.group_id, p.roundup, p.is_update)
SELECT *, row_number() OVER (ORDER BY material DESC, n_sources > 1 DESC, newest_h, group_id)::INTEGER AS rank FROM facts QUALIFY rank <= 12
"""


@query(_PENDING)
def pending_groups(spark, d):
    """Fresh items to ranked groups: stories, roundups of lone notices, nothing that is all known."""
    age = F.col("doc_id") % 160
    items = _items(spark, d).where(G.freshness(F.timestamp_add("HOUR", (-age).cast("int"), F.lit(AS_OF).cast("timestamp_ntz")), _as_of(spark), F.lit("x")) == "fresh")
    rows = items.select(F.col("doc_id").alias("id"), "source", age.alias("age"), "title", "summary", (F.col("doc_id") % 7 == 0).alias("echoes"), (F.col("doc_id") % 7 > 0).alias("is_new"), T.tokens(F.concat_ws(" ", "title", F.substring("summary", 1, 280))).alias("tokens"))
    found = P.pending_groups(rows, P.token_groups(rows), F.col("title").rlike("^[A-C]"))
    return found.select("group_id", "roundup", "is_update", "n_members", "n_sources", "lead_id", "material", F.col("newest").alias("newest_h"), "rank")


@query(None)
def pending_stories(spark, d):
    """Fresh items, grouped by event, against the memory of older ones: the groups to report on next.

    Ages are hours before the time of reading; items beyond the window of 120 hours are what was seen.
    """
    now = _as_of(spark)
    aged = _stories(spark, d).withColumn("age", F.col("id") % 160).withColumn("stamp", F.timestamp_add("HOUR", (-F.col("age")).cast("int"), now))
    reason = G.freshness(F.col("stamp"), now, F.col("title"))
    fresh, memory = aged.where(reason == "fresh"), aged.where(reason == "old").select("title", F.col("stamp").alias("first_seen"))
    none = F.lit(None).cast("string").alias("url")
    items = P.novelty(fresh.select("*", none), memory.select(none), memory, now)
    found = P.pending_groups(items, P.event_groups(fresh), F.col("title").rlike("^incident\\b"))
    return found.select("group_id", "roundup", "is_update", "n_members", "n_sources", "lead_id", "material", "newest", "rank")


@query(f"""
WITH reasons AS (SELECT event_type, CASE WHEN trim(event_type) = '' THEN 'untitled' WHEN ts IS NULL THEN 'fresh'
  WHEN ts < TIMESTAMP '{AS_OF}' - INTERVAL 120 HOUR THEN 'old' WHEN ts > TIMESTAMP '{AS_OF}' + INTERVAL 6 HOUR THEN 'future' ELSE 'fresh' END AS reason FROM events)
SELECT event_type, reason, count(*) AS n FROM reasons GROUP BY ALL""")
def freshness_reasons(spark, d):
    events = _read(spark, d, "events")
    reason = G.freshness(F.col("ts"), _as_of(spark), F.col("event_type"))
    return events.groupBy("event_type", reason.alias("reason")).agg(F.count("*").alias("n"))


_URL = r"""
WITH bare AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS b FROM pages),
parts AS (SELECT page_id, url, b, lower(regexp_extract(b, '^[a-zA-Z]+://[^/?]*')) AS head FROM bare),
cut AS (SELECT page_id, url, head, regexp_replace(regexp_replace(substr(b, length(head) + 1), '\?.*$', ''), '/+$', '') AS path,
  list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]*|fbclid|gclid|ref|spm)(=|$)')) AS q FROM parts),
canonical AS (SELECT page_id, url, head || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url FROM cut)
"""


@query(_URL + "SELECT page_id, canonical_url, regexp_matches(canonical_url, '^https?://[^/\\s@<>\"'']+\\.[a-z]{2,}([/?#][^\\s<>\"'']*)?$') AS safe FROM canonical")
def canonical_urls(spark, d):
    pages = _read(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical_url"))
    return pages.withColumn("safe", T.is_safe_url(F.col("canonical_url")))


@query(_URL + "SELECT page_id, url, canonical_url FROM canonical QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY page_id) = 1")
def distinct_links(spark, d):
    pages = _read(spark, d, "pages").select("page_id", "url", T.canonical_url(F.col("url")).alias("canonical_url"))
    return I.newest(pages, ["canonical_url"], [F.col("page_id")], 1).drop("place")


@query("""
SELECT event_id, event_id % 3 = 0 AS inferred, strftime(CASE WHEN event_id % 3 = 0 THEN min(ts) OVER (PARTITION BY user_id, event_type) ELSE ts END, '%Y-%m-%d %H:%M:%S') AS stamp FROM events""")
def first_seen_stamp(spark, d):
    events = _read(spark, d, "events").withColumn("dated", F.when(F.col("event_id") % 3 != 0, F.col("ts")))
    return I.first_seen(events, ["user_id", "event_type"], "dated", "ts").select("event_id", "inferred", _time("dated").alias("stamp"))


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events""")
def carry_forward(spark, d):
    events = _read(spark, d, "events")
    return I.carried_forward(events, ["user_id"], ["ts", "event_id"], "event_id", F.col("event_type") != "error").select("event_id", "user_id", "carried")


_STATUS = """
WITH status AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS last_ok, max(ts) AS last_fetch, bool_or(event_type <> 'error') FILTER (true) AS any_ok,
  arg_max(event_type <> 'error', (ts, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)) AS ok, count(*) AS fetches FROM events GROUP BY user_id)
"""


@query(_STATUS + "SELECT user_id, strftime(last_ok, '%Y-%m-%d %H:%M:%S') AS last_ok, strftime(last_fetch, '%Y-%m-%d %H:%M:%S') AS last_fetch, ok, fetches FROM status")
def source_status(spark, d):
    status = I.source_status(_read(spark, d, "events"), "user_id", "ts", F.col("event_type") != "error")
    return status.select("user_id", _time("last_ok").alias("last_ok"), _time("last_fetch").alias("last_fetch"), "ok", "fetches")


@query(_STATUS + "SELECT user_id, CASE WHEN last_ok IS NULL THEN 'never' WHEN date_diff('second', last_ok, TIMESTAMP '2024-01-30 12:00:00') // 3600 > 12 THEN 'silent' WHEN NOT ok THEN 'failing' END AS warning FROM status WHERE warning IS NOT NULL")
def coverage_warnings(spark, d):
    status = I.source_status(_read(spark, d, "events"), "user_id", "ts", F.col("event_type") != "error")
    return I.coverage_warnings(status, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), 12).select("user_id", "warning")


@query("SELECT o_orderpriority, o_orderkey, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place <= 60")
def capped_log(spark, d):
    orders = _read(spark, d, "orders")
    return I.newest(orders, ["o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 60).select("o_orderpriority", "o_orderkey", "place")


@query("SELECT doc_id, CASE WHEN length(title) > 60 THEN rtrim(substr(title, 1, 59)) || '…' ELSE title END AS title, place::INTEGER AS place FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place <= 25")
def finalised_items(spark, d):
    items = I.newest(_items(spark, d), ["source"], [F.col("doc_id")], 25)
    return items.select("doc_id", I.clipped(F.col("title"), 60).alias("title"), "place")


@query("""
WITH w AS (SELECT *, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01 07:00:00') AS s FROM events WHERE ts IS NOT NULL)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE s + INTERVAL 8 HOUR <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL""")
def briefing_windows(spark, d):
    rows = B.closed(_read(spark, d, "events"), "ts", _as_of(spark))
    return rows.groupBy(_time("window.start").alias("window_start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH w AS (SELECT user_id, event_id, event_type, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01 07:00:00') AS s FROM events WHERE ts IS NOT NULL),
f AS (SELECT user_id, event_type, min(s) AS s FROM w GROUP BY ALL),
n AS (SELECT user_id, s, array_to_string(list_sort(list(event_type)), ',') AS new_facts FROM f GROUP BY ALL),
seen AS (SELECT user_id, s, count(*) AS n_rows, min(event_id) AS first_row FROM w GROUP BY ALL)
SELECT user_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, n_rows, first_row, coalesce(new_facts, '') AS new_facts,
  CASE WHEN s = min(s) OVER (PARTITION BY user_id) THEN 'new' WHEN new_facts IS NOT NULL THEN 'update' ELSE 'unchanged' END AS state
FROM seen LEFT JOIN n USING (user_id, s)""")
def event_updates(spark, d):
    out = B.event_updates(_read(spark, d, "events"), "user_id", "ts", "event_type", "event_id")
    return out.select("user_id", _time("start").alias("window_start"), "n_rows", "first_row", F.coalesce(F.array_join("new_facts", ","), F.lit("")).alias("new_facts"), "state")


@query("""
WITH a AS (SELECT event_id, event_type AS section, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), event_type ORDER BY value DESC, ts, event_id) AS place FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY section, place) AS total_place FROM a WHERE place <= 6)
SELECT day, section, event_id, total_place::INTEGER AS total_place FROM b WHERE total_place <= 15""")
def section_top_k(spark, d):
    rows = _read(spark, d, "events").withColumn("section", F.col("event_type")).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    top = B.section_top(rows, ["day"], F.col("section"), [F.desc("value"), F.col("ts"), F.col("event_id")])
    return top.select("day", "section", "event_id", "total_place")


_COUNTS = """
WITH h AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS k, o_orderkey, o_custkey, o_orderdate::DATE AS day FROM orders),
counts AS (SELECT a.o_orderkey, count(b.day) FILTER (a.day - b.day <= 30) AS n_30d, count(b.day) FILTER (a.day - b.day <= 180) AS n_180d, count(b.day) AS n_365d
  FROM h a LEFT JOIN h b ON (a.k IS NULL OR a.k = b.o_custkey) AND b.day < a.day AND a.day - b.day <= 365 GROUP BY a.o_orderkey)
"""


def _counts(spark, d):
    orders = _read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    rows = orders.select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("o_custkey"), "day")
    return H.history_counts(rows, orders, "o_orderkey", "o_custkey", "day", [30, 180, 365])


@query(_COUNTS + "SELECT * FROM counts")
def history_counts(spark, d):
    return _counts(spark, d)


@query(_COUNTS + """,
flags AS (SELECT c.*, o_orderstatus = 'P' AS uo, o_totalprice > 300000 AS ut, o_orderstatus = 'F' AS co, o_totalprice < 50000 AS ct, o_orderpriority = '1-URGENT' AS fl FROM counts c JOIN orders USING (o_orderkey))
SELECT o_orderkey, greatest(0, least(100, 35 * uo::INT + 25 * (n_180d = 0)::INT + 15 * (n_365d = 0)::INT + 15 * ut::INT + 10 * fl::INT - 40 * co::INT - 15 * ct::INT - 30 * least(n_30d, 2)))::INTEGER AS score,
  array_to_string(list_filter([CASE WHEN uo THEN 'unusual operator' END, CASE WHEN n_180d = 0 THEN 'no such combination in 180 days' END, CASE WHEN n_365d = 0 THEN 'new registration in 365 days' END, CASE WHEN ut THEN 'unusual type' END, CASE WHEN fl THEN 'flagged' END, CASE WHEN co THEN 'usual operator' END, CASE WHEN ct THEN 'usual type' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM flags""")
def rarity_score(spark, d):
    orders = _read(spark, d, "orders")
    flags = orders.select(
        "o_orderkey",
        (F.col("o_orderstatus") == "P").alias("unusual_operator"),
        (F.col("o_totalprice") > 300000).alias("unusual_type"),
        (F.col("o_orderstatus") == "F").alias("usual_operator"),
        (F.col("o_totalprice") < 50000).alias("usual_type"),
        (F.col("o_orderpriority") == "1-URGENT").alias("flagged"),
    )
    counts = _counts(spark, d).withColumnsRenamed({"n_30d": "n_repeat_30d", "n_180d": "n_combo_180d", "n_365d": "n_registration_365d"})
    return H.rarity(flags.join(counts, "o_orderkey")).select("o_orderkey", "score", F.array_join("reasons", "; ").alias("reasons"))


@query("""
WITH w(entry, p_brand, p_size) AS (VALUES (1, 'Brand#13', NULL), (2, NULL, 7), (3, 'Brand#22', 12), (4, NULL, 30))
SELECT p_partkey, min(entry) AS entry FROM part p JOIN w ON (w.p_brand IS NULL OR w.p_brand = p.p_brand) AND (w.p_size IS NULL OR w.p_size = p.p_size) GROUP BY p_partkey""")
def watchlist_hits(spark, d):
    watchlist = spark.createDataFrame([(1, "Brand#13", None), (2, None, 7), (3, "Brand#22", 12), (4, None, 30)], "entry int, p_brand string, p_size int")
    return H.watched(_read(spark, d, "part"), watchlist, ["p_brand", "p_size"], "p_partkey")


@query("""
WITH f AS (SELECT c_custkey, c_nationkey, c_mktsegment, min(o_orderdate)::DATE AS since, max(o_orderdate)::DATE AS through FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN f ON o_custkey = c_custkey WHERE o_orderdate::DATE BETWEEN since + 30 AND through - 30""")
def dated_dimension(spark, d):
    orders = _read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("day"))
    spans = orders.groupBy("c_custkey").agg(F.date_add(F.min("day"), 30).alias("since"), F.date_sub(F.max("day"), 30).alias("through"))
    dimension = spans.join(_read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return H.dated_rows(orders, dimension, "c_custkey", "day", "since", "through").select("o_orderkey", "c_custkey", "c_mktsegment")


_PRICES = [("steel", 2.0, 8.0), ("standard", 1.0, 3.0), ("standard polished", 1.5, 4.5), ("promo", 0.5, 1.5), ("a", 0.1, 0.2)]


@query("""
WITH p(pattern, price_in, price_out) AS (VALUES ('steel', 2.0::DOUBLE, 8.0::DOUBLE), ('standard', 1.0, 3.0), ('standard polished', 1.5, 4.5), ('promo', 0.5, 1.5), ('a', 0.1, 0.2))
SELECT p_partkey, pattern, round((p_size * 1000 * price_in + p_retailprice * price_out) / 1e6::DOUBLE, 8) AS cost FROM part LEFT JOIN p ON contains(lower(p_type), pattern)
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(pattern) DESC NULLS LAST, pattern) = 1""")
def price_longest_match(spark, d):
    prices = spark.createDataFrame(_PRICES, "pattern string, price_in double, price_out double")
    met = H.longest_match(_read(spark, d, "part"), prices, "p_type", "pattern", "p_partkey")
    return met.select("p_partkey", "pattern", T.cost(F.col("p_size") * 1000, F.col("p_retailprice"), F.col("price_in"), F.col("price_out")).alias("cost"))


@query("SELECT event_type, count(*) AS calls, greatest(0, count(*) - count(CASE WHEN value > 5 THEN 1 END)) AS unknown_calls, sum(user_id) AS tokens_in, sum(event_id) AS tokens_out FROM events GROUP BY ROLLUP (event_type)")
def usage_totals(spark, d):
    events = _read(spark, d, "events").withColumn("usage", F.when(F.col("value") > 5, 1))
    out = M.usage_totals(events, "event_type", "usage", "user_id", "event_id")
    return out.withColumns({"tokens_in": F.col("tokens_in").cast("long"), "tokens_out": F.col("tokens_out").cast("long")})


_ATTEMPTS = "WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN value > 20 THEN 'ok' ELSE 'failed' END AS status, value, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events)"


def _attempts(spark, d):
    return _read(spark, d, "events").withColumn("status", F.when(F.col("value") > 20, "ok").otherwise("failed"))


@query(_ATTEMPTS + " SELECT event_type, count(*) AS attempts, count(*) FILTER (status = 'ok') AS successes, count(*) FILTER (status <> 'ok') AS failures, count(*) FILTER (event_type <> f) AS fallbacks, round(100.0::DOUBLE * count(*) FILTER (status = 'ok') / count(*), 1) AS success_share, round(avg(value), 4) AS mean_duration FROM a GROUP BY event_type")
def attempt_reliability(spark, d):
    return M.attempt_reliability(_attempts(spark, d), "user_id", "event_id", "event_type", "status", "value")


@query(_ATTEMPTS + ", r AS (SELECT user_id, count(*) AS n, arg_max(status, event_id) AS l, count(DISTINCT event_type) AS labels FROM a GROUP BY user_id) SELECT count(*) AS runs, count(*) FILTER (l = 'ok') AS published, count(*) FILTER (labels > 1) AS with_fallback, sum(n)::BIGINT AS attempts FROM r")
def run_summary(spark, d):
    return M.run_summary(_attempts(spark, d), "user_id", "event_id", "event_type", "status")


@query("SELECT event_type, count(*) AS events, count(*) FILTER (value IS NULL) AS unknown, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def assist_totals(spark, d):
    return M.assist_totals(_read(spark, d, "events"), "event_type", "value")


@query("""
WITH s AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY ALL)
SELECT strftime(day, '%Y-%m-%d') AS day, n, lag(n) OVER o AS previous,
  CASE WHEN count(n) OVER w7 >= 2 THEN round(avg(n) OVER w7, 4) END AS mean_7d, CASE WHEN count(n) OVER w30 >= 2 THEN round(avg(n) OVER w30, 4) END AS mean_30d,
  max(n) OVER w30 AS peak_30d, strftime(arg_max(day, (n, -epoch(day))) OVER w30, '%Y-%m-%d') AS peak_day, max(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 30 DAY PRECEDING) AS month_ago
FROM s WINDOW o AS (ORDER BY day), w7 AS (ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), w30 AS (ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def series_context(spark, d):
    series = _read(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    out = M.series_context(series, "day", "n")
    return out.withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "peak_day": F.date_format("peak_day", "yyyy-MM-dd")})


@query("SELECT event_id FROM events WHERE date_diff('minute', date_trunc('minute', ts), TIMESTAMP '2024-01-25 00:00:00') <= 10080 ORDER BY ts DESC, event_id DESC LIMIT 2000")
def retained_rows(spark, d):
    events = _read(spark, d, "events").withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    return M.retained(events, "minute", F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), 7, 2000, [F.desc("ts"), F.desc("event_id")]).select("event_id")


_DELTA = """
WITH o AS (SELECT c_custkey, md5(c_name || '|' || c_mktsegment) AS h FROM customer WHERE c_custkey % 7 <> 0),
n AS (SELECT c_custkey, md5(c_name || '|' || CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END) AS h FROM customer WHERE c_custkey % 11 <> 0),
states AS (SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'updated' ELSE 'unchanged' END AS state FROM o FULL JOIN n ON o.c_custkey = n.c_custkey)
"""


def _versions(spark, d):
    customer = _read(spark, d, "customer")
    digest = lambda segment: F.md5(F.concat_ws("|", "c_name", segment))
    old = customer.where("c_custkey % 7 <> 0").select("c_custkey", digest(F.col("c_mktsegment")).alias("h"))
    new = customer.where("c_custkey % 11 <> 0").select("c_custkey", digest(F.when(F.col("c_custkey") % 5 == 0, "NEW").otherwise(F.col("c_mktsegment"))).alias("h"))
    return old, new


@query(_DELTA + "SELECT state, count(*) AS n FROM states GROUP BY state")
def index_delta(spark, d):
    return I.index_delta(*_versions(spark, d), "c_custkey", "h").groupBy("state").agg(F.count("*").alias("n"))


@query(_DELTA + "SELECT c_custkey, h FROM n UNION ALL SELECT c_custkey, h FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def upserted_index(spark, d):
    old, new = _versions(spark, d)
    return I.upserted(old, new, "c_custkey")


@query(r"""
WITH q AS (SELECT item_id, unnest(string_split(text, chr(10))) AS quote FROM benchmark)
SELECT DISTINCT item_id, trim(quote) AS quote, doc_id FROM q JOIN documents ON contains(text, trim(quote)) WHERE length(trim(quote)) >= 8""")
def quote_verification(spark, d):
    """Each line of a benchmark item is a quote."""
    lines = _read(spark, d, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("quote"))
    quotes = lines.select("item_id", F.trim("quote").alias("quote")).distinct()
    return G.verified_quotes(quotes, _read(spark, d, "documents").select("doc_id", "text"), "quote", "text", "doc_id").select("item_id", "quote", "doc_id")


_SEARCH = f"""
WITH {_ITEMS},
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}'))) AS token FROM benchmark),
t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{{4,}}'))) AS token, 4 AS w FROM items UNION ALL SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Z][a-z]{{3,}}'), lambda x: lower(x)))), 3 FROM items UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(summary), '[a-z0-9]{{4,}}'))), 1 FROM items),
p AS (SELECT DISTINCT item_id AS query_id, doc_id, 6 AS w FROM (SELECT item_id, split_part(text, chr(10), 1) AS phrase FROM benchmark) JOIN documents ON contains(text, phrase) WHERE length(phrase) >= 8),
u AS (SELECT query_id, doc_id, w FROM q JOIN t USING (token) UNION ALL SELECT * FROM p)
SELECT query_id, doc_id, sum(w)::BIGINT AS score, row_number() OVER (PARTITION BY query_id ORDER BY sum(w) DESC, doc_id DESC)::INTEGER AS place FROM u GROUP BY query_id, doc_id HAVING sum(w) >= 3 QUALIFY place <= 5"""


def _searched(spark, d):
    """Queries, documents and phrases of the search: benchmark items against all documents."""
    items = _read(spark, d, "benchmark")
    queries = items.select(F.col("item_id").alias("query_id"), T.tokens(F.col("text"), 4).alias("tokens"))
    entities = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0)), lambda x: F.lower(x)))
    docs = _items(spark, d).select(F.col("doc_id").alias("id"), T.tokens(F.col("title"), 4).alias("title_tokens"), entities.alias("entity_tokens"), T.tokens(F.col("summary"), 4).alias("text_tokens"))
    phrases = G.verified_quotes(items.select(F.col("item_id").alias("query_id"), T.first_line(F.col("text")).alias("phrase")), _read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "phrase", "text", "id")
    return queries, docs, phrases


@query(_SEARCH)
def lexical_search(spark, d):
    return P.lexical_search(*_searched(spark, d)).select("query_id", F.col("id").alias("doc_id"), "score", "place")


@query(_SEARCH)
def indexed_search(spark, d):
    """The same search through a stored index, built for the documents as they are."""
    queries, docs, phrases = _searched(spark, d)
    index = LexicalIndex(spark, new_path(spark, "lexical-index"))
    index.refresh(index_records(docs))
    return index.search(queries, phrases).select("query_id", F.col("id").alias("doc_id"), "score", "place")


@query(f"""
WITH {_ITEMS}
SELECT doc_id, CASE WHEN lower(title) = 'the and' THEN 200 WHEN contains(lower(title), 'the and') THEN 100 ELSE 0 END + 20 * contains(lower(title), 'the')::INT + 6 * contains(lower(summary), 'the')::INT + 20 * contains(lower(title), 'and')::INT + 6 * contains(lower(summary), 'and')::INT AS score
FROM items WHERE (contains(lower(title), 'the') OR contains(lower(summary), 'the')) AND (contains(lower(title), 'and') OR contains(lower(summary), 'and'))""")
def site_search(spark, d):
    return P.site_search(_items(spark, d), ["the", "and"], "the and").select("doc_id", "score")


@query(f"""
WITH {_ITEMS},
t AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{{5,}}')) AS t FROM items),
s AS (SELECT doc_id, source, len(t) AS size, unnest(t) AS token FROM t),
m AS (SELECT a.doc_id AS seed_id, a.size, b.doc_id, count(*) AS shared FROM s a JOIN s b ON a.token = b.token AND a.source <> b.source AND a.doc_id <> b.doc_id GROUP BY ALL HAVING count(*) >= least(3, a.size))
SELECT seed_id, doc_id, shared, row_number() OVER (PARTITION BY seed_id ORDER BY shared DESC, doc_id)::INTEGER AS place FROM m QUALIFY place <= 4""")
def companion_rows(spark, d):
    items = _items(spark, d).select(F.col("doc_id").alias("id"), "source", T.tokens(F.col("title")).alias("tokens"))
    return P.companions(items.withColumnRenamed("id", "seed_id"), items).select("seed_id", F.col("id").alias("doc_id"), "shared", "place")


_GUARD = r"CASE WHEN regexp_matches(text, '[A-Za-z0-9+/]{80,}={0,2}') THEN 'encoded' WHEN regexp_matches(text, '(?i)(ignore|disregard|forget) (all |any )?(the |your )?(previous|prior|above|earlier) (instructions|rules|prompts)|system prompt|jailbreak|developer mode') THEN 'injection' WHEN regexp_matches(lower(text), ' (the|and) ') THEN 'on_topic' WHEN length(text) < 12 THEN 'too_short' ELSE 'off_topic' END"


@query(f"SELECT conv_id, turn, {_GUARD} AS label FROM conversations")
def guardrail_labels(spark, d):
    turns = _read(spark, d, "conversations")
    return turns.select("conv_id", "turn", G.guardrail(F.col("text"), " (the|and) ").alias("label"))


@query("""
WITH r AS (SELECT conv_id, turn, substr(coalesce(text, ''), 1, 700) AS part, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, substr(coalesce(text, ''), 1, 700) DESC) AS place FROM conversations WHERE role IN ('user', 'assistant')),
t AS (SELECT *, sum(length(part)) OVER (PARTITION BY conv_id ORDER BY turn DESC, part DESC ROWS UNBOUNDED PRECEDING) AS total FROM r WHERE place <= 6)
SELECT conv_id, turn, length(part) AS chars, total::BIGINT AS total FROM t WHERE total <= 3000""")
def history_budget(spark, d):
    out = G.history_budget(_read(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return out.select("conv_id", "turn", F.length("part").cast("long").alias("chars"), "total")


@query("""
WITH p AS (SELECT source, doc_id, substr(text, 1, 4000) AS part FROM documents),
b AS (SELECT *, 12000 - coalesce(sum(length(part)) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM p)
SELECT source, doc_id, length(substr(part, 1, l::INT)) AS chars, md5(substr(part, 1, l::INT)) AS part_md5 FROM b WHERE l > 0""")
def context_budget(spark, d):
    out = G.context_budget(_read(spark, d, "documents"), ["source"], [F.desc("doc_id")], "text", 4000, 12000, "doc_id")
    return out.select("source", "doc_id", F.length("part").cast("long").alias("chars"), F.md5("part").alias("part_md5"))


@query("WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS place FROM documents) SELECT source, doc_id, place::INTEGER AS place, ((place - 1) // 6)::BIGINT AS chunk, count(*) OVER (PARTITION BY source, (place - 1) // 6) AS chunk_rows FROM p")
def chunked_rows(spark, d):
    return G.chunked(_read(spark, d, "documents").select("source", "doc_id"), ["source"], [F.desc("doc_id")], 6)


@query("""
WITH a AS (SELECT n_name AS alias, n_nationkey AS entity FROM nation UNION ALL SELECT substr(n_name, 1, 2), n_nationkey FROM nation UNION ALL SELECT r_name, 100 + r_regionkey FROM region),
u AS (SELECT lower(alias) AS alias, min(entity) AS entity FROM a GROUP BY lower(alias) HAVING count(DISTINCT entity) = 1)
SELECT s_suppkey, entity FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN u ON lower(substr(n_name, 1, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 99 END)) = u.alias""")
def alias_resolution(spark, d):
    nation, region = _read(spark, d, "nation"), _read(spark, d, "region")
    names = nation.select(F.col("n_name").alias("alias"), F.col("n_nationkey").cast("int").alias("entity"))
    short = nation.select(F.substring("n_name", 1, 2).alias("alias"), F.col("n_nationkey").cast("int").alias("entity"))
    aliases = names.union(short).union(region.select("r_name", (F.col("r_regionkey") + 100).cast("int")))
    mentions = _read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.substring("n_name", 1, 2)).otherwise(F.col("n_name")).alias("mention"))
    return H.resolved(mentions, aliases, "mention").select("s_suppkey", "entity")


@query(r"""
WITH l AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(ignore|disregard|forget) (all |any )?(the |your )?(previous|prior|above|earlier) (instructions|rules|prompts)|system prompt|jailbreak|developer mode') THEN 'injection'
  WHEN regexp_matches(text, '(?i)(token|secret|password|api[_-]?key)\s*=\s*"?[0-9a-z]{16,}|BEGIN [A-Z ]*PRIVATE KEY|(^|\s)/(home|root|etc)/') THEN 'secret' ELSE 'pass' END AS label FROM documents)
SELECT doc_id, label FROM l WHERE label <> 'pass'""")
def injection_quarantine(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", G.quarantine(F.col("text")).alias("label"))
    return docs.where("label <> 'pass'")


@query(f"WITH {_ITEMS} SELECT doc_id, length(trim(CASE WHEN length(title) > 0 AND instr(summary, title) > 0 THEN substr(summary, 1, instr(summary, title) - 1) || substr(summary, instr(summary, title) + length(title)) ELSE summary END)) >= 25 AS material FROM items")
def material_items(spark, d):
    return _items(spark, d).select("doc_id", G.has_material(F.col("title"), F.col("summary")).alias("material"))


@query(f"WITH {_ITEMS} SELECT CASE WHEN regexp_matches(lower(title || ' ' || summary), '(^|[^\\pL\\pN_])(the|and)([^\\pL\\pN_]|$)') THEN 'a' WHEN regexp_matches(lower(title || ' ' || summary), '(^|[^\\pL\\pN_])(der|die)([^\\pL\\pN_]|$)') THEN 'b' ELSE 'ops' END AS category, coalesce((contains(lower(summary), 'the') OR contains(lower(summary), 'la')) AND regexp_matches(lower(summary), '[aeiou]n') AND NOT regexp_matches(lower(summary), 'token'), false) AS in_scope, count(*) AS n FROM items GROUP BY ALL")
def subject_categories(spark, d):
    items = _items(spark, d)
    label = G.category(F.concat_ws(" ", "title", "summary"), [("a", r"(?<![\pL\pN_])(the|and)(?![\pL\pN_])"), ("b", r"(?<![\pL\pN_])(der|die)(?![\pL\pN_])")], "ops")
    scope = G.keyword_scope(F.col("summary"), ["the", "la"], "[aeiou]n", "token")
    return items.groupBy(label.alias("category"), scope.alias("in_scope")).agg(F.count("*").alias("n"))


def _points(spark, d):
    """Events as points of tracks: a user's day is a track, the value sets height and distance."""
    events = _read(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    ground = F.col("event_type") == "purchase"
    return events.select("user_id", "day", "ts", F.col("event_id").alias("point_id"), F.when(~ground, F.col("value") * 300).alias("alt_ft"), ground.alias("on_ground"), (F.col("value") / 4).alias("distance_km"), (F.col("value") * 3).alias("ground_speed"), (F.col("event_id") % 2 == 0).alias("low_confidence"))


@query("""
WITH p AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, ts, event_id, CASE WHEN event_type <> 'purchase' THEN value * 300 END AS alt, event_type = 'purchase' AS g, value / 4 AS km, value * 3 AS v,
  row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS n FROM events),
l AS (SELECT user_id, day, arg_min(n, (alt, n)) FILTER (alt IS NOT NULL) AS ln, min(alt) AS low, max(n) AS n_points, arg_max(km, n) AS lk FROM p GROUP BY ALL),
f AS (SELECT user_id, day, any_value(n_points) AS n_points, max(alt) FILTER (n > ln) AS after_low, any_value(low) AS low, arg_max(g, n) AS lg, arg_max(v, n) AS lv, any_value(lk) AS lk, count(alt) AS air,
  arg_min(alt, n) FILTER (alt IS NOT NULL) AS fa, arg_max(alt, n) FILTER (alt IS NOT NULL) AS la, arg_min(km, n) FILTER (alt IS NOT NULL) AS fk, arg_max(km, n) FILTER (alt IS NOT NULL) AS ak, bool_and(event_id % 2 = 0) FILTER (alt IS NOT NULL) AS unsure,
  bool_or(n < n_points AND (coalesce(alt < 15000, false) OR km > lk)) AS came FROM p JOIN l USING (user_id, day) GROUP BY user_id, day)
SELECT user_id, day, n_points::INTEGER AS n_points, CASE WHEN after_low - low > 2000 THEN 'overflight' WHEN lg AND lk <= 5 THEN CASE WHEN lv > 100 THEN 'insufficient' WHEN came THEN 'confirmed' ELSE 'insufficient' END
  WHEN air >= 3 AND fa - la > 500 AND fk - ak > 2 AND ak <= 10 AND la <= 3000 AND NOT unsure THEN 'probable' WHEN la >= 15000 THEN 'overflight' WHEN fk - ak > 0 THEN 'approaching' ELSE 'observed' END AS status FROM f""")
def track_status(spark, d):
    return K.track_status(_points(spark, d), ["user_id", "day"]).select("user_id", "day", "n_points", "status")


_SEEN = """
WITH raw AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '~' ELSE '' END || 'AB' || user_id AS hex, ' b-' || user_id || ' ' AS r, CASE WHEN event_id % 4 > 0 THEN event_type END AS t, CASE WHEN event_type = 'click' THEN 'ground' ELSE (floor(value) * 300)::BIGINT::VARCHAR END AS alt,
    CASE WHEN event_id % 19 > 0 THEN value END AS lat, value AS lon, CASE WHEN event_id % 3 > 0 THEN event_id % 90 END AS seen, event_id % 43 AS seen_pos, (event_id % 5) * 3 AS flags, CASE event_id % 29 WHEN 0 THEN '7700' ELSE '1200' END AS squawk, CASE event_id % 31 WHEN 0 THEN 'general' ELSE 'none' END AS emergency,
    CASE event_id % 7 WHEN 0 THEN 'mlat' WHEN 1 THEN 'adsb_icao_nt' ELSE 'adsb_icao' END AS kind FROM events)
"""


@query(_SEEN + """
SELECT event_id, lower(ltrim(hex, '~')) AS hex, upper(trim(r)) AS registration, upper(t) AS type, alt = 'ground' AS on_ground, TRY_CAST(alt AS DOUBLE) AS alt_ft, kind = 'mlat' AS low_confidence,
  CASE WHEN starts_with(hex, '~') THEN 'address' WHEN flags & 1 <> 0 THEN 'military' WHEN flags & 4 <> 0 THEN 'pia' WHEN flags & 8 <> 0 THEN 'ladd' WHEN squawk = '7700' OR emergency <> 'none' THEN 'emergency'
    WHEN lat IS NULL OR seen_pos > 30 OR coalesce(seen > 60, false) OR kind = 'adsb_icao_nt' THEN 'position' END AS left_out FROM raw""")
def observation_rules(spark, d):
    """Events as raw observations: typed fields, and why a row may not be followed."""
    n, value = F.col("event_id"), F.col("value")
    text = lambda c: c.cast("string")
    raw = _read(spark, d, "events").select(
        "event_id", F.concat(F.when(n % 17 == 0, "~").otherwise(""), F.lit("AB"), text(F.col("user_id"))).alias("hex"), F.concat(F.lit(" b-"), text(F.col("user_id")), F.lit(" ")).alias("r"), F.when(n % 4 > 0, F.col("event_type")).alias("t"), F.lit(None).cast("string").alias("flight"),
        F.when(F.col("event_type") == "click", "ground").otherwise(text(F.floor(value) * 300)).alias("alt_baro"), value.alias("gs"), F.when(n % 19 > 0, value).alias("lat"), value.alias("lon"), F.when(n % 3 > 0, n % 90).alias("seen"), (n % 43).alias("seen_pos"), ((n % 5) * 3).cast("int").alias("dbFlags"),
        F.when(n % 29 == 0, "7700").otherwise("1200").alias("squawk"), F.when(n % 31 == 0, "general").otherwise("none").alias("emergency"), F.when(n % 7 == 0, "mlat").when(n % 7 == 1, "adsb_icao_nt").otherwise("adsb_icao").alias("type"), F.col("event_id").alias("ts"),
    )
    rows = K.normalised(raw).withColumnRenamed("ts", "event_id")
    ok = K.position_ok(F.col("lat"), F.col("lon"), F.col("seen"), F.col("seen_pos"), F.col("source_type"))
    reason = F.when(F.col("non_icao"), "address").otherwise(F.coalesce(K.sensitive_reason(F.col("dbFlags"), F.col("squawk"), F.col("emergency")), F.when(~ok, "position")))
    return rows.select("event_id", "hex", "registration", "type", "on_ground", "alt_ft", "low_confidence", reason.alias("left_out"))


@query(None)
def rate_limited(spark, d):
    events = _read(spark, d, "events")
    asked = events.withColumns({"cost": F.col("value") / 100, "outside": F.col("event_type") == "view"})
    found = B.rate_limited(asked, "user_id", "ts", "event_id", per_minute=2, per_day=10, cooldown_s=3600, question="event_type", cost="cost", budget=100.0, external="outside", external_per_day=1)
    return found.withColumnsRenamed({"user": "user_id", "request": "event_id"})


@query(None)
def title_ratio_pairs(spark, d):
    """Every two different title keys with a ratio of 0.75 or more, the one with the smaller id first."""
    titles = _items(spark, d).groupBy(T.title_key(F.col("title")).alias("title")).agg(F.min("doc_id").alias("id"))
    return P.similar_titles(titles, titles, once=True)


@query(None)
def page_text(spark, d):
    from aeroflow.sources.html_pages import page_texts

    return page_texts(_read(spark, d, "pages"))


@query("""
WITH c AS (SELECT c_custkey, 20 + c_nationkey AS lat, 100 + c_custkey % 40 AS lon FROM customer), s AS (SELECT s_suppkey, 20 + s_nationkey AS lat, 100 + s_suppkey % 40 AS lon, 150.0 AS radius_km FROM supplier),
m AS (SELECT c_custkey, s_suppkey, 6371.0::DOUBLE * 2 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2)))) AS km FROM c JOIN s ON abs(c.lat - s.lat) <= 2 AND abs(c.lon - s.lon) <= 3)
SELECT c_custkey, s_suppkey, round(km, 3) AS distance_km FROM m WHERE km <= 150""")
def geo_range_join(spark, d):
    points = _read(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") + 20).alias("lat"), (F.col("c_custkey") % 40 + 100).alias("lon"))
    places = _read(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") + 20).alias("p_lat"), (F.col("s_suppkey") % 40 + 100).alias("p_lon"), F.lit(150.0).alias("radius_km"))
    met = H.copies_within_radius(points, places, ("lat", "p_lat"), ("lon", "p_lon"), T.haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")))
    return met.select("c_custkey", "s_suppkey", F.round("distance_km", 3).alias("distance_km"))


from aeroflow.plans import article_queries as _articles, desk_queries as _desk, publish_queries as _publish, site_queries as _site  # noqa: E402,F401
