"""Queries for published tables and dimensions, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from aeroflow.functions import text as T
from aeroflow.operators import site as S
from aeroflow.plans.registry import query


def _read(spark, d, table):
    return spark.read.parquet(f"{d}/{table}.parquet")


def _stamp(text):
    return F.lit(text).cast("timestamp_ntz")


@query("""
WITH p AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'x1' ELSE chr((65 + s_nationkey % 26)::INT) || chr((65 + s_suppkey % 26)::INT) || chr((65 + s_suppkey // 26 % 26)::INT) || 'A' END AS k, s_acctbal / 80 AS lat, s_acctbal / 40 AS lon, s_suppkey % 11 AS r FROM supplier)
SELECT k, problem FROM (SELECT k, CASE WHEN NOT regexp_matches(k, '^[A-Z]{4}$') THEN 'key' WHEN count(*) OVER (PARTITION BY k) > 1 THEN 'repeated' WHEN NOT lat BETWEEN -90 AND 90 OR NOT lon BETWEEN -180 AND 180 THEN 'position' WHEN r <= 0 THEN 'radius' END AS problem FROM p) WHERE problem IS NOT NULL""")
def place_rules(spark, d):
    letter = lambda n: F.char((F.lit(65) + n % 26).cast("int"))
    key = F.when(F.col("s_suppkey") % 9 == 0, "x1").otherwise(F.concat(letter(F.col("s_nationkey")), letter(F.col("s_suppkey")), letter(F.floor(F.col("s_suppkey") / 26)), F.lit("A")))
    places = _read(spark, d, "supplier").select(key.alias("k"), (F.col("s_acctbal") / 80).alias("lat"), (F.col("s_acctbal") / 40).alias("lon"), (F.col("s_suppkey") % 11).alias("r"))
    return S.checked_places(places, "k", "lat", "lon", "r")


@query("""
WITH p AS (SELECT p_brand AS model, p_retailprice AS price, CASE WHEN p_size % 3 = 0 THEN 'https://prices.example.org/' || p_partkey WHEN p_size % 3 = 1 THEN 'http://prices.example.org/' || p_partkey ELSE 'https://other.example.org/' || p_partkey END AS source FROM part)
SELECT model, price, source FROM p WHERE price > 0 AND regexp_matches(source, '^https://prices.example.org(/|$)') QUALIFY row_number() OVER (PARTITION BY model ORDER BY source, price) = 1""")
def price_rules(spark, d):
    host = F.when(F.col("p_size") % 3 == 0, "https://prices.example.org/").when(F.col("p_size") % 3 == 1, "http://prices.example.org/").otherwise("https://other.example.org/")
    prices = _read(spark, d, "part").select(F.col("p_brand").alias("model"), F.col("p_retailprice").alias("price"), F.concat(host, F.col("p_partkey").cast("string")).alias("source"))
    return S.checked_prices(prices, "model", "price", "source", "prices.example.org")


@query("""
SELECT user_id, round(100.0::DOUBLE * count(*) FILTER (event_type = 'error') / nullif(count(*) FILTER (event_type <> 'signup'), 0), 1) AS share,
  CASE WHEN m < 60 THEN m || ' min' WHEN m < 1440 THEN m // 60 || ' h' ELSE m // 1440 || ' d' END AS age
FROM (SELECT *, floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(ts) OVER (PARTITION BY user_id))) / 60)::BIGINT AS m FROM events) GROUP BY user_id, m""")
def source_view(spark, d):
    events = _read(spark, d, "events")
    by = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.count_if(F.col("event_type") != "signup").alias("n"), F.max("ts").alias("last"))
    return by.select("user_id", S.disruption_share(F.col("bad"), F.col("n")).alias("share"), S.age_label(F.col("last"), _stamp("2024-01-31 00:00:00")).alias("age"))


@query(r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1) || CASE WHEN doc_id % 2 = 0 THEN ' - ' || source ELSE '' END, '\s+[-|]\s+[^-|]{1,40}$', '')) AS b FROM documents)
SELECT doc_id, CASE WHEN length(b) >= 8 AND NOT regexp_matches(b, '^(https?://|www\.)|\.aspx$') THEN b END AS title FROM t""")
def clean_titles(spark, d):
    docs = _read(spark, d, "documents")
    title = F.concat(T.first_line(F.col("text")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" - "), "source")).otherwise(""))
    return docs.select("doc_id", S.clean_title(title).alias("title"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def parsed_dates(spark, d):
    orders = _read(spark, d, "orders")
    n = F.col("o_orderkey") % 3
    written = F.when(n == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(n == 1, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "d MMMM yyyy"))
    return orders.select("o_orderkey", F.date_format(S.any_date(written), "yyyy-MM-dd").alias("day"))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'license') THEN 'ground' WHEN regexp_matches(lower(text), 'token|secret') THEN 'safety' WHEN regexp_matches(lower(text), ' (der|die) ') THEN 'home' ELSE 'world' END AS section,
  CASE WHEN regexp_matches(lower(text), 'scum|trash') THEN 3 WHEN regexp_matches(lower(text), 'stupid|loser') THEN 2 ELSE 0 END AS severity FROM documents""")
def sections(spark, d):
    section, severity = S.classified(F.col("text"), [("ground", "license"), ("safety", "token|secret"), ("home", " (der|die) ")], "world", [("scum|trash", 3), ("stupid|loser", 2)])
    return _read(spark, d, "documents").select("doc_id", section.alias("section"), severity.alias("severity"))


@query("""
WITH t(topic, category, term) AS (VALUES ('law', NULL, 'license'), ('law', 'es', NULL), ('abuse', NULL, 'scum'), ('abuse', NULL, 'idiot'), ('news', 'de', NULL))
SELECT DISTINCT doc_id, topic FROM documents JOIN t ON lang = category OR (term IS NOT NULL AND contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || term || ' '))""")
def topic_members(spark, d):
    topics = spark.createDataFrame([("law", None, "license"), ("law", "es", None), ("abuse", None, "scum"), ("abuse", None, "idiot"), ("news", "de", None)], "topic string, category string, term string")
    return S.topic_rows(_read(spark, d, "documents"), topics, "doc_id", "text", "lang")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND contains(lower(concat_ws(' ', c_custkey, c_name, c_mktsegment)), 'build')")
def live_filter(spark, d):
    return S.live_rows(_read(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"], "BUILD", F.col("c_acctbal") > 0, "c_name").select("c_custkey", "c_name")


_SQL_CLOSERS = re.escape(S.CLOSERS).replace("'", "''")
_SENTENCES = rf"""
WITH b AS (SELECT doc_id, trim(text) AS body, CASE WHEN doc_id % 3 = 0 THEN substr(trim(text), 1, 90) ELSE trim(substr(trim(text), 1, 180)) END AS summary FROM documents),
c AS (SELECT *, trim(regexp_replace(body, '[\s\x0B\x85\p{{Z}}]+', ' ', 'g')) AS clean,
  length(body) > 180 AND summary = substr(body, 1, 180) AND NOT regexp_matches(summary, '([{S.ENDS}]|\.)[{_SQL_CLOSERS}]*\s*\z') AS hard_cut FROM b),
p AS (SELECT *, regexp_extract_all(substr(clean, 1, 260), '{S.SENTENCE.replace(re.escape(S.CLOSERS), _SQL_CLOSERS)}') AS pieces, rtrim(substr(clean, 1, 180)) AS head FROM c),
w AS (SELECT *, list_transform(range(1, len(pieces) + 1), lambda i: trim(array_to_string(list_slice(pieces, 1, i), ''))) AS whole,
  CASE WHEN length(regexp_extract(head, '(?s)^(.*) [^ ]*$', 1)) >= 90 THEN rtrim(regexp_extract(head, '(?s)^(.*) [^ ]*$', 1)) ELSE head END AS prefix FROM p)
SELECT doc_id, CASE WHEN NOT coalesce(hard_cut, false) THEN summary WHEN length(clean) <= 180 THEN clean
  ELSE coalesce(list_filter(whole, lambda x: length(x) >= 180)[1], whole[-1], regexp_replace(prefix, '[,;:，；：]+$', '') || '…') END AS summary FROM w
"""


@query(_SENTENCES)
def repaired_summaries(spark, d):
    """Summaries that are the first 180 characters of a text, and shorter ones that stay as they are."""
    body = F.trim("text")
    summary = F.when(F.col("doc_id") % 3 == 0, F.substring(body, 1, 90)).otherwise(F.trim(F.substring(body, 1, S.SOFT)))
    return _read(spark, d, "documents").select("doc_id", S.repaired_summary(summary, F.col("text")).alias("summary"))


@query(r"SELECT doc_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), 1, 14), ' ') AS summary FROM documents")
def compact_summaries(spark, d):
    return _read(spark, d, "documents").select("doc_id", S.compact_words(F.col("text")).alias("summary"))


@query("""
WITH t AS (SELECT conv_id, text AS t FROM conversations)
SELECT conv_id, bool_and(length(t) BETWEEN 10 AND 120 AND contains(lower(t), 'e')) AND count(*) = 4 AND count(DISTINCT t) = 4 AS valid FROM t GROUP BY conv_id""")
def suggestion_sets(spark, d):
    turns = _read(spark, d, "conversations").select("conv_id", F.col("text").alias("t"), F.lit("E").alias("anchor"))
    return S.valid_sets(turns, "conv_id", "t", "anchor", 4)


@query("""
WITH u AS (SELECT user_id, ts, 0 AS tier FROM events WHERE ts >= TIMESTAMP '2024-01-30' AND event_type = 'purchase' UNION ALL SELECT user_id, ts, 1 FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND event_type = 'purchase' UNION ALL SELECT user_id, ts, 2 FROM events),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY tier, ts DESC) = 1)
SELECT user_id, tier FROM o ORDER BY tier, ts DESC, user_id LIMIT 12""")
def candidate_pools(spark, d):
    events = _read(spark, d, "events").select("user_id", "ts", "event_type")
    bought = events.where("event_type = 'purchase'").drop("event_type")
    pools = [bought.where(F.col("ts") >= _stamp("2024-01-30 00:00:00")), bought.where(F.col("ts") >= _stamp("2024-01-29 00:00:00")), events.drop("event_type")]
    return S.tiered(pools, "user_id", "ts").select("user_id", "tier")


@query("SELECT event_type, arg_max(event_id, ts) AS event_id FROM events WHERE value > 10 GROUP BY event_type")
def latest_closed(spark, d):
    rows = _read(spark, d, "events").select("event_type", "event_id", "ts", (F.col("value") > 10).alias("ok"))
    return S.latest_closed(rows, "event_type", "ts", "ok").select("event_type", "event_id")


@query("""
WITH a AS (SELECT doc_id, text AS u, split_part(text, chr(10), 1) AS t FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id, text AS u, split_part(text, chr(10), 1) AS t FROM documents WHERE doc_id % 2 = 1),
m AS (SELECT a.doc_id, 0 AS rule, r.doc_id AS match FROM a JOIN r USING (u) UNION ALL SELECT a.doc_id, 1, r.doc_id FROM a JOIN r USING (t))
SELECT doc_id, match, rule FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rule, match) = 1""")
def update_targets(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("u"), T.first_line(F.col("text")).alias("t"))
    return S.best_match(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", "doc_id", "u", "t")


@query("""
WITH a AS (SELECT upper(substr(n_name, 1, 3)) AS code, n_name AS airline FROM nation QUALIFY row_number() OVER (PARTITION BY upper(substr(n_name, 1, 3)) ORDER BY n_name) = 1),
s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN upper(substr(n_name, 1, 3)) || s_suppkey ELSE 'X' END AS callsign, lower(n_name) AS owner FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, coalesce(a.airline, b.airline) AS operator FROM s LEFT JOIN a ON regexp_matches(callsign, '^[A-Z]{3}[0-9]') AND substr(callsign, 1, 3) = a.code LEFT JOIN a b ON owner = lower(b.airline)""")
def operators_of_flights(spark, d):
    nation = _read(spark, d, "nation")
    airlines = nation.groupBy(F.upper(F.substring("n_name", 1, 3)).alias("code")).agg(F.min("n_name").alias("airline"))
    rows = _read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.upper(F.substring("n_name", 1, 3)), F.col("s_suppkey").cast("string"))).otherwise("X").alias("callsign"), F.lower("n_name").alias("owner"))
    return S.operator_of(rows, airlines, "callsign", "owner").select("s_suppkey", "operator")


@query("""
WITH p AS (SELECT p_partkey AS photo, p_brand, p_type, p_size AS year FROM part WHERE p_partkey % 10 = 0), r AS (SELECT p_partkey AS rec, p_brand, p_type FROM part WHERE p_partkey % 10 = 1),
m AS (SELECT rec, 0 AS rule, -year AS age, photo FROM r JOIN p USING (p_type) UNION ALL SELECT rec, 1, -year, photo FROM r JOIN p USING (p_brand))
SELECT rec, photo, rule FROM m QUALIFY row_number() OVER (PARTITION BY rec ORDER BY rule, age, photo) = 1""")
def media_matches(spark, d):
    part = _read(spark, d, "part")
    photos = part.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("photo"), "p_brand", "p_type", F.col("p_size").alias("year"))
    records = part.where("p_partkey % 10 = 1").select(F.col("p_partkey").alias("rec"), "p_brand", "p_type")
    return S.media_choice(records, photos, "rec", "p_type", "p_brand")


@query("WITH o AS (SELECT user_id, strftime(min(ts), '%Y-%m-%d') AS day, arg_min(event_type, (strftime(ts, '%Y-%m-%d'), event_id)) AS l FROM events GROUP BY user_id) SELECT day, count(*) AS n FROM o GROUP BY day")
def changes_by_day(spark, d):
    events = _read(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return S.grouped_changes(events, "user_id", "day", "event_type").select("day", "n")


@query(r"""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey % 50 || ' aircraft and ' || o_orderkey % 9 || ' ships' WHEN 1 THEN 'Aircraft: ' || o_custkey % 50 || '; ships: ' || o_orderkey % 9 ELSE 'none' END AS t FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN regexp_extract(t, '(\d+)[^0-9]+(\d+)', 1)::INT END AS aircraft, CASE WHEN o_orderkey % 3 < 2 THEN regexp_extract(t, '(\d+)[^0-9]+(\d+)', 2)::INT END AS ships FROM t""")
def activity_counts(spark, d):
    n, c, s = F.col("o_orderkey") % 3, (F.col("o_custkey") % 50).cast("string"), (F.col("o_orderkey") % 9).cast("string")
    text = F.when(n == 0, F.concat(c, F.lit(" aircraft and "), s, F.lit(" ships"))).when(n == 1, F.concat(F.lit("Aircraft: "), c, F.lit("; ships: "), s)).otherwise("none")
    rows = _read(spark, d, "orders").select("o_orderkey", text.alias("t"))
    aircraft, ships = S.activity_counts(F.col("t"))
    return rows.select("o_orderkey", aircraft.alias("aircraft"), ships.alias("ships"))


_AUTH, _NAMED = (x.replace("'", "''") for x in (T.AUTHORIZATION, T.NAMED_SECRET))
_LOGS = ["token = abc1", "Authorization: Bearer abc2", 'api_key="abc3"', "bearer abc4 PASSWORD:abc5", "authorization basic abc6", "nothing\t here"]


@query(
    rf"""WITH l AS (SELECT event_id, props || ' ' || CASE event_id % 6 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LOGS))} END || ' HTTPS://x.org/' || event_id || ' end' AS line FROM events),
u AS (SELECT event_id, regexp_replace(trim(regexp_replace(line, '[\x00-\x20\x7f]+', ' ', 'g')), '(?i)https?://\S+', '[url]', 'g') AS line FROM l)
SELECT event_id, substr(regexp_replace(regexp_replace(line, '{_AUTH}', '\1=[secret]', 'g'), '{_NAMED}', '\1=[secret]', 'g'), 1, 200) AS line FROM u"""
)
def redacted_logs(spark, d):
    """Log lines with secrets of several shapes."""
    line = F.element_at(F.array(*map(F.lit, _LOGS)), (F.col("event_id") % 6 + 1).cast("int"))
    events = _read(spark, d, "events")
    return events.select("event_id", T.redacted(F.concat_ws(" ", "props", line, F.concat(F.lit("HTTPS://x.org/"), F.col("event_id").cast("string")), F.lit("end"))).alias("line"))


@query("SELECT DISTINCT conv_id, substr(sha256('k:' || conv_id), 1, 24) AS pseudonym FROM conversations")
def pseudonyms(spark, d):
    return _read(spark, d, "conversations").select("conv_id", T.pseudonym(F.col("conv_id").cast("string"), "k").alias("pseudonym")).distinct()


@query(r"""SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(split_part(text, chr(10), 1))), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS key FROM documents""")
def search_keys(spark, d):
    """Titles as they are searched: normalised, case-folded, marks as spaces."""
    return _read(spark, d, "documents").select("doc_id", T.search_key(T.first_line(F.col("text"))).alias("key"))


@query("""
WITH t AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%MZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 2 THEN 'yesterday' END AS t FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:00') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM t""")
def parsed_times(spark, d):
    """Times written to the minute, in full, or as something else."""
    n = F.col("event_id") % 4
    text = F.when(n == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'")).when(n == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).when(n == 2, "yesterday")
    rows = _read(spark, d, "events").select("event_id", text.alias("t"))
    return rows.select("event_id", F.date_format(T.parsed_time(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))
