"""Queries for feeds, suggestions, cards, run logs, prices, routes and schedules, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from aeroflow.functions import text as T
from aeroflow.operators import briefings as B, desk as D, editions as E, gates as G, grouping as P, ingest as I
from aeroflow.plans.registry import query


def _read(spark, d, table):
    return spark.read.parquet(f"{d}/{table}.parquet")


def _stamp(text):
    return F.lit(text).cast("timestamp_ntz")


def _day(column):
    return F.date_format(column, "yyyy-MM-dd")


@query("""
WITH r AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS outcome, sum(value) AS seconds, list(CASE WHEN value > 20 THEN 'ok' ELSE 'failed' END ORDER BY ts, event_id) AS a FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN outcome IN ('view', 'click') THEN outcome ELSE 'unknown' END AS outcome, seconds >= 86400 AS longest, least(50, len(a))::INTEGER AS n_attempts, len(list_filter(list_slice(a, 1, 50), lambda x: x <> 'ok'))::INTEGER AS n_failed FROM r""")
def sanitised_runs(spark, d):
    e = _read(spark, d, "events")
    attempt = F.struct("ts", "event_id", F.when(F.col("value") > 20, "ok").otherwise("failed").alias("status"))
    runs = e.groupBy(F.col("user_id").alias("run")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("outcome"), F.sum("value").alias("seconds"), F.array_sort(F.collect_list(attempt)).alias("attempts"))
    return D.sanitised_runs(runs, ["view", "click"]).select(F.col("run").alias("user_id"), "outcome", (F.col("seconds") >= 86400).alias("longest"), "n_attempts", "n_failed")


@query("SELECT event_id, event_type AS kind, round(least(120, greatest(0, value)), 3) AS latency, substr(md5(props), 1, 16) AS question_hash FROM events WHERE event_type IN ('view', 'click')")
def sanitised_assists(spark, d):
    rows = _read(spark, d, "events").select(F.col("event_id").alias("event"), F.col("event_type").alias("kind"), F.col("value").alias("latency"), F.md5("props").alias("question_hash"))
    return D.sanitised_assists(rows, ["view", "click"]).withColumnRenamed("event", "event_id")


_SERIOUS = "WITH i AS (SELECT *, CASE WHEN value > 150 THEN 'acc' WHEN value > 80 THEN 'ser' ELSE 'inc' END AS sev FROM events WHERE event_type = 'error'), s AS (SELECT * FROM i WHERE sev IN ('acc', 'ser') AND DATE '2024-01-20' - ts::DATE BETWEEN 0 AND 7)"


def _serious(spark, d):
    e = _read(spark, d, "events").where("event_type = 'error'")
    sev = F.when(F.col("value") > 150, "acc").when(F.col("value") > 80, "ser").otherwise("inc")
    return D.weekly_serious(e.withColumn("sev", sev).withColumn("day", F.col("ts").cast("date")), "day", "sev", F.lit("2024-01-20").cast("date"))


@query(_SERIOUS + " SELECT event_id, sev FROM s")
def weekly_incidents(spark, d):
    return _serious(spark, d).select("event_id", "sev")


@query(_SERIOUS + " SELECT count(*) AS serious_this_week, count(*) FILTER (sev = 'acc') AS accidents FROM s")
def serious_this_week(spark, d):
    return _serious(spark, d).agg(F.count("*").alias("serious_this_week"), F.count_if(F.col("sev") == "acc").alias("accidents"))


@query("SELECT user_id, event_id FROM events WHERE event_type = 'error' AND value > 50 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_notable(spark, d):
    return D.first_notable(_read(spark, d, "events"), (F.col("event_type") == "error") & (F.col("value") > 50), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("""
WITH p(label, i, c, o) AS (VALUES ('AIR', 3.0::DOUBLE, 0.3::DOUBLE, 15.0::DOUBLE), ('MAIL', 1.0, 0.1, 5.0), ('SHIP', 0.5, 0.05, 2.0)),
c AS (SELECT l_shipmode AS label, l_partkey AS ti, l_suppkey * 9 AS ca, l_orderkey AS o FROM (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'AIR' WHEN 1 THEN 'MAIL' WHEN 2 THEN 'SHIP' ELSE 'RAIL' END AS l_shipmode FROM lineitem))
SELECT label, count(*) AS calls, sum(ca)::BIGINT AS cached, round(sum(((ti - ca) * p.i + ca * p.c + c.o * p.o) / 1e6::DOUBLE), 6) AS cost FROM c JOIN p USING (label) WHERE ca BETWEEN 0 AND ti AND c.o >= 0 GROUP BY ROLLUP (label)""")
def token_costs(spark, d):
    prices = spark.createDataFrame([("AIR", 3.0, 0.3, 15.0), ("MAIL", 1.0, 0.1, 5.0), ("SHIP", 0.5, 0.05, 2.0)], "label string, price_in double, price_cached double, price_out double")
    n = F.col("l_linenumber") % 4
    label = F.when(n == 0, "AIR").when(n == 1, "MAIL").when(n == 2, "SHIP").otherwise("RAIL")
    calls = _read(spark, d, "lineitem").select(label.alias("label"), F.col("l_partkey").alias("tokens_in"), (F.col("l_suppkey") * 9).alias("cached"), F.col("l_orderkey").alias("tokens_out"))
    return D.token_costs(calls, prices)


@query("""
WITH a AS (SELECT upper(substr(n_name, 1, 3)) AS icao, CASE WHEN n_nationkey % 5 > 0 THEN upper(substr(n_name, 1, 2)) END AS iata, n_nationkey FROM nation),
s AS (SELECT s_suppkey, icao, iata, CASE WHEN s_suppkey % 3 = 0 THEN 'XXX' ELSE icao END || CASE WHEN s_suppkey % 7 = 0 THEN 'AB' ELSE (s_suppkey % 9000)::VARCHAR END AS callsign FROM supplier JOIN a ON s_nationkey = n_nationkey)
SELECT s_suppkey, CASE WHEN substr(callsign, 1, 3) = icao AND iata IS NOT NULL AND regexp_matches(callsign, '^[A-Z]{3}[0-9]{1,4}[A-Z]?$') THEN iata || substr(callsign, 4) ELSE callsign END AS shown FROM s""")
def display_callsigns(spark, d):
    airlines = _read(spark, d, "nation").select("n_nationkey", F.upper(F.substring("n_name", 1, 3)).alias("icao"), F.when(F.col("n_nationkey") % 5 > 0, F.upper(F.substring("n_name", 1, 2))).alias("iata"))
    n = F.col("s_suppkey")
    rows = _read(spark, d, "supplier").join(airlines, F.col("s_nationkey") == F.col("n_nationkey"))
    callsign = F.concat(F.when(n % 3 == 0, "XXX").otherwise(F.col("icao")), F.when(n % 7 == 0, "AB").otherwise((n % 9000).cast("string")))
    return rows.select("s_suppkey", D.display_callsign(callsign, F.col("icao"), F.col("iata")).alias("shown"))


@query("""
WITH c AS (SELECT o_custkey AS k, CASE WHEN max(o_orderkey) % 3 > 0 THEN 'r' || max(o_orderkey) END AS route, max(o_orderdate)::TIMESTAMP AS stamp FROM orders GROUP BY o_custkey),
n AS (SELECT * FROM c ORDER BY stamp DESC, k LIMIT 400),
g AS (SELECT * FROM n WHERE date_diff('second', stamp, TIMESTAMP '2001-01-01 00:00:00') // 3600 < CASE WHEN route IS NOT NULL THEN 20000 ELSE 6000 END)
SELECT c_custkey, route, g.k IS NULL AS look_up FROM customer LEFT JOIN g ON c_custkey = g.k""")
def cached_routes(spark, d):
    cache = _read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o"), F.max("o_orderdate").cast("timestamp_ntz").alias("stamp"))
    cache = cache.select("c_custkey", F.when(F.col("o") % 3 > 0, F.concat(F.lit("r"), F.col("o").cast("string"))).alias("route"), "stamp")
    return D.cached_routes(_read(spark, d, "customer").select("c_custkey"), cache, "c_custkey", _stamp("2001-01-01 00:00:00"), 20000, 6000)


@query("""
WITH n(name, rule, code) AS (VALUES ('license', 1, 'L'), ('the', 2, 'E'), ('and', 2, 'E2'), ('los', 2, 'S'), ('de', 3, 'F'), ('la', 3, 'F2'), ('der', 4, 'G'), ('zu', 4, 'G2')),
w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS name FROM documents),
m AS (SELECT doc_id, rule, code, min(rule) OVER (PARTITION BY doc_id) AS best FROM w JOIN n USING (name))
SELECT doc_id, best AS rule, array_to_string(list_sort(list_distinct(list(code))), ',') AS codes FROM m WHERE rule = best GROUP BY doc_id, best""")
def entity_profiles(spark, d):
    names = [("license", 1, "L"), ("the", 2, "E"), ("and", 2, "E2"), ("los", 2, "S"), ("de", 3, "F"), ("la", 3, "F2"), ("der", 4, "G"), ("zu", 4, "G2")]
    return D.entity_profiles(_read(spark, d, "documents"), spark.createDataFrame(names, "name string, rule int, code string"), "doc_id", "text")


@query(r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{2,5}')) AS code, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]{2,5}'), 1) - 1 AS place FROM documents)
SELECT doc_id, code, min(place)::INTEGER AS place FROM m GROUP BY doc_id, code""")
def first_mentions(spark, d):
    return D.first_mentions(_read(spark, d, "documents"), "doc_id", "text", r"[A-Z][a-z]{2,5}")


@query("""
WITH g AS (SELECT event_id % 900 AS url, max((ts, event_id)) AS m FROM events WHERE event_type <> 'error' AND epoch(TIMESTAMP '2024-01-20 12:00:00') - epoch(ts) BETWEEN -7200 AND 172800 GROUP BY event_id % 900)
SELECT url, m[2] AS event_id, row_number() OVER (ORDER BY m DESC)::INTEGER - 1 AS place FROM g QUALIFY place < 31""")
def headline_feed(spark, d):
    rows = _read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"), F.col("ts").alias("stamp"), (F.col("event_id") % 900).alias("url"))
    return D.headline_feed(rows, _stamp("2024-01-20 12:00:00")).select("url", F.col("id").alias("event_id"), "place")


@query("""
WITH o AS (SELECT conv_id, role || ' ' || length(text) % 5 AS t, 0 AS tier, min(turn) AS o FROM conversations GROUP BY ALL),
g AS (SELECT DISTINCT conv_id, t, 1 AS tier, o FROM conversations, (VALUES ('generic a', 0), ('user 1', 1), ('generic b', 2), ('generic c', 3), ('generic d', 4), ('generic e', 5), ('generic f', 6)) v(t, o)),
u AS (SELECT conv_id, t, min((tier, o)) AS best_at FROM (SELECT * FROM o UNION ALL SELECT * FROM g) GROUP BY conv_id, t)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY best_at, t)::INTEGER AS place, t AS suggestion FROM u QUALIFY place <= 6""")
def suggestion_lists(spark, d):
    text = F.concat("role", F.lit(" "), (F.length("text") % 5).cast("string"))
    rows = _read(spark, d, "conversations").select("conv_id", text.alias("suggestion"), F.col("turn").cast("int").alias("turn"))
    out = D.suggestions(rows, ["generic a", "user 1", "generic b", "generic c", "generic d", "generic e", "generic f"], "conv_id", "suggestion", "turn")
    return out.withColumnRenamed("text", "suggestion")


@query("""
WITH u AS (SELECT user_id, event_id % 40 AS url, 0 AS tier, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT user_id, event_id % 40, 1, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) FROM events WHERE event_type = 'view'),
o AS (SELECT user_id, url, min((tier, place)) AS best_at FROM u GROUP BY ALL)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY best_at, url)::INTEGER AS card, url FROM o QUALIFY card <= 5""")
def citation_cards(spark, d):
    e = _read(spark, d, "events").withColumn("url", F.col("event_id") % 40)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pools = [e.where(F.col("event_type") == kind).withColumn("place", place) for kind in ("purchase", "view")]
    return D.citation_cards(pools, "user_id", "url")


@query("SELECT event_id, strftime((ts + INTERVAL 8 HOUR)::DATE - CASE WHEN hour(ts + INTERVAL 8 HOUR) < 7 THEN 1 ELSE 0 END, '%Y-%m-%d') AS day FROM events")
def scheduled_days(spark, d):
    return _read(spark, d, "events").select("event_id", _day(D.scheduled_day(F.col("ts"), 7)).alias("day"))


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, max(ts) AS t, count(*) AS n FROM events GROUP BY ALL) WHERE t >= TIMESTAMP '2024-02-03 00:00:00' - CASE WHEN event_type IN ('error', 'signup') THEN INTERVAL 360 HOUR ELSE INTERVAL 120 HOUR END")
def live_events(spark, d):
    known = _read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("t"), F.count("*").alias("n"))
    return D.live_events(known, "t", "event_type", _stamp("2024-02-03 00:00:00"), ["error", "signup"], 15, 120).select("user_id", "event_type", "n")


@query("""
WITH s AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'partial' ELSE 'success' END AS status, (ts >= TIMESTAMP '2024-01-29')::INT AS new FROM events WHERE ts >= TIMESTAMP '2024-01-27')
SELECT user_id, arg_max(status, ((status <> 'failed')::INT, new, ts)) AS status FROM s GROUP BY user_id""")
def guarded_status(spark, d):
    e = _read(spark, d, "events").where(F.col("ts") >= _stamp("2024-01-27 00:00:00"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "partial").otherwise("success")
    rows = e.select("user_id", status.alias("status"), F.col("ts").alias("stamp"))
    late = F.col("stamp") >= _stamp("2024-01-29 00:00:00")
    return D.guarded_status(rows.where(~late), rows.where(late), "user_id")


@query("""
WITH s AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), x AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT strftime(day, '%Y-%m-%d') AS day FROM s WHERE day NOT IN (SELECT day FROM x)""")
def due_days(spark, d):
    orders = _read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    return D.due_days(orders.select("day").distinct(), orders, "day", F.col("o_orderpriority") == "1-URGENT").select(_day("day").alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 100 < 60 AND o_custkey % 50 <> 0 THEN 'history' WHEN o_orderstatus = 'P' THEN 'rejected' ELSE 'queued' END AS route, o_orderdate::DATE < min(o_orderdate::DATE) OVER () + 30 AS warm_up FROM orders")
def candidate_routes(spark, d):
    orders = _read(spark, d, "orders")
    rows = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 100).alias("score"), (F.col("o_custkey") % 50 == 0).alias("watched"), F.when(F.col("o_orderstatus") == "P", "conflict").alias("second"))
    first = orders.agg(F.min(F.col("o_orderdate").cast("date")).alias("first")).scalar()
    return rows.select("o_orderkey", D.routed_candidates(rows).alias("route"), (F.col("day") < F.date_add(first, 30)).alias("warm_up"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 2))::INTEGER AS n_words, 0 AS n_pairs FROM documents")
def query_tokens(spark, d):
    found = T.query_tokens(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", F.size(found["words"]).alias("n_words"), F.size(found["pairs"]).alias("n_pairs"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_name ELSE c_mktsegment END AS label, CASE WHEN abs(c_custkey * 1000) >= 1000 THEN (c_custkey) || ',000' ELSE '0' END AS thousands FROM customer WHERE c_custkey < 1000")
def shown_labels(spark, d):
    rows = _read(spark, d, "customer").where("c_custkey < 1000")
    segment = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).otherwise(" ")
    return rows.select("c_custkey", T.either(segment, F.col("c_name")).alias("label"), T.thousands(F.col("c_custkey") * 1000).alias("thousands"))


@query("SELECT n_nationkey, lower(strip_accents(n_name)) AS k, trim(regexp_replace(' ' || lower(strip_accents(n_name)) || ' ', ' (united|kingdom|states) ', ' ')) AS core FROM nation")
def accent_keys(spark, d):
    nation = _read(spark, d, "nation").withColumn("k", T.accent_key(F.col("n_name")))
    return nation.select("n_nationkey", "k", T.core_name(F.col("k"), ["united", "kingdom", "states"]).alias("core"))


@query("SELECT strftime(day, '%Y-%m-%d') AS day, n FROM (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY ALL) ORDER BY day DESC")
def briefing_index(spark, d):
    rows = _read(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    old, new = rows.where(F.dayofyear("day") % 2 == 0).withColumn("n", F.lit(0).cast("long")).unionByName(rows.where(F.dayofyear("day") % 2 == 1)), rows
    return I.upserted(old, new, "day").orderBy(F.desc("day")).select(_day("day").alias("day"), "n")


_SAME = """
WITH i AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(split_part(text, chr(10), 1) || ' ' || substr(substr(text, length(split_part(text, chr(10), 1)) + 2), 1, 280), '[A-Za-z0-9][A-Za-z0-9+''-]*|[\u3400-\u9fff]{2,}'), lambda x: lower(x)), lambda x: (length(x) >= 3 OR regexp_matches(x, '[0-9]')) AND NOT list_contains(['the', 'and', 'des', 'und'], x) AND NOT regexp_full_match(x, '(19|20)\\d\\d|\\d{1,2}(st|nd|rd|th)')))) AS t FROM documents),
s AS (SELECT t, min(doc_id) AS id, len(t) AS n FROM i WHERE len(t) >= 3 GROUP BY t),
x AS (SELECT id, n, unnest(t) AS k FROM s),
p AS (SELECT a.id AS src, b.id AS dst, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m, bool_or(regexp_matches(a.k, '[0-9]')) AS ident, bool_or(a.k IN ('tion', 'los', 'les', 'der', 'was')) AS act FROM x a JOIN x b ON a.k = b.k AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) >= 3)
"""


@query(_SAME + "SELECT src, dst FROM p WHERE (ident AND c >= 0.45::DOUBLE * least(n, m)) OR (act AND c >= 4 AND (c >= 0.55::DOUBLE * least(n, m) OR c >= 0.38::DOUBLE * (n + m - c)))")
def same_event_pairs(spark, d):
    docs = _read(spark, d, "documents")
    tokens = P.event_tokens(T.first_line(F.col("text")), T.rest_of(F.col("text")), ["the", "and", "des", "und"])
    return P.anchored_links(docs.select(F.col("doc_id").alias("id"), tokens.alias("tokens")), ["tion", "los", "les", "der", "was"])


_EDITIONS = """
WITH RECURSIVE w AS (SELECT event_id, user_id, ts, event_type, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01 07:00:00') AS s,
    list_distinct([event_type, 'v' || floor(value / 20)::INT]) AS facts, event_id % 13 > 0 AND event_id % 11 > 0 AS ok FROM events WHERE ts < TIMESTAMP '2024-01-20 07:00:00'),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, ts DESC, event_id) AS n FROM w WHERE ok AND user_id IS NOT NULL),
f AS (
  SELECT user_id, n, s, event_id, facts AS known, true AS told, 'new' AS state, []::VARCHAR[] AS fresh FROM r WHERE n = 1
  UNION ALL
  SELECT r.user_id, r.n, r.s, r.event_id,
    CASE WHEN NOT (f.told AND r.s = f.s) AND len(list_filter(r.facts, lambda x: NOT list_contains(f.known, x))) > 0 THEN list_distinct(list_concat(f.known, r.facts)) ELSE f.known END,
    f.told AND r.s = f.s OR len(list_filter(r.facts, lambda x: NOT list_contains(f.known, x))) > 0,
    CASE WHEN f.told AND r.s = f.s THEN 'skipped' WHEN len(list_filter(r.facts, lambda x: NOT list_contains(f.known, x))) > 0 THEN 'update' ELSE 'unchanged' END,
    CASE WHEN f.told AND r.s = f.s THEN []::VARCHAR[] ELSE list_filter(r.facts, lambda x: NOT list_contains(f.known, x)) END
  FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
"""


def _edition_rows(spark, d):
    """Events as articles of their user; some lack a title or a source."""
    e = _read(spark, d, "events").where(F.col("ts") < _stamp("2024-01-20 07:00:00"))
    n = F.col("event_id")
    url = F.when(n % 11 > 0, F.concat(F.lit("https://x.org/"), n.cast("string"))).otherwise("ftp://x.org")
    rows = e.select(F.col("user_id").alias("event"), n.alias("row_id"), "ts", F.when(n % 13 > 0, F.col("event_type")).otherwise(" ").alias("title"), F.col("props").alias("summary"), F.array(url).alias("urls"),
                    F.array_distinct(F.array(F.col("event_type"), F.concat(F.lit("v"), F.floor(F.col("value") / 20).cast("string")))).alias("facts"), F.col("event_type").alias("section"), "value")
    return E.edition_rows(rows)


@query(_EDITIONS + "SELECT user_id AS event, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_id AS row_id, state, array_to_string(list_sort(fresh), ',') AS new_facts FROM f")
def edition_items(spark, d):
    """What each closed window says of an event: new, an update by new facts only, or nothing new."""
    items = E.edition_items(_edition_rows(spark, d)[0])
    return items.select("event", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "row_id", "state", F.array_join(F.array_sort("new_facts"), ",").alias("new_facts"))


@query(_EDITIONS + """,
told AS (SELECT f.s, f.state, w.event_type, row_number() OVER (PARTITION BY f.s, w.event_type ORDER BY w.ts DESC, w.event_id) AS p, w.ts, w.event_id FROM f JOIN w USING (event_id) WHERE f.state IN ('new', 'update')),
shown AS (SELECT s, state, row_number() OVER (PARTITION BY s ORDER BY event_type, p) AS place FROM told WHERE p <= 6 QUALIFY place <= 15),
counts AS (SELECT s, count(*) AS n_items, count(*) FILTER (state = 'update') AS n_updates FROM shown GROUP BY s),
bad AS (SELECT s, count(*) AS n FROM w WHERE NOT ok GROUP BY s), down AS (SELECT DISTINCT s FROM w WHERE event_type = 'error' AND (event_id * 7) % 5 = 0 AND event_id % 9 = 0)
SELECT strftime(x.s, '%Y-%m-%d %H:%M:%S') AS start, coalesce(n_items, 0) AS n_items, coalesce(n_updates, 0) AS n_updates, coalesce(bad.n, 0) AS n_warnings, CASE WHEN down.s IS NULL THEN 'published' ELSE 'partial' END AS status
FROM (SELECT s FROM f UNION SELECT s FROM bad UNION SELECT s FROM down) x LEFT JOIN counts USING (s) LEFT JOIN bad USING (s) LEFT JOIN down USING (s)""")
def edition_status(spark, d):
    """Each window's briefing: items shown, updates, warnings about rows, and whether its input was degraded."""
    rows, warnings = _edition_rows(spark, d)
    down = rows.sparkSession.read.parquet(f"{d}/events.parquet").where((F.col("event_type") == "error") & ((F.col("event_id") * 7) % 5 == 0) & (F.col("event_id") % 9 == 0) & (F.col("ts") < _stamp("2024-01-20 07:00:00")))
    degraded = down.select(B.briefing_window(F.col("ts"))["start"].cast("timestamp").alias("start"))
    as_time = lambda x: x.withColumn("start", F.col("start").cast("timestamp"))
    _, windows = E.briefings(E.edition_items(rows), rows.drop("start"), as_time(warnings), degraded, F.col("section"))
    return windows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""
WITH w AS (SELECT *, TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * ((epoch(ts)::BIGINT - 25200) // 28800 * 28800 + 25200) AS s FROM events),
c AS (SELECT * FROM w WHERE s + INTERVAL 8 HOUR <= TIMESTAMP '2024-01-20 12:00:00'),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY s, event_type ORDER BY value DESC, ts, event_id) AS p FROM f WHERE r = 1)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS section, event_id, row_number() OVER (PARTITION BY s ORDER BY event_type, p)::INTEGER AS place FROM k WHERE p <= 6 QUALIFY place <= 15""")
def briefing(spark, d):
    """Closed windows, each user's first row of a kind only, the best of each section."""
    rows = B.closed(_read(spark, d, "events"), "ts", _stamp("2024-01-20 12:00:00")).withColumn("start", F.col("window.start"))
    new = D.first_notable(rows, F.lit(True), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).withColumn("section", F.col("event_type"))
    top = B.section_top(new, ["start"], F.col("section"), [F.desc("value"), F.col("ts"), F.col("event_id")])
    return top.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "section", "event_id", F.col("total_place").alias("place"))


@query("""
WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
g AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS t FROM q WHERE length(text) >= 12 AND NOT regexp_matches(text, '[A-Za-z0-9+/]{80,}={0,2}') AND NOT regexp_matches(text, '(?i)(ignore|disregard|forget) (all |any )?(the |your )?(previous|prior|above|earlier) (instructions|rules|prompts)|system prompt|jailbreak|developer mode')),
x AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9]{4,}'))) AS k FROM documents),
u AS (SELECT conv_id, unnest(t) AS k FROM g),
s AS (SELECT conv_id, doc_id, source, 4 * count(*) AS score FROM u JOIN x USING (k) GROUP BY ALL HAVING 4 * count(*) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, doc_id DESC) AS place FROM s QUALIFY place <= 5),
o AS (SELECT conv_id, source, min(place) AS place FROM r GROUP BY ALL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place, source)::INTEGER AS card, source FROM o QUALIFY card <= 5""")
def answer_cards(spark, d):
    """First questions that pass the guardrail, searched in titles, as citation cards by source."""
    turns = _read(spark, d, "conversations").where("role = 'user'")
    asked = D.first_notable(turns, F.lit(True), ["conv_id"], [F.col("turn")])
    fine = asked.where(G.guardrail(F.col("text"), " ").isin("on_topic", "off_topic") & (F.length("text") >= 12))
    docs = _read(spark, d, "documents")
    found = P.lexical_search(fine.select(F.col("conv_id").alias("query_id"), T.tokens(F.col("text"), 4).alias("tokens")), docs.select(F.col("doc_id").alias("id"), T.tokens(T.first_line(F.col("text")), 4).alias("title_tokens")))
    named = found.join(docs.select(F.col("doc_id").alias("id"), "source"), "id").select(F.col("query_id").alias("conv_id"), "source", "place")
    return D.citation_cards([named], "conv_id", "source")


@query("""
WITH t(alias, grp) AS (VALUES ('license', 1), ('apache', 1), ('los', 2), ('les', 2)),
v AS (SELECT doc_id, source, split_part(text, chr(10), 1) AS title, text FROM documents),
h AS (SELECT DISTINCT doc_id, grp FROM v JOIN t ON contains(lower(text), alias)),
a AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(alias))), ' ') AS aliases FROM h JOIN t USING (grp) GROUP BY doc_id)
SELECT doc_id, md5(title || ' ' || coalesce(aliases, '')) AS body, substr(sha256(concat_ws(chr(31), doc_id, title)), 1, 16) AS content_id FROM v LEFT JOIN a USING (doc_id)""")
def search_documents(spark, d):
    """Search rows: the title with its aliases and a content id."""
    from aeroflow.operators.articles import expanded_aliases

    groups = spark.createDataFrame([("license", 1), ("apache", 1), ("los", 2), ("les", 2)], "alias string, grp int").select("grp", "alias")
    docs = _read(spark, d, "documents").withColumn("title", T.first_line(F.col("text")))
    aliases = expanded_aliases(docs, groups, "doc_id", "text")
    rows = docs.join(aliases, "doc_id", "left")
    return rows.select("doc_id", F.md5(F.concat_ws(" ", "title", F.coalesce("aliases", F.lit("")))).alias("body"), F.substring(T.content_hash("doc_id", "title"), 1, 16).alias("content_id"))




@query(r"""
WITH p AS (SELECT page_id, html, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages),
r(suffix, pattern) AS (VALUES ('example.org', 'a'), ('example.net', 'b')),
m AS (SELECT page_id, html, arg_max(pattern, length(suffix)) AS pattern FROM p JOIN r ON host = suffix OR ends_with(host, '.' || suffix) GROUP BY page_id, html, host),
i AS (SELECT page_id, CASE pattern WHEN 'a' THEN regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) ELSE regexp_extract_all(html, '<(h1)>([^<]*)</h1>', 1) END AS l, CASE pattern WHEN 'a' THEN regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) ELSE regexp_extract_all(html, '<(h1)>([^<]*)</h1>', 2) END AS t FROM m)
SELECT page_id, n::INTEGER AS n, l[n] AS link, trim(t[n]) AS title FROM (SELECT page_id, l, t, unnest(CASE WHEN len(l) > 0 THEN range(1, len(l) + 1) ELSE [NULL] END) AS n FROM i)""")
def listing_items(spark, d):
    rules = spark.createDataFrame([("example.org", '<a href="([^"]*)">([^<]*)</a>'), ("example.net", "<(h1)>([^<]*)</h1>")], "suffix string, pattern string")
    return D.listing_items(_read(spark, d, "pages"), rules, "page_id", "url", "html")


@query("""
WITH n(name, code) AS (VALUES ('the', 'T1'), ('los', 'L2'), ('der', 'D3'), ('les', 'F4')),
t AS (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents),
h AS (SELECT doc_id, min((instr(lower(title), name), -length(name), code)) AS m FROM t JOIN n ON instr(lower(title), name) > 0 GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN m IS NULL THEN title ELSE substr(title, 1, (m[1] - m[2] - 1)::INT) || ' (' || m[3] || ')' || substr(title, (m[1] - m[2])::INT) END) AS title FROM t LEFT JOIN h USING (doc_id)""")
def annotated_titles(spark, d):
    names = spark.createDataFrame([("the", "T1"), ("los", "L2"), ("der", "D3"), ("les", "F4")], "name string, code string")
    docs = _read(spark, d, "documents").select("doc_id", T.first_line(F.col("text")).alias("title"))
    return D.annotated(docs, names, "doc_id", "title").select("doc_id", F.md5("title").alias("title"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_partkey * 10 END AS photo, p_size % 3 = 0 AS stale FROM part WHERE p_partkey % 2 = 0")
def stale_media(spark, d):
    part = _read(spark, d, "part")
    media = part.where("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "old").otherwise(F.col("p_brand")).alias("p_brand"), (F.col("p_partkey") * 10).alias("photo"))
    return D.stale_media(part.select("p_partkey", "p_brand"), media, "p_partkey", "p_brand")


@query("""
WITH k AS (SELECT event_id % 4000 AS key, user_id, event_type, max(ts) AS t FROM events GROUP BY ALL),
p AS (SELECT a.user_id AS current, b.user_id AS archive, list_distinct(list(a.event_type)) AS kinds, count(*) AS shared FROM k a JOIN k b ON a.key = b.key AND a.event_type = b.event_type AND a.user_id > b.user_id GROUP BY ALL),
r AS (SELECT *, CASE WHEN list_contains(kinds, 'error') THEN 1 WHEN list_contains(kinds, 'purchase') THEN 2 ELSE 3 END AS tier FROM p)
SELECT current, archive, tier, shared, row_number() OVER (PARTITION BY current ORDER BY tier, shared DESC, archive DESC)::INTEGER AS place FROM r QUALIFY place <= 5""")
def archive_ranking(spark, d):
    keys = _read(spark, d, "events").select((F.col("event_id") % 4000).alias("key"), "user_id", "event_type")
    return D.archive_ranking(keys, "user_id", "key", "event_type", ["error", "purchase"])


@query("""
WITH q AS (SELECT event_id AS event, user_id % 20 AS place, ts, event_type = 'view' AS agreed FROM events WHERE value > 20),
b AS (SELECT user_id % 20 AS place, event_type AS note, min(ts) AS since, CASE WHEN event_type <> 'view' THEN max(ts) END AS through FROM events WHERE event_type <> 'click' GROUP BY user_id % 20, event_type),
n AS (SELECT event, list_sort(list_distinct(list(note))) AS notes FROM q JOIN b USING (place) WHERE since <= ts AND (through IS NULL OR ts <= through) GROUP BY event)
SELECT event, (CASE WHEN agreed THEN 2 ELSE 1 END + coalesce(len(notes), 0))::INTEGER AS n_items, array_to_string(notes, ',') AS notes FROM q LEFT JOIN n USING (event)""")
def queue_groups(spark, d):
    e = _read(spark, d, "events").withColumn("place", F.col("user_id") % 20)
    queue = e.where(F.col("value") > 20).select(F.col("event_id").alias("event"), "place", F.col("ts").alias("stamp"), (F.col("event_type") == "view").alias("agreed"))
    background = e.where("event_type <> 'click'").groupBy("place", F.col("event_type").alias("note")).agg(F.min("ts").alias("since"), F.max(F.when(F.col("event_type") != "view", F.col("ts"))).alias("through"))
    return D.queue_groups(queue, background)


@query("SELECT event_id FROM events WHERE NOT coalesce(CASE WHEN event_type = 'error' THEN true WHEN event_type = 'view' THEN NULL ELSE false END, false)")
def unarchived_rows(spark, d):
    archived = F.when(F.col("event_type") == "error", True).when(F.col("event_type") != "view", False)
    return _read(spark, d, "events").where(~F.coalesce(archived, F.lit(False))).select("event_id")


@query("""
WITH s AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY ALL)
SELECT strftime(day, '%Y-%m-%d') AS day, n, lag(n) OVER (ORDER BY day) AS previous FROM s""")
def series_upsert(spark, d):
    """A series with its old days overwritten by new counts, and each day's context."""
    from aeroflow.operators import metrics as M

    new = _read(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    old = new.where(F.dayofyear("day") < 200).withColumn("n", F.lit(-1).cast("long"))
    twice = I.upserted(I.upserted(old, new, "day"), new, "day")
    return M.series_context(twice, "day", "n").select(_day("day").alias("day"), "n", "previous")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2 AND s_acctbal > 0")
def active_dimension(spark, d):
    """Suppliers of active nations: the dimension is filtered before it is sent out."""
    active = _read(spark, d, "nation").where("n_regionkey <> 2").select("n_nationkey", "n_name")
    return _read(spark, d, "supplier").where("s_acctbal > 0").join(active, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
