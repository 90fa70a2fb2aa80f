"""Queries for views, facts, gates and routing of articles, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from aeroflow.functions import text as T
from aeroflow.operators import gates as G, publish as B
from aeroflow.plans.registry import query


def _read(spark, d, table):
    return spark.read.parquet(f"{d}/{table}.parquet")


def _time(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


_FORMAT = "'%Y-%m-%d %H:%M:%S'"
_VIEWS = """
WITH r AS (SELECT event_id, 'a' || event_id AS id, event_type = 'error' AS archived, CASE WHEN event_id % 13 > 0 THEN ts END AS published, CASE WHEN event_id % 4 = 0 THEN ts - INTERVAL 1 HOUR END AS source_time,
  CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 2 HOUR END AS updated, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END AS ta, CASE WHEN event_id % 7 > 0 THEN 'b ' || event_type END AS tb, event_id % 11 > 0 AS safe, CASE WHEN event_id % 6 = 0 THEN ts + INTERVAL 1 DAY END AS placed FROM events),
views AS (SELECT id, coalesce(nullif(trim(ta), ''), nullif(trim(tb), '')) AS title_a, coalesce(nullif(trim(tb), ''), nullif(trim(ta), '')) AS title_b, coalesce(source_time, published) AS display, coalesce(placed, published) AS sort, greatest(published, updated, source_time) AS modified
  FROM r WHERE NOT archived AND (trim(ta) <> '' OR trim(tb) <> '') AND published IS NOT NULL AND safe AND length(id) >= 3)
"""


def _views(spark, d):
    e = _read(spark, d, "events")
    n = F.col("event_id")
    url = F.when(n % 11 > 0, F.concat(F.lit("https://x.org/"), n.cast("string"))).otherwise("ftp://x.org")
    rows = e.select(
        F.concat(F.lit("a"), n.cast("string")).alias("id"),
        (F.col("event_type") == "error").alias("archived"),
        F.when(n % 13 > 0, F.col("ts")).alias("published"),
        F.when(n % 4 == 0, F.expr("ts - interval 1 hour")).alias("source_time"),
        F.when(n % 5 == 0, F.expr("ts + interval 2 hours")).alias("updated"),
        F.when(n % 6 == 0, F.expr("ts + interval 1 day")).alias("placed"),
        F.when(n % 3 == 0, " ").otherwise(F.col("event_type")).alias("title_a"),
        F.when(n % 7 > 0, F.concat(F.lit("b "), F.col("event_type"))).alias("title_b"),
        F.array(F.lit("x"), url).alias("urls"),
    )
    return B.article_view(rows)


@query(_VIEWS + f"SELECT id, title_a, title_b, strftime(display, {_FORMAT}) AS display, strftime(sort, {_FORMAT}) AS sort, strftime(modified, {_FORMAT}) AS modified FROM views")
def article_views(spark, d):
    return _views(spark, d).select("id", "title_a", "title_b", _time("display").alias("display"), _time("sort").alias("sort"), _time("modified").alias("modified"))


_INJECTED = r"regexp_matches(text, '(?i)(ignore|disregard|forget) (all |any )?(the |your )?(previous|prior|above|earlier) (instructions|rules|prompts)|system prompt|jailbreak|developer mode')"
_SECRET = r"""regexp_matches(text, '(?i)(token|secret|password|api[_-]?key)\s*=\s*"?[0-9a-z]{16,}|BEGIN [A-Z ]*PRIVATE KEY|(^|\s)/(home|root|etc)/')"""
_CANDIDATES = rf"""
WITH c AS (SELECT doc_id, source, text, CASE WHEN doc_id % 17 = 0 THEN 'id' WHEN lang = 'fr' THEN 'status' WHEN NOT contains(lower(text), 'an') THEN 'scope' WHEN {_INJECTED} OR {_SECRET} THEN 'injection'
  WHEN contains(lower(text), 'license') THEN 'conflict' WHEN source IS NULL THEN 'source' WHEN doc_id % 19 = 0 THEN 'date' WHEN length(split_part(text, chr(10), 1)) < 30 THEN 'quote' END AS reason FROM documents)
"""


def _candidates(spark, d):
    docs = _read(spark, d, "documents")
    text, n = F.col("text"), F.col("doc_id")
    reason = B.candidate_reason(
        n % 17 > 0,
        F.col("lang") != "fr",
        F.contains(F.lower(text), F.lit("an")),
        G.quarantine(text) == "pass",
        ~F.contains(F.lower(text), F.lit("license")),
        F.col("source").isNotNull(),
        n % 19 > 0,
        F.length(T.first_line(text)) >= 30,
    )
    return docs.withColumn("reason", reason)


@query(_CANDIDATES + "SELECT doc_id, reason FROM c")
def archive_candidates(spark, d):
    return _candidates(spark, d).select("doc_id", "reason")


_FACTS = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM documents),
f AS (SELECT doc_id, number, source || number AS claim, line AS quote, CASE WHEN number % 3 = 0 THEN 'http://f.org/' || number WHEN doc_id % 2 = 0 THEN 'https://one.org/' || doc_id END AS url FROM l),
facts AS (SELECT doc_id, number, quote, url FROM f WHERE trim(claim) <> '' AND length(lower(trim(regexp_replace(quote, '\s+', ' ', 'g')))) >= 8 AND url IS NOT NULL)
"""


def _facts(spark, d):
    docs = _read(spark, d, "documents")
    fact = lambda x, i: F.struct(F.concat("source", (i + 1).cast("string")).alias("claim"), x.alias("quote"), F.when((i + 1) % 3 == 0, F.concat(F.lit("http://f.org/"), (i + 1).cast("string"))).alias("url"))
    own = F.concat(F.lit("https://one.org/"), F.col("doc_id").cast("string"))
    urls = F.when(F.col("doc_id") % 2 == 0, F.array(own)).otherwise(F.array(own, F.lit("https://two.org/")))
    return B.qualified_facts(docs.select("doc_id", urls.alias("urls"), F.transform(F.split("text", "\n", -1), fact).alias("facts")), "doc_id")


@query(_FACTS + "SELECT doc_id, number::INTEGER AS number, md5(quote) AS quote, url FROM facts")
def qualified_facts(spark, d):
    return _facts(spark, d).select("doc_id", "number", F.md5("quote").alias("quote"), "url")


@query("""
WITH i AS (SELECT source, lang = 'de' AS roundup, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 20) ELSE ' ' END AS summary, CASE WHEN doc_id % 5 = 0 THEN text END AS fulltext FROM documents WHERE length(text) < 300)
SELECT source, (bool_or(roundup) AND count(*) FILTER (trim(title) <> '') >= 2) OR bool_or(coalesce(trim(summary) <> '' OR length(fulltext) >= 80 OR (length(title) >= 20 AND contains(title, 'was')), false)) AS evidence FROM i GROUP BY source""")
def event_evidence(spark, d):
    docs = _read(spark, d, "documents").where(F.length("text") < 300)
    title = T.first_line(F.col("text"))
    items = docs.select("source", (F.col("lang") == "de").alias("roundup"), title.alias("title"), F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 20)).otherwise(" ").alias("summary"), F.when(F.col("doc_id") % 5 == 0, F.col("text")).alias("fulltext"), F.contains(title, F.lit("was")).alias("verb"))
    return B.has_evidence(items, "source")


@query(r"""
WITH t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents)
SELECT doc_id, CASE WHEN contains(t, 'the and') OR contains(t, 'of the') THEN 'narration' WHEN doc_id % 4 > 0 AND (contains(t, 'los que') OR contains(t, 'und der') OR contains(t, 'les de')) THEN 'sourcing' END AS gate FROM t""")
def phrase_gate(spark, d):
    gate = B.phrase_gate(F.col("text"), ["the and", "of the"], ["los que", "und der", "les de"], F.col("doc_id") % 4 == 0)
    return _read(spark, d, "documents").select("doc_id", gate.alias("gate"))


@query("""
WITH g AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS labelled, bool_or(o_orderstatus = 'O') AS independent, count(DISTINCT o_orderdate) AS paragraphs, list_distinct(list(o_orderkey % 40)) AS urls, list_distinct(list(o_orderkey % 40) FILTER (o_orderkey % 8 <> 3)) AS fact_urls FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN NOT labelled THEN 'label' WHEN NOT independent THEN 'wording' WHEN paragraphs < len(urls) THEN 'paragraphs' WHEN len(list_filter(urls, lambda x: NOT list_contains(coalesce(fact_urls, []), x))) > 0 THEN 'facts' END AS reason FROM g""")
def roundup_gate(spark, d):
    key = (F.col("o_orderkey") % 40).cast("string")
    groups = _read(spark, d, "orders").groupBy("o_custkey").agg(
        F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("labelled"),
        F.bool_or(F.col("o_orderstatus") == "O").alias("independent"),
        F.count_distinct("o_orderdate").alias("paragraphs"),
        F.collect_set(key).alias("urls"),
        F.collect_set(F.when(F.col("o_orderkey") % 8 != 3, key)).alias("fact_urls"),
    )
    return groups.select("o_custkey", B.roundup_reason(F.col("labelled"), F.col("independent"), F.col("paragraphs"), F.col("urls"), F.col("fact_urls")).alias("reason"))


@query(f"""
WITH t AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 30 MINUTE END AS st, ts, event_id % 6 > 0 AS inferred FROM events)
SELECT user_id, strftime(coalesce(max(coalesce(st, ts)) FILTER (NOT inferred), max(coalesce(st, ts))), {_FORMAT}) AS stamp, count(*) FILTER (NOT inferred) > 0 AS is_stated FROM t GROUP BY user_id""")
def event_times(spark, d):
    e = _read(spark, d, "events")
    rows = e.select("user_id", F.when(F.col("event_id") % 3 == 0, F.expr("ts - interval 30 minutes")).alias("source_time"), F.col("ts").alias("published"), (F.col("event_id") % 6 > 0).alias("inferred"))
    return B.event_times(rows, "user_id").select("user_id", _time("stamp").alias("stamp"), "is_stated")


@query("""
WITH g AS (SELECT o_custkey, max(CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END) AS manual, max(CASE WHEN o_orderstatus = 'P' THEN o_orderdate END) AS best, min(o_orderdate) AS detected, bool_or(o_orderpriority = '5-LOW') AS verified, max(o_orderdate) AS fallback FROM orders GROUP BY o_custkey)
SELECT o_custkey, strftime(coalesce(manual, best, CASE WHEN verified THEN detected END, fallback), '%Y-%m-%d') AS day, CASE WHEN manual IS NOT NULL THEN 'manual' WHEN best IS NOT NULL THEN 'source' WHEN verified THEN 'evidence' ELSE 'fallback' END AS origin FROM g""")
def publication_times(spark, d):
    day = F.col("o_orderdate").cast("date")
    g = _read(spark, d, "orders").groupBy("o_custkey").agg(
        F.max(F.when(F.col("o_orderkey") % 7 == 0, day)).alias("manual"),
        F.collect_set(F.when(F.col("o_orderstatus") == "P", day)).alias("sources"),
        F.min(day).alias("detected"),
        F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("verified"),
        F.max(day).alias("fallback"),
    )
    stamp, origin = B.resolved_time(F.col("manual"), F.col("sources"), F.col("detected"), F.col("verified"), F.col("fallback"))
    return g.select("o_custkey", F.date_format(stamp, "yyyy-MM-dd").alias("day"), origin.alias("origin"))


@query(_CANDIDATES + "SELECT doc_id, reason, CASE WHEN reason IS NULL THEN 'publish' WHEN doc_id % 5 < 3 THEN 'retry' ELSE 'reject' END AS route FROM c")
def draft_routing(spark, d):
    rows = _candidates(spark, d)
    return rows.select("doc_id", "reason", B.routed(F.col("reason"), F.col("doc_id") % 5).alias("route"))


_MERGED = """
WITH d AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS title, max(ts) AS stamp, list(event_type ORDER BY ts, event_id) AS e FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id),
p AS (SELECT user_id AS id, min(ts) AS stamp, count(*) AS revision FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_type = 'purchase' GROUP BY user_id),
articles AS (SELECT id, title, coalesce(p.stamp, d.stamp) AS stamp, CASE WHEN p.stamp IS NOT NULL THEN d.stamp END AS updated, coalesce(revision, 0) + 1 AS revision, e FROM d LEFT JOIN p USING (id))
"""


def _merged(spark, d):
    e = _read(spark, d, "events")
    half = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    drafts = e.where(F.col("ts") >= half).groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("title"), F.max("ts").alias("stamp"), in_order.alias("entities"))
    published = e.where((F.col("ts") < half) & (F.col("event_type") == "purchase")).groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("stamp"), F.count("*").alias("revision"))
    return B.merged_articles(drafts, published)


@query(_MERGED + f"SELECT id, title, strftime(stamp, {_FORMAT}) AS stamp, strftime(updated, {_FORMAT}) AS updated, revision, len(list_distinct(e))::INTEGER AS n_entities, e[1] AS first_entity FROM articles")
def merged_articles(spark, d):
    return _merged(spark, d).select("id", "title", _time("stamp").alias("stamp"), _time("updated").alias("updated"), "revision", F.size("entities").alias("n_entities"), F.get("entities", F.lit(0)).alias("first_entity"))


@query(_MERGED + f"SELECT id, title, strftime(coalesce(updated, stamp), {_FORMAT}) AS stamp, title IN ('error', 'purchase') AS hot FROM articles")
def flashes(spark, d):
    return _merged(spark, d).select("id", "title", _time(F.coalesce("updated", "stamp")).alias("stamp"), F.col("title").isin("error", "purchase").alias("hot"))


@query(_MERGED + "SELECT id, title, strftime(stamp, '%Y-%m-%d') AS day, CASE WHEN revision > 20 THEN 'acc' WHEN revision > 10 THEN 'ser' ELSE 'inc' END AS severity FROM articles WHERE title = 'error' AND len(list_distinct(e)) > 1")
def incidents(spark, d):
    rows = _merged(spark, d).where((F.col("title") == "error") & (F.size("entities") > 1))
    severity = F.when(F.col("revision") > 20, "acc").when(F.col("revision") > 10, "ser").otherwise("inc")
    return rows.select("id", "title", F.date_format("stamp", "yyyy-MM-dd").alias("day"), severity.alias("severity"))


@query("""
WITH r AS (SELECT event_id, event_type AS section, 'event ' || event_type || ' ' || user_id AS title, value > 5 AS host_ok, event_id % 4 > 0 AS cited, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS place, strftime(ts, '%Y-%m-%d') AS day FROM events),
k AS (SELECT DISTINCT 'event ' || event_type || ' ' || user_id AS t FROM events WHERE event_id % 97 = 0),
g AS (SELECT * FROM r WHERE place <= 40 AND length(title) BETWEEN 8 AND 160 AND host_ok AND cited AND NOT EXISTS (SELECT 1 FROM k WHERE contains(title, t) OR contains(t, title)))
SELECT event_id, section, day, n::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY day || section ORDER BY place, event_id) AS n FROM g) WHERE n <= 4""")
def swept_items(spark, d):
    e = _read(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    title = F.concat(F.lit("event "), "event_type", F.lit(" "), F.col("user_id").cast("string"))
    rows = e.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id")))
    rows = rows.select("event_id", "day", "event_type", F.concat("day", "event_type").alias("section"), title.alias("title"), (F.col("value") > 5).alias("host_ok"), (F.col("event_id") % 4 > 0).alias("cited"), "place")
    return B.swept_items(rows, e.where("event_id % 97 = 0").select(title.alias("title"))).select("event_id", F.col("event_type").alias("section"), "day", "n")


@query("""
WITH m AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '{"url": "' || url || '", "kind": "logo"}' WHEN 2 THEN '{"url": "' || url || '", "kind": "other"}' ELSE 'data:' || page_id END AS m, url FROM pages)
SELECT page_id, CASE WHEN page_id % 4 < 2 AND regexp_matches(url, '^https?://') THEN url END AS url, CASE WHEN page_id % 4 < 2 AND regexp_matches(url, '^https?://') THEN CASE WHEN page_id % 4 = 1 THEN 'logo' ELSE 'photo' END END AS kind FROM m""")
def media_shapes(spark, d):
    n = F.col("page_id") % 4
    as_object = lambda kind: F.concat(F.lit('{"url": "'), "url", F.lit(f'", "kind": "{kind}"}}'))
    text = F.when(n == 0, F.col("url")).when(n == 1, as_object("logo")).when(n == 2, as_object("other")).otherwise(F.concat(F.lit("data:"), F.col("page_id").cast("string")))
    pages = _read(spark, d, "pages").select("page_id", B.media_shape(text).alias("m"))
    return pages.select("page_id", "m.url", "m.kind")


@query(_FACTS + """, q AS (SELECT doc_id AS request, doc_id AS event, substr(quote, 5, 30) AS quote FROM facts WHERE number % 2 = 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY number) = 1),
h AS (SELECT request, min(number) AS number FROM q JOIN facts f ON f.doc_id = q.event AND (contains(f.quote, q.quote) OR contains(q.quote, f.quote)) GROUP BY request)
SELECT request, number::INTEGER AS number FROM q LEFT JOIN h USING (request)""")
def archive_facts(spark, d):
    facts = _facts(spark, d)
    asked = facts.where("number % 2 = 0").groupBy("doc_id").agg(F.min_by("quote", "number").alias("quote"))
    requests = asked.select(F.col("doc_id").alias("request"), F.col("doc_id").alias("event"), F.substring("quote", 5, 30).alias("quote"))
    return B.archive_fact(requests, facts.select(F.col("doc_id").alias("event"), "number", "quote"))


@query("""
WITH r AS (SELECT user_id AS event, list_distinct(list(event_id % 500)) AS urls FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY user_id),
q AS (SELECT user_id AS row, user_id * 3 AS event, list_distinct(list(event_id % 500)) AS urls FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY user_id),
u AS (SELECT event, unnest(urls) AS url FROM r), v AS (SELECT row, unnest(urls) AS url FROM q),
m AS (SELECT row, 0 AS rule, q.event FROM q JOIN r USING (event) UNION ALL SELECT row, 1, u.event FROM v JOIN u USING (url)),
b AS (SELECT row, arg_min(event, (rule, event)) AS match, min(rule) AS rule FROM m GROUP BY row)
SELECT q.row, match, rule FROM q LEFT JOIN b ON q.row = b.row""")
def registry_matches(spark, d):
    e = _read(spark, d, "events").withColumn("url", F.col("event_id") % 500)
    stamp = lambda x: F.lit(x).cast("timestamp_ntz")
    registry = e.where(F.col("ts") < stamp("2024-01-03 00:00:00")).groupBy(F.col("user_id").alias("event")).agg(F.collect_set("url").alias("urls"))
    rows = e.where(F.col("ts") >= stamp("2024-01-29 00:00:00")).groupBy(F.col("user_id").alias("row")).agg(F.collect_set("url").alias("urls"))
    return B.registry_match(rows.withColumn("event", F.col("row") * 3), registry)


@query(_CANDIDATES + "SELECT doc_id, CASE WHEN doc_id % 30 > 14 THEN 'expired' ELSE coalesce(reason, 'accepted') END AS outcome FROM c WHERE doc_id % 2 = 0")
def backlog_review(spark, d):
    backlog = _candidates(spark, d).where("doc_id % 2 = 0").withColumn("age_days", F.col("doc_id") % 30)
    return backlog.select("doc_id", F.when(F.col("age_days") > 14, "expired").otherwise(F.coalesce("reason", F.lit("accepted"))).alias("outcome"))


@query("""
WITH k(o_orderpriority, category) AS (VALUES ('1-URGENT', 'safety'), ('2-HIGH', 'safety'), ('3-MEDIUM', 'business'))
SELECT o_orderkey, coalesce(category, 'world') AS category, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderstatus = 'P' THEN 'a' WHEN o_orderstatus = 'F' THEN 'b' ELSE 'a,b' END AS languages, n AS n_sources FROM orders LEFT JOIN k USING (o_orderpriority) JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def operator_articles(spark, d):
    kinds = spark.createDataFrame([("1-URGENT", "safety"), ("2-HIGH", "safety"), ("3-MEDIUM", "business")], "o_orderpriority string, category string")
    sources = _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_suppkey").alias("n_sources"))
    rows = _read(spark, d, "orders").join(kinds, "o_orderpriority", "left").join(sources, "o_orderkey")
    languages = F.when(F.col("o_orderstatus") == "P", "a").when(F.col("o_orderstatus") == "F", "b").otherwise("a,b")
    return rows.select("o_orderkey", F.coalesce("category", F.lit("world")).alias("category"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), languages.alias("languages"), "n_sources")


@query(r"""
WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents)
SELECT doc_id, md5(lower(trim(regexp_replace(title, '\s+', ' ', 'g')))) AS squashed, md5(trim(regexp_replace(lower(regexp_replace(title, '\s+[-|]\s+[^-|]{1,40}$', '')), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g'))) AS key_a, md5(regexp_replace(lower(title), '[^\p{L}\p{M}\p{N}]+', '', 'g')) AS key_b FROM t""")
def title_keys(spark, d):
    title = T.first_line(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", F.md5(T.squash(title)).alias("squashed"), F.md5(T.title_key(title)).alias("key_a"), F.md5(T.compact_title_key(title)).alias("key_b"))


@query(r"""
WITH t AS (SELECT doc_id, lower(strip_accents(split_part(text, chr(10), 1))) AS t FROM documents)
SELECT doc_id, trim(left(trim(regexp_replace(regexp_replace(t, '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-'), 40), '-') AS slug FROM t""")
def slugs(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.slug(T.first_line(F.col("text"))).alias("slug"))


