"""Queries for articles, evidence and publication, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from aeroflow.functions import text as T
from aeroflow.operators import articles as A, drafts as D
from aeroflow.plans.registry import query

_WORDS = r"len(regexp_extract_all(text, '[^\s]+'))"


def _read(spark, d, table):
    return spark.read.parquet(f"{d}/{table}.parquet")


def _docs(spark, d):
    docs = _read(spark, d, "documents")
    return docs.withColumn("title", T.first_line(F.col("text"))).withColumn("words", F.regexp_count("text", F.lit(r"[^\s]+"))).withColumn("paragraphs", F.size(F.split("text", "\n", -1)))


@query(rf"""
WITH d AS (SELECT doc_id, text, {_WORDS} AS words, len(string_split(text, chr(10))) AS paragraphs, split_part(text, chr(10), 1) AS title FROM documents)
SELECT doc_id, coalesce(CASE WHEN length(trim(title)) = 0 THEN 'title' END, CASE WHEN length(title) > 300 THEN 'title length' END, CASE WHEN words < 20 THEN 'short' END, CASE WHEN text LIKE '%###%' THEN 'markup' END, CASE WHEN paragraphs > 40 THEN 'paragraphs' END, 'valid') AS verdict,
  coalesce(CASE WHEN paragraphs BETWEEN 4 AND 7 AND words >= 250 THEN 'full' WHEN paragraphs >= 2 AND words BETWEEN 90 AND 150 THEN 'brief' END, 'none') AS format FROM d""")
def draft_validation(spark, d):
    docs = _docs(spark, d)
    rules = [
        ("title", F.length(F.trim("title")) == 0),
        ("title length", F.length("title") > 300),
        ("short", F.col("words") < 20),
        ("markup", F.contains(F.col("text"), F.lit("###"))),
        ("paragraphs", F.col("paragraphs") > 40),
    ]
    return docs.select("doc_id", F.coalesce(A.first_failure(rules), F.lit("valid")).alias("verdict"), F.coalesce(A.length_format(F.col("paragraphs"), F.col("words")), F.lit("none")).alias("format"))


@query("""
WITH g(rule, term, required) AS (VALUES (1, 'license', 'apache'), (2, 'token', NULL), (3, 'scum', NULL), (4, 'the ', 'and '))
SELECT doc_id, min(rule) AS rule FROM documents JOIN g ON contains(lower(text), term) AND (required IS NULL OR NOT contains(lower(text), required)) GROUP BY doc_id""")
def terminology_gate(spark, d):
    glossary = spark.createDataFrame([(1, "license", "apache"), (2, "token", None), (3, "scum", None), (4, "the ", "and ")], "rule int, term string, required string")
    return A.terminology(_read(spark, d, "documents"), glossary, "doc_id", "text")


@query("""
SELECT l_orderkey, CASE WHEN min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*) THEN 'numbering' WHEN count(*) FILTER (l_linestatus = 'O') < 2 THEN 'evidence' ELSE 'bound' END AS binding FROM lineitem GROUP BY l_orderkey""")
def evidence_binding(spark, d):
    facts = _read(spark, d, "lineitem").withColumn("current", F.col("l_linestatus") == "O")
    return A.binding_problem(facts, "l_orderkey", "l_linenumber", "current")


@query("""
SELECT l_orderkey, bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5)) AS verified FROM lineitem GROUP BY l_orderkey""")
def reverified_facts(spark, d):
    lines = _read(spark, d, "lineitem")
    stored = lines.join(_read(spark, d, "part").where("p_size > 5"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return A.all_verified(lines, stored, "l_orderkey", "l_partkey")


@query("SELECT source, count(DISTINCT lang) AS n_sources, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY source HAVING count(DISTINCT lang) < 4 OR sum(length(text)) < 160000")
def thin_groups(spark, d):
    return A.thin(_read(spark, d, "documents"), "source", "lang", "text", chars=160000)


@query(r"""
WITH i AS (SELECT page_id AS id, url, trim(regexp_replace(lower(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '\s+[-|]\s+[^-|]{1,40}$', '')), '[^\p{L}\p{N}_]+', ' ', 'g')) AS title FROM pages)
SELECT id, CASE WHEN url IN (SELECT url FROM i WHERE id % 3 = 0) THEN 'seen' WHEN title IN (SELECT title FROM i WHERE id % 5 = 0) THEN 'update' ELSE 'new' END AS state FROM i""")
def seen_states(spark, d):
    pages = _read(spark, d, "pages").select(F.col("page_id").alias("id"), "url", T.title_key(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"))
    return A.seen_state(pages, pages.where("id % 3 = 0"), pages.where("id % 5 = 0"))


@query("""
SELECT event_id, CASE WHEN n > 1 THEN b || '-' || n ELSE b END AS unique_id FROM (SELECT event_id, strftime(ts, '%Y%m%d') || event_type AS b, row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') || event_type ORDER BY ts, event_id) AS n FROM events)""")
def unique_ids(spark, d):
    events = _read(spark, d, "events").withColumn("base", F.concat(F.date_format("ts", "yyyyMMdd"), "event_type"))
    return A.unique_ids(events, "base", ["ts", "event_id"]).select("event_id", "unique_id")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_versions(spark, d):
    return A.latest(_read(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


_NAMES = ["the", "les", "der", "los", "tion"]


@query(r"""
WITH h AS (SELECT doc_id, unnest([{'n': 'the', 'p': 0}, {'n': 'les', 'p': 1}, {'n': 'der', 'p': 2}, {'n': 'los', 'p': 3}, {'n': 'tion', 'p': 4}]) AS c, lower(split_part(text, chr(10), 1)) AS lead, lower(text) AS body FROM documents),
s AS (SELECT doc_id, c.n AS name, c.p AS p, 10 * (length(lead) - length(replace(lead, c.n, ''))) // length(c.n) + (length(body) - length(replace(body, c.n, ''))) // length(c.n) AS score FROM h)
SELECT doc_id, name, score::INTEGER AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, p) = 1""")
def mention_scores(spark, d):
    return A.mention_scores(_docs(spark, d), _NAMES, "title", "text", "doc_id")


_KEYS = r"""
WITH k AS (
  SELECT doc_id, 'registration' AS kind, unnest(list_distinct(regexp_extract_all(text, '\bB-\d{4,5}\b'))) AS key FROM documents UNION ALL
  SELECT doc_id, 'flight', unnest(list_distinct(regexp_extract_all(text, '\b[A-Z]{2}\d{3,4}\b'))) FROM documents UNION ALL
  SELECT doc_id, 'date', unnest(list_distinct(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b'))) FROM documents UNION ALL
  SELECT doc_id, 'phone', unnest(list_distinct(regexp_extract_all(text, '\+\d \(\d{3}\) \d{3}-\d{4}'))) FROM documents UNION ALL
  SELECT doc_id, 'number', unnest(list_distinct(regexp_extract_all(text, '\b\d{12,19}\b'))) FROM documents)
"""


@query(_KEYS + "SELECT doc_id, kind, key FROM k")
def entity_keys(spark, d):
    return A.entity_keys(_read(spark, d, "documents"), "doc_id", "text")


@query(_KEYS + """, p AS (SELECT a.doc_id AS current, b.doc_id AS archive, count(*) AS shared, array_to_string(list_sort(list_distinct(list(a.kind))), ',') AS kinds FROM k a JOIN k b ON a.kind = b.kind AND a.key = b.key AND a.doc_id > b.doc_id GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY current ORDER BY shared DESC, archive)::INTEGER AS place FROM p QUALIFY place <= 5""")
def archive_relations(spark, d):
    return A.related(A.entity_keys(_read(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query(None)
def evidence_budget(spark, d):
    docs = _docs(spark, d).withColumn("rank", F.col("doc_id") % 7)
    return A.evidence_budget(docs, "source", "lang", "rank", "doc_id", "title", chars=600)


@query("""
WITH p(event_type, price_in, price_out) AS (VALUES ('click', 2.0::DOUBLE, 8.0::DOUBLE), ('view', 1.0, 3.0), ('purchase', 0.5, 1.5), ('signup', 4.0, 9.0))
SELECT user_id, round(sum((event_id * price_in + value * price_out) / 1e6::DOUBLE), 8) AS cost, bool_and(price_in IS NOT NULL) AS all_priced, count(*) AS calls FROM events LEFT JOIN p USING (event_type) GROUP BY user_id""")
def job_costs(spark, d):
    prices = spark.createDataFrame([("click", 2.0, 8.0), ("view", 1.0, 3.0), ("purchase", 0.5, 1.5), ("signup", 4.0, 9.0)], "event_type string, price_in double, price_out double")
    return A.priced_jobs(_read(spark, d, "events"), prices, "user_id", "event_type", "event_id", "value")


_CACHE = """
WITH c AS (SELECT user_id, CASE WHEN max(event_id) % 3 > 0 THEN 'text' || max(event_id) END AS text, max(ts) - INTERVAL 1 DAY * (user_id % 40) AS stamp FROM events GROUP BY user_id),
good AS (SELECT * FROM c WHERE date_diff('second', stamp, TIMESTAMP '2024-01-30 23:00:00') // 3600 <= CASE WHEN text IS NOT NULL THEN 504 ELSE 24 END)
"""


def _cached(spark, d):
    events = _read(spark, d, "events")
    newest = events.groupBy("user_id").agg(F.max("event_id").alias("e"), F.max("ts").alias("t"))
    cache = newest.select("user_id", F.when(F.col("e") % 3 > 0, F.concat(F.lit("text"), F.col("e").cast("string"))).alias("text"), F.expr("t - make_dt_interval(cast(user_id % 40 as int))").alias("stamp"))
    return A.cached_worklist(newest.select("user_id", "e"), cache, "user_id", F.lit("2024-01-30 23:00:00").cast("timestamp_ntz"))


@query(_CACHE + "SELECT user_id, text FROM good WHERE text IS NOT NULL")
def cached_texts(spark, d):
    return _cached(spark, d)[0].select("user_id", "text")


@query(_CACHE + "SELECT user_id FROM c WHERE user_id NOT IN (SELECT user_id FROM good) ORDER BY user_id LIMIT 12")
def fetch_worklist(spark, d):
    return _cached(spark, d)[1]


@query("""
WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS attempts, bool_or(event_type = 'purchase' AND value > 150) AS matched, max(ts) AS tried FROM events GROUP BY user_id)
SELECT user_id FROM s WHERE NOT matched AND attempts < 20 AND date_diff('second', tried, TIMESTAMP '2024-01-30 12:00:00') // 3600 >= 6 ORDER BY attempts, user_id LIMIT 6""")
def retry_list(spark, d):
    events = _read(spark, d, "events")
    state = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("attempts"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 150)).alias("matched"), F.max("ts").alias("tried"))
    return A.retry_list(events, state, "user_id", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), attempts=20)


@query("SELECT event_id FROM events WHERE ts + INTERVAL 30 MINUTE <= TIMESTAMP '2024-01-10 00:00:00' AND event_type <> 'error' AND ts >= TIMESTAMP '2024-01-09 00:00:00' ORDER BY ts, event_id LIMIT 3")
def held_back(spark, d):
    queue = _read(spark, d, "events").where("ts >= timestamp_ntz'2024-01-09 00:00:00'").withColumn("not_before", F.expr("ts + interval 30 minutes")).withColumn("conflict", F.col("event_type") == "error")
    return A.released(queue, "not_before", "conflict", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), "event_id").select("event_id")


@query("SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def nulled_references(spark, d):
    published = _read(spark, d, "customer").where("c_acctbal > 0")
    return A.nulled_references(_read(spark, d, "orders").select("o_orderkey", "o_custkey"), published, "o_custkey", "c_custkey")


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS stamp FROM events GROUP BY user_id")
def seen_memory(spark, d):
    events = _read(spark, d, "events").select("user_id", F.col("ts").alias("stamp"))
    half = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return A.keep_first(events.where(F.col("stamp") >= half), events.where(F.col("stamp") < half), "user_id", "stamp").select("user_id", F.date_format("stamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("""
WITH g(grp, alias) AS (VALUES (1, 'apache'), (1, 'license'), (2, 'the and'), (2, 'les de'), (3, 'token'), (3, 'secret')),
h AS (SELECT DISTINCT doc_id, grp FROM documents JOIN g ON contains(lower(text), alias))
SELECT doc_id, array_to_string(list_sort(list_distinct(list(alias))), ' ') AS aliases FROM h JOIN g USING (grp) GROUP BY doc_id""")
def alias_expansion(spark, d):
    groups = spark.createDataFrame([(1, "apache"), (1, "license"), (2, "the and"), (2, "les de"), (3, "token"), (3, "secret")], "grp int, alias string")
    return A.expanded_aliases(_read(spark, d, "documents"), groups, "doc_id", "text")


@query("""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages),
r(suffix, rule) AS (VALUES ('example.org', 'allowed'), ('example.com', 'forum'), ('cheap-pills.example.com', 'blocked'))
SELECT page_id, coalesce(arg_max(rule, length(suffix)), 'unknown') AS policy FROM p LEFT JOIN r ON host = suffix OR host LIKE '%.' || suffix GROUP BY page_id""")
def host_policy(spark, d):
    rules = spark.createDataFrame([("example.org", "allowed"), ("example.com", "forum"), ("cheap-pills.example.com", "blocked")], "suffix string, rule string")
    pages = _read(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("host"))
    met = pages.join(rules, (F.col("host") == F.col("suffix")) | F.endswith(F.col("host"), F.concat(F.lit("."), "suffix")), "left")
    return met.groupBy("page_id").agg(F.coalesce(F.max_by("rule", F.length("suffix")), F.lit("unknown")).alias("policy"))


@query("""
SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'purchase'
EXCEPT SELECT user_id, strftime(ts, '%Y-%m-%d') FROM events WHERE event_type = 'error'""")
def clean_days(spark, d):
    events = _read(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return events.where("event_type = 'purchase'").select("user_id", "day").distinct().join(events.where("event_type = 'error'").select("user_id", "day"), ["user_id", "day"], "left_anti")


@query("""
WITH b AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (ts < TIMESTAMP '2024-01-15'))) AS a, list_sort(list_distinct(list(event_type) FILTER (ts >= TIMESTAMP '2024-01-15'))) AS b FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') AS united, array_to_string(list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))), ',') AS fresh,
  array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: list_contains(coalesce(b, []), x))), ',') AS common FROM b""")
def fact_sets(spark, d):
    events = _read(spark, d, "events")
    half = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    sets = events.groupBy("user_id").agg(F.collect_set(F.when(F.col("ts") < half, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("ts") >= half, F.col("event_type"))).alias("b"))
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    return sets.select("user_id", joined(F.array_union("a", "b")).alias("united"), joined(F.array_except("b", "a")).alias("fresh"), joined(F.array_intersect("a", "b")).alias("common"))


@query("""
WITH a AS (SELECT n_name, count(*) AS customers, round(avg(c_acctbal), 4) AS mean_balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT n_name, customers, mean_balance, row_number() OVER (ORDER BY mean_balance DESC, n_name)::INTEGER AS rank, round(customers * 1.0::DOUBLE / max(customers) OVER (), 4) AS share FROM a""")
def ranking_shares(spark, d):
    nation = _read(spark, d, "nation")
    totals = _read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return totals.select("n_name", "customers", "mean_balance", F.row_number().over(Window.orderBy(F.desc("mean_balance"), "n_name")).alias("rank"), F.round(F.col("customers") / F.max("customers").over(everything), 4).alias("share"))


@query(None)
def draft_gates(spark, d):
    """Documents as drafts of their source's group, with facts quoted from texts, through all gates.

    The first paragraphs are both languages' bodies; every fifth draft quotes what no text says.
    """
    docs = _read(spark, d, "documents").where("text is not null")
    lines = F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, 9)
    side = F.struct(F.get(lines, F.lit(0)).alias("title"), F.get(lines, F.lit(0)).alias("summary"), lines.alias("body"))
    quote = lambda at: F.when(F.col("doc_id") % 5 == 0, F.reverse(F.substring("text", at, 40))).otherwise(F.substring("text", at, 40))
    fact = lambda n, at: F.struct(F.lit(f"F{n}").alias("fact_id"), F.lit("claim").alias("claim"), quote(at).alias("quote"), F.concat(F.lit("https://x.org/"), F.col("doc_id").cast("string")).alias("url"), F.lit("source").alias("scope"), F.lit(None).cast("string").alias("archive_id"), F.lit(None).cast("boolean").alias("archive"))
    words = D.en_words(lines)
    drafts = docs.select(
        F.col("doc_id").cast("string").alias("draft_id"), F.coalesce("source", F.lit("")).alias("group_id"), F.when(words >= D.FULL_EN, "publish").when(words > 20, "publish_brief").otherwise("reject").alias("status"), F.coalesce("lang", F.lit("")).alias("cat"),
        side.alias("zh"), side.alias("en"), F.struct(F.lit("a").alias("zh"), F.lit("b").alias("en"), F.lit(False).alias("hot")).alias("flash"), F.array(fact(1, 1), fact(2, 41)).alias("facts"), F.array(F.lit("F1")).alias("headline_refs"), F.array(F.lit("F2")).alias("summary_refs"),
        F.array().cast("array<string>").alias("flags"), F.lit("").alias("decision"), F.lit(False).alias("human_review"), F.lit("confirmed").alias("event_status"), F.lit(None).cast("struct<sev:string,status:string,date:string,aircraft:string,operator:string>").alias("incident"), (F.col("doc_id") % 4).cast("int").alias("tries"),
    )
    groups = drafts.select("group_id", F.lit("event").alias("kind"), F.array().cast("array<string>").alias("urls"), (F.col("group_id") == "").alias("full_text")).distinct()
    glossary = _read(spark, d, "nation").select(F.col("n_name").alias("rule"), F.col("n_name").alias("term"), F.lit(None).cast("string").alias("required"))
    evidence = docs.select(F.coalesce("source", F.lit("")).alias("group_id"), "text")
    out = D.gated(drafts, evidence, groups, glossary, ["in this article"], ["according to documents"], ["en", "de", "fr"], ["risk"], "(?i)this draft was")
    return out.select("draft_id", F.size("verified").alias("n_verified"), "gate", "problem", "route")
