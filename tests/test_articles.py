from pyspark.sql import functions as F

from aeroflow.operators import articles as A, gates as G, history as H, metrics as M, briefings as B


def test_evidence_budget_skips_and_goes_on(spark):
    facts = [("g", "e1", 1, 1, "x" * 50), ("g", "e1", 1, 2, "x" * 60), ("g", "e2", 2, 1, "x" * 90), ("g", "e3", 3, 1, "x" * 40), ("g", "e4", 4, 1, "x" * 5), ("g", "e5", 5, 1, "x")]
    df = spark.createDataFrame(facts, "grp string, event string, rank int, number int, text string")
    got = A.evidence_budget(df, "grp", "event", "rank", "number", "text", chars=100)
    assert sorted(map(tuple, got.collect())) == [("g", "e1", 1), ("g", "e3", 1), ("g", "e4", 1)]


def test_rate_limits_do_not_count_denials(spark):
    rows = [(1, i, f"2024-01-01 00:00:{i:02d}", f"q{i % 3}") for i in range(6)] + [(1, 9, "2024-01-01 00:02:00", "q0"), (2, 10, "2024-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "user int, id int, ts string, q string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.request: r.decision for r in B.rate_limited(df, "user", "ts", "id", per_minute=2, cooldown_s=30, question="q").collect()}
    assert got == {0: "allowed", 1: "allowed", 2: "minute", 3: "cooldown", 4: "cooldown", 5: "minute", 9: "allowed", 10: "allowed"}


def test_series_excludes_the_day_itself(spark):
    days = [("2024-07-20", 7), ("2024-07-22", 30), ("2024-07-26", 5), ("2024-07-27", 99), ("2024-06-27", 20)]
    df = spark.createDataFrame(days, "day string, n int").withColumn("day", F.to_date("day"))
    row = next(r for r in M.series_context(df, "day", "n").collect() if str(r.day) == "2024-07-27")
    assert (row.previous, row.peak_30d, str(row.peak_day), row.month_ago) == (5, 30, "2024-07-22", 20)


def test_null_key_counts_every_row(spark):
    history = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-05"), ("a", "2024-01-09")], "k string, day string").withColumn("day", F.to_date("day"))
    rows = spark.createDataFrame([(1, "a", "2024-01-10"), (2, None, "2024-01-10"), (3, "c", "2024-01-10")], "id int, k string, day string").withColumn("day", F.to_date("day"))
    got = {r.id: (r.n_3d, r.n_30d) for r in H.history_counts(rows, history, "id", "k", "day", [3, 30]).collect()}
    assert got == {1: (1, 2), 2: (1, 3), 3: (0, 0)}


def test_material_ignores_one_echo_of_the_title(spark):
    df = spark.createDataFrame([("A title", "A title"), ("A title", "A title and then much more to be told"), ("", "x" * 25), (None, "x" * 25)], "t string, s string")
    assert [r.m for r in df.select(G.has_material(F.col("t"), F.col("s")).alias("m")).collect()] == [False, True, True, True]


def test_quotes_are_found_inside_texts(spark):
    quotes = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "short")], "qid int, q string")
    texts = spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten"), (2, "one two three")], "id int, text string")
    assert [tuple(r) for r in G.verified_quotes(quotes, texts, "q", "text", "id").select("qid", "id").collect()] == [(1, 1)]


def test_summaries_end_at_sentences(spark):
    from pyspark.sql import functions as F

    from aeroflow.operators.site import repaired_summary, sentence_cut

    start = "word " * 30
    rows = [
        ("short  one\n", "short one"),
        (start + "and more to say here, so that it goes on. Then more" + " x" * 200, (start + "and more to say here, so that it goes on.")),
        ("Begin. " + "word " * 80, "Begin."),
        ("word, " * 80, "word, " * 28 + "word…"),
        ("v1.5 is " * 40, ("v1.5 is " * 23).strip()[:180].rsplit(" ", 1)[0] + "…"),
        ("He said “go.” " + "word " * 80, "He said “go.”"),
        ("字" * 170 + "。" + "字" * 30 + "！」" + "字" * 100, "字" * 170 + "。" + "字" * 30 + "！」"),
        ("x" * 300, "x" * 180 + "…"),
        (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").orderBy("i")
    assert [r.s for r in df.select(sentence_cut(F.col("t")).alias("s")).collect()] == [want for _, want in rows]
    body = "Begin. " + "word " * 80
    cases = [(body[:180], body, "Begin."), ("own words", body, "own words"), (body[:179], body, body[:179]), ("short", "short", "short"), (None, body, None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string").orderBy("i")
    assert [r.s for r in df.select(repaired_summary(F.col("a"), F.col("b")).alias("s")).collect()] == [want for *_, want in cases]


def test_no_secret_is_left_in_logs(spark):
    from pyspark.sql import functions as F

    from aeroflow.functions.text import redacted

    shapes = ["Authorization: Bearer S3CR3T", "authorization=S3CR3T", 'AUTHORIZATION: "Basic S3CR3T"', "api-key S3CR3T", "api_key:S3CR3T", 'API KEY = "S3CR3T"', "token=S3CR3T", "bearer S3CR3T", "password: 'S3CR3T'", "secret S3CR3T", "{\"token\": \"S3CR3T\"}", "see https://h/?token=S3CR3T", "Authorization\x00:\tBearer\nS3CR3T"]
    got = [r.s for r in spark.createDataFrame([(f"before {s} after",) for s in shapes], "t string").select(redacted(F.col("t")).alias("s")).collect()]
    assert not [s for s in got if "S3CR3T" in s] and all(s.startswith("before ") and s.endswith("after") for s in got), got
    assert spark.createDataFrame([("plain text",), (None,)], "t string").select(redacted(F.col("t")).alias("s")).collect()[0].s == "plain text"


def test_articles_without_a_title_are_not_shown(spark):
    from aeroflow.operators.publish import article_view

    schema = "id string, archived boolean, published timestamp_ntz, source_time timestamp_ntz, updated timestamp_ntz, placed timestamp_ntz, title_a string, title_b string, urls array<string>"
    rows = spark.sql("select timestamp_ntz'2024-01-02 03:04:05' as t").collect()[0].t
    ok = ["https://x.org/a"]
    data = [("abc", None, rows, None, None, None, " ", None, ok), ("abd", False, rows, None, None, rows.replace(day=9), " ", "B", ok), ("abe", True, rows, None, None, None, "A", "B", ok), ("abf", False, None, None, None, None, "A", None, ok), ("abg", False, rows, None, None, None, "A", None, ["ftp://x"])]
    got = article_view(spark.createDataFrame(data, schema)).collect()
    assert [(r.id, r.title_a, r.title_b, r.sort.day) for r in got] == [("abd", "B", "B", 9)]
