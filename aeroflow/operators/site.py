"""Published tables: views, sections, candidate pools, dimensions and summaries."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def checked_places(places: DataFrame, key: str, lat: str, lon: str, radius: str) -> DataFrame:
    """Rows of a place dimension that break a rule: key shape, repeated key, range, radius."""
    repeated = F.count("*").over(Window.partitionBy(key)) > 1
    problem = (
        F.when(~F.col(key).rlike("^[A-Z]{4}$"), "key")
        .when(repeated, "repeated")
        .when(~F.col(lat).between(-90, 90) | ~F.col(lon).between(-180, 180), "position")
        .when(F.col(radius) <= 0, "radius")
    )
    return places.withColumn("problem", problem).where("problem is not null").select(key, "problem")


def checked_prices(prices: DataFrame, model: str, price: str, source: str, host: str) -> DataFrame:
    """Price rows that may be used: a positive rate from the allowed host, the first of a model."""
    good = prices.where((F.col(price) > 0) & F.col(source).rlike(f"^https://{host}(/|$)"))
    return good.withColumn("_n", F.row_number().over(Window.partitionBy(model).orderBy(source, price))).where("_n = 1").drop("_n")


def disruption_share(delays: Column, tracked: Column) -> Column:
    """Delays in percent of what is tracked, to one digit; null if nothing is."""
    return F.round(100.0 * delays / F.nullif(tracked, F.lit(0)), 1)


def age_label(stamp: Column, as_of: Column) -> Column:
    """minutes, hours or days since a time."""
    minutes = F.timestamp_diff("MINUTE", stamp, as_of)
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" d")))


def clean_title(title: Column, least: int = 8) -> Column:
    """A title without the publisher's tail; null if what is left is short or a bare address."""
    bare = F.trim(F.regexp_replace(title, r"\s+[-|]\s+[^-|]{1,40}$", ""))
    return F.when((F.length(bare) >= least) & ~bare.rlike(r"^(https?://|www\.)|\.aspx$"), bare)


def any_date(text: Column) -> Column:
    """Dates written as ISO, "July 23, 2026", "16 December 2025" or RFC 2822; others null."""
    bare = F.regexp_replace(text, "^[A-Za-z]{3}, ", "")
    patterns = ["yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy", "d MMM yyyy HH:mm:ss Z"]
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(p)) for p in patterns), F.try_to_timestamp(text)).cast("date")


def classified(text: Column, sections: Sequence[tuple[str, str]], default: str, severities: Sequence[tuple[str, int]]) -> tuple[Column, Column]:
    """A section and a severity by the first pattern that occurs."""
    low = F.lower(text)
    section = F.coalesce(*(F.when(low.rlike(p), F.lit(name)) for name, p in sections), F.lit(default))
    severity = F.coalesce(*(F.when(low.rlike(p), F.lit(n)) for p, n in severities), F.lit(0))
    return section, severity


def topic_rows(docs: DataFrame, topics: DataFrame, doc_id: str, text: str, category: str) -> DataFrame:
    """(doc, topic) by category or by a term that occurs as a word. ``topics`` (topic, category, term) is small."""
    by_term = F.col("term").isNotNull() & F.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " "), F.lit(" ")), F.concat(F.lit(" "), "term", F.lit(" ")))
    met = docs.join(topics.withColumnRenamed("category", "_category"), (F.col("_category") == F.col(category)) | by_term)
    return met.select(doc_id, "topic").distinct()


def live_rows(rows: DataFrame, columns: Sequence[str], query: str, airborne: Column, order: str) -> DataFrame:
    """Airborne rows of which some column holds the query, by callsign with blanks last."""
    hit = F.contains(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))), F.lit(query.lower()))
    return rows.where(airborne & hit).orderBy(F.nullif(F.col(order), F.lit("")).asc_nulls_last())


#: Lengths from which and up to which a summary may be cut, marks that end a sentence
#: anywhere, and marks that may follow the end of one.
SOFT, HARD = 180, 260
ENDS = "!?。！？"
CLOSERS = "\"'”’)）]』」》"

#: A sentence with its end: a full stop counts before white space, a closing mark or the end of the text.
SENTENCE = rf"(?s).*?(?:[{ENDS}][{re.escape(CLOSERS)}]*|\.(?:[{re.escape(CLOSERS)}]+|\s|\z))"


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def ends_sentence(text: Column) -> Column:
    """Whether the text's last characters end a sentence."""
    return text.rlike(rf"([{ENDS}]|\.)[{re.escape(CLOSERS)}]*\s*\z")


def sentence_cut(text: Column) -> Column:
    """A text in single spaces: whole up to SOFT characters, else up to the first sentence end from
    there to HARD, else to the last one before; without any it ends at a word, with an ellipsis.

    No more than HARD characters are ever kept, so only the first HARD + 1 words are put in single spaces.
    """
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def cut(clean: Column) -> Column:
        pieces = F.regexp_extract_all(F.substring(clean, 1, HARD), F.lit(SENTENCE), F.lit(0))
        whole = once(pieces, lambda p: F.transform(p, lambda _, i: F.trim(F.array_join(F.slice(p, F.lit(1), i + 1), ""))))
        sentences = once(whole, lambda w: F.coalesce(F.get(F.filter(w, lambda x: F.length(x) >= SOFT), F.lit(0)), F.get(w, F.size(w) - 1)))
        head = F.rtrim(F.substring(clean, 1, SOFT))
        word = F.rtrim(F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1))
        prefix = F.when(F.length(F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)) >= SOFT // 2, word).otherwise(head)
        bare = F.concat(F.regexp_replace(prefix, "[,;:，；：]+$", ""), F.lit("…"))
        return F.when(F.length(clean) <= SOFT, clean).otherwise(F.coalesce(sentences, bare))

    start = F.regexp_extract(text, rf"(?U)^\s*+(?:\S++\s*+){{0,{HARD + 1}}}", 0)
    return once(single_spaced(start), cut)


def repaired_summary(summary: Column, body: Column) -> Column:
    """A summary that is the first SOFT characters of a longer body, cut inside a sentence, is cut at one
    instead; every other summary stays as it is. Null stays null."""
    hard_cut = (F.length(F.trim(body)) > SOFT) & (F.trim(summary) == F.substring(F.trim(body), 1, SOFT)) & ~ends_sentence(F.trim(summary))
    return F.when(hard_cut, sentence_cut(F.trim(body))).otherwise(summary)


def compact_words(text: Column, words: int = 14) -> Column:
    """The first words of a text."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, words), " ")


def valid_sets(rows: DataFrame, group: str, text: str, anchor: str, size: int = 6) -> DataFrame:
    """Groups of exactly ``size`` rows with different texts of 10 to 120 characters that all share
    their anchor token; a group is valid as a whole or not at all."""
    good = F.length(text).between(10, 120) & F.contains(F.lower(F.col(text)), F.lower(F.col(anchor)))
    return rows.groupBy(group).agg((F.bool_and(good) & (F.count("*") == size) & (F.count_distinct(text) == size)).alias("valid"))


def tiered(pools: Sequence[DataFrame], key: str, stamp: str, most: int = 12) -> DataFrame:
    """The newest rows of the first pool, then of the next, each key once."""
    union = pools[0].withColumn("tier", F.lit(0))
    for i, pool in enumerate(pools[1:], 1):
        union = union.unionByName(pool.withColumn("tier", F.lit(i)))
    once = union.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("tier", F.desc(stamp)))).where("_n = 1").drop("_n")
    return once.orderBy("tier", F.desc(stamp), key).limit(most)


def latest_closed(rows: DataFrame, group: str, cutoff: str, ok: str) -> DataFrame:
    """The row of the latest cutoff in each group, of those that succeeded."""
    return rows.where(ok).groupBy(group).agg(F.max_by(F.struct(*rows.columns), cutoff).alias("r")).select("r.*")


def best_match(rows: DataFrame, records: DataFrame, row_id: str, record_id: str, url: str, title: str) -> DataFrame:
    """The record that a row updates: the first with its URL, else the first with its title key."""
    first = lambda key, rule: rows.join(records.groupBy(key).agg(F.min(record_id).alias("match")), key).select(row_id, F.lit(rule).alias("rule"), "match")
    return first(url, 0).union(first(title, 1)).groupBy(row_id).agg(F.min(F.struct("rule", "match")).alias("m")).select(row_id, "m.match", "m.rule")


def operator_of(rows: DataFrame, airlines: DataFrame, callsign: str, owner: str) -> DataFrame:
    """The airline by a callsign of three letters and a digit, else by the owner's exact name.

    ``airlines``: code, airline; a small dimension.
    """
    prefix = F.when(F.col(callsign).rlike("^[A-Z]{3}[0-9]"), F.substring(callsign, 1, 3))
    a = airlines.select(F.col("code").alias("_code"), F.col("airline").alias("_by_code"))
    b = airlines.groupBy(F.lower("airline").alias("_name")).agg(F.min("airline").alias("_by_name"))
    met = rows.join(a, prefix == F.col("_code"), "left").join(b, F.lower(F.col(owner)) == F.col("_name"), "left")
    return met.withColumn("operator", F.coalesce("_by_code", "_by_name")).drop("_code", "_by_code", "_name", "_by_name")


def media_choice(records: DataFrame, photos: DataFrame, record_id: str, exact: str, kind: str) -> DataFrame:
    """The photo for a record: of the same ``exact`` key, else of the same ``kind``, the newest first.

    ``photos``: photo, the two keys and year. Each rule is an equality join on its own.
    """
    best = photos.groupBy(exact).agg(F.min(F.struct((-F.col("year")).alias("age"), "photo")).alias("p"))
    first = records.join(best, exact).select(record_id, F.lit(0).alias("rule"), "p.age", "p.photo")
    newest = photos.groupBy(kind).agg(F.min(F.struct((-F.col("year")).alias("age"), "photo")).alias("p"))
    second = records.join(newest, kind).select(record_id, F.lit(1).alias("rule"), "p.age", "p.photo")
    return first.union(second).groupBy(record_id).agg(F.min(F.struct("rule", "age", "photo")).alias("m")).select(record_id, "m.photo", "m.rule")


def grouped_changes(rows: DataFrame, row_id: str, day: str, label: str) -> DataFrame:
    """Change entries by day, ids that repeat told once."""
    once = rows.groupBy(row_id).agg(F.min_by(F.struct(day, label), day).alias("r")).select(row_id, f"r.{day}", f"r.{label}")
    return once.groupBy(day).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"))


def activity_counts(text: Column) -> tuple[Column, Column]:
    """Aircraft and ships told in a text: the number before the noun, else after it."""
    number = lambda noun: F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (rf"(?i)(\d{{1,4}})\s+{noun}", rf"(?i){noun}\D{{0,12}}(\d{{1,4}})"))).try_cast("int")
    return number("aircraft"), number("ships?")
