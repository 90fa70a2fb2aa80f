"""Articles: validation, evidence, views, mentions, entity keys and publication."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroflow.operators.dictionary import phrases_in


def first_failure(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks, null if it breaks none."""
    return F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in rules))


def length_format(paragraphs: Column, words: Column) -> Column:
    """full (4 to 7 paragraphs, 250 words or more), brief (2 paragraphs or more, 90 to 150 words), else null."""
    return F.when(paragraphs.between(4, 7) & (words >= 250), "full").when((paragraphs >= 2) & words.between(90, 150), "brief")


def terminology(records: DataFrame, glossary: DataFrame, record_id: str, text: str) -> DataFrame:
    """The first rule (by ``rule``) that a record breaks: a forbidden term occurs, or a term that
    asks for a rendering occurs without it.

    ``glossary``: rule, term, required (null: the term is forbidden), both in lower case. One automaton
    finds all terms and renderings in a pass over a text; rules and terms found then meet by equality.
    """
    low = records.select(F.col(record_id).alias("id"), F.lower(F.col(text)).alias("text"))
    terms = glossary.select(F.col("term").alias("p")).union(glossary.select("required"))
    said = phrases_in(low, terms, "text", "id", "p").select("id", F.col("phrase").alias("term")).distinct()
    rendered = said.select("id", F.col("term").alias("required"), F.lit(True).alias("rendered"))
    met = said.join(glossary, "term").join(rendered, ["id", "required"], "left").where("rendered is null")
    return met.groupBy(F.col("id").alias(record_id)).agg(F.min("rule").alias("rule"))


def binding_problem(facts: DataFrame, record_id: str, number: str, current: str, least: int = 2) -> DataFrame:
    """Records whose facts are not numbered 1 to n, or with fewer than ``least`` current facts."""
    counted = facts.groupBy(record_id).agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high"), F.count_distinct(number).alias("different"), F.count_if(current).alias("current"))
    problem = F.when((F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("different") != F.col("n")), "numbering").when(F.col("current") < least, "evidence")
    return counted.select(record_id, F.coalesce(problem, F.lit("bound")).alias("binding"))


def all_verified(facts: DataFrame, stored: DataFrame, record_id: str, key: str) -> DataFrame:
    """Records whose stored facts all occur again; one missing fact and none survives."""
    met = facts.select(record_id, key).join(stored.select(record_id, key, F.lit(True).alias("found")).distinct(), [record_id, key], "left")
    return met.groupBy(record_id).agg(F.bool_and(F.coalesce("found", F.lit(False))).alias("verified"))


def thin(groups: DataFrame, group: str, source: str, text: str, sources: int = 4, chars: int = 1600) -> DataFrame:
    """Groups with fewer sources or characters than it takes."""
    size = groups.groupBy(group).agg(F.count_distinct(source).alias("n_sources"), F.sum(F.length(text)).alias("n_chars"))
    return size.where((F.col("n_sources") < sources) | (F.col("n_chars") < chars))


def seen_state(rows: DataFrame, seen_urls: DataFrame, seen_titles: DataFrame) -> DataFrame:
    """seen (the URL is known), update (a new URL with a known title) or new.

    ``rows``: id, url, title; ``seen_urls``: url; ``seen_titles``: title.
    """
    known = rows.join(seen_urls.select("url", F.lit(True).alias("_u")).distinct(), "url", "left").join(seen_titles.select("title", F.lit(True).alias("_t")).distinct(), "title", "left")
    return known.select("id", F.when(F.col("_u").isNotNull(), "seen").when(F.col("_t").isNotNull(), "update").otherwise("new").alias("state"))


def unique_ids(rows: DataFrame, base: str, order: Sequence[str]) -> DataFrame:
    """Equal base ids get -2, -3 and so on, in the given order."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return rows.withColumn("unique_id", F.when(n > 1, F.concat_ws("-", base, n.cast("string"))).otherwise(F.col(base)))


def latest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last version of each key."""
    names = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_row"))
    return best.select(key, "_row.*")


def mention_scores(docs: DataFrame, names: Sequence[str], lead: str, body: str, doc_id: str) -> DataFrame:
    """The name that a document is about: 10 for each mention in the lead and 1 in the body.

    Ties go to the earlier name in the list, which is a dictionary kept by hand.
    """
    hits = [(10 * F.regexp_count(F.lower(lead), F.lit(n)) + F.regexp_count(F.lower(body), F.lit(n))).cast("int") for n in names]
    scored = F.array(*(F.struct(h.alias("score"), F.lit(-i).alias("place"), F.lit(n).alias("name")) for i, (n, h) in enumerate(zip(names, hits))))
    best = docs.select(doc_id, F.array_max(scored).alias("best"))
    return best.where("best.score > 0").select(doc_id, "best.name", "best.score")


#: Kinds of keys that a text gives, with their patterns.
ENTITY_KEYS = {"registration": r"\bB-\d{4,5}\b", "flight": r"\b[A-Z]{2}\d{3,4}\b", "date": r"\b\d{4}-\d{2}-\d{2}\b", "phone": r"\+\d \(\d{3}\) \d{3}-\d{4}", "number": r"\b\d{12,19}\b"}


def entity_keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The long table (doc, kind, key) of the distinct keys in texts."""
    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))

    found = F.flatten(F.array(*(of(kind, pattern) for kind, pattern in ENTITY_KEYS.items())))
    return docs.select(doc_id, F.explode(found).alias("e")).select(doc_id, "e.kind", "e.key")


def related(keys: DataFrame, doc_id: str, most: int = 5) -> DataFrame:
    """Pairs of documents by shared keys; the older one is the archive. The ``most`` best for each.

    Documents meet on equal keys, which are rare by kind; each pair comes once with its evidence.
    """
    a, b = keys.alias("a"), keys.alias("b")
    met = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.key") == F.col("b.key")) & (F.col(f"a.{doc_id}") > F.col(f"b.{doc_id}")))
    pairs = met.groupBy(F.col(f"a.{doc_id}").alias("current"), F.col(f"b.{doc_id}").alias("archive")).agg(F.count("*").alias("shared"), F.array_join(F.array_sort(F.collect_set("a.kind")), ",").alias("kinds"))
    order = Window.partitionBy("current").orderBy(F.desc("shared"), "archive")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def evidence_budget(facts: DataFrame, group: str, event: str, rank: str, number: str, text: str, events: int = 3, most: int = 12, chars: int = 12000) -> DataFrame:
    """The facts that fit a group's budget, in rank order of events.

    An event keeps its leading facts that fit; one with none is skipped and the next may still
    fit. What fits depends on what came before, so a group's facts pass in order and only the
    state of the budget is held. No event gives more than its first ``most`` facts, which are
    picked before the shuffle by group.
    """
    kept = facts.select(F.col(group).alias("grp"), F.col(event).alias("event"), F.col(rank).alias("rank"), F.col(number).alias("number"), F.length(text).alias("size"))
    leading = Window.partitionBy("grp", "rank", "event").orderBy("number")
    kept = kept.withColumn("place", F.row_number().over(leading)).where(F.col("place") <= most).drop("place")
    dealt = kept.repartition("grp").sortWithinPartitions("grp", "rank", "event", "number")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = now = None
        left, room, taken, open_, fits = chars, most, 0, False, False
        for b in batches:
            out = []
            for row in b.itertuples():
                if own is None or own[0] != row.grp:
                    own, now, left, room, taken = (row.grp,), None, chars, most, 0
                if now != (row.rank, row.event):
                    now, open_, fits = (row.rank, row.event), taken < events and room > 0, False
                if not open_:
                    continue
                if row.size > left or not room:
                    open_ = False
                    continue
                left, room = left - row.size, room - 1
                taken += not fits
                fits = True
                out.append((row.grp, row.event, row.number))
            yield pd.DataFrame(out, columns=["grp", "event", "number"])

    kinds = dict(kept.dtypes)
    return dealt.mapInPandas(fold, f"grp {kinds['grp']}, event {kinds['event']}, number {kinds['number']}")


def priced_jobs(calls: DataFrame, prices: DataFrame, job: str, label: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """Cost of each job, null-safe, and whether all its calls had a price. ``prices`` is small."""
    met = calls.join(F.broadcast(prices), label, "left")  # a price list kept by hand
    cost = (F.col(tokens_in) * F.col("price_in") + F.col(tokens_out) * F.col("price_out")) / 1e6
    return met.groupBy(job).agg(F.round(F.sum(cost), 8).alias("cost"), F.bool_and(F.col("price_in").isNotNull()).alias("all_priced"), F.count("*").alias("calls"))


def cached_worklist(rows: DataFrame, cache: DataFrame, key: str, as_of: Column, hit_days: int = 21, miss_hours: int = 24, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """Rows with a cached text that is still good, and the first keys to fetch.

    ``cache``: key, text (null: a miss), stamp. Hits are good for days, misses for hours.
    """
    age = F.timestamp_diff("HOUR", F.col("stamp"), as_of)
    good = cache.where(F.when(F.col("text").isNotNull(), age <= hit_days * 24).otherwise(age <= miss_hours)).withColumn("_good", F.lit(True))
    met = rows.join(good, key, "left")
    missing = met.where(F.col("_good").isNull()).select(key).distinct().orderBy(key).limit(most)
    return met.where("text is not null").drop("_good"), missing


def retry_list(rows: DataFrame, state: DataFrame, key: str, as_of: Column, attempts: int = 3, hours: int = 6, most: int = 6) -> DataFrame:
    """Keys to look up now: never tried, or failed fewer than ``attempts`` times and long enough ago."""
    met = rows.select(key).distinct().join(state, key, "left")
    open_ = F.col("attempts").isNull() | (~F.col("matched") & (F.col("attempts") < attempts) & (F.timestamp_diff("HOUR", F.col("tried"), as_of) >= hours))
    return met.where(open_).orderBy(F.coalesce("attempts", F.lit(0)), key).limit(most).select(key)


def released(queue: DataFrame, not_before: str, conflict: str, as_of: Column, order: str, most: int = 3) -> DataFrame:
    """Queued rows whose time has come, without conflicts, the first few; the rest stay queued."""
    return queue.where((F.col(not_before) <= as_of) & ~F.col(conflict)).orderBy(not_before, order).limit(most)


def nulled_references(rows: DataFrame, published: DataFrame, reference: str, key: str) -> DataFrame:
    """References to ids that are not published become null; the row stays."""
    known = published.select(F.col(key).alias("_known")).distinct()
    return rows.join(known, F.col(reference) == F.col("_known"), "left").withColumn(reference, F.col("_known")).drop("_known")


def keep_first(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """A union in which the first stamp of a key wins."""
    return old.select(key, stamp).unionByName(new.select(key, stamp)).groupBy(key).agg(F.min(stamp).alias(stamp))


def expanded_aliases(records: DataFrame, groups: DataFrame, record_id: str, text: str) -> DataFrame:
    """All aliases of each alias group of which a record's text holds one. ``groups`` (grp, alias) is small."""
    low = records.select(F.col(record_id).alias("id"), F.lower(F.col(text)).alias("text"))
    said = phrases_in(low, groups, "text", "id", "alias").select(F.col("id").alias(record_id), F.col("phrase").alias("alias"))
    hit = said.join(groups, "alias").select(record_id, "grp").distinct()
    return hit.join(groups, "grp").groupBy(record_id).agg(F.array_join(F.array_sort(F.collect_set("alias")), " ").alias("aliases"))
