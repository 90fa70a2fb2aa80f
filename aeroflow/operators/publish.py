"""From drafts and archives to published rows: views, reasons, facts, gates and routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroflow.functions import text as T
from aeroflow.operators.articles import first_failure

#: Least length of a quote or an unsplit text that can prove something.
MIN_QUOTE, MIN_FULLTEXT, MIN_TITLE = 8, 80, 20


def article_view(rows: DataFrame) -> DataFrame:
    """Articles as shown: id, both languages' titles, display, sort and modified times.

    ``rows``: id, archived, published, source_time, updated, placed, title_a, title_b, urls. Archived
    rows, ids of another shape, rows without a time, without a title in either language or without
    a safe source are left out. A missing title is taken from the other language. A time at which
    a row was placed by hand (``placed``) is its sort time, else the time of publication.
    """
    a, b = (F.nullif(F.trim(c), F.lit("")) for c in ("title_a", "title_b"))
    shown = rows.where(~F.coalesce("archived", F.lit(False)) & F.col("id").rlike("^[a-z0-9-]{3,80}$") & F.col("published").isNotNull() & F.coalesce(a, b).isNotNull() & F.exists("urls", T.is_safe_url))
    times = [F.coalesce("source_time", "published").alias("display"), F.coalesce("placed", "published").alias("sort"), F.greatest("published", "updated", "source_time").alias("modified")]
    return shown.select("id", F.coalesce(a, b).alias("title_a"), F.coalesce(b, a).alias("title_b"), *times)


def candidate_reason(id_ok: Column, live: Column, in_scope: Column, clean: Column, settled: Column, sourced: Column, dated: Column, quoted: Column) -> Column:
    """Why a row can't serve as archive, in this order; null for a candidate."""
    names = ["id", "status", "scope", "injection", "conflict", "source", "date", "quote"]
    return first_failure([(name, ~ok) for name, ok in zip(names, (id_ok, live, in_scope, clean, settled, sourced, dated, quoted))])


def qualified_facts(articles: DataFrame, article_id: str) -> DataFrame:
    """Facts with a claim, a quote of MIN_QUOTE normalised characters and a URL.

    ``articles``: the id, urls array<string>, facts array<struct<claim, quote, url>>. A fact without
    a URL inherits that of an article with a single source. Facts are numbered from 1 in order.
    """
    spread = articles.select(article_id, "urls", F.posexplode("facts").alias("place", "fact"))
    url = F.coalesce("fact.url", F.when(F.size("urls") == 1, F.get("urls", F.lit(0))))
    facts = spread.select(article_id, (F.col("place") + 1).alias("number"), F.col("fact.claim").alias("claim"), F.col("fact.quote").alias("quote"), url.alias("url"))
    return facts.where((F.trim("claim") != "") & (F.length(T.squash(F.col("quote"))) >= MIN_QUOTE) & T.is_safe_url(F.col("url")))


def has_evidence(items: DataFrame, group: str) -> DataFrame:
    """Per group, whether its items tell an event: two titled items of a roundup, a summary, a full
    text, or a long title with an event verb. ``items``: group, roundup, title, summary, fulltext, verb.
    """
    said = (F.trim("summary") != "") | (F.length("fulltext") >= MIN_FULLTEXT) | ((F.length("title") >= MIN_TITLE) & F.col("verb"))
    told = items.groupBy(group).agg(F.bool_or("roundup").alias("_r"), F.count_if(F.trim("title") != "").alias("_n"), F.bool_or(F.coalesce(said, F.lit(False))).alias("_said"))
    return told.select(group, ((F.col("_r") & (F.col("_n") >= 2)) | F.col("_said")).alias("evidence"))


def phrase_gate(text: Column, narration: Sequence[str], sourcing: Sequence[str], has_fulltext: Column) -> Column:
    """narration for phrases about the writing itself; sourcing for claims of unseen sources, where
    no full text was at hand; else null."""
    low = T.squash(text)
    any_of = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))
    return F.when(any_of(narration), "narration").when(~has_fulltext & any_of(sourcing), "sourcing")


def roundup_reason(labelled: Column, independent: Column, paragraphs: Column, urls: Column, fact_urls: Column) -> Column:
    """The first fault of a roundup: label, wording, paragraphs (one for each item) or facts (one for each URL)."""
    return first_failure([("label", ~labelled), ("wording", ~independent), ("paragraphs", paragraphs < F.size(urls)), ("facts", F.size(F.array_except(urls, fact_urls)) > 0)])


def event_times(rows: DataFrame, group: str) -> DataFrame:
    """Per group: the newest stated time, else the newest inferred one, and which it was.

    ``rows``: group, source_time, published, inferred.
    """
    stamp = F.coalesce("source_time", "published")
    found = rows.groupBy(group).agg(F.max(F.when(~F.col("inferred"), stamp)).alias("stated"), F.max(stamp).alias("any"))
    return found.select(group, F.coalesce("stated", "any").alias("stamp"), F.col("stated").isNotNull().alias("is_stated"))


def resolved_time(manual: Column, sources: Column, detected: Column, verified: Column, fallback: Column) -> tuple[Column, Column]:
    """A publication time and where it comes from: by hand, the newest of the sources' metadata, a
    detection that evidence verifies, or the fallback."""
    best = F.array_max(sources)
    seen = F.when(verified, detected)
    origin = F.when(manual.isNotNull(), "manual").when(best.isNotNull(), "source").when(seen.isNotNull(), "evidence").otherwise("fallback")
    return F.coalesce(manual, best, seen, fallback), origin


def routed(reason: Column, tries: Column, most: int = 3) -> Column:
    """publish without a reason; retry while tries are left; else reject."""
    return F.when(reason.isNull(), "publish").when(tries < most, "retry").otherwise("reject")


def merged_articles(drafts: DataFrame, published: DataFrame) -> DataFrame:
    """Drafts as articles: a known id keeps its first time and counts its revision up.

    ``drafts``: id, title, stamp, entities array; ``published``: id, stamp, revision. Entities keep
    their order without repeats.
    """
    old = published.select("id", F.col("stamp").alias("_stamp"), F.col("revision").alias("_revision"))
    met = drafts.join(old, "id", "left")
    return met.select("id", "title", F.coalesce("_stamp", "stamp").alias("stamp"), F.when(F.col("_stamp").isNotNull(), F.col("stamp")).alias("updated"), (F.coalesce("_revision", F.lit(0)) + 1).alias("revision"), F.array_distinct("entities").alias("entities"))


def swept_items(rows: DataFrame, existing: DataFrame, most_in: int = 40, each: int = 4) -> DataFrame:
    """Swept rows that may go into a briefing, the first ``each`` of a section.

    ``rows``: place, section, title, host_ok, cited; ``existing``: title. Only the first ``most_in``
    rows count. Titles of 8 to 160 characters, a good host and a citation are needed, and neither a
    title nor an existing one may contain the other; existing titles are a briefing's few.
    """
    first = rows.where(F.col("place") <= most_in)
    good = first.where(F.length("title").between(8, 160) & F.col("host_ok") & F.col("cited"))
    known = existing.select(F.lower("title").alias("_known")).distinct()
    new = good.join(known, F.contains(F.lower("title"), F.col("_known")) | F.contains(F.col("_known"), F.lower("title")), "left_anti")
    return new.withColumn("n", F.row_number().over(Window.partitionBy("section").orderBy("place"))).where(F.col("n") <= each)


def media_shape(text: Column) -> Column:
    """A medium told as a URL or as an object in one struct (url, kind); null unless http(s) and of a known kind."""
    as_object = F.from_json(text, "url string, kind string")
    url = F.when(F.startswith(F.ltrim(text), F.lit("{")), as_object["url"]).otherwise(F.trim(text))
    kind = F.coalesce(F.when(F.startswith(F.ltrim(text), F.lit("{")), as_object["kind"]), F.lit("photo"))
    return F.when(url.rlike("^https?://") & kind.isin("photo", "logo", "map"), F.struct(url.alias("url"), kind.alias("kind")))


def archive_fact(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """The first fact of a requested event whose quote contains, or is contained in, the asked one.

    ``requests``: request, event, quote; ``facts``: event, number, quote. Requests without one stay.
    """
    known = facts.select("event", F.col("number").alias("_number"), F.col("quote").alias("_quote"))
    hit = F.contains("_quote", F.col("quote")) | F.contains("quote", F.col("_quote"))
    met = requests.join(known, "event").where(hit).groupBy("request").agg(F.min("_number").alias("number"))
    return requests.select("request").join(met, "request", "left")


def registry_match(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """The registered event of each row: by id, else the smallest that shares a URL.

    ``rows``: row, event, urls; ``registry``: event, urls. A URL meets rows by its smallest event only.
    """
    by_id = rows.join(registry.select("event"), "event").select("row", F.lit(0).alias("rule"), "event")
    asked = rows.select("row", F.explode("urls").alias("url"))
    first = registry.select("event", F.explode("urls").alias("url")).groupBy("url").agg(F.min("event").alias("event"))
    by_url = asked.join(first, "url").select("row", F.lit(1).alias("rule"), "event")
    best = by_id.unionByName(by_url).groupBy("row").agg(F.min(F.struct("rule", "event")).alias("m"))
    return rows.select("row").join(best, "row", "left").select("row", F.col("m.event").alias("match"), F.col("m.rule").alias("rule"))
