"""Feeds, suggestions, cards, run logs, prices, routes and schedules around the published rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroflow.operators.overlap import SPAN, best_overlaps


def clamped(value: Column, low: float, high: float) -> Column:
    """A number within bounds; null for what is no number."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value.try_cast("double")))


def sanitised_runs(rows: DataFrame, outcomes: Sequence[str], most: int = 50) -> DataFrame:
    """Run logs as they may be shown: known outcomes, bounded numbers, the first ``most`` attempts.

    ``rows``: run, outcome, seconds, attempts array<struct<label, status>>; gives run, outcome,
    seconds, n_attempts and n_failed.
    """
    outcome = F.when(F.col("outcome").isin(*outcomes), F.col("outcome")).otherwise("unknown")
    kept = F.slice("attempts", 1, most)
    failed = F.size(F.filter(kept, lambda x: x["status"] != "ok"))
    return rows.select("run", outcome.alias("outcome"), clamped(F.col("seconds"), 0, 86400).alias("seconds"), F.size(kept).alias("n_attempts"), failed.alias("n_failed"))


def sanitised_assists(rows: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Assist telemetry by a whitelist: known kinds, a latency of up to 120 s and a clipped hash."""
    return rows.where(F.col("kind").isin(*kinds)).select("event", "kind", F.round(clamped(F.col("latency"), 0, 120), 3).alias("latency"), F.substring("question_hash", 1, 16).alias("question_hash"))


def weekly_serious(rows: DataFrame, day: str, severity: str, as_of: Column, days: int = 7) -> DataFrame:
    """Accidents and serious incidents of the last days."""
    age = F.date_diff(as_of, F.col(day))
    return rows.where(F.col(severity).isin("acc", "ser") & age.between(0, days))


def first_notable(rows: DataFrame, notable: Column, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first notable row of each key."""
    return rows.where(notable).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def token_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost by label and in total, with cached tokens at their own price.

    ``calls``: label, tokens_in, cached, tokens_out; ``prices``: label, price_in, price_cached,
    price_out, a small dimension. Rows whose cached tokens exceed all input are impossible and go.
    """
    possible = calls.where((F.col("cached") >= 0) & (F.col("cached") <= F.col("tokens_in")) & (F.col("tokens_out") >= 0))
    met = possible.join(prices, "label")
    cost = ((F.col("tokens_in") - F.col("cached")) * F.col("price_in") + F.col("cached") * F.col("price_cached") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return met.rollup("label").agg(F.count("*").alias("calls"), F.sum("cached").alias("cached"), F.round(F.sum(cost), 6).alias("cost"))


def display_callsign(callsign: Column, icao: Column, iata: Column) -> Column:
    """An ICAO call sign with the airline's IATA code, only where code and number agree."""
    number = F.regexp_extract(callsign, "^[A-Z]{3}([0-9]{1,4}[A-Z]?)$", 1)
    return F.when((F.substring(callsign, 1, 3) == icao) & (number != "") & iata.isNotNull(), F.concat(iata, number)).otherwise(callsign)


def cached_routes(rows: DataFrame, cache: DataFrame, key: str, as_of: Column, hit_hours: int = 24, miss_hours: int = 6, newest: int = 400) -> DataFrame:
    """Rows with their route if one is cached and good; ``look_up`` tells the misses.

    ``cache``: key, route (null: known to have none), stamp; only its ``newest`` rows count.
    """
    kept = cache.orderBy(F.desc("stamp"), key).limit(newest)
    age = F.timestamp_diff("HOUR", F.col("stamp"), as_of)
    good = kept.where(age < F.when(F.col("route").isNotNull(), hit_hours).otherwise(miss_hours)).select(key, "route", F.lit(True).alias("_known"))
    return rows.join(good, key, "left").withColumn("look_up", F.col("_known").isNull()).drop("_known")


def entity_profiles(stories: DataFrame, names: DataFrame, story: str, text: str) -> DataFrame:
    """Codes that each story names, by the most telling rule that hits.

    ``names``: name, rule, code, a dictionary kept by hand (1 full name, 2 model, 3 code, 4 family).
    """
    words = stories.select(story, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0)))).alias("name"))
    met = words.join(names, "name")
    best = met.withColumn("_best", F.min("rule").over(Window.partitionBy(story))).where("rule = _best")
    return best.groupBy(story).agg(F.min("rule").alias("rule"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def first_mentions(rows: DataFrame, record: str, text: str, pattern: str) -> DataFrame:
    """Each code that a text holds, once, at its first place."""
    spread = rows.select(record, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("place", "code"))
    return spread.groupBy(record, "code").agg(F.min("place").alias("place"))


def headline_feed(rows: DataFrame, as_of: Column, back_hours: int = 48, ahead_hours: int = 2, most: int = 31) -> DataFrame:
    """The newest headlines of sources that answered, a URL once; the first is the lead.

    ``rows``: id, ok, stamp, url. Places are numbered from 0 (the lead).
    """
    good = rows.where(F.col("ok") & F.col("stamp").between(as_of - F.expr(f"interval {back_hours} hours"), as_of + F.expr(f"interval {ahead_hours} hours")))
    once = good.groupBy("url").agg(F.max(F.struct("stamp", "id")).alias("r")).select("url", "r.stamp", "r.id")
    order = [F.desc("stamp"), F.desc("id")]
    return once.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)  # ``most`` rows


def suggestions(rows: DataFrame, generic: Sequence[str], group: str, text: str, order: str, size: int = 6) -> DataFrame:
    """``size`` different suggestions for each group: its own in order, filled up with generic ones."""
    own = rows.groupBy(group, F.col(text).alias("text")).agg(F.min(order).alias("_order")).select(group, "text", F.lit(0).alias("_tier"), "_order")
    fill = rows.select(group).distinct().select(group, F.posexplode(F.array(*map(F.lit, generic))).alias("_order", "text")).select(group, "text", F.lit(1).alias("_tier"), "_order")
    once = own.unionByName(fill).groupBy(group, "text").agg(F.min(F.struct("_tier", "_order")).alias("_at"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_at", "text"))
    return once.withColumn("place", place).where(F.col("place") <= size).select(group, "place", "text")


def citation_cards(groups: Sequence[DataFrame], key: str, url: str, most: int = 5) -> DataFrame:
    """Cards of several result groups in order, a URL once, the first ``most`` of each key.

    Each group: key, url, place.
    """
    union = groups[0].select(key, url, F.lit(0).alias("_tier"), "place")
    for i, g in enumerate(groups[1:], 1):
        union = union.unionByName(g.select(key, url, F.lit(i).alias("_tier"), "place"))
    once = union.groupBy(key, url).agg(F.min(F.struct("_tier", "place")).alias("_at"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_at", url))
    return once.withColumn("card", place).where(F.col("card") <= most).select(key, "card", url)


def scheduled_day(run: Column, slot_hour: int, zone_hours: int = 8) -> Column:
    """The local day that a run belongs to: before the day's slot it is the day before."""
    local = F.timestamp_add("HOUR", F.lit(zone_hours), run)
    return F.date_sub(local.cast("date"), F.when(F.hour(local) < slot_hour, 1).otherwise(0))


def live_events(rows: DataFrame, stamp: str, kind: str, as_of: Column, long_kinds: Sequence[str], long_days: int = 30, short_hours: int = 72) -> DataFrame:
    """Known events whose time has not run out: long for some kinds, short for the others."""
    kept = F.when(F.col(kind).isin(*long_kinds), F.expr(f"interval {long_days * 24} hours")).otherwise(F.expr(f"interval {short_hours} hours"))
    return rows.where(F.col(stamp) >= as_of - kept)


def guarded_status(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The status of each key after new runs: a failure never replaces a success.

    Both: key, status (success, partial, failed), stamp. Of equal standing the newest counts.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    standing = F.when(F.col("status") == "failed", 0).otherwise(1)
    return both.groupBy(key).agg(F.max_by("status", F.struct(standing, "_new", "stamp")).alias("status"))


def due_days(slots: DataFrame, done: DataFrame, day: str, version: Column) -> DataFrame:
    """Days without a row of the current version."""
    return slots.join(done.where(version).select(day).distinct(), day, "left_anti")


def routed_candidates(rows: DataFrame, threshold: int = 60) -> Column:
    """history below the threshold, rejected where a second source disagrees, else queued."""
    return F.when((F.col("score") < threshold) & ~F.col("watched"), "history").when(F.col("second") == "conflict", "rejected").otherwise("queued")


def listing_items(pages: DataFrame, rules: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """Item rows of listing pages by their site's pattern; pages without an item give one row with none.

    ``rules``: suffix, pattern (group 1 the link, group 2 the title), a dimension kept by hand; the
    longest suffix of a page's host counts. Items are numbered from 1 in page order.
    """
    host = F.lower(F.regexp_extract(F.col(url), "^https?://([^/?#]+)", 1))
    hosts = pages.select(host.alias("_host")).distinct()
    fits = (F.col("_host") == F.col("suffix")) | F.endswith("_host", F.concat(F.lit("."), "suffix"))
    chosen = hosts.join(rules, fits).groupBy("_host").agg(F.max_by("pattern", F.length("suffix")).alias("pattern"))
    met = pages.select(page, F.col(html).alias("_html"), host.alias("_host")).join(chosen, "_host")
    both = F.arrays_zip(F.regexp_extract_all("_html", F.col("pattern"), F.lit(1)).alias("link"), F.regexp_extract_all("_html", F.col("pattern"), F.lit(2)).alias("title"))
    spread = met.select(page, F.posexplode_outer(both).alias("n", "item"))
    return spread.select(page, (F.col("n") + 1).alias("n"), F.col("item.link").alias("link"), F.trim("item.title").alias("title"))


def annotated(rows: DataFrame, names: DataFrame, record: str, text: str) -> DataFrame:
    """Texts with the code after the first mention of the first name that they hold.

    ``names``: name, code, a dimension kept by hand. Of names at one place the longest counts; a
    text that already tells the code there, or holds no name, stays as it is.
    """
    at = F.instr(F.lower(F.col(text)), F.lower("name"))
    hit = rows.select(record, text).join(names, at > 0).select(record, at.alias("at"), F.length("name").alias("size"), "code")
    best = hit.groupBy(record).agg(F.min(F.struct("at", (-F.col("size")).alias("less"), "code")).alias("m"))
    met = rows.join(best, record, "left")
    end = F.col("m.at") - F.col("m.less")
    told = F.startswith(F.substring(F.col(text), end, F.length(text)), F.concat(F.lit(" ("), "m.code", F.lit(")")))
    added = F.concat(F.substring(F.col(text), F.lit(1), end - 1), F.lit(" ("), "m.code", F.lit(")"), F.substring(F.col(text), end, F.length(text)))
    return met.withColumn(text, F.when(F.col("m").isNull() | told, F.col(text)).otherwise(added)).drop("m")


def stale_media(records: DataFrame, media: DataFrame, record: str, key: str) -> DataFrame:
    """Each record's medium, kept only while it was chosen for the record's key of today."""
    old = media.select(record, F.col(key).alias("_key"), "photo")
    met = records.join(old, record)
    return met.select(record, F.when(F.col("_key").eqNullSafe(F.col(key)), F.col("photo")).alias("photo"), (~F.col("_key").eqNullSafe(F.col(key))).alias("stale"))


def archive_ranking(keys: DataFrame, row: str, key: str, kind: str, tiers: Sequence[str], most: int = 5) -> DataFrame:
    """(current, archive, tier, shared, place): the earlier rows that share keys with each one: by tier, then shared keys, then the newest.

    ``keys``: ``row`` (later ones are larger), ``key`` and ``kind``; a key is shared if its kind is the same. A pair's tier is that
    of its most telling kind, in the order of ``tiers``; others come last. Pairs are counted in blocks and never travel.
    """
    tier = F.coalesce(*(F.when(F.col(kind) == k, i) for i, k in enumerate(tiers, 1)), F.lit(len(tiers) + 1))
    held = keys.where(F.col(row).isNotNull() & F.col(key).isNotNull() & F.col(kind).isNotNull())
    token = F.struct(F.concat(F.col(key).cast("string"), F.lit("\n"), F.col(kind)).alias("token"), tier.alias("tier"))
    sets = held.groupBy(F.col(row).alias("id")).agg(F.collect_set(token).alias("tokens"))
    docs = sets.select("id", F.lit(None).cast("string").alias("source"), F.col("tokens.token").alias("tokens"), F.col("tokens.tier").alias("weights"))
    asked = docs.select(F.col("id").alias("query_id"), "source", "tokens", F.lit(1).alias("least"))
    found = best_overlaps(asked, docs, most, newest=True, tiers=len(tiers) + 1, earlier=True)
    behind = F.floor(F.col("score") / SPAN).cast("int")
    return found.select(F.col("query_id").alias("current"), F.col("id").alias("archive"), (F.lit(len(tiers) + 1) - behind).alias("tier"), F.pmod(F.col("score"), F.lit(SPAN)).alias("shared"), "place")


def queue_groups(queue: DataFrame, background: DataFrame) -> DataFrame:
    """Queued events as story groups: the event, a second item where two sources agree, and dated background.

    ``queue``: event, place, stamp, agreed; ``background``: place, since, through, note. Gives event,
    n_items and notes in order.
    """
    known = background.select("place", "since", "through", "note")
    valid = (F.col("since").isNull() | (F.col("since") <= F.col("stamp"))) & (F.col("through").isNull() | (F.col("stamp") <= F.col("through")))
    notes = queue.join(known, "place").where(valid).groupBy("event").agg(F.array_sort(F.collect_set("note")).alias("notes"))
    return queue.join(notes, "event", "left").select("event", (F.when(F.col("agreed"), 2).otherwise(1) + F.coalesce(F.size("notes"), F.lit(0))).alias("n_items"), F.array_join("notes", ",").alias("notes"))
