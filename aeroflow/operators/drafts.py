"""Drafts through all gates to published articles: one table, a gate's name for each rejected row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from aeroflow.functions import text as T
from aeroflow.operators.articles import first_failure
from aeroflow.operators.dictionary import grouped_phrases, phrases_in
from aeroflow.storage import materialise

_SIDE = "struct<title:string,summary:string,body:array<string>>"
FACT = "struct<fact_id:string,claim:string,quote:string,url:string,scope:string,archive_id:string,archive:boolean>"
DRAFT = (
    f"draft_id string, group_id string, status string, cat string, zh {_SIDE}, en {_SIDE}, flash struct<zh:string,en:string,hot:boolean>, facts array<{FACT}>, headline_refs array<string>, summary_refs array<string>, "
    "flags array<string>, decision string, human_review boolean, event_status string, incident struct<sev:string,status:string,date:string,aircraft:string,operator:string>, tries int"
)

#: What a draft may say of itself, and lengths of the two formats.
STATUSES = ["publish", "publish_brief", "manual_review", "reject"]
EVENT_STATUSES = ["confirmed", "preliminary", "planned", "under_investigation", "unknown"]
SEVERITIES, INCIDENT_STATUSES = ["acc", "ser", "inc"], ["open", "closed", "prelim"]
MOST_PARAGRAPHS, FULL_PARAGRAPHS, BRIEF_PARAGRAPHS = 7, 4, 2
FULL_ZH, FULL_EN, BRIEF_ZH, BRIEF_EN = 500, 250, (180, 320), (90, 150)


def _said(c: Column) -> Column:
    """Whether a text is there and not blank."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def zh_characters(body: Column) -> Column:
    """Letters and digits of any script."""
    return F.length(F.regexp_replace(F.array_join(body, ""), r"[^\p{L}\p{N}]", ""))


def en_words(body: Column) -> Column:
    """Words of ASCII letters and digits, with apostrophes and hyphens inside."""
    return F.regexp_count(F.array_join(body, " "), F.lit("[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*"))


def article_format(zh: Column, en: Column) -> Column:
    """full or brief if both languages' bodies keep one contract, else null."""
    paragraphs = lambda least: F.size(zh["body"]).between(least, MOST_PARAGRAPHS) & F.size(en["body"]).between(least, MOST_PARAGRAPHS)
    z, e = zh_characters(zh["body"]), en_words(en["body"])
    full = paragraphs(FULL_PARAGRAPHS) & (z >= FULL_ZH) & (e >= FULL_EN)
    return F.when(full, "full").when(paragraphs(BRIEF_PARAGRAPHS) & z.between(*BRIEF_ZH) & e.between(*BRIEF_EN), "brief")


def validation_problem(categories: Sequence[str], risk_flags: Sequence[str], process: str) -> Column:
    """The first rule of form that a row of the DRAFT schema breaks, null for none; a draft that rejects itself breaks none.

    ``process`` is a pattern of phrases about how the text was put together.
    """
    col, facts = F.col, F.col("facts")
    listed = lambda c, allowed: F.coalesce(c.isin(*allowed), F.lit(False))
    kind = article_format(col("zh"), col("en"))
    rules: list[tuple[str, Column]] = [("category", ~listed(col("cat"), categories))]
    for side in ("zh", "en"):
        body = col(side)["body"]
        rules += [
            (f"{side} block", col(side).isNull()),
            (f"{side} title", ~_said(col(side)["title"])),
            (f"{side} summary", col(side)["summary"].isNull()),
            (f"{side} body", body.isNull() | (F.size(body) < 1) | F.exists(body, lambda p: ~_said(p))),
            (f"{side} paragraphs", F.size(body) > MOST_PARAGRAPHS),
        ]
    for side in ("zh", "en"):
        prose = F.concat(F.array(F.coalesce(col(side)["summary"], F.lit(""))), col(side)["body"])
        rules.append((f"{side} process", F.exists(prose, lambda p: p.rlike(process))))
    ids = F.transform(facts, lambda f: F.coalesce(f["fact_id"], F.lit("")))
    archived = F.exists(facts, lambda f: F.coalesce(f["scope"] == "archive", F.lit(False)) & ~(F.coalesce(f["archive"], F.lit(False)) & _said(f["archive_id"]) & f["url"].isNotNull()))
    refs = lambda name: col(name).isNull() | F.exists(col(name), lambda r: r.isNull() | ~F.coalesce(F.array_contains(ids, r), F.lit(False)))
    flags = col("flags").isNull() | F.exists(col("flags"), lambda f: ~F.coalesce(f.isin(*risk_flags), F.lit(False)))
    incident = col("incident")
    rules += [
        ("full contract", (col("status") == "publish") & ~F.coalesce(kind == "full", F.lit(False))),
        ("brief contract", (col("status") == "publish_brief") & ~F.coalesce(kind == "brief", F.lit(False))),
        ("either contract", (col("status") == "manual_review") & kind.isNull()),
        ("flash", col("flash").isNull() | col("flash")["zh"].isNull() | col("flash")["en"].isNull()),
        ("flash hot", col("flash")["hot"].isNull()),
        ("facts", facts.isNull() | (F.size(facts) < 1)),
        ("fact", F.exists(facts, lambda f: f["claim"].isNull() | f["quote"].isNull())),
        ("fact scope", F.exists(facts, lambda f: ~F.coalesce(f["scope"].isin("source", "archive"), F.lit(True)))),
        ("archive fact", archived),
        ("headline refs", refs("headline_refs")),
        ("summary refs", refs("summary_refs")),
        ("flags", flags),
        ("decision", col("status").isin("publish", "publish_brief") & (F.coalesce(col("decision"), F.lit("")) != "")),
        ("review", (col("status") == "manual_review") & ((F.size("flags") < 1) | ~F.coalesce(col("human_review"), F.lit(False)) | ~_said(col("decision")))),
        ("event status", ~listed(col("event_status"), EVENT_STATUSES)),
        ("incident severity", incident.isNotNull() & ~listed(incident["sev"], SEVERITIES)),
        ("incident status", incident.isNotNull() & ~listed(incident["status"], INCIDENT_STATUSES)),
        ("incident date", incident.isNotNull() & ~F.coalesce(incident["date"].rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.lit(False))),
        ("incident fields", incident.isNotNull() & (incident["aircraft"].isNull() | incident["operator"].isNull())),
    ]
    of_form = first_failure([(name, F.coalesce(broken, F.lit(False))) for name, broken in rules])
    return F.when(~listed(col("status"), STATUSES), "status").when(col("status") != "reject", of_form)


def binding_problem(facts: Column) -> Column:
    """The first fault of the facts that verified (an array in order): numbering, too few of the current
    event, or a headline or summary without one."""
    ids = F.transform(facts, lambda f: f["fact_id"])
    expected = F.transform(F.sequence(F.lit(1), F.size(facts)), lambda i: F.concat(F.lit("F"), i.cast("string")))
    current = F.filter(facts, lambda f: f["scope"] == "source")
    current_ids = F.transform(current, lambda f: f["fact_id"])
    rules = [("numbering", F.coalesce(ids != expected, F.lit(True))), ("two current facts", (F.col("status") == "publish") & (F.size(current) < 2)), ("current fact", F.size(current) < 1)]
    for name in ("headline_refs", "summary_refs"):
        rules += [(f"{name} unverified", (F.size(name) < 1) | (F.size(F.array_except(name, ids)) > 0)), (f"{name} not current", ~F.arrays_overlap(F.col(name), current_ids))]
    return first_failure([(name, F.coalesce(broken, F.lit(False))) for name, broken in rules])


def roundup_problem(urls: Column, facts: Column) -> Column:
    """The first fault of a collection of separate events (``urls``: those of its items): its label, the word that
    they are independent, an introduction and a paragraph for each, a verified fact for each URL."""
    whole = lambda side: F.concat_ws(" ", F.col(side)["title"], F.col(side)["summary"], F.array_join(F.col(side)["body"], " "))
    told = F.transform(F.filter(facts, lambda f: f["scope"] == "source"), lambda f: T.canonical_url(f["url"]))
    asked = F.transform(F.filter(urls, lambda u: F.trim(u) != ""), lambda u: T.canonical_url(u))
    return first_failure(
        [
            ("zh label", ~F.col("zh")["title"].rlike("彙整|快訊")),
            ("en label", ~F.col("en")["title"].rlike(r"(?i)\b(roundup|briefing)\b")),
            ("independent", ~F.contains(whole("zh"), F.lit("獨立")) | ~whole("en").rlike(r"(?i)\bindependent\b")),
            ("paragraphs", F.least(F.size(F.col("zh")["body"]), F.size(F.col("en")["body"])) < F.size(urls) + 1),
            ("event without fact", F.size(F.array_except(asked, told)) > 0),
        ]
    )


def gated(drafts: DataFrame, evidence: DataFrame, groups: DataFrame, glossary: DataFrame, narration: Sequence[str], sourcing: Sequence[str], categories: Sequence[str], risk_flags: Sequence[str], process: str, most_tries: int = 3) -> DataFrame:
    """Every draft with its verified facts, the gate that stops it (null for none), the problem and the route.

    ``drafts``: DRAFT, draft_id unique; ``evidence``: group_id, text (source texts of a group);
    ``groups``: group_id, kind, urls, full_text; ``glossary``: rule, term, required (null: forbidden).
    The gates in order: validation, facts (a quote of 8 characters or more stands in a text of the group; others are
    taken out), binding, roundup (of kind ``roundup``), glossary, phrases. A draft that
    rejects itself is rejected; one that a gate stops is retried while ``tries`` are left.
    """
    checked = materialise(drafts.withColumn("form", validation_problem(categories, risk_flags, process)), "drafts-checked")
    fine = checked.where("form is null and status <> 'reject'")
    asked = fine.select("draft_id", "group_id", F.explode("facts").alias("fact")).where(F.length("fact.quote") >= 8)
    found = grouped_phrases(evidence, asked.select("group_id", F.col("fact.quote").alias("quote")), "group_id", "text", "quote")
    verified = asked.withColumn("quote", F.col("fact.quote")).join(found, ["group_id", "quote"], "left_semi")
    by_draft = verified.groupBy("draft_id").agg(F.collect_set("quote").alias("quotes"))
    joined = checked.join(by_draft, "draft_id", "left").join(groups.select("group_id", "kind", "urls", "full_text"), "group_id", "left")
    kept = F.filter("facts", lambda f: F.coalesce(F.array_contains(F.col("quotes"), f["quote"]), F.lit(False)))
    side = lambda s: F.concat_ws("\n", F.col(s)["title"], F.col(s)["summary"], F.array_join(F.col(s)["body"], "\n"))
    joined = materialise(joined.withColumns({"verified": kept, "prose": T.squash(F.concat_ws("\n", side("zh"), side("en")))}), "drafts-joined")

    lower = glossary.select("rule", F.lower("term").alias("term"), F.lower("required").alias("required"))
    terms = lower.select(F.col("term").alias("p")).union(lower.select("required")).where("p is not null")
    said = phrases_in(joined, terms, "prose", "draft_id", "p").select(F.col("id").alias("draft_id"), F.col("phrase").alias("term"))
    hit = said.join(lower, "term").join(said.select("draft_id", F.col("term").alias("required"), F.lit(True).alias("rendered")), ["draft_id", "required"], "left")
    broken = hit.where("required is null or rendered is null").groupBy("draft_id").agg(F.min("rule").alias("glossary"))

    any_of = lambda phrases: F.exists(F.array(*(F.lit(p.lower()) for p in phrases)), lambda p: F.contains(F.col("prose"), p))
    phrase = F.when(any_of(narration), "narration").when(~F.coalesce("full_text", F.lit(False)) & any_of(sourcing), "sourcing")
    roundup = F.when(F.col("kind") == "roundup", roundup_problem(F.col("urls"), F.col("verified")))
    steps = [
        ("validation", F.col("form")),
        ("facts", F.when(F.size("verified") < 1, "no verified quote")),
        ("binding", binding_problem(F.col("verified"))),
        ("roundup", roundup),
        ("glossary", F.col("glossary")),
        ("phrases", phrase),
    ]
    own = F.col("status") == "reject"
    judged = joined.join(broken, "draft_id", "left").withColumn("steps", F.array(*(F.struct(F.lit(name).alias("gate"), problem.cast("string").alias("problem")) for name, problem in steps)))
    stopped = F.get(F.filter("steps", lambda s: s["problem"].isNotNull()), F.lit(0))
    stopped = F.when(~F.coalesce(own, F.lit(False)), stopped)
    route = F.when(own, "reject").when(stopped.isNull(), "publish").when(F.col("tries") < most_tries, "retry").otherwise("reject")
    return judged.select(*drafts.columns, "verified", stopped["gate"].alias("gate"), stopped["problem"].alias("problem"), route.alias("route"))


def articles(routed: DataFrame, published: DataFrame, stamp: Column) -> DataFrame:
    """The published drafts as articles: a known id keeps its first time and counts its revision up.

    ``published``: id, stamp, revision. Facts are the verified ones; sources are their URLs.
    """
    old = published.select(F.col("id").alias("draft_id"), F.col("stamp").alias("_stamp"), F.col("revision").alias("_revision"))
    met = routed.where("route = 'publish'").join(old, "draft_id", "left")
    urls = F.array_distinct(F.transform(F.filter("verified", lambda f: _said(f["url"])), lambda f: T.canonical_url(f["url"])))
    shown = F.when(F.col("status") == "publish_brief", "brief").when(F.col("status") == "publish", "full").otherwise("review")
    return met.select(F.col("draft_id").alias("id"), "cat", "zh", "en", F.col("verified").alias("facts"), urls.alias("sources"), shown.alias("format"), "event_status", "flags", F.coalesce("_stamp", stamp).alias("stamp"), F.when(F.col("_stamp").isNotNull(), stamp).alias("updated"), (F.coalesce("_revision", F.lit(0)) + 1).alias("revision"))


def flashes(routed: DataFrame, stamp: Column) -> DataFrame:
    """A flash for each published draft that has one in both languages."""
    shown = routed.where("route = 'publish'").where(_said(F.col("flash")["zh"]) & _said(F.col("flash")["en"]))
    return shown.select(F.col("draft_id").alias("article_id"), stamp.alias("stamp"), "flash.hot", "flash.zh", "flash.en")


def incidents(routed: DataFrame) -> DataFrame:
    """An incident row for each published draft that reports one."""
    return routed.where("route = 'publish' and incident is not null").select(F.col("draft_id").alias("article_id"), "incident.*")
