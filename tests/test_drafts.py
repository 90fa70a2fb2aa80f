"""Drafts through the gates, one mutation of a good draft at a time."""

import copy
import datetime

import pytest
from pyspark.sql import functions as F

from aeroflow.operators import drafts as D

WORDS = " ".join(["word"] * 70)
ZH = "機場跑道維修完成並恢復起降" * 11  # 143 letters
SOURCE = "The airport reopened its runway on Monday after repairs. Officials said all flights resumed by noon."


def fact(n, quote="reopened its runway on Monday", scope="source", **more):
    return {"fact_id": f"F{n}", "claim": "c", "quote": quote, "url": "https://x.org/a?utm_source=q", "scope": scope, "archive_id": None, "archive": None} | more


GOOD = {
    "draft_id": "d", "group_id": "g", "status": "publish", "cat": "ops", "zh": {"title": "標題", "summary": "摘要", "body": [ZH] * 4}, "en": {"title": "Runway open", "summary": "It opened.", "body": [WORDS] * 4},
    "flash": {"zh": "快", "en": "fast", "hot": False}, "facts": [fact(1), fact(2, "all flights resumed by noon")], "headline_refs": ["F1"], "summary_refs": ["F1", "F2"], "flags": [], "decision": "", "human_review": False,
    "event_status": "confirmed", "incident": None, "tries": 1,
}
BRIEF = {"status": "publish_brief", "zh": {"title": "標題", "summary": "摘要", "body": [ZH[:100]] * 2}, "en": {"title": "T", "summary": "s", "body": [" ".join(["word"] * 50)] * 2}}
INCIDENT = {"sev": "ser", "status": "open", "date": "2024-01-05", "aircraft": "A320", "operator": "X"}
ARCHIVE = fact(3, "Officials said all flights", "archive", archive=True, archive_id="e1")
ROUNDUP = {"group_id": "r", "zh": {"title": "事件彙整", "summary": "各自獨立", "body": [ZH] * 4}, "en": {"title": "Safety roundup", "summary": "independent events", "body": [WORDS] * 4}}


def en(**more):
    return {"en": GOOD["en"] | more}


CASES = [
    ({}, None, None, "publish"), (BRIEF, None, None, "publish"), ({"incident": INCIDENT}, None, None, "publish"), ({"facts": [*GOOD["facts"], ARCHIVE]}, None, None, "publish"),
    ({"status": "manual_review", "flags": ["risk"], "decision": "why", "human_review": True}, None, None, "publish"),
    ({"status": "reject", "zh": None, "facts": None}, None, None, "reject"), ({"status": "odd"}, "validation", "status", "retry"), ({"status": None, "tries": 3}, "validation", "status", "reject"),
    ({"cat": "x"}, "validation", "category", "retry"), ({"zh": None}, "validation", "zh block", "retry"), (en(title=" "), "validation", "en title", "retry"), (en(summary=None), "validation", "en summary", "retry"),
    (en(body=[]), "validation", "en body", "retry"), (en(body=[WORDS, " "]), "validation", "en body", "retry"), (en(body=[WORDS] * 8), "validation", "en paragraphs", "retry"), (en(summary="This draft was merged from notes"), "validation", "en process", "retry"),
    (en(body=[WORDS] * 3), "validation", "full contract", "retry"), (BRIEF | {"status": "publish"}, "validation", "full contract", "retry"), ({"status": "publish_brief"}, "validation", "brief contract", "retry"),
    (BRIEF | {"status": "manual_review", "en": {"title": "t", "summary": "s", "body": ["a", "b"]}}, "validation", "either contract", "retry"), ({"flash": {"zh": None, "en": "x", "hot": True}}, "validation", "flash", "retry"), ({"flash": GOOD["flash"] | {"hot": None}}, "validation", "flash hot", "retry"),
    ({"facts": []}, "validation", "facts", "retry"), ({"facts": [fact(1, None)]}, "validation", "fact", "retry"), ({"facts": [fact(1, scope="web")]}, "validation", "fact scope", "retry"), ({"facts": [*GOOD["facts"], ARCHIVE | {"archive_id": ""}]}, "validation", "archive fact", "retry"),
    ({"headline_refs": ["F9"]}, "validation", "headline refs", "retry"), ({"summary_refs": None}, "validation", "summary refs", "retry"), ({"flags": ["odd"]}, "validation", "flags", "retry"), ({"decision": "because"}, "validation", "decision", "retry"),
    ({"status": "manual_review", "decision": "why", "human_review": True}, "validation", "review", "retry"), ({"event_status": None}, "validation", "event status", "retry"), ({"incident": INCIDENT | {"sev": "x"}}, "validation", "incident severity", "retry"),
    ({"incident": INCIDENT | {"status": "x"}}, "validation", "incident status", "retry"), ({"incident": INCIDENT | {"date": "2024-1-5"}}, "validation", "incident date", "retry"), ({"incident": INCIDENT | {"operator": None}}, "validation", "incident fields", "retry"),
    ({"facts": [fact(1, "never said anywhere"), fact(2, "nor was this one")]}, "facts", "no verified quote", "retry"), ({"group_id": "other"}, "facts", "no verified quote", "retry"),
    ({"facts": [fact(1), fact(3, "all flights resumed by noon")], "summary_refs": ["F1"]}, "binding", "numbering", "retry"), ({"facts": [fact(1), fact(2, "never said anywhere")], "summary_refs": ["F1"]}, "binding", "two current facts", "retry"),
    (BRIEF | {"facts": [ARCHIVE | {"fact_id": "F1"}], "summary_refs": ["F1"]}, "binding", "current fact", "retry"), (BRIEF | {"facts": [fact(1), fact(2, "never said anywhere")]}, "binding", "summary_refs unverified", "retry"),
    ({"facts": [*GOOD["facts"], ARCHIVE], "headline_refs": ["F3"]}, "binding", "headline_refs not current", "retry"),
    (ROUNDUP, None, None, "publish"), ({"group_id": "r"}, "roundup", "zh label", "retry"), (ROUNDUP | {"en": ROUNDUP["en"] | {"title": "Runway"}}, "roundup", "en label", "retry"), (ROUNDUP | {"en": ROUNDUP["en"] | {"summary": "s"}}, "roundup", "independent", "retry"),
    (ROUNDUP | {"group_id": "r4"}, "roundup", "paragraphs", "retry"), (ROUNDUP | {"group_id": "r2"}, "roundup", "event without fact", "retry"),
    (en(summary="The Jumbo jet landed"), "glossary", "no jumbo", "retry"), (en(summary="It flew for Acme"), "glossary", "say Acme Air", "retry"), (en(summary="It flew for Acme, that is ACME AIR"), None, None, "publish"),
    (en(summary="In this article we look"), "phrases", "narration", "retry"), (en(summary="According to documents seen"), "phrases", "sourcing", "retry"), (en(summary="According to documents seen") | {"group_id": "full"}, None, None, "publish"),
]


@pytest.fixture(scope="module")
def routed(spark):
    rows = []
    for i, (change, *_) in enumerate(CASES):
        rows.append(copy.deepcopy(GOOD) | change | {"draft_id": f"d{i}"})
    drafts = spark.createDataFrame(rows, D.DRAFT)
    evidence = spark.createDataFrame([(g, SOURCE) for g in ("g", "r", "r2", "r4", "full")] + [("other", "another text"), ("g", None)], "group_id string, text string")
    groups = spark.createDataFrame(
        [("g", "event", [], False), ("other", "event", [], False), ("full", "event", [], True), ("r", "roundup", ["https://x.org/a", ""], False), ("r2", "roundup", ["https://x.org/a", "https://x.org/b"], False), ("r4", "roundup", ["https://x.org/a"] * 4, False)],
        "group_id string, kind string, urls array<string>, full_text boolean",
    )
    glossary = spark.createDataFrame([("no jumbo", "jumbo jet", None), ("say Acme Air", "acme", "Acme Air")], "rule string, term string, required string")
    out = D.gated(drafts, evidence, groups, glossary, ["in this article"], ["according to documents"], ["ops"], ["risk"], "(?i)this draft was")
    return out.persist()


def test_gates_in_order(routed):
    got = {r.draft_id: (r.gate, r.problem, r.route) for r in routed.collect()}
    want = {f"d{i}": tuple(case[1:]) for i, case in enumerate(CASES)}
    assert {k: (got[k], want[k], CASES[int(k[1:])][0]) for k in want if got[k] != want[k]} == {}


def test_published_drafts_become_articles(spark, routed):
    now = F.lit(datetime.datetime(2024, 1, 5, 9)).cast("timestamp")
    old = spark.createDataFrame([("d0", datetime.datetime(2024, 1, 1), 2)], "id string, stamp timestamp, revision int")
    found = {r.id: r for r in D.articles(routed, old, now).collect()}
    assert set(found) == {f"d{i}" for i, c in enumerate(CASES) if c[3] == "publish"}
    first = found["d0"]
    assert (first.stamp.day, first.updated.day, first.revision, first.sources, first.format, len(first.facts)) == (1, 5, 3, ["https://x.org/a"], "full", 2)
    assert (found["d1"].stamp.day, found["d1"].updated, found["d1"].revision, found["d1"].format) == (5, None, 1, "brief")
    assert {r.article_id for r in D.flashes(routed, now).collect()} == set(found)
    assert [(r.article_id, r.sev, r.date) for r in D.incidents(routed).collect()] == [("d2", "ser", "2024-01-05")]


def test_no_drafts(spark):
    empty = spark.createDataFrame([], D.DRAFT)
    none = lambda schema: spark.createDataFrame([], schema)
    assert D.gated(empty, none("group_id string, text string"), none("group_id string, kind string, urls array<string>, full_text boolean"), none("rule string, term string, required string"), ["a"], ["b"], ["c"], ["d"], "e").count() == 0
