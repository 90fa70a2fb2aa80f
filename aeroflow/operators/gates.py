"""Record gates: each gives a reason, a label or a budgeted part of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroflow.operators.dictionary import phrases_in
from aeroflow.operators.scan import before, deal

#: Fixed patterns of text that tries to steer a language model.
INJECTION = r"(?i)(ignore|disregard|forget) (all |any )?(the |your )?(previous|prior|above|earlier) (instructions|rules|prompts)|system prompt|jailbreak|developer mode"
#: Fixed patterns of secrets: keys in assignments, tokens of known shapes, local paths.
SECRETS = r"(?i)(token|secret|password|api[_-]?key)\s*=\s*\"?[0-9a-z]{16,}|BEGIN [A-Z ]*PRIVATE KEY|(^|\s)/(home|root|etc)/"
ENCODED = r"[A-Za-z0-9+/]{80,}={0,2}"


def freshness(stamp: Column, as_of: Column, title: Column, window_hours: int = 120, ahead_hours: int = 6) -> Column:
    """Why a row is dropped (untitled, old, future), or fresh; rows without a time stay."""
    oldest, newest = as_of - F.expr(f"interval {window_hours} hours"), as_of + F.expr(f"interval {ahead_hours} hours")
    return F.when(F.coalesce(F.trim(title), F.lit("")) == "", "untitled").when(stamp.isNull(), "fresh").when(stamp < oldest, "old").when(stamp > newest, "future").otherwise("fresh")


def has_material(title: Column, summary: Column, least: int = 25) -> Column:
    """A summary says something if ``least`` characters are left without one echo of the title."""
    at = F.when(F.length(title) > 0, F.position(title, summary)).otherwise(0)
    rest = F.concat(F.substring(summary, F.lit(1), at - 1), F.substring(summary, at + F.length(title), F.length(summary)))
    return F.length(F.trim(F.when(at > 0, rest).otherwise(summary))) >= least


def keyword_scope(text: Column, keywords: Sequence[str], scope: str, veto: str | None = None) -> Column:
    """Any keyword and the scope pattern; a veto pattern wins."""
    low = F.lower(text)
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(low, F.lit(word))
    hit = hit & low.rlike(scope)
    return F.coalesce(hit & ~low.rlike(veto) if veto else hit, F.lit(False))


def category(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first rule whose pattern occurs."""
    out = None
    for label, pattern in rules:
        out = F.when(F.lower(text).rlike(pattern), label) if out is None else out.when(F.lower(text).rlike(pattern), label)
    return out.otherwise(default)


def guardrail(text: Column, topic: str, least: int = 12) -> Column:
    """First of: encoded payload, injection, on topic, too short, off topic."""
    return F.when(text.rlike(ENCODED), "encoded").when(text.rlike(INJECTION), "injection").when(F.lower(text).rlike(topic), "on_topic").when(F.length(text) < least, "too_short").otherwise("off_topic")


def quarantine(text: Column) -> Column:
    """injection, secret or pass."""
    return F.when(text.rlike(INJECTION), "injection").when(text.rlike(SECRETS), "secret").otherwise("pass")


def history_budget(turns: DataFrame, conversation: str, turn: str, role: str, text: str, last: int = 6, chars: int = 700, budget: int = 3000) -> DataFrame:
    """The last user and assistant turns, each clipped, while their total stays in the budget."""
    said = turns.where(F.col(role).isin("user", "assistant")).withColumn("part", F.substring(F.coalesce(F.col(text), F.lit("")), 1, chars))
    latest = Window.partitionBy(conversation).orderBy(F.desc(turn), F.desc("part"))
    ranked = said.withColumn("place", F.row_number().over(latest)).where(F.col("place") <= last)
    total = F.sum(F.length("part")).over(latest.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("total", total).where(F.col("total") <= budget)


def context_budget(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], text: str, each: int, budget: int, row_id: str) -> DataFrame:
    """Rows in order, each clipped, until the budget is used; the last is cut to what is left.

    ``row_id`` is unique. Lengths are totalled over parts of each group; only rows inside the
    budget meet their texts, and at most ``budget`` + 1 rows with a text are left in a group.
    """
    size = F.length(F.substring(F.coalesce(F.col(text), F.lit("")), 1, each)).cast("long")
    given = rows.withColumn("_size", size)
    groups = {f"_k{i}": _group(F.col(k)) for i, k in enumerate(keys)}
    sized = given.select(*(c for c in rows.columns if c != text), "_size", *(v.alias(k) for k, v in groups.items()))
    placed = before(deal(sized, list(groups), order, "context-sizes"), list(groups), order, {"_used": (F.sum, F.col("_size"))})
    kept = placed.where(F.col("_used") < budget).select(F.col(row_id).alias("_id"), (budget - F.col("_used")).alias("left"))
    out = rows.join(kept, F.col(row_id).eqNullSafe(F.col("_id"))).drop("_id").withColumn("part", F.substring(F.coalesce(F.col(text), F.lit("")), 1, each))
    return out.withColumn("part", F.expr("substring(part, 1, cast(left as int))"))


def _group(key: Column) -> Column:
    """A key that is never null and tells null from every value."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))


def chunked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """Chunk numbers of ``size`` rows in order, and each chunk's number of rows; places are counted over
    parts of each group."""
    groups = {f"_k{i}": _group(F.col(k)) for i, k in enumerate(keys)}
    held = deal(rows.withColumns(groups), list(groups), order, "chunk-rows")
    placed = before(held, list(groups), order, {"_ahead": (F.sum, F.lit(1))})
    out = placed.withColumns({"place": (F.col("_ahead") + 1).cast("int"), "chunk": F.floor(F.col("_ahead") / size)})
    sized = out.withColumn("chunk_rows", F.count("*").over(Window.partitionBy(*groups, "chunk")))
    return sized.select(*rows.columns, "place", "chunk", "chunk_rows")


def verified_quotes(quotes: DataFrame, texts: DataFrame, quote: str, text: str, text_id: str, least: int = 8) -> DataFrame:
    """The quotes of ``least`` characters or more with the id of each text that contains them literally.

    All columns of ``quotes`` and ``text_id``. One automaton finds all quotes in one pass over a text,
    whatever their number of words; only ids and quotes meet in the join that follows.
    """
    asked = quotes.where(F.length(quote) >= least)
    found = phrases_in(texts, asked, text, text_id, quote).select(F.col("id").alias(text_id), F.col("phrase").alias(quote))
    return found.distinct().join(asked, quote)
