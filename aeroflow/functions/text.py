"""Column functions on texts, titles and URLs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Query parameters that only track where a visit came from.
TRACKING = ["fbclid", "gclid", "ref", "spm"]


def squash(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def title_key(title: Column) -> Column:
    """A title without its " - publisher" tail and with marks as spaces."""
    bare = F.regexp_replace(title, r"\s+[-|]\s+[^-|]{1,40}$", "")
    return F.trim(F.regexp_replace(F.lower(bare), r"(?U)[^\w]+", " "))


def compact_title_key(title: Column) -> Column:
    """A title's letters and digits only."""
    return F.regexp_replace(F.lower(title), r"(?U)[^\w]+|_", "")


@F.pandas_udf(StringType())
def search_key(text: pd.Series) -> pd.Series:
    """NFKC, case-folded, marks as spaces."""
    folded = text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())
    return folded.str.replace(r"[^\w]+", " ", regex=True).str.strip()


@F.pandas_udf(StringType())
def slug(text: pd.Series) -> pd.Series:
    """ASCII letters and digits joined by hyphens, 40 characters at most."""
    plain = text.map(lambda x: "" if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower())
    return plain.str.replace(r"[^a-z0-9]+", "-", regex=True).str.strip("-").str.slice(0, 40).str.strip("-")


def tokens(text: Column, least: int = 5) -> Column:
    """Distinct runs of ``least`` or more ASCII letters and digits, lower-cased, sorted."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0))))


def query_tokens(text: Column) -> Column:
    """A question's ASCII words of two or more letters and digits, and the pairs of neighbouring CJK characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit("[\u4e00-\u9fff]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.struct(words.alias("words"), pairs.alias("pairs"))


def either(first: Column, second: Column) -> Column:
    """The first text that is not blank."""
    return F.coalesce(*(F.when(F.trim(x) != "", x) for x in (first, second)))


def thousands(value: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(value, 0)


@F.pandas_udf(StringType())
def accent_key(text: pd.Series) -> pd.Series:
    """Lower case without accents."""
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()
    return text.map(lambda x: None if x is None else plain(x))


def core_name(key: Column, generic: list[str]) -> Column:
    """A name's words without the generic ones."""
    return F.array_join(F.filter(F.split(key, " "), lambda w: ~w.isin(*generic)), " ")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def rest_of(text: Column) -> Column:
    """What follows the first line."""
    return F.substring(text, F.length(first_line(text)) + 2, F.length(text))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host; no tracking parameters, fragment or trailing slash."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(bare, "^[a-zA-Z]+://[^/?]*", 0))
    path = F.regexp_replace(F.regexp_replace(F.substring(bare, F.length(head) + 1, F.length(bare)), r"\?.*$", ""), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^(utm_[a-z]*|{'|'.join(TRACKING)})(=|$)"))
    return F.concat(head, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def is_safe_url(url: Column) -> Column:
    """http or https with a host, without credentials, spaces or markup."""
    return F.coalesce(url.rlike(r"^https?://[^/\s@<>\"']+\.[a-z]{2,}([/?#][^\s<>\"']*)?$"), F.lit(False))


#: Fixed patterns of secrets in logs: an authorization header with its scheme, and named values.
AUTHORIZATION = r"(?i)\b(authorization)\b[\"']?\s*[:=]?\s*[\"']?(?:(?:bearer|basic|digest|token)\s+)?[^\s\"']+"
NAMED_SECRET = r"(?i)\b(api[-_ ]?key|access[-_ ]?key|token|bearer|secret|password|passwd)\b[\"']?\s*[:=]?\s*[\"']?[^\s\"'\[]+"


def redacted(text: Column, chars: int = 200) -> Column:
    """A log text in single spaces without control characters, URLs and secrets, clipped.

    After a name of a secret the next word goes, with or without a sign or a quote between them;
    after an authorization header its scheme and value go.
    """
    out = F.trim(F.regexp_replace(text, r"[\x00-\x20\x7f]+", " "))
    out = F.regexp_replace(out, r"(?i)https?://\S+", "[url]")
    out = F.regexp_replace(out, AUTHORIZATION, "$1=[secret]")
    out = F.regexp_replace(out, NAMED_SECRET, "$1=[secret]")
    return F.substring(out, 1, chars)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 6371.0 * 2 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def parsed_time(text: Column) -> Column:
    """UTC times to the minute or as full ISO strings; others null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mmX")), F.try_to_timestamp(text))


def pseudonym(value: Column, salt: str) -> Column:
    """A keyed hash of 24 characters."""
    return F.substring(F.sha2(F.concat(F.lit(salt), F.lit(":"), value), 256), 1, 24)


def content_hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1e6, 8)
