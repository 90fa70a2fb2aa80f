"""Readers of crawled pages: publication times and the readable text of articles."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_CHROME = re.compile(r"<(script|style|nav|header|footer|aside|form|noscript|iframe)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_ROOTS = [re.compile(rf"<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|\Z)", re.S | re.I) for tag in ("article", "main", "body")]
_BLOCK = re.compile(r"<(h1|h2|h3|p|li)\b[^>]*>(.*?)(?=</?(?:h1|h2|h3|p|li|ul|ol|div|article|main|body)\b|\Z)", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")


def readable_text(page: str | None, most: int = 6000, least: int = 200) -> str | None:
    """Headings, paragraphs and list items of the article, without repeated lines; None if short.

    A block counts from 30 characters on, or 8 of Chinese or Japanese. The text is cut to ``most``
    characters, which is what this reader is for; the corpus operators keep whole texts.
    """
    bare = _CHROME.sub(" ", page or "")
    root = next((m[1] for pattern in _ROOTS if (m := pattern.search(bare))), bare)
    lines = dict.fromkeys(" ".join(html.unescape(_TAG.sub(" ", m[2])).split()) for m in _BLOCK.finditer(root))
    text = "\n".join(x for x in lines if len(x) >= 30 or len(_CJK.findall(x)) >= 8)[:most]
    return text if len(text) >= least else None


def published(page: str | None) -> str | None:
    """The first publication time that a page gives: in meta tags, time tags or linked data."""
    page = page or ""
    for tag in re.findall(r"<meta\b[^>]*>", page, re.I):
        if re.search(r"(article:published_time|datePublished|pubdate)", tag, re.I) and (m := re.search(r"content\s*=\s*[\"']([^\"']+)", tag, re.I)):
            return m[1]
    if m := re.search(r"<time\b[^>]*datetime\s*=\s*[\"']([^\"']+)", page, re.I):
        return m[1]
    for block in re.findall(r"<script\b[^>]*application/ld\+json[^>]*>(.*?)</script", page, re.S | re.I):
        try:
            found = json.loads(block)
        except ValueError:
            continue
        for item in found if isinstance(found, list) else [found]:
            if isinstance(item, dict) and isinstance(item.get("datePublished"), str):
                return item["datePublished"]
    return None


#: Pages that are held as strings at once.
PIECE = 64


def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text and published for batches of id and HTML; only ``PIECE`` pages of a batch are unpacked at a time."""
    for b in batches:
        for begin in range(0, b.num_rows, PIECE):
            part = b.slice(begin, PIECE)
            texts, times = [], []
            for x in part.column(1):
                page = x.as_py()
                texts.append(readable_text(page))
                times.append(published(page))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(times, pa.string())], names=["id", "text", "published"])


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, published) of each page; text is null where there is no readable article."""
    kept = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return kept.mapInArrow(read_pages, f"id {kept.dtypes[0][1]}, text string, published string").withColumnRenamed("id", id_col)
