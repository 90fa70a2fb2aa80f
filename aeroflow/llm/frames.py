"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Texts are handled in groups of about this many characters, so that a batch of very long
#: texts needs no more memory than one of short texts.
GROUP_CHARS = 1_000_000

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def groups(texts: list[str | None], limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``limit`` characters together; a longer text is a run."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def batch(columns: dict[str, pa.Array | list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, types[k]) for k, x in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))
