"""Running totals within groups of any size, over parts of a sorted order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroflow.storage import materialise

PART = "_part"


def deal(df: DataFrame, group: Sequence[str], order: Sequence[Column], label: str) -> DataFrame:
    """``df`` with its place ``_part`` in the order by group and ``order``, written as a table.

    Parts are ranges of that order with about as many rows each, so a group that holds a third of
    all rows spans many parts, as long as ``order`` tells its rows apart.
    """
    dealt = df.repartitionByRange(*(F.col(c) for c in group), *order)
    return materialise(dealt.withColumn(PART, F.spark_partition_id()), label)


def _combined(how: Callable[[Column], Column], a: Column, b: Column) -> Column:
    a, b = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
    return a.bitwiseXOR(b) if how is F.bit_xor else a + b


def before(dealt: DataFrame, group: Sequence[str], order: Sequence[Column], totals: dict[str, tuple[Callable[[Column], Column], Column]]) -> DataFrame:
    """What the rows of a group before each row total, for a table from :func:`deal`.

    ``totals`` maps a new column to (``F.sum`` or ``F.bit_xor``, what is totalled). Each part of a
    group is summed up in one row; windows run over these rows and within a part, never over a
    whole group. Group columns hold no nulls.
    """
    keys = [PART, *group]
    held = dealt.select("*", *(x.alias(f"_{n}") for n, (_, x) in totals.items()))
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    steps = held.groupBy(*keys).agg(*(how(F.col(f"_{n}")).alias(f"_{n}_all") for n, (how, _) in totals.items()))
    steps = steps.select(*keys, *(how(F.col(f"_{n}_all")).over(earlier).alias(f"_{n}_base") for n, (how, _) in totals.items()))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = held.select("*", *(how(F.col(f"_{n}")).over(within).alias(f"_{n}_here") for n, (how, _) in totals.items())).join(steps, keys)
    return out.select(*dealt.columns, *(_combined(how, F.col(f"_{n}_base"), F.col(f"_{n}_here")).alias(n) for n, (how, _) in totals.items()))
