"""Previous rows and running totals without one window for each session.

Rows of a session are cut into buckets along their order. Windows hold one bucket of one session; what a bucket needs
from those before it (its last row, sums, maxima) comes from one small row for each bucket, and only these rows are
ordered by session. ``bucket`` must not fall along the order: floor(t / width) for an order that begins with t.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


KEY = "_g"


def _keyed(rows: DataFrame, by: Sequence[str], bucket: Column) -> DataFrame:
    """rows with their session and bucket as one struct, whose nulls are equal: windows, sums and the join of the carried rows all
    deal rows by this one key, so rows are shuffled once, and once in all where a first helper keeps it for the second."""
    return rows if KEY in rows.columns else rows.withColumn(KEY, F.struct(*by, bucket.alias("_b")))


def _earlier(ends: DataFrame, by: Sequence[str]) -> WindowSpec:
    """The buckets of a session before each; one row is one bucket."""
    return Window.partitionBy(*[F.col(f"{KEY}.{c}") for c in by]).orderBy(f"{KEY}._b").rowsBetween(Window.unboundedPreceding, -1)


def _value(c: str, nulls: bool) -> Column:
    """The value, wrapped so that a null may be told from no row; null itself where nulls do not count."""
    return F.struct(F.col(c).alias("v")) if nulls else F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v")))


def with_previous(rows: DataFrame, by: Sequence[str], order: Sequence[str], values: Mapping[str, str], bucket: Column, nulls: bool = True, keep: bool = False) -> DataFrame:
    """rows with new columns (name: source column) of the row before; with nulls=False, of the last row before that has a value.

    With ``keep`` the key stays, for a next helper with the same ``by`` and ``bucket``.
    """
    at = _keyed(rows, by, bucket)
    before = Window.partitionBy(KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    last = {n: F.max_by(_value(c, nulls), place if nulls else F.when(F.col(c).isNotNull(), place)) for n, c in values.items()}
    ends = at.groupBy(KEY).agg(*[e.alias(f"_e_{n}") for n, e in last.items()])
    carried = ends.select(KEY, *[F.last(f"_e_{n}", True).over(_earlier(ends, by)).alias(f"_c_{n}") for n in values])
    inner = at.withColumns({f"_i_{n}": F.last(_value(c, nulls), True).over(before) for n, c in values.items()})
    found = inner.join(carried, KEY, "left")
    return found.withColumns({n: F.coalesce(f"_i_{n}", f"_c_{n}")["v"] for n in values}).drop(*([] if keep else [KEY]), *[f"_{k}_{n}" for n in values for k in "ic"])


def with_running(rows: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], bucket: Column, maxima: Mapping[str, Column] | None = None, keep: bool = False) -> DataFrame:
    """rows with running sums (this row included, nulls as 0) and running maxima (of the rows before)."""
    maxima = dict(maxima or {})
    at = _keyed(rows, by, bucket).withColumns({f"_s_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()} | {f"_m_{n}": c for n, c in maxima.items()})
    inside = Window.partitionBy(KEY).orderBy(*order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    totals = at.groupBy(KEY).agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums], *[F.max(f"_m_{n}").alias(f"_t_{n}") for n in maxima])
    earlier = _earlier(totals, by)
    carried = totals.select(KEY, *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums], *[F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in maxima])
    inner = {f"_i_{n}": F.sum(f"_s_{n}").over(upto) for n in sums} | {f"_i_{n}": F.max(f"_m_{n}").over(before) for n in maxima}
    found = at.withColumns(inner).join(carried, KEY, "left")
    made = {n: F.col(f"_i_{n}") + F.coalesce(f"_c_{n}", F.lit(0)) for n in sums} | {n: F.greatest(f"_i_{n}", f"_c_{n}") for n in maxima}
    return found.withColumns(made).drop(*([] if keep else [KEY]), *[f"_{k}_{n}" for n in (*sums, *maxima) for k in "smic"])
