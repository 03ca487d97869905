"""Joins of intervals by bins, and running totals of any length by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places of a key that are summed together.
TOGETHER = 4096


def _as_number(rows: DataFrame, column: str) -> Column:
    """The column on a line of numbers, in order: dates by days, times by microseconds."""
    kind = rows.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def bin_width(*sides: tuple[DataFrame, Column, Column]) -> float:
    """The largest mean length of the sides' intervals, or of their gaps where all are points.

    With bins of the mean length, the intervals of a side meet three bins each on average at most, however long some are.
    One pass over each side.
    """
    widths = []
    for rows, low, high in sides:
        found = rows.select(low.alias("a"), high.alias("b")).where("a <= b").agg(F.avg(F.col("b") - F.col("a")).alias("mean"), F.count("*").alias("n"), (F.max("b") - F.min("a")).alias("range")).first()
        widths.append((found["mean"] or 0.0, (found["range"] or 0.0) / max(1, found["n"])))
    return max(w for w, _ in widths) or max(g for _, g in widths) or 1.0


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float | None = None
) -> DataFrame:
    """Each pair of rows of equal keys whose closed intervals meet, once: columns of ``left``, then those of ``right`` but the keys.

    A span names the columns of an interval's ends; a point has one column twice. Every interval is listed in each bin
    of ``width`` (see ``bin_width``) that it meets, and rows meet by keys and bin, so that a hot key is dealt by bins. A
    pair counts in the first bin that both are in. Null keys and null ends meet nothing, nor does an interval that ends
    before it begins. ``right`` shares no column names with ``left`` but the keys.
    """
    kinds = {"date" if isinstance(k, T.DateType) else "time" if isinstance(k, (T.TimestampType, T.TimestampNTZType)) else "number" for k in (
        rows.schema[c].dataType for rows, span in ((left, left_span), (right, right_span)) for c in span
    )}
    if len(kinds) > 1:
        raise ValueError(f"ends of intervals are of different kinds: {', '.join(sorted(kinds))}")
    both = set(left.columns) & set(right.columns) - set(keys)
    if both:
        raise ValueError(f"both sides have columns {', '.join(sorted(both))}")
    ends = [tuple(_as_number(rows, c) for c in span) for rows, span in ((left, left_span), (right, right_span))]
    wide = width or bin_width((left, *ends[0]), (right, *ends[1]))

    def listed(rows: DataFrame, low: Column, high: Column, first: str) -> DataFrame:
        at = lambda x: F.floor(x / F.lit(float(wide)))
        placed = rows.where(low <= high).select("*", at(low).alias(first), at(high).alias("__last"))
        return placed.select("*", F.explode(F.sequence(first, "__last")).alias("__bin")).drop("__last")

    met = listed(left, *ends[0], "__a").join(listed(right, *ends[1], "__b"), [*keys, "__bin"])
    first = F.col("__bin") == F.greatest("__a", "__b")
    meet = (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1]))
    return met.where(first & meet).select(*left.columns, *(c for c in right.columns if c not in keys))


def running_total(rows: DataFrame, key: str, place: str, value: Column, name: str, together: int = TOGETHER) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over rows of the same key at smaller places. Null keys are one key.

    Rows are summed within ranges of ``together`` places; the totals of a key's ranges, one row each, are summed in turn.
    Rows of one place are in no defined order, so places differ within a key.
    """
    own = rows.withColumns({"__range": F.floor(F.col(place) / together), "__value": value.cast("long")})
    totals = own.groupBy(F.col(key).alias("__key"), F.col("__range").alias("__of")).agg(F.sum("__value").alias("__total"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__key", "__of", F.coalesce(F.sum("__total").over(before("__key").orderBy("__of")), F.lit(0)).alias("__before"))
    within = own.withColumn("__within", F.coalesce(F.sum("__value").over(before(key, "__range").orderBy(place)), F.lit(0)))
    met = within.join(totals, F.col(key).eqNullSafe(F.col("__key")) & F.col("__range").eqNullSafe(F.col("__of")))
    return met.select(*rows.columns, (F.col("__before") + F.col("__within")).alias(name))
