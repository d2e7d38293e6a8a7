"""Joins of intervals that overlap, in proportion to what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers in a bucket: an interval is in as many buckets as it touches, and two meet in the bucket where the
#: later one begins.
WIDTH = 64


def _buckets(start: Column, end: Column, width: int) -> Column:
    """The buckets of [start, end); none for an empty interval."""
    first, last = F.floor(start / width), F.floor((end - 1) / width)
    return F.explode(F.when(start < end, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose half-open intervals meet in a number: all columns of both, the keys
    once. Spans name the columns of start and end; other names of the two must differ.

    The bucket is one more key of the join, so that many intervals of one key neither meet all of the other side
    nor stand in one task. An empty interval meets nothing.
    """
    left = a.withColumn("_bucket", _buckets(F.col(a_span[0]), F.col(a_span[1]), width))
    right = b.withColumn("_bucket", _buckets(F.col(b_span[0]), F.col(b_span[1]), width))
    later = F.greatest(a_span[0], b_span[0])
    met = left.join(right, [*keys, "_bucket"]).where((F.col(a_span[0]) < F.col(b_span[1])) & (F.col(b_span[0]) < F.col(a_span[1])))
    return met.where(F.floor(later / width) == F.col("_bucket")).drop("_bucket")


def holding(points: DataFrame, spans: DataFrame, keys: list[str], at: str, span: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """Pairs of points and half-open spans (an end of null: no end) with equal ``keys`` that hold them: all columns of
    both, the keys once. Numbers are from 0 on; other names of the two must differ.

    A span is cut into blocks of buckets, each twice as long as the size before and beginning at a multiple of its
    length, two of a size at most; a point looks at the block of each size around it. So keys are equal, a pair meets
    once, and only buckets at the ends of a span have points that it doesn't hold.
    """
    top = (points.agg(F.max(at)).first()[0] or 0) // width
    sizes = F.explode(F.sequence(F.lit(0), F.lit((top + 1).bit_length() - 1))).alias("_size")
    p = points.select("*", F.floor(F.col(at) / width).alias("_at"), sizes).withColumn("_block", F.expr("shiftright(_at, _size)")).drop("_at")
    begin, end = (F.col(c) for c in span)
    stop = F.least(F.coalesce(F.floor((end - 1) / width), F.lit(top)), F.lit(top)) + 1
    s = spans.select("*", F.floor(begin / width).alias("_lo"), stop.alias("_hi"), sizes)
    s = s.withColumns({"_lo": F.expr("shiftright(_lo + shiftleft(1L, _size) - 1, _size)"), "_hi": F.expr("shiftright(_hi, _size)")}).where("_lo < _hi")
    s = s.withColumn("_block", F.explode(F.expr("array_compact(array(if(_lo % 2 = 1, _lo, null), if(_hi % 2 = 1, _hi - 1, null)))"))).drop("_lo", "_hi")
    met = p.join(s, [*keys, "_size", "_block"]).where((begin <= F.col(at)) & (end.isNull() | (F.col(at) < end)))
    return met.drop("_size", "_block")
