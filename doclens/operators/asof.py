"""Joins by time: the last row at or before a moment, and the intervals that a moment lies in.

Both sides of an as-of join are dealt together by range in the order of key and time, so a key of any size lies in as many ranges as it needs. Inside a range the last
row of the right side is carried along; what comes into a range from those before it is one row for each range at the most.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.operators.greedy import kept


def as_of(left: DataFrame, right: DataFrame, time: str, right_time: str, by: dict[str, str] | None = None, order: list[str] | None = None) -> DataFrame:
    """left with the columns of right from its last row at or before left's time, of equal keys `by` (left's to right's); nulls where there is none.

    Of rows of right at the same time the last in the order of `order` (right's columns) counts. Null times and keys meet nothing. The two sides' columns have
    different names.
    """
    by, order = by or {}, order or []
    held = [c for c in right.columns]
    key = F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(by)]) if by else F.struct(F.lit("").alias("k0"))
    other = F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(by.values())]) if by else F.struct(F.lit("").alias("k0"))
    usable = lambda t, keys: F.lit(True) if not keys and not t else F.col(t).isNotNull() & ~F.exists(F.array(*[F.col(k).isNull() for k in keys] or [F.lit(False)]), lambda x: x)
    place = F.struct(*[F.col(c) for c in order]) if order else F.struct(F.lit(0).alias("o"))
    empty_left, empty_right = F.lit(None).cast(_struct(left, left.columns)), F.lit(None).cast(_struct(right, held))
    a = left.where(usable(time, by)).select(key.alias("key"), F.col(time).cast("timestamp").alias("t"), F.lit(1).alias("side"), F.lit(None).cast(_struct(right, order) if order else "struct<o:int>").alias("place"), F.struct(*left.columns).alias("l"), empty_right.alias("r"))
    b = right.where(usable(right_time, by.values())).select(other.alias("key"), F.col(right_time).cast("timestamp").alias("t"), F.lit(0).alias("side"), place.alias("place"), empty_left.alias("l"), F.struct(*held).alias("r"))
    every = a.union(b).withColumn("salt", F.monotonically_increasing_id())
    dealt = kept(every.repartitionByRange("key", "t", "side", "place", "salt").withColumn("range", F.spark_partition_id()))
    last = F.max_by("r", F.struct("t", "place", "salt"))
    ends = dealt.where("side = 0").groupBy("key", "range").agg(last.alias("end"))
    spans = dealt.groupBy("key", "range").agg(F.lit(1).alias("one")).join(ends, ["key", "range"], "left")
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # A key has a row for each range that it reaches into; all but the last end of a range lie in it alone.
    carried = spans.withColumn("carried", F.last("end", ignorenulls=True).over(before)).where("carried is not null").select("key", "range", "carried")
    within = Window.partitionBy("range", "key").orderBy("t", "side", "place", "salt").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("own", F.last("r", ignorenulls=True).over(within)).where("side = 1").join(carried, ["range", "key"], "left")
    rows = found.withColumn("met", F.coalesce("own", "carried")).select("l.*", *[F.col(f"met.{c}").alias(c) for c in held])
    rest = left.where(~F.coalesce(usable(time, by), F.lit(False))).select("*", *[F.lit(None).cast(dict(right.dtypes)[c]).alias(c) for c in held])
    return rows.union(rest)


def _struct(df: DataFrame, columns: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "struct<" + ",".join(f"`{c}`:{kinds[c]}" for c in columns) + ">"


def _pieces(start: Column, end: Column, top: int = 62) -> Column:
    """array<(level, bin)>: the least number of aligned bins of 2^level units that make up [start, end), which is shorter than 2^(top + 1): two of a level at most."""
    piece = lambda level, n: F.struct(level.cast("int").alias("level"), n.cast("long").alias("bin"))
    state = F.struct(start.cast("long").alias("a"), end.cast("long").alias("b"), F.array().cast("array<struct<level:int,bin:bigint>>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        a, b = s["a"], s["b"]
        odd_a, odd_b = (a < b) & (F.pmod(a, F.lit(2)) == 1), (a < b) & (F.pmod(b, F.lit(2)) == 1)
        left = F.when(odd_a, F.array(piece(level, a))).otherwise(F.array().cast("array<struct<level:int,bin:bigint>>"))
        right = F.when(odd_b & (b - 1 >= a + F.when(odd_a, 1).otherwise(0)), F.array(piece(level, b - 1))).otherwise(F.array().cast("array<struct<level:int,bin:bigint>>"))
        return F.struct(F.shiftright(F.when(odd_a, a + 1).otherwise(a), 1).alias("a"), F.shiftright(F.when(odd_b, b - 1).otherwise(b), 1).alias("b"), F.concat(s["out"], left, right).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(top)), state, step, lambda s: s["out"])


#: Lengths of which all ends of intervals may be multiples: in microseconds, a day, an hour, a minute, a second, a millisecond.
UNITS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000)


def in_intervals(points: DataFrame, intervals: DataFrame, at: Column, start: Column, end: Column, by: dict[str, str] | None = None) -> DataFrame:
    """points joined to the intervals [start, end) that `at` lies in (whole numbers), of equal keys `by`. Null ends and empty intervals hold nothing.

    An interval is cut into aligned bins of 2^level, two a level at most; a point is in one bin of each level that an interval's length has, of which there are 63 at
    most. So the join is by equal bins, each pair is met in one bin, and neither long intervals nor crowded moments make more than their own results.
    Bins are of the largest of UNITS that all ends are multiples of, so intervals between midnights have days and few levels. Intervals of keys without a point
    are left out; the others are written once, to be measured and cut. Both sides are dealt by bins: Spark takes exploded rows for as few as they were and would broadcast them.
    """
    by = by or {}
    spans = intervals.withColumns({"__a": start.cast("long"), "__b": end.cast("long")}).where("__a < __b")
    if by:
        keys = points.select(*[F.col(a).alias(f"__k{i}") for i, a in enumerate(by)]).distinct()
        spans = spans.join(keys, reduce(and_, [F.col(b) == F.col(f"__k{i}") for i, b in enumerate(by.values())]), "left_semi")
    spans = kept(spans)
    longest, *even = spans.agg(F.max(F.col("__b").cast("double") - F.col("__a")), *[F.every((F.col("__a") % u == 0) & (F.col("__b") % u == 0)) for u in UNITS]).first()
    unit = next((u for u, fits in zip(UNITS, even, strict=True) if fits), 1)
    top = min(62, max(0, math.ceil(math.log2((longest or 1) / unit))))
    cut = spans.withColumn("__piece", F.explode(_pieces(F.expr(f"__a div {unit}"), F.expr(f"__b div {unit}"), top))).withColumns({"__level": F.col("__piece.level"), "__bin": F.col("__piece.bin")}).drop("__piece", "__a", "__b")
    dealt = points.withColumn("__at", at.cast("long")).where("__at is not null")
    whole = F.expr(f"(__at - pmod(__at, {unit}L)) div {unit}") if unit > 1 else F.col("__at")
    n = F.explode(F.array(*[F.struct(F.lit(x).alias("l"), F.shiftright(whole, x).alias("b")) for x in range(top + 1)]))
    dealt = dealt.withColumn("__p", n).withColumns({"__pl": F.col("__p.l"), "__pb": F.col("__p.b")}).drop("__p", "__at")
    on = (F.col("__pl") == F.col("__level")) & (F.col("__pb") == F.col("__bin"))
    for a, b in by.items():
        on &= dealt[a] == cut[b]
    return dealt.join(cut.hint("merge"), on).drop("__pl", "__pb", "__level", "__bin")
