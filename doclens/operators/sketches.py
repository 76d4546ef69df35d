"""Sketches of an index by collection, source and issuer: distinct texts, quantiles of lengths, most frequent articles; small, and mergeable over groups and generations.

A sketch is made once for the rows of a generation and kept as a row of a table; totals of any level, and of several generations, come from merging those rows, without
the chunks. All are Spark's own aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the buckets of a distinct sketch (error about 1.04 / sqrt(2^LOG)), size of a quantile sketch (rank error about 1.7 / K), items of a frequency sketch.
LOG, K, ITEMS = 12, 200, 512


def made(rows: DataFrame, by: list[str], distinct: str, number: str, frequent: str) -> DataFrame:
    """(by, n, distinct, quantiles, frequent) of rows: a sketch row for each group; nulls count in n alone."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(F.col(distinct), LOG).alias("distinct"),
        F.kll_sketch_agg_double(F.col(number).cast("double"), K).alias("quantiles"),
        F.call_function("approx_top_k_accumulate", F.col(frequent), F.lit(ITEMS)).alias("frequent"),
    )


def rollup(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of every level of `by`, the total's at last; level says how many of the columns are rolled up. Rows of several generations merge alike."""
    return sketches.rollup(*by).agg(
        F.grouping_id().alias("level"),
        F.sum("n").alias("n"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles", K).alias("quantiles"),
        F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(ITEMS)).alias("frequent"),
    )


def told(sketches: DataFrame, ranks: tuple[float, ...] = (0.5, 0.9, 0.99), most: int = 5) -> DataFrame:
    """Sketches as figures: distinct (estimate), quantiles at `ranks`, and the `most` most frequent items with their counts."""
    at = [F.kll_sketch_get_quantile_double("quantiles", F.lit(r)) for r in ranks]
    return sketches.withColumns({"distinct": F.hll_sketch_estimate("distinct"), "quantiles": F.array(*at), "frequent": F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(most))})
