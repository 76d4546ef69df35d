"""What the operators of this subpackage share: the shared folder, text batches, ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where rows are joined or ordered; real ids are above it.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all run on one machine, else an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names the folder that the driver and all executors share; it is unset")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="doclens-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _release(spark)
    df.write.parquet(path)
    _release(spark)
    return spark.read.schema(df.schema).parquet(path)


def _release(spark: SparkSession) -> None:
    """Spark deletes the files of a plan's shuffles, which can be as large as the input, when the driver's JVM has collected the plan.

    That is asked for between steps, as it would else come too late for the next one.
    """
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that no later step reads."""
    for t in tables:
        files = t.inputFiles()
        if files:
            context = t.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(id_col: str) -> Column:
    """The id as a long that is never null."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def id_of(key: str) -> Column:
    """The id that key_of was made from."""
    return F.when(F.col(key) != NULL_ID, F.col(key))


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[tuple[dict[str, list], list[str]]]:
    """Pieces of about a MB of text: the other columns as lists, and the texts with null as ''. A longer text is a piece of its own."""
    for batch in batches:
        k = batch.schema.get_field_index(text)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            # Only what goes into a piece becomes Python objects at a time.
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
            piece = batch.slice(at, end - at)
            cols = {n: piece.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            yield cols, [t or "" for t in cols.pop(text)]
            at = end


def map_texts(df: DataFrame, fn: Callable[[Any, dict[str, list], list[str]], dict[str, Any]], schema: str, setup: Callable[[], Any] | None = None, text: str = "text", most: int = 1 << 20) -> DataFrame:
    """df through fn(state, other columns, texts) -> columns of schema, in pieces of about `most` bytes of text; setup makes the state once in each task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DataType

    arrow = to_arrow_schema(DataType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for cols, texts in chunks(batches, text, most):
            out = fn(state, cols, texts)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def mark_of(text_col: str) -> Column:
    """A 64-bit hash of the text, by which rows that share an id are told apart; never null."""
    return F.xxhash64(text_col)


def remainder_of(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id has none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def bounded_sample(df: DataFrame, most: int, key: str, by: str) -> DataFrame:
    """About most rows of df at the most, in equal shares of the values of `by`: rows whose hashed key is low.

    The bound is a parameter of the caller; the choice depends on keys alone, so it is the same in every run.
    Small values of `by` are taken whole. The counts stay a table, as `by` may have any number of values.
    """
    counts = df.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"))
    level = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    n = counts.count()
    share = max(1, most // max(1, n))
    rates = counts.select("__by", (F.lit(float(share << 30)) / F.col("__n")).alias("__rate"))
    # A few values' rates are broadcast, so that nothing of df is shuffled.
    rates = F.broadcast(rates) if n <= 10_000 else rates
    return df.join(rates, F.col(by).eqNullSafe(F.col("__by"))).where(level < F.col("__rate")).select(df.columns)


#: A key of at least so many rows may be hot, and its rows are joined in so many shares.
HOT, SHARES = 10_000, 64


def hot_join(rows: DataFrame, one: DataFrame, on: list[str], n: str, spread: list[str], total: int | None = None) -> DataFrame:
    """rows joined to one, which has a row for each key `on` and says in column n how many rows have it; n is dropped.

    Of keys with more than HOT rows and a thousandth of all there are fewer than 1000, so they are broadcast; their rows are dealt by `spread`
    to SHARES shares, each with its copy of the key's row. So no task gets all the rows of a key. total is the number of rows, if it is known.
    """
    total = one.agg(F.sum(n)).first()[0] or 0 if total is None else total
    if total <= HOT:
        return rows.join(one.drop(n), on)
    hot = F.col(n) > max(HOT, total // 1000)
    keys = F.broadcast(one.where(hot).select(*on, F.lit(True).alias("__hot")))
    share = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(SHARES)).cast("int")).otherwise(0)
    left = rows.join(keys, on, "left").withColumn("__share", share).drop("__hot")
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    return left.join(one.withColumn("__share", F.explode(copies)).drop(n), [*on, "__share"]).drop("__share")
