"""A model's replies as a table: each distinct prompt is asked once, what was replied is kept, and what failed is an error in its row.

Prompts are known by a hash of their text and of the attempt. Those without a stored reply are asked in rounds, each of which adds its replies to the store as one
generation, so a run that stops loses one round at the most and the next run asks the rest. Nothing downstream calls the model again,
whatever plans are made of the replies and however often their tasks are retried.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.operators import generations
from doclens.operators.greedy import folder, kept

Model = Callable[[list[str]], list[str]]
#: Prompts that one call may have, that one task asks, and that one round stores.
CALL, TASK, ROUND = 16, 64, 20_000
_REPLY = "key string, reply string, error string, collection string"


def _called(model: Model, prompts: list[str], tries: int) -> list[tuple[str | None, str | None]]:
    """(reply, error) of each prompt; a call that raises, or gives another number of replies, is made again, `tries` times in all."""
    error = ""
    for _ in range(tries):
        try:
            found = list(model(prompts))
            if len(found) == len(prompts):
                return [(None if x is None else str(x).strip(), None if x is not None else "no reply") for x in found]
            error = f"{len(found)} replies to {len(prompts)} prompts"
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:500]
    return [(None, error)] * len(prompts)


def stored(df: DataFrame, store: str) -> DataFrame:
    """(key, reply, error) of the store: of each key the reply if there is one, else the error."""
    spark = df.sparkSession
    rows = generations.rows(spark, store, generations.load(spark, store))
    if rows is None:
        return spark.createDataFrame([], _REPLY).drop("collection")
    return rows.groupBy("key").agg(F.min("reply").alias("reply"), F.min("error").alias("error")).withColumn("error", F.when(F.col("reply").isNull(), F.col("error")))


def asked(df: DataFrame, prompt: str, into: str, model: Model, store: str | None = None, tries: int = 3, attempt: int = 0) -> DataFrame:
    """df with the replies to its prompt column as `into`, and as `into`_error why there is none; rows without a prompt have neither.

    store is a folder that keeps replies from run to run (without one, a new folder in the shared one): what it has is not asked again, but failed prompts are. A
    model that fails never fails the job: after `tries` calls its prompts have an error. attempt tells prompts apart that are asked again on purpose.
    """
    spark = df.sparkSession
    store = store or f"{folder(spark)}/replies-{uuid.uuid4().hex}"
    key = F.when(F.col(prompt).isNotNull(), F.sha2(F.concat(F.lit(f"{attempt}\n"), prompt), 256))
    # The prompts come from any plan; it is run once, not once for the asking and once for the join.
    rows = kept(df.withColumn("__key", key))
    open_ = rows.where("__key is not null").groupBy(F.col("__key").alias("key")).agg(F.first(prompt).alias("prompt"))
    open_ = kept(open_.join(stored(df, store).where("reply is not null"), "key", "left_anti"))
    n = open_.count()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), CALL):
                some = b.iloc[at : at + CALL]
                reply, error = zip(*_called(model, some["prompt"].tolist(), tries), strict=True)
                yield pd.DataFrame({"key": some["key"].tolist(), "reply": reply, "error": error, "collection": "replies"})

    rounds = -(-n // ROUND)
    for k in range(rounds):
        own = open_.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k).repartition(max(1, -(-min(n, ROUND) // TASK)), "key")
        generations.add(spark, store, own.mapInPandas(ask, _REPLY))
    found = stored(df, store).select(F.col("key").alias("__key"), F.col("reply").alias(into), F.col("error").alias(f"{into}_error"))
    return rows.join(found, "__key", "left").drop("__key")
