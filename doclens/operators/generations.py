"""Generations of a table's files: who reads one sees its files as they are, whatever is added or deleted beside it, and whoever stops half-way changes nothing.

Below the table's folder, data/batch=<name>/collection=<name> has rows; files are written once and never changed. A generation is the list of the
folders that make the table and of the batches ever added. It is written aside under a name of its own, and counts from the moment when
its number's pointer, which has that name, is put by an exclusive create: of two writers of one number, one fails and starts again from
what the other put. A pointer without its whole line (a writer that stopped while it put it) counts as none, and its number stays unused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Generation:
    """folders: (batch, folder of the collection as it is written). batches: all that were ever added, so that none is added twice."""

    number: int = 0
    folders: frozenset[tuple[str, str]] = frozenset()
    batches: frozenset[str] = frozenset()


class _Files:
    """The few file operations that generations need, on any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def put(self, name: str, text: str) -> bool:
        """Writes a new file; False if there is one already."""
        try:
            out = self.fs.create(self.path(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or self.fs.exists(self.path(name)):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def step(name: str) -> None:
    """Called between the steps of a change; tests stop here."""


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The generations there are, in order."""
    files = _Files(spark, root)
    return [int(n) for n in files.names("generations") if n.isdigit() and files.text(f"generations/{n}").endswith("\n")]


def load(spark: SparkSession, root: str, number: int | None = None) -> Generation:
    """A generation; the last one without a number, an empty one with number 0 if there is none. Nothing is written."""
    known = numbers(spark, root)
    if number is None and not known:
        return Generation()
    number = known[-1] if number is None else number
    if number not in known:
        raise ValueError(f"no generation {number} in {root}")
    files = _Files(spark, root)
    rows = [line.split("\t") for line in files.text(files.text(f"generations/{number:020d}").strip()).splitlines()]
    return Generation(number, frozenset((r[1], r[2]) for r in rows if r[0] == "folder"), frozenset(r[1] for r in rows if r[0] == "batch"))


def rows(spark: SparkSession, root: str, at: Generation) -> DataFrame | None:
    """The rows of a generation, with batch and collection from the names of the folders; None of an empty one."""
    if not at.folders:
        return None
    base = f"{root.rstrip('/')}/data"
    return spark.read.option("basePath", base).parquet(*sorted(f"{base}/{batch}/{folder}" for batch, folder in at.folders))


def commit(spark: SparkSession, root: str, change: Callable[[Generation], Generation | None]) -> Generation:
    """Puts change(last generation) as the next one, again from the start where another writer was faster; None changes nothing."""
    files = _Files(spark, root)
    while True:
        last = load(spark, root)
        new = change(last)
        if new is None:
            return last
        name = f"lists/{uuid.uuid4().hex}"
        files.put(name, "".join([*(f"folder\t{b}\t{f}\n" for b, f in sorted(new.folders)), *(f"batch\t{b}\n" for b in sorted(new.batches))]))
        step("list")
        number = max([int(n) for n in files.names("generations") if n.isdigit()], default=0) + 1
        if number == last.number + 1 or number - 1 not in numbers(spark, root):
            if files.put(f"generations/{number:020d}", name + "\n"):
                step("pointer")
                return Generation(number, new.folders, new.batches)


def write(spark: SparkSession, root: str, df: DataFrame, batch: str) -> frozenset[tuple[str, str]]:
    """df as the files of a batch, by collection. They belong to no generation yet; a batch that was left half-written is written anew."""
    files = _Files(spark, root)
    df.write.mode("overwrite").partitionBy("collection").parquet(files.path(f"data/batch={batch}").toString())
    step("data")
    return frozenset((f"batch={batch}", n) for n in files.names(f"data/batch={batch}") if n.startswith("collection="))


def add(spark: SparkSession, root: str, df: DataFrame, batch: str | None = None) -> Generation:
    """df's rows, added as one generation. A batch whose name was added before is not added again, so a retry writes nothing twice."""
    batch = batch or uuid.uuid4().hex
    if batch in load(spark, root).batches:
        return load(spark, root)
    # Files of an attempt that another one may still be writing stay its own.
    made = write(spark, root, df, uuid.uuid4().hex)

    def change(last: Generation) -> Generation | None:
        return None if batch in last.batches or not made else Generation(0, last.folders | made, last.batches | {batch})

    return commit(spark, root, change)


def replace(spark: SparkSession, root: str, collection: str, gone) -> int:
    """Takes the rows of a collection where `gone` holds out of the table, and says how many they were. Only the folders that have some are written anew."""
    while True:
        last = load(spark, root)
        all_rows = rows(spark, root, last)
        if all_rows is None:
            return 0
        own = all_rows.where(F.col("collection") == collection)
        hit = {r.batch: r.n for r in own.where(gone).groupBy("batch").agg(F.count("*").alias("n")).collect()}
        if not hit:
            return 0
        old = {(b, f) for b, f in last.folders if b.removeprefix("batch=") in hit and f in _named(spark, root, last, collection)}
        left = own.where(F.col("batch").isin(*hit) & ~F.coalesce(gone, F.lit(False))).drop("batch")
        made = frozenset() if left.isEmpty() else write(spark, root, left, uuid.uuid4().hex)
        lost = []

        def change(now: Generation, old=old, made=made, lost=lost) -> Generation | None:
            if not old <= now.folders:  # another delete was faster
                lost.append(now)
                return None
            return Generation(0, now.folders - old | made, now.batches)

        commit(spark, root, change)
        if not lost:
            return sum(hit.values())


def _named(spark: SparkSession, root: str, at: Generation, collection: str) -> set[str]:
    """The folder names of a collection: Spark escapes some characters in them."""
    names = {f for _, f in at.folders}
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return {f for f in names if unescape(f.removeprefix("collection=")) == collection}


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes the files that the last `keep` generations don't list, those of changes that were never ended too, and says how many folders. Run it beside no writer or older reader."""
    files = _Files(spark, root)
    known = numbers(spark, root)
    used = frozenset().union(*(load(spark, root, n).folders for n in known[-keep:])) if known else frozenset()
    gone = [(b, f) for b in files.names("data") if b.startswith("batch=") for f in files.names(f"data/{b}") if f.startswith("collection=") and (b, f) not in used]
    for n in known[:-keep]:
        files.fs.delete(files.path(f"generations/{n:020d}"), False)
    for b, f in gone:
        files.fs.delete(files.path(f"data/{b}/{f}"), True)
    for b in {b for b, _ in gone} - {b for b, _ in used}:
        files.fs.delete(files.path(f"data/{b}"), True)
    return len(gone)


def difference(old: DataFrame, new: DataFrame, id_col: str, content: list[str], place: list[str]) -> DataFrame:
    """(id, change, copies) of what differs between two generations, as multisets: added or removed; changed (same id, other content); moved (same id and content, other place).

    copies is how many rows of a content and place are more or fewer in new; of an id with both, a removed and an added content are one change. One
    grouping of both sides by id, content and place, which are counted before the shuffle, and one by id.
    """
    mark = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    side = lambda df, n: df.select(F.col(id_col).alias("id"), mark.alias("content"), F.to_json(F.struct(*place), {"ignoreNullFields": "false"}).alias("place"), F.lit(n).alias("n"))
    counts = side(old, -1).union(side(new, 1)).groupBy("id", "content", "place").agg(F.sum("n").alias("n")).where("n <> 0")
    by_content = counts.groupBy("id", "content").agg(F.sum("n").alias("net"), F.sum(F.greatest("n", F.lit(0))).alias("more"))
    by_id = by_content.groupBy("id").agg(
        F.sum(F.when(F.col("net") > 0, F.col("net")).otherwise(0)).alias("up"),
        F.sum(F.when(F.col("net") < 0, -F.col("net")).otherwise(0)).alias("down"),
        # What a content gained at one place and lost at another.
        F.sum(F.when(F.col("net") > 0, F.col("more") - F.col("net")).otherwise(F.col("more"))).alias("moved"),
    )
    kinds = F.array(
        F.struct(F.lit("changed").alias("change"), F.least("up", "down").alias("copies")),
        F.struct(F.lit("added").alias("change"), (F.col("up") - F.least("up", "down")).alias("copies")),
        F.struct(F.lit("removed").alias("change"), (F.col("down") - F.least("up", "down")).alias("copies")),
        F.struct(F.lit("moved").alias("change"), F.col("moved").alias("copies")),
    )
    return by_id.select("id", F.explode(F.filter(kinds, lambda x: x["copies"] > 0)).alias("k")).select("id", "k.change", "k.copies")
