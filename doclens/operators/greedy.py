"""Acceptance in order: a document is refused by an earlier accepted one that it conflicts with, and by no other.

Who refuses whom depends on the order alone inside a connected component of conflicts. So components are found first, in a number of rounds that grows
with the logarithm of their size; small ones are decided in order by one task each, many to a task, and only components too large for a task
are decided by rounds of joins.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.operators import retrieval

#: Rounds in which sure cases are settled while there are more than so many links a class; after them all links are listed.
PEELS, FEW = 8, 16
LAST = 2**62
#: Documents and links of a component that one task decides, and of a bucket of components, about.
ONE_TASK, BUCKET = 200_000, 50_000


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and the executors share. Where it is unset, a temporary one if all run on one machine, else an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names the folder that the driver and all executors share; it is unset")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="accept-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df written into the shared folder and read again."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of `kept` that nothing reads any more."""
    for t in tables:
        files = t.inputFiles()
        if files:
            jvm = t.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b) of longs: the smallest node that edges reach. Nodes without an edge to another one are left out.

    Large and small stars in turn (Kiveris et al., 2014): every node points to its smallest neighbour, and takes its neighbours along. Up to ONE_TASK
    edges are one task's work.
    """
    e = kept(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.count() <= ONE_TASK:
        return e.coalesce(1).mapInPandas(_joined, "node long, component long")
    before = None
    while True:
        both = e.union(e.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("s")).select("s.a", F.col("s.m").alias("b")).where("a <> b").distinct()
        old, e = e, kept(small)
        dropped(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.groupBy("a").agg(F.min("b").alias("component"))
    return roots.select(F.col("a").alias("node"), "component").union(roots.select("component", "component").distinct())


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for edges in batches:
        for a, b in zip(edges["a"].tolist(), edges["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(root), "component": [find(x) for x in root]}, dtype="int64")


def _decided(docs: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    around: dict = {}
    for a, b in zip(links["earlier"], links["later"], strict=True):
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    labels, twins, out = set(), set(), []
    docs = docs.sort_values("seq", kind="stable")
    for label, twin, counts in zip(docs["label"], docs["twin"], docs["counts"], strict=True):
        named, known = pd.notna(label), pd.notna(twin)
        refused = named and label in labels or known and (twin in twins or any(t in twins for t in around.get(twin, ())))
        if not refused and counts:
            labels |= {label} if named else set()
            twins |= {twin} if known else set()
        out.append("duplicate" if refused else "accepted")
    return docs[["seq", "label", "twin"]].assign(status=out)


def accept(docs: DataFrame, links: DataFrame, one_task: int | None = None) -> DataFrame:
    """(seq, label, twin, status): status is accepted, or duplicate where an earlier accepted document has the same label, the same twin class, or a linked class.

    docs (seq, label, twin, counts) in the order of seq; null labels and twins are like no other. A document that is refused refuses no other, nor does one whose
    counts is false (it brings nothing). links (earlier, later) are between twin classes, whatever their order.
    """
    one_task = ONE_TASK if one_task is None else one_task
    schema = f"seq {dict(docs.dtypes)['seq']}, label {dict(docs.dtypes)['label']}, twin {dict(docs.dtypes)['twin']}, status string"
    node = lambda kind, c: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(kind), F.col(c)))
    state = kept(docs.select("seq", "label", "twin", "counts", node("seq", "seq").alias("node")))
    pairs = kept(links.where("earlier is not null and later is not null").distinct())
    edges = state.select(F.col("node").alias("a"), node("label", "label").alias("b")).union(state.select("node", node("twin", "twin"))).union(pairs.select(node("twin", "earlier"), node("twin", "later")))
    found = kept(components(edges))
    rows = state.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")
    joined = pairs.withColumn("node", node("twin", "earlier")).join(found, "node").select("earlier", "later", "component")
    sizes = kept(rows.select("component", F.lit(1).alias("d")).union(joined.select("component", F.lit(0))).groupBy("component").agg(F.count("*").alias("size"), F.sum("d").alias("docs")))
    # Who is alone in a component has nobody to be refused by.
    alone = rows.join(sizes.where("docs = 1"), "component", "left_semi").select("seq", "label", "twin", F.lit("accepted").alias("status"))
    small, large = sizes.where((F.col("docs") > 1) & (F.col("size") <= one_task)), sizes.where((F.col("docs") > 1) & (F.col("size") > one_task))
    total = small.agg(F.sum("size")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("component"), F.lit(max(1, -(-total // BUCKET)))).alias("bucket")
    own = rows.join(small, "component", "left_semi").select(bucket, "seq", "label", "twin", "counts")
    near = joined.join(small, "component", "left_semi").select(bucket, "earlier", "later")
    out = alone.union(own.groupBy("bucket").cogroup(near.groupBy("bucket")).applyInPandas(lambda d, x: _decided(d, x), schema))
    if not large.isEmpty():
        out = out.union(by_rounds(rows.join(large, "component", "left_semi").drop("component"), joined.join(large, "component", "left_semi").drop("component")))
    out = kept(out)
    dropped(state, pairs, found, sizes)
    return out


def by_rounds(docs: DataFrame, links: DataFrame) -> DataFrame:
    """The same for components of any size. Every round decides all documents whose earlier ones are decided as far as it matters.

    Labels and classes are compared by the first open and the first accepted document of each, aggregated before the shuffle, never by pairs of documents.
    """
    state = kept(docs.select("seq", "label", "twin", "counts", F.lit("open").alias("status")))
    near = links.select(F.col("earlier").alias("twin"), F.col("later").alias("other"))
    near = near.union(near.select("other", "twin")).union(docs.where("twin is not null").select("twin", F.col("twin").alias("other")))
    near = kept(near.where("twin is not null and other is not null").distinct())
    taken, first = F.min(F.when(F.col("counts") & (F.col("status") == "accepted"), F.col("seq"))), F.min(F.when(F.col("counts") & (F.col("status") != "duplicate"), F.col("seq")))
    while not state.where("status = 'open'").isEmpty():
        labels = state.groupBy("label").agg(taken.alias("label_taken"), first.alias("label_first"))
        classes = state.groupBy(F.col("twin").alias("other")).agg(taken.alias("taken"), first.alias("first"))
        around = near.join(classes, "other").groupBy("twin").agg(F.min("taken").alias("twin_taken"), F.min("first").alias("twin_first"))
        rows = state.join(labels, "label", "left").join(around, "twin", "left")
        before = lambda a, b: F.coalesce(F.least(a, b) < F.col("seq"), F.lit(False))
        status = F.when(F.col("status") != "open", F.col("status")).when(before("label_taken", "twin_taken"), "duplicate").when(before("label_first", "twin_first"), "open").otherwise("accepted")
        old, state = state, kept(rows.select("seq", "label", "twin", "counts", status.alias("status")))
        dropped(old)
    return state.drop("counts")


def alike(docs: DataFrame, probes: DataFrame, targets: DataFrame, least: float) -> DataFrame:
    """(seq, status) of accept, where the links are between probes and earlier targets of one collection that are within `least`.

    docs (seq, label, twin, counts); probes and targets (twin, collection, v): a class has one probe and any number of targets. The pairs of a large
    group of near copies are never listed: hits are counted first, and while they are many, documents without any earlier conflict are accepted at once, with
    all that they refuse. What is left has no conflict with those.
    """
    live, done = kept(docs.select("seq", "label", "twin", "counts")), None
    for peel in range(PEELS + 1):
        firsts = kept(live.where("twin is not null").groupBy("twin").agg(F.min("seq").alias("seq"), F.min(F.when(F.col("counts"), F.col("seq"))).alias("held")))
        asked = probes.join(firsts.select("twin", "seq"), "twin").select(F.col("twin").alias("query_id"), "collection", "v", "seq")
        held = targets.join(firsts.where("held is not null"), "twin").select(F.col("twin").alias("id"), "collection", "v", F.col("held").alias("seq"))
        found = kept(retrieval.hits(asked, held, least))
        if peel == PEELS or (found.agg(F.sum("n")).first()[0] or 0) <= FEW * firsts.count():
            break
        free = live.where("counts").join(firsts.select("twin", "seq"), ["twin", "seq"]).join(found.select(F.col("query_id").alias("twin")), "twin", "left_anti")
        heads = live.where("label is not null").groupBy("label").agg(F.min("seq").alias("head"))
        roots = kept(free.join(heads, "label", "left").where("head is null or head = seq").select("seq", "label", "twin"))
        taken = held.join(roots.select(F.col("twin").alias("id")), "id", "left_semi")
        near = retrieval.hits(asked.withColumn("seq", F.lit(LAST)), taken, least).select(F.col("query_id").alias("twin"), F.col("first").alias("met"))
        own = roots.select("twin", F.col("seq").alias("own")).where("twin is not null")
        names = roots.where("label is not null").select("label", F.col("seq").alias("named"))
        rows = live.join(near, "twin", "left").join(own, "twin", "left").join(names, "label", "left").withColumn("least", F.least("met", "own", "named"))
        rows = rows.join(roots.select("seq", F.lit(True).alias("root")), "seq", "left")
        status = F.when(F.col("root"), "accepted").when(F.col("least") < F.col("seq"), "duplicate")
        rows = kept(rows.select("seq", "label", "twin", "counts", status.alias("status")))
        settled = rows.where("status is not null").select("seq", "status")
        done = settled if done is None else done.union(settled)
        dropped(firsts, found, roots)
        live = rows.where("status is null").drop("status")
    links = retrieval.within(asked, held, least, ordered=True).select(F.col("id").alias("earlier"), F.col("query_id").alias("later"))
    rest = accept(live, links).select("seq", "status")
    return rest if done is None else rest.union(done)
