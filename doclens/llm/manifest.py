"""A Merkle manifest of a table: one tree of sha256 digests for each group of rows, and one over the groups' roots.

A run of FANOUT neighbouring nodes becomes the digest of their digests; the last run of a level may be shorter, and is hashed as it is, without
padding. Leaves are dealt by range in the trees' order and numbered, so each task holds segments: leaves of one tree whose numbers follow each other.

1. A segment goes through a mountain range: a stack with one open run for each level. A full run (or the tree's short last one) is carried
   up as one node. What the segment completes is recorded; nodes of runs that lie across a segment's ends stay as its edges.
2. Edges are merged level by level: a run of edges of several segments becomes a node, an edge of the next level.
   A segment leaves 14 edges a level at most, so this is a small part of the leaves.
3. For proofs, each segment gets the runs of merged edges above it, two a level, and recomputes its own nodes from its leaves.

The roots of the groups are the leaves of one more tree, built in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from doclens.llm.common import written

FANOUT, SHIFT = 8, 3
#: Leaves of a segment at most.
SEGMENT = 1024
_SEGMENT = ["tree", "part", "seg"]
PATH = "array<struct<before:array<string>,after:array<string>>>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(c: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; - if null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(said, columns)), 256)


def width(n: int, level: int) -> int:
    """How many nodes a tree of n leaves has at a level."""
    return -(-n // FANOUT**level)


@dataclass
class Forest:
    """leaves: tree, part, seg, at (number in the segment), leaf and the other columns. segments: tree, part, seg, start, n (leaves of the tree). nodes: tree,
    level, number, digest (level 1 and up). runs: tree, level, run, children, of those that lie across segments. roots: tree, root, n.
    """

    leaves: DataFrame
    segments: DataFrame
    nodes: DataFrame
    runs: DataFrame
    roots: DataFrame


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, …) in the order of tree and `order`, with part (of the range), seg and at."""
    spread = rows.withColumn("salt", F.monotonically_increasing_id())  # full repeats of a row go to several parts
    dealt = spread.repartitionByRange("tree", *order, "salt").sortWithinPartitions("tree", *order, "salt").drop("salt")
    k = rows.columns.index("tree")

    def number(batches):
        part, tree, at = TaskContext.get().partitionId(), None, -1
        for b in batches:
            places = []
            for t in b.column(k).to_pylist():
                tree, at = t, at + 1 if t == tree else 0
                places.append(at)
            own = ([part] * len(places), [p // SEGMENT for p in places], [p % SEGMENT for p in places])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int32()) for x in own)], names=[*b.schema.names, "part", "seg", "at"])

    return dealt.mapInArrow(number, StructType([*rows.schema.fields, *(StructField(c, IntegerType()) for c in ("part", "seg", "at"))]))


class Range:
    """The open runs of a segment, from the leaves up. `made` has the nodes completed, `edges` those of runs that the segment does not hold whole."""

    def __init__(self, start: int, n: int) -> None:
        self.n, self.open, self.made, self.edges, self.next = n, [], [], [], [start]

    def push(self, node: str, level: int = 0, number: int | None = None) -> None:
        if level == len(self.open):
            self.open.append([])
            self.next.append(None)
        number = self.next[0] if number is None else number
        if level == 0:
            self.next[0] = number + 1
        else:
            self.made.append((level, number, node))
        wide = width(self.n, level)
        run = self.open[level]
        run.append((number, node))
        if wide > 1 and (number % FANOUT == FANOUT - 1 or number == wide - 1):
            if run[0][0] % FANOUT == 0:
                self.open[level] = []
                self.push(digest([d for _, d in run]), level + 1, number // FANOUT)
            else:
                self.close(level)

    def close(self, level: int) -> None:
        self.edges += [(level, k, d) for k, d in self.open[level]]
        self.open[level] = []

    def end(self) -> None:
        for level in range(len(self.open)):
            self.close(level)


def _segment(group: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at", kind="stable")
    peaks = Range(int(head["start"].iloc[0]), int(head["n"].iloc[0]))
    for d in group["leaf"]:
        peaks.push(d)
    peaks.end()
    edges = {(level, k) for level, k, _ in peaks.edges}
    rows = [(level, k, d, (level, k) in edges) for level, k, d in peaks.made] + [(*e, True) for e in peaks.edges if e[0] == 0]
    return pd.DataFrame({"tree": head["tree"].iloc[0], **{c: [r[i] for r in rows] for i, c in enumerate(("level", "number", "digest", "edge"))}})


def forest(rows: DataFrame, order: list[str]) -> Forest:
    """The trees of rows (tree, leaf, …), whose leaves ascend by `order`; equal rows in any order."""
    leaves = written(_numbered(rows, order), "leaves")
    counts = leaves.groupBy(*_SEGMENT).agg(F.count("*").alias("rows"))
    before = Window.partitionBy("tree").orderBy("part", "seg")
    parts = counts.withColumn("start", F.sum("rows").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    segments = written(parts.select(*_SEGMENT, F.coalesce("start", F.lit(0)).alias("start"), "rows", F.sum("rows").over(Window.partitionBy("tree")).alias("n")), "segments")
    made = leaves.select(*_SEGMENT, "at", "leaf").groupBy(*_SEGMENT).cogroup(segments.groupBy(*_SEGMENT)).applyInPandas(_segment, "tree string, level int, number long, digest string, edge boolean")
    made = written(made, "nodes")
    sizes = segments.groupBy("tree").agg(F.first("n").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    wide = lambda level: F.ceil(F.col("n") / F.lit(FANOUT**level)).cast("long")

    nodes, runs, roots, level = made.where("level > 0").drop("edge"), None, None, 0
    edges = made.where("edge and level = 0").select("tree", "number", "digest")
    while True:
        # Of a tree that has one node at this level, that is the root; other edges become nodes by runs.
        sized = edges.join(sizes, "tree")
        top = sized.where(wide(level) == 1).select("tree", F.col("digest").alias("root"), "n")
        roots = top if roots is None else roots.union(top)
        if width(largest, level) <= 1:
            break
        children = F.transform(F.array_sort(F.collect_list(F.struct("number", "digest"))), lambda x: x["digest"])
        run = sized.where(wide(level) > 1).groupBy("tree", F.shiftright("number", SHIFT).alias("run")).agg(children.alias("children"))
        run = written(run.select("tree", F.lit(level).alias("level"), "run", "children", F.sha2(F.array_join("children", ""), 256).alias("digest")), "runs")
        runs = run if runs is None else runs.union(run)
        level += 1
        merged = run.select("tree", F.lit(level).alias("level"), F.col("run").alias("number"), "digest")
        nodes = nodes.union(merged)
        edges = made.where(F.col("edge") & (F.col("level") == level)).select("tree", "number", "digest").union(merged.drop("level"))
    if runs is None:
        runs = leaves.sparkSession.createDataFrame([], "tree string, level int, run long, children array<string>, digest string")
    return Forest(leaves, segments, nodes, runs.drop("digest"), roots)


def _above(places: DataFrame, by: list[str], low: Column, high: Column, f: Forest) -> DataFrame:
    """by, runs: of the leaves low to high of places (tree, n, …), the runs above them that lie across segments, (level, run, children), two a level at most."""
    levels = F.sequence(F.lit(0), F.ceil(F.log(float(FANOUT), F.greatest(F.col("n"), F.lit(1)).cast("double"))).cast("int"))
    wanted = places.select("tree", *by, low.alias("__low"), high.alias("__high"), F.explode(levels).alias("level"))
    run = lambda c: F.call_function("shiftright", F.col(c), SHIFT * (F.col("level") + 1))
    wanted = wanted.select("tree", *by, "level", F.explode(F.array_distinct(F.array(run("__low"), run("__high")))).alias("run"))
    found = wanted.join(f.runs, ["tree", "level", "run"])
    return found.groupBy("tree", *by).agg(F.collect_list(F.struct("level", "run", "children")).alias("runs"))


class Paths:
    """The nodes that a segment's leaves and the runs above it (level, run, children) make known, and the way up from each leaf."""

    def __init__(self, start: int, n: int, leaves: list[str], runs: list, top: list[tuple[list[str], list[str]]]) -> None:
        self.start, self.n, self.top, self.known = start, n, top, {}
        peaks = Range(start, n)
        for d in leaves:
            peaks.push(d)
        self.nodes = {(0, start + i): d for i, d in enumerate(leaves)} | {(level, k): d for level, k, d in peaks.made}
        self.nodes |= {(r["level"], FANOUT * r["run"] + i): d for r in runs for i, d in enumerate(r["children"])}

    def up(self, level: int, number: int) -> list[tuple[list[str], list[str]]]:
        """(siblings before, siblings after) at each level, from a node to the root of all; those of a run share what lies above it."""
        wide = width(self.n, level)
        if wide <= 1:
            return self.top
        run = number // FANOUT
        if (level, run) not in self.known:
            children = [self.nodes[level, k] for k in range(FANOUT * run, min(wide, FANOUT * (run + 1)))]
            self.known[level, run] = children, self.up(level + 1, run)
        children, rest = self.known[level, run]
        return [(children[: number % FANOUT], children[number % FANOUT + 1 :]), *rest]


def fold(node: str, path: list[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        node = digest([*before, node, *after])
    return node


def _each(f: Forest, tops: DataFrame | None, use: Callable[[pd.DataFrame, list[list]], pd.DataFrame], schema: str) -> DataFrame:
    """use(leaves of a segment, paths of each) for every segment; tops (tree, subroot, root, path) has what lies above the trees."""
    heads = f.segments.join(_above(f.segments, ["part", "seg"], F.col("start"), F.col("start") + F.col("rows") - 1, f), _SEGMENT, "left")
    if tops is None:
        tops = f.roots.select("tree", F.col("root").alias("subroot"), "root", F.array().cast(PATH).alias("path"))
    heads = heads.join(tops, "tree").select(*_SEGMENT, "start", "n", "runs", "subroot", "root", "path")

    def run(group: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        group, h = group.sort_values("at", kind="stable").reset_index(drop=True), head.iloc[0]
        runs = [] if h["runs"] is None else h["runs"]
        paths = Paths(int(h["start"]), int(h["n"]), group["leaf"].tolist(), list(runs), [(list(s["before"]), list(s["after"])) for s in h["path"]])
        group["subroot"], group["root"] = h["subroot"], h["root"]
        return use(group, [paths.up(0, paths.start + i) for i in range(len(group))])

    return f.leaves.groupBy(*_SEGMENT).cogroup(heads.groupBy(*_SEGMENT)).applyInPandas(run, schema)


def proved(rows: DataFrame, order: list[str], use: Callable[[pd.DataFrame, list[list]], pd.DataFrame], schema: str) -> DataFrame:
    """use(leaves of a segment, the path of each to the root of all) for every segment of rows (tree, leaf, …); leaves also have subroot and root."""
    trees = forest(rows, order)
    upper = forest(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf")), ["name"])

    def told(leaves: pd.DataFrame, paths: list[list]) -> pd.DataFrame:
        steps = [[{"before": b, "after": a} for b, a in p] for p in paths]
        return pd.DataFrame({"tree": leaves["name"], "subroot": leaves["leaf"], "root": leaves["root"], "path": steps})

    tops = written(_each(upper, None, told, f"tree string, subroot string, root string, path {PATH}"), "tops")
    return _each(trees, tops, use, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs.

    A leaf is the sha256 of `columns`, each as its byte count, a colon and its value, or - if null. A tree for each value of group_col (null is one,
    too, and comes first; then in the order of UTF-8 bytes) has its leaves in the order of ids, null ids first, rows that repeat an id in
    the order of their leaves; full repeats are leaves of their own. The roots of the trees are the leaves of the last one. proof_sha256 is the digest of
    all siblings up to the root. Where 3 divides the crc32 of the id as text (a null id has none), the row is tampered with: A-Z of its text are made
    small; folded_root comes from that leaf (else the own one) and the siblings, and verified says whether it is root. An empty table gives no row.
    Other columns aren't read.
    """
    small = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0, F.lit(False))
    tampered = F.when(hit, leaf([small if c == text_col else F.col(c) for c in columns]))
    # A letter before the name keeps null first, and apart from an empty name.
    name = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(name.alias("tree"), F.col(id_col).alias("id"), leaf([F.col(c) for c in columns]).alias("leaf"), tampered.alias("tampered"))

    def use(leaves: pd.DataFrame, paths: list[list]) -> pd.DataFrame:
        proof = [digest([s for before, after in p for part in (before, after) for s in part]) for p in paths]
        start = leaves["tampered"].where(leaves["tampered"].notna(), leaves["leaf"])
        folded = [fold(d, p) for d, p in zip(start, paths, strict=True)]
        ids = pd.array(leaves["id"], dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "leaf": leaves["leaf"], "subroot": leaves["subroot"], "root": leaves["root"], "proof_sha256": proof, "folded_root": folded, "verified": [f == r for f, r in zip(folded, leaves["root"], strict=True)]})

    return proved(rows, ["id", "leaf"], use, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _in_sql(column: str, value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def sql(columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> str:
    """The rows of digests in DuckDB's SQL: levels, folds and the checksum by recursion and lists."""
    own = " || ".join(_in_sql(c, c) for c in columns)
    small = " || ".join(_in_sql(c, "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if c == "text" else c) for c in columns)
    # One step of the checksum takes in a byte or, where the list has -1, shifts by a bit.
    steps = "list_concat([4294967295::BIGINT], flatten(list_transform(string_split_regex(doc_id::VARCHAR, ''), lambda c: list_concat([ord(c)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT)))))"
    crc = f"xor(list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
    run = "list(d ORDER BY k)"
    climb = "array_to_string(l[1:k % 8], '') AS a, array_to_string(l[k % 8 + 2:], '') AS b"
    return f"""WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({own}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({small}) END AS tampered FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (SELECT tree, 0 AS level, k, n, leaf AS d FROM numbered UNION ALL SELECT tree, level + 1, k // 8, any_value((n + 7) // 8), sha256(string_agg(d, '' ORDER BY k)) FROM nodes WHERE n > 1 GROUP BY tree, level, k // 8),
runs AS (SELECT tree, level, k // 8 AS run, {run} AS l FROM nodes WHERE n > 1 GROUP BY tree, level, k // 8),
subroots AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS k, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (SELECT 0 AS level, k, n, subroot AS d FROM subroots UNION ALL SELECT level + 1, k // 8, any_value((n + 7) // 8), sha256(string_agg(d, '' ORDER BY k)) FROM upper WHERE n > 1 GROUP BY level, k // 8),
upper_runs AS (SELECT level, k // 8 AS run, {run} AS l FROM upper WHERE n > 1 GROUP BY level, k // 8),
folds AS (SELECT doc_id, leaf, tree, 0 AS level, k, coalesce(tampered, leaf) AS f, '' AS proof FROM numbered
  UNION ALL SELECT doc_id, leaf, tree, level + 1, k // 8, sha256(a || f || b), proof || a || b FROM (SELECT doc_id, leaf, folds.tree, folds.level, k, f, proof, {climb} FROM folds JOIN runs ON runs.tree = folds.tree AND runs.level = folds.level AND run = k // 8)),
below AS (SELECT * FROM folds QUALIFY level = max(level) OVER (PARTITION BY tree)),
ups AS (SELECT doc_id, leaf, subroot, 0 AS level, subroots.k, f, proof FROM below JOIN subroots USING (tree)
  UNION ALL SELECT doc_id, leaf, subroot, level + 1, k // 8, sha256(a || f || b), proof || a || b FROM (SELECT doc_id, leaf, subroot, ups.level, k, f, proof, {climb} FROM ups JOIN upper_runs ON upper_runs.level = ups.level AND run = k // 8)),
ends AS (SELECT * FROM ups QUALIFY level = max(level) OVER ())
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM ends JOIN (SELECT d AS root FROM upper WHERE n = 1) ON true"""
