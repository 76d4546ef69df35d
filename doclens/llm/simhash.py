"""SimHash near-duplicates, compared bit-sliced.

Fingerprints are collapsed to distinct ones. Each distinct fingerprint goes to a bucket for
every pair of six bit blocks: two fingerprints at 4 or fewer differing bits agree on two
blocks at least, so they meet. A task sorts the rows of its buckets, stores their bits as
64 vertical planes, and compares every row with the one d places further by one XOR of a
plane with itself shifted by d bits; carry-save counters add up 64 distances in each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from doclens.llm.common import discard, hot_join, id_of, key_of, map_texts, mark_of, written
from doclens.llm.graph import components

#: Six blocks of the 64 bits, as (lowest bit, width).
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
RADIUS = 4
SEED = 42


def shingle_hashes(text: str, n: int = 4) -> np.ndarray:
    """XXH64 of the n-word shingles, repeats included; of all words if they are fewer; none without a word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = memoryview(b" ".join(words))
    if len(words) <= n:
        return np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[:-n].tolist()]
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)), dtype=np.uint64, count=len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; 0 for none. Bits are summed a block at a time, so long texts need no more memory."""
    if not len(hashes):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 2048):
        bits = np.unpackbits(hashes[at : at + 2048].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += (np.ones(len(bits), dtype=np.float32) @ bits.astype(np.float32)).astype(np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, marked: bool = False) -> DataFrame:
    """(key, fp): the id (key_of) and the signed 64-bit fingerprint of every row; a null text counts as empty. If marked, mark (mark_of) too."""
    carry = {"key": key_of(id_col)} | ({"mark": mark_of(text_col)} if marked else {})
    names = tuple(carry)

    def run(_, cols, texts):
        fps = np.fromiter((fingerprint(shingle_hashes(t, shingle)) for t in texts), dtype=np.uint64, count=len(texts))
        return {k: cols[k] for k in names} | {"fp": fps.view(np.int64)}

    rows = docs.select(*[c.alias(k) for k, c in carry.items()], F.col(text_col).alias("text"))
    return map_texts(rows, run, ", ".join(f"{k} long" for k in (*names, "fp")))


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: bit i of row p is bit p of fingerprint i."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    n = -(-len(fps) // 64) * 64
    full = np.zeros((64, n), dtype=np.uint8)
    full[:, : len(fps)] = bits.T
    return np.packbits(full, axis=1, bitorder="little").view("<u8")


def _shifted(planes: np.ndarray, d: int) -> np.ndarray:
    """Every plane d bits further: bit i becomes what bit i + d was."""
    words, bits = divmod(d, 64)
    moved = np.zeros_like(planes)
    keep = planes.shape[-1] - words
    if keep > 0:
        moved[..., :keep] = planes[..., words:] >> np.uint64(bits)
        if bits:
            moved[..., : keep - 1] |= planes[..., words + 1 :] << np.uint64(64 - bits)
    return moved


def within(planes: np.ndarray, wanted: np.ndarray, d: int, radius: int = RADIUS) -> np.ndarray:
    """Of the wanted rows (packed bits), those at `radius` or fewer bits from the row d places further (packed bits).

    Four planes are added at a time in carry-save form to counters of 1, 2 and 4; what passes 7 or the radius
    stays out, and words (64 pairs each) in which all are out are abandoned.
    """
    near = wanted.copy()
    live = np.flatnonzero(near)
    ones = twos = fours = np.zeros(len(live), dtype=np.uint64)
    words, bits = divmod(d, 64)
    low, high = np.uint64(bits), np.uint64(64 - bits)
    width = planes.shape[1]
    for at in range(0, 64, 4):
        if not len(live):
            return near
        one, two = planes[:, np.minimum(live + words, width - 1)], None
        if bits:
            two = planes[:, np.minimum(live + words + 1, width - 1)]
        for p in range(at, at + 4):
            there = one[p] >> low | two[p] << high if bits else one[p]
            x = planes[p, live] ^ there
            carry = ones & x
            ones = ones ^ x
            carry2 = twos & carry
            twos = twos ^ carry
            near[live] &= ~(fours & carry2)  # past 7
            fours = fours ^ carry2
        if radius == 4:
            near[live] &= ~(fours & (ones | twos))
        else:
            near[live] &= ~_above(ones, twos, fours, radius)
        still = near[live] != 0
        if not still.all():
            live, ones, twos, fours = live[still], ones[still], twos[still], fours[still]
    return near


def _above(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Where the counters hold more than radius (0 to 7)."""
    out = np.zeros_like(ones)
    for v in range(radius + 1, 8):
        out |= (ones if v & 1 else ~ones) & (twos if v & 2 else ~twos) & (fours if v & 4 else ~fours)
    return out


def bucket_links(bucket: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the buckets' pairs at `radius` bits join: at most one for each row.

    Rows must be sorted by bucket. Every pair of a bucket is compared, by its distance d in the order.
    """
    n = len(fps)
    if n < 2:
        return fps[:0], fps[:0]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.append(starts, n))
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows of the bucket from here on
    planes = _planes(fps)
    root = np.arange(n)
    for d in range(1, int(sizes.max())):
        ok = np.zeros(planes.shape[1] * 64, dtype=np.uint8)
        ok[:n] = left > d
        wanted = np.packbits(ok, bitorder="little").view("<u8")
        hit = np.flatnonzero(np.unpackbits(within(planes, wanted, d, radius).view(np.uint8), bitorder="little"))
        if len(hit):
            root = _flat(root)
            for i in hit[root[hit] != root[hit + d]].tolist():
                a, b = _find(root, i), _find(root, i + d)
                root[max(a, b)] = min(a, b)
    root = _flat(root)
    low = np.flatnonzero(root != np.arange(n))
    return fps[low], fps[root[low]]


def _flat(root: np.ndarray) -> np.ndarray:
    while (root[root] != root).any():
        root = root[root]
    return root


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return int(i)


def links(fps: DataFrame, radius: int = RADIUS, split: int = 20000) -> DataFrame:
    """(a, b): links of distinct fingerprints (fps.fp) that join exactly those that pairs at `radius` bits or fewer join.

    A bucket of over `split` rows is dealt again by finer pieces of the fingerprints, twice; what is still larger then is compared by pairs of
    blocks of about `split` rows. So no task holds more than two such blocks, and no pair is left out.
    """
    if radius > 4:
        raise ValueError("six blocks and pairs of them hold for a radius of 4 at most")

    def key(i: int, j: int):
        parts = [F.shiftrightunsigned("fp", BLOCKS[k][0]).bitwiseAND(F.lit((1 << BLOCKS[k][1]) - 1)) for k in (i, j)]
        return F.lit((i * 6 + j) << 22) + F.shiftleft(parts[0], 11) + parts[1]

    rows = fps.select("fp", F.explode(F.array(*[key(i, j) for i, j in combinations(range(6), 2)])).alias("bucket"))
    return _compared(rows, radius, split, 0)


def _compared(rows: DataFrame, radius: int, split: int, level: int) -> DataFrame:
    """Rows (fp, bucket) by bucket through bucket_links; what is in larger buckets is first dealt by a finer piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def made(b: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            x, y = bucket_links(b, f.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        for batch in batches:
            b, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held.append((b, f))
            size += len(b)
            if size >= 100_000:
                b, f = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(b, b[-1])) if b[0] <= b[-1] else 0
                if cut:
                    yield made(b[:cut], f[:cut])
                held, size = [(b[cut:], f[cut:])], len(b) - cut
        if size:
            b, f = (np.concatenate(x) for x in zip(*held, strict=True))
            yield made(b, f)

    large = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > split), "buckets")
    if large.isEmpty():
        return _sorted(rows).mapInArrow(run, "a long, b long")
    apart = hot_join(rows, large, ["bucket"], "n", ["fp"]) if level < 2 else hot_join(rows, large.withColumn("size", F.col("n")), ["bucket"], "n", ["fp"])
    small = _sorted(rows.join(large, "bucket", "left_anti")).mapInArrow(run, "a long, b long")
    if level < 2:
        # At `radius` bits two rows agree on one of radius + 1 pieces of the bits, whatever the bucket: as many copies.
        width = -(-64 // (radius + 1 + level))
        pieces = [(at, min(width, 64 - at)) for at in range(0, 64, width)]
        dealt = F.array(*[F.xxhash64("bucket", F.lit(at), F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << w) - 1))) for at, w in pieces])
        return small.union(_compared(apart.select("fp", F.explode(dealt).alias("bucket")), radius, split, level + 1))
    blocks = F.ceil(F.col("size") / split).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.xxhash64("bucket", F.least(mine, k), F.greatest(mine, k)))
    return small.union(_sorted(apart.select("fp", F.explode(pairs).alias("bucket"))).mapInArrow(run, "a long, b long"))


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket", "fp").select("bucket", "fp")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs; the id column is named doc_id.

    Fingerprints at `radius` or fewer differing bits link; component_id is the smallest id reachable. A null text
    counts as empty (fingerprint 0, linked like any other). A null id comes out null, and is smaller than
    any other, so its group's component_id is null. Repeated rows give repeated rows. Other columns of docs aren't read.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    known = _least(fps, F.col("key"), radius)
    return hot_join(fps, known, ["fp"], "n", ["key"]).select(id_of("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_of("component").alias("component_id"))


def _least(fps: DataFrame, value: Column, radius: int) -> DataFrame:
    """(fp, component, n) of every distinct fingerprint: the least value of the rows of its group, and how many rows have it."""
    distinct = written(fps.groupBy("fp").agg(F.min(value).alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    linked = written(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("fps"))
    known = written(hot_join(linked, least, ["root"], "fps", ["fp"]).select("fp", "component", "n"), "components")
    discard(distinct, linked)
    return known


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stay: one of each group, of the smallest id; of rows of that id, the one whose text has the least hash.

    A row is known by its id and its text's 64-bit hash, so rows that share an id (or have none) but not a text are judged apart.
    Repeated rows are one. Columns are those of docs.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle, marked=True), "fingerprints")
    row = F.struct("key", "mark")
    known = _least(fps, row, radius)
    gone = hot_join(fps, known, ["fp"], "n", ["key", "mark"]).where(row != F.col("component")).select(F.col("key").alias("__key"), F.col("mark").alias("__mark")).distinct()
    gone = written(gone, "gone")
    rows = docs.withColumns({"__key": key_of(id_col), "__mark": mark_of(text_col)})
    rows = rows.join(gone, ["__key", "__mark"], "left_anti")
    # Only where rows are repeated do texts have to be shuffled to make one of them.
    if not fps.groupBy("key", "mark").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["__key", "__mark"])
    return rows.select(docs.columns)
