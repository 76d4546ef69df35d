import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from doclens.llm import packing as P

DOC = "doc_id long, text string"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = [None, "", " \n", "Hello, world! it's 2024", "It'S Ünïcode and spaces\x1codd\x1dones", "éte ́x ẞ ΣΑΣ İstanbul", "<|endoftext|> a<|startoftext|>b", "日本語のテキスト 🙂🙂 don't", "x" * 3000, "a " * 5000, "ñ b\x85c\x0bd"]


def test_ids_are_those_of_the_tokenizer():
    ids = P._word_ids(None)
    rnd = random.Random(8)
    odd = "'sdrtvel_ aB9!<|>é\u0130Ŀŉſß×µªº²\u0301İx\u1e9e日\u00ad\u200b."
    texts = TEXTS + ["".join(rnd.choice(odd) for _ in range(rnd.randint(1, 60))) for _ in range(3000)] + ["".join(map(chr, range(32, 0x250)))]
    for t in texts:
        assert np.frombuffer(ids([t or ""])[0], dtype="<u4").tolist() == ids_of(t)[:-1], t


def check(rows, size, got):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(by) == list(range(len(by)))
    want = []
    for d, t in rows:
        ids = ids_of(t)
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            want.append((d, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    return len(by)


def test_pieces_are_exact_and_packed_without_gaps(spark):
    rnd = random.Random(3)
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, "twice"), (3, "twice")]
    rows += [(100 + i, " ".join(rnd.choice(["Is", "and", "erblest,", "thé", "42"]) for _ in range(rnd.choice([3, 3, 3, 50, 400])))) for i in range(300)]
    df = spark.createDataFrame(rows, DOC).repartition(7)
    for size in (4096, 64):
        n = check(rows, size, P.pack(df, size=size).collect())
        total = sum(len(ids_of(t)) for _, t in rows)
        assert n <= -(-total // size) * 1.02 + 1
    assert P.pack(df.limit(0)).count() == 0


def test_best_two_fit_fills_tighter_than_the_greedy_start():
    # 6 + 3 leaves a gap of 1; the 3 gives way to 2 + 2.
    assert P.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0].lengths == [(6, 1), (2, 2)]


@pytest.mark.parametrize("seed", range(6))
def test_counts_are_all_used(seed):
    rnd = random.Random(seed)
    counts = {rnd.randint(1, 100): rnd.randint(1, 30) for _ in range(rnd.randint(1, 60))}
    patterns, used = P.best_two_fit(counts, 100), {}
    for p in patterns:
        assert sum(x * n for x, n in p.lengths) <= 100
        for x, n in p.lengths:
            used[x] = used.get(x, 0) + n * p.times
    assert used == counts
    bins = []  # first fit, longest first
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        i = next((i for i, gap in enumerate(bins) if gap >= x), None)
        if i is None:
            bins.append(100 - x)
        else:
            bins[i] -= x
    assert sum(p.times for p in patterns) <= len(bins) * 1.02 + 1


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a b c", 7, "z"), (2, None, 8, None)], "doc_id long, text string, length int, rank string")
    assert P.pack(df).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert P.pack(df).count() == 2


def test_other_tokenizers_give_their_own_ids():
    """Where words can't be encoded apart, whole texts are."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, ids = Tokenizer.from_file(path), P.WordIds(path)
    for t in TEXTS:
        assert np.frombuffer(ids([t or ""])[0], dtype="<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids, t
