import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from structura.llm.packing import pack, plan, split

JSON = P.path("byte_bpe_50k.json")


def check(df, rows, size):
    t = Tokenizer.from_file(JSON)
    want = defaultdict(list)
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(split(len(ids), size)):
            want[i].append((k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
    got, places = defaultdict(list), defaultdict(list)
    for r in pack(df, JSON, P.PATTERN, size=size).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    total = 0
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
        total += at
    return len(places), -(-total // size)


def test_places(docs, rows, odd, odd_rows):
    for size in (2048, 64):
        used, least = check(docs, rows, size)
        assert used <= least * 1.05 + 1
        check(odd, odd_rows, size)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(5.5, 1.0, 20000).astype(int), 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    ranges = plan(counts, 2048)
    placed = np.zeros(2049, int)
    for length, first, n, _, _ in sorted(ranges):
        assert first == placed[length]
        placed[length] += n
    assert (placed == counts).all()
    assert max(s + n for _, _, n, s, _ in ranges) <= -(-lengths.sum() // 2048) * 1.002


def test_split():
    assert split(5, 4) == [(0, 1), (1, 4)] and split(8, 4) == [(0, 4), (4, 4)] and split(4, 4) == [(0, 4)]


def test_empty(empty):
    assert pack(empty, JSON, P.PATTERN).collect() == []


def test_more_partitions_than_files(spark):
    """Scratch tables have 64 files here at most: several partitions run in one task."""
    rows = [(k, "a b " * (k % 7)) for k in range(800)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(200), rows, 64)
