import random
from collections import Counter, defaultdict

import numpy as np
import xxhash

from structura.llm import simhash as S
from structura.llm.simhash import anchors, fingerprint, links, near_dedup, near_duplicates

from .conftest import plain


def slow_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def expected(rows, n=3):
    fps = [slow_fingerprint(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return sorted(((i, f"{fps[k]:016x}", min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)), key=repr)


def test_fingerprints_and_components(docs, rows):
    assert plain(near_duplicates(docs)) == expected(rows)


def test_odd_rows(odd, odd_rows):
    assert plain(near_duplicates(odd)) == expected(odd_rows)


def test_every_pair_shares_an_anchor():
    rng = np.random.default_rng(3)
    half = rng.integers(0, 2**32, 200, dtype=np.uint64).astype(np.uint32)
    for flip in [0, *(1 << b for b in range(32))]:
        i, a = anchors(half)
        j, b = anchors(half ^ np.uint32(flip))
        left, right = defaultdict(set), defaultdict(set)
        for k, x in zip(i, a):
            left[k].add(x)
        for k, x in zip(j, b):
            right[k].add(x)
        assert all(left[k] & right[k] for k in range(200))
        assert max(Counter(i.tolist()).values()) <= 17


def test_links_find_all_components(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(30):
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4).collect()
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in found:
        assert bin((e.src ^ e.dst) & (2**64 - 1)).count("1") <= 3
        parent[find(e.src)] = find(e.dst)
    for a in signed:
        for b in signed:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                assert find(a) == find(b)


def test_near_dedup(docs, odd, odd_rows, rows):
    want = {e[2] for e in expected(rows, 5)}
    kept = near_dedup(docs, words=5)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert near_dedup(odd, words=5).columns == odd.columns
    groups = len({e[2] if e[2] is not None else e[1] for e in expected(odd_rows, 5)})
    assert near_dedup(odd, words=5).count() == groups


def test_fingerprint_of_long_text():
    text = "one two three four five " * 20000
    assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_empty(empty):
    assert near_duplicates(empty).collect() == [] and near_dedup(empty).collect() == []


def test_hot_fingerprints_meet_what_is_found(spark):
    from structura.llm.common import Scratch

    rows = [(k, 7) for k in range(5000)] + [(10_000 + k, k % 900) for k in range(2000)]
    fps = spark.createDataFrame(rows, "doc_id long, fp long").repartition(5)
    found = spark.createDataFrame([(k, k * 3) for k in range(900)], "fp long, label long")
    got = S.labelled(fps, found, Scratch(spark, "hot"))
    assert sorted(map(tuple, got.select("doc_id", "fp", "label").collect())) == sorted((i, f, f * 3) for i, f in rows)


def test_components_of_a_long_path(spark):
    from structura.llm.common import Scratch

    edges = spark.createDataFrame([(k, k + 1) for k in range(1500)] + [(5001, 5000)], "src long, dst long")
    got = {r.node: r.label for r in S.components(edges, Scratch(spark, "path")).collect()}
    assert got == {**{k: 0 for k in range(1501)}, 5000: 5000, 5001: 5000}
