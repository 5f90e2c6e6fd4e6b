import hashlib
import random

import numpy as np
import pytest

from structura.llm import suffix_dedup as S

from .conftest import plain, words


def expected(rows, length=S.LENGTH):
    out = []
    for (i, t), spans in zip(rows, S.brute_force([t or "" for _, t in rows], length)):
        raw = (t or "").encode()
        out.append((i, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(S.cut(raw, np.array(spans, np.int64).reshape(-1, 2))).hexdigest()))
    return sorted(out, key=repr)


def test_cover():
    assert {(a - b) % S.V for a in S.D for b in S.D} == set(range(S.V))


def test_against_brute_force(docs, rows):
    assert plain(S.suffix_dedup(docs)) == expected(rows)


def test_odd_rows(odd, odd_rows):
    assert plain(S.suffix_dedup(odd)) == expected(odd_rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlapping_passages(spark, seed):
    """Passages of lengths about the limit at any residue, in some or in all texts, within one text, and periodic."""
    rng = random.Random(seed)
    pool = [words(rng, 300) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.choice([395, 399, 400, 401, 410, 600, 900])], words(rng, rng.choice([0, 1, 30]))]
        rows.append((k, "".join(parts)))
    rows += [(100, "ab" * 700), (101, "x" * 400), (102, "x" * 401), (103, "y" * 399), (104, "é" * 250)]
    assert plain(S.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == expected(rows)


def test_stretches(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(S.stretches, "__defaults__", (S.LENGTH, 700))
    flat = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len((t or "").encode()) for _, t in rows])))
    starts = []
    for group in S.stretches(bounds, 400, 700):
        _, value, position, valid = S._gathered(flat, group, 400)
        starts += [(int(v), int(p)) for v, p in zip(value[valid], position[valid])]
    want = [(k, p) for k, (a, b) in enumerate(zip(bounds, bounds[1:])) for p in range(max(0, b - a - 399))]
    assert sorted(starts) == want


def test_empty(empty):
    assert S.suffix_dedup(empty).collect() == []


def test_crowded_names(spark):
    """One passage in far more documents than are asked about, cut at any place, with a few contexts that reach further."""
    rng = random.Random(9)
    hot, left = words(rng, 200), [words(rng, 12) for _ in range(5)]
    rows = []
    for k in range(150):
        a = rng.randrange(0, 300)
        rows.append((k, words(rng, rng.randint(0, 20)) + rng.choice(left)[rng.randrange(30) :] * (a == 0 or k % 3 == 0) + hot[a if k % 3 else 0 :][: rng.choice([390, 400, 405, 700])] + words(rng, 5)))
    assert plain(S.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))) == expected(rows)
