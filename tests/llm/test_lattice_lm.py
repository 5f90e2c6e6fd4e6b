import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from structura.llm import lattice_lm as M

PATH = P.path("piece_bpe_32k.model")


def every_segmentation(word, p):
    """Sum over all segmentations by plain recursion."""

    def inner(rest):
        if not rest:
            return 1.0
        total = sum(math.exp(p.inner[rest[:k]][1]) * inner(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in p.inner)
        if rest[0] not in p.inner:
            total += math.exp(sum(p.byte[b][1] for b in rest[0].encode())) * inner(rest[1:])
        return total

    return sum(math.exp(p.first[word[:k]][1]) * inner(word[k:]) for k in range(0, len(word) + 1) if word[:k] in p.first)


@pytest.fixture(scope="module")
def pieces():
    return M.build(PATH, M.initial_weights(PATH))


def test_forward_is_marginal(pieces):
    for word in ("the", "thonting", "haß", "été,", "中文字", "aሴb", "x" * 12, "ḁ"):
        assert math.exp(M.log_probability(word, pieces)) == pytest.approx(every_segmentation(word, pieces), rel=1e-9)


def test_long_word_does_not_underflow(pieces):
    assert -1e7 < M.log_probability("q" * 20000, pieces) < -1e4


def test_expected_counts_sum_to_pieces_used(pieces):
    """Expected counts are derivatives: a small change of a weight changes the log probability by count times change."""
    counts = M.expected_counts(["thonting"], pieces)
    k, w = pieces.inner["ing"]
    changed = M.Pieces(pieces.first, {**pieces.inner, "ing": (k, w + 1e-6)}, pieces.byte, pieces.longest, pieces.size)
    assert (M.log_probability("thonting", changed) - M.log_probability("thonting", pieces)) / 1e-6 == pytest.approx(counts[k], abs=1e-4)


def test_words_and_end_are_a_distribution(pieces):
    total = sum(math.exp(w) for _, w in [*pieces.first.values(), *pieces.inner.values()]) + sum(math.exp(w) for _, w in pieces.byte if w > -1e8)
    assert total == pytest.approx(1.0, abs=2e-2) and total <= 1.0 + 1e-9


def expected(rows, weights):
    split = [((t or "").encode().lower().split(), i is not None and zlib.crc32(str(i).encode()) % 10 == 0, i) for i, t in rows]
    c = Counter(w for ws, held, _ in split if not held for w in ws)
    docs = sum(not held for _, held, _ in split)
    n, v = sum(c.values()) + docs, len(c) + (docs > 0)
    once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    totals = M.Totals(n, v, docs, once, twice)
    p = M.build(PATH, weights)
    end = math.log(docs / (docs + sum(c.values())))
    out = []
    for ws, held, i in split:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) + math.log10((docs + 0.1) / (n + 0.1 * (v + 1)))
        score, seen = 0.0, Counter()
        for t, w in enumerate(ws):
            q = 10 ** totals.log10(c[w], M.log_probability(w.decode("utf-8", "replace"), p) + math.log1p(-math.exp(end)))
            share = 0.25 * t / (t + 30)
            q = (1 - share) * q + (share * seen[w] / t if t else 0)
            score += math.log10(q) if q > 0 else -float("inf")
            seen[w] += 1
        score += totals.log10(docs, end) + math.log10(1 - 0.25 * len(ws) / (len(ws) + 30))
        out.append((i, held, len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n, base, score))
    return out


@pytest.mark.parametrize("hot", [0, 5, 10**6])
def test_scores(docs, rows, odd, odd_rows, hot):
    for df, own in ((docs, rows), (odd, odd_rows)):
        words = sorted({w for i, t in own if not (i is not None and zlib.crc32(str(i).encode()) % 10 == 0) for w in (t or "").encode().lower().split()})
        counts = M.segment_counts([w.decode("utf-8", "replace") for w in words], PATH)
        usable = np.array(M._vocabulary(PATH)[2])
        total = np.where(usable, M.PRIOR + counts, 0.0)
        with np.errstate(divide="ignore"):
            weights = np.log(total / total.sum())
        got = sorted((tuple(r) for r in M.language_scores(df, PATH, hot=hot).collect()), key=repr)
        want = sorted(expected(own, weights), key=repr)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        for g, w in zip(got, want):
            assert g[5] == pytest.approx(w[5], rel=1e-9)
            if math.isfinite(w[6]):
                assert g[6] == pytest.approx(w[6], rel=1e-6)
            assert math.isfinite(g[6]) and g[6] <= 0


def test_empty(empty):
    assert M.language_scores(empty, PATH).collect() == []


def test_more_partitions_than_files(spark):
    """Scratch tables have 64 files here at most: several partitions run in one task, and no document gets another's rare words."""
    rows = [(k, f"thond w{k} w{k % 50} the") for k in range(400)]
    scores = lambda n: sorted(tuple(r) for r in M.language_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), PATH, hot=0).collect())
    few, many = scores(4), scores(200)
    assert [r[:5] for r in many] == [r[:5] for r in few]
    assert [r[5:] for r in many] == [pytest.approx(r[5:], rel=1e-9) for r in few]
