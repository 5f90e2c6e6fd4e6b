import math
import random

import pytest
from pyspark.sql import functions as F

from structura.llm import negatives as N

from .conftest import plain

KIND = "vec_id long, embedding array<float>, label int, q int, row int, group string"


def expected(rows, anchors=lambda i: i % 100 == 0, k=5):
    """rows of (vec_id, vector, label)."""
    own = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out, seen = [], set()
    for i, v, l in own:
        if i is None or not anchors(i) or (i, tuple(v), l) in seen:
            continue
        seen.add((i, tuple(v), l))
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), last(j), j, m) for j, w, m in own), key=lambda r: r[:2])
        for s, _, p, _ in [r for r in scored if r[3] == l and r[2] != i][:k]:
            fit = [r for r in scored if r[3] != l and 80 * -s <= 100 * -r[0] <= 100 * -s][:k]
            out += [(i, p, n + 1, j, -s, -t) for n, (t, _, j, _) in enumerate(fit)]
    return sorted(out, key=repr)


def vectors(seed, n, dim=8, clusters=6, labels=4):
    """Clusters of different sizes and norms; a third of all rows are near copies of one, some repeat, many scores tie."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    rows = []
    for i in range(n):
        m = middles[0] if rng.random() < 0.34 else rng.choice(middles)
        rows.append((i, [round(x + rng.choice([0, 0.02, 0.3]) * rng.gauss(0, 1), 2) for x in m], rng.randrange(labels)))
    return rows


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2, "g") for r in rows], KIND).repartition(5)
    return plain(N.hard_negatives(df, F.col("vec_id") % 100 == 0, **kw))


def single(rows):
    """Vectors as 32-bit floats hold them."""
    import numpy as np

    return [(i, v and [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP_LEAST", 4)  # several groups, crowded cells and blocks
    rows = vectors(1, 3000)
    got = mined(spark, rows)
    assert len(got) > 300 and got == expected(single(rows))


def test_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP_LEAST", 2)
    rows = vectors(2, 700, dim=3, clusters=40, labels=60)
    assert mined(spark, rows) == expected(single(rows))


def test_odd_rows(spark):
    rows = vectors(3, 320, dim=4)
    rows += [(400, None, 1), (500, [1.0, None, 0.0, 0.0], 1), (600, [float("nan"), 0.0, 0.0, 0.0], 1), (700, [float("inf"), 0.0, 0.0, 0.0], 1), (800, [1.0, 1.0, 0.0, 0.0], None), (None, [1.0, 1.0, 0.0, 0.0], 1), (None, [0.9, 1.0, 0.0, 0.0], 2)]
    rows += [rows[0], rows[0], rows[100], rows[1], rows[1], (0, rows[5][1], 2), (900, [], 1), (1000, [1.5], 1), (1001, [0.0] * 4, 0), (1100, [0.0] * 4, 1), (-200, [-1.0, -1.0, -1.0, -2.0], 2)]
    assert mined(spark, rows) == expected(single(rows))


def test_small_and_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.9, 0.2], 0), (3, [0.85, 0.0], 2)]
    assert mined(spark, rows) == expected(single(rows)) != []


def test_large_components(spark):
    rows = [(i, [x * 100000.0 for x in v], l) for i, v, l in vectors(4, 300, dim=4)]  # scores beyond 2**53
    assert mined(spark, rows) == expected(single(rows)) != []
    with pytest.raises(Exception, match="fit a long"):
        mined(spark, [(0, [1e30], 1), (1, [1.0], 1)])
