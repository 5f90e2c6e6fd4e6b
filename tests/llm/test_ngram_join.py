import random

import numpy as np

from structura.llm import ngram_join as J

from .conftest import SCHEMA, plain


def grams(text, n=3):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def expected(rows, need=90, n=3):
    sets, parent = [grams(t, n) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= need * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def joined(spark, rows, **kw):
    return plain(J.similar_sets(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(5), **kw))


def near(seed, texts=12, copies=9, words=300, edits=4, vocabulary=4000):
    """Copies with few words changed, of texts and of copies, so that likenesses lie on both sides of 0.9 and links form chains."""
    rng = random.Random(seed)
    out = []
    for _ in range(texts):
        first = len(out)
        out.append([f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(20, words))])
        for _ in range(copies):
            own = list(out[rng.randrange(first, len(out))])
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = f"{rng.choice('wv')}{rng.randrange(vocabulary)}"
            if rng.random() < 0.3:
                own = own[: -rng.randint(1, 12)]
            out.append(own)
    rows = [(k, " ".join(t)) for k, t in enumerate(out)]
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = near(1)
    got = joined(spark, rows)
    assert got == expected(rows)
    assert len({r[2] for r in got}) < len(rows) * 2 / 3


def test_other_parameters(spark):
    rows = near(2, texts=6, edits=12)
    assert joined(spark, rows, words=5, need=80) == expected(rows, 80, 5)


def lines(seed, n=260):
    """Texts put together from few frequent lines, many of equal size, so that prefixes are shared by many and groups have several members."""
    rng = random.Random(seed)
    pool = [" ".join(f"q{rng.randrange(900)}" for _ in range(12)) for _ in range(14)]
    rows = []
    for k in range(n):
        own = rng.sample(pool, rng.choice([10, 11, 11, 12]))
        if rng.random() < 0.6:
            own = sorted(own)
        rows.append((k, "\n".join(own)))
    return rows


def test_frequent_lines(spark):
    rows = lines(3)
    assert joined(spark, rows) == expected(rows)


def test_same_prefix_groups(spark, monkeypatch):
    """A sketch of two slots orders by hash, so groups with equal prefixes and different rests come up."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        own = list(base)
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(5)}"
        rows.append((k, " ".join(own)))
    assert joined(spark, rows) == expected(rows)
    classes = {frozenset(grams(t)) for _, t in rows}
    assert len(classes) > 40


def test_leaders_leave_a_rest(spark):
    """Copies just below the likeness of the leaders but not of each other: only the last pass links them."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for family in range(12):
        own = list(base)
        for k in rng.sample(range(200), 5):
            own[k] = f"f{family}x{k}"
        for copy in range(4):
            other = list(own)
            other[rng.randrange(200)] = f"c{family}y{copy}"
            rows.append((family * 4 + copy, " ".join(other)))
    got = joined(spark, rows)
    assert got == expected(rows)


def test_small_sizes(spark):
    words = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join(words[: n + 2])) for k, n in enumerate([1, 2, 8, 9, 10, 11, 18, 19, 20, 21, 9, 10])]
    assert joined(spark, rows) == expected(rows)


def test_fixtures(spark, docs, rows, odd, odd_rows, empty):
    assert plain(J.similar_sets(docs)) == expected(rows)
    assert plain(J.similar_sets(odd)) == expected(odd_rows)
    assert J.similar_sets(empty).collect() == []


def test_many_copies_over_partitions(spark):
    rows = [(k, "one two three four five six") for k in range(3000)] + [(5000 + k, f"a{k} b c d e") for k in range(50)]
    got = joined(spark, rows)
    assert [r[2] for r in got if r[0] < 5000] == [0] * 3000 and all(r[0] == r[2] for r in got if r[0] >= 5000)


def test_prefix_is_long_enough():
    for need in (50, 80, 90, 99):
        for n in range(1, 200):
            least = -(-need * n // 100)  # what a set alike shares at least
            assert J.prefix_length(n, need) == n - least + 1
            for m in range(least, n + 1):
                shared = J.least_shared(n, m, need)
                assert 100 * shared >= need * (n + m - shared) and not 100 * (shared - 1) >= need * (n + m - shared + 1)


def test_order_of_slots():
    tokens = J.shingles(b"A b  c\td a B c")
    assert len(tokens) == len(grams("a b c d a b c")) and (np.diff(tokens.astype(object)) > 0).all()
    assert (np.diff(J.slots(tokens)) >= 0).all()


def test_long_parities():
    rng = np.random.default_rng(6)
    for n, m in ((0, 0), (3, 5), (255, 300), (256, 1000), (3000, 3100), (700, 9000)):
        both = rng.integers(0, 2**64, n, np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 2**64, k, np.uint64)))) for k in (7, m))
        x, y = J.parities(a), J.parities(b)
        assert len(x) >= 4 and 64 * len(x) >= min(len(a), 256) and 64 * len(y) >= len(b)
        least = min(len(x), len(y))
        assert np.bitwise_count(J.folded(x, least) ^ J.folded(y, least)).sum() <= len(np.setxor1d(a, b))
        odd = np.bincount((b & np.uint64(255)).astype(int), minlength=256) & 1
        assert (J.folded(y, 4).view(np.uint8) == np.packbits(odd.astype(np.uint8), bitorder="little")).all()


def test_long_texts_that_differ_are_not_compared(spark, monkeypatch):
    """Pairs of long texts share their rarest tokens and differ in blocks that are frequent; 256 parities tell none of them apart."""
    rng = random.Random(7)
    blocks = [[f"b{rng.randrange(9000)}" for _ in range(300)] for _ in range(4)]
    rows = []
    for k in range(10):
        base = [f"t{k}x{rng.randrange(9000)}" for _ in range(1200)]
        rows += [(2 * k + side, " ".join(base + blocks[(k + side) % 4])) for side in (0, 1)]
    rows.append((90, rows[0][1] + " and more"))
    compared, asked = J.compared, []

    def counted(pairs, *rest):
        asked.extend(tuple(r) for r in pairs.collect())
        return compared(pairs, *rest)

    monkeypatch.setattr(J, "compared", counted)
    got = joined(spark, rows)
    assert got == expected(rows)
    assert [r[2] for r in got if r[0] == 90] == [0]
    assert len(asked) == 1  # the pair that links
