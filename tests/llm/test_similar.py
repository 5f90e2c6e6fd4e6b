import random

from corpus_pipeline import drop_near_copies
from structura.llm.similar import similar_dedup

from .conftest import SCHEMA


def shingles(text, n=5):
    words = (text or "").lower().encode().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def expected(rows):
    """Smallest identifier of each component, by comparing all pairs of sets."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and both >= 0.8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        own = (i is None, i or 0)
        least[find(k)] = min(own, least.get(find(k), own))
    return sorted(least.values())


def edited():
    """Copies with up to 14 words changed in 100 to 400, so that likenesses lie on both sides of 0.8, and chains of copies of copies."""
    rng = random.Random(8)
    out = []
    for _ in range(30):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(100, 400))]
        out.append(text)
        for _ in range(8):
            own = list(rng.choice([text, out[-1]]))
            for _ in range(rng.randint(1, 14)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(5000)}"
            out.append(own)
    return [(k, " ".join(t)) for k, t in enumerate(out)]


def kept(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


def test_stage_against_all_pairs(spark):
    rows = edited()
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(5)
    want = expected(rows)
    assert 30 <= len(want) < len(rows)
    assert kept(drop_near_copies(spark, df, "")) == want


def test_fixtures(docs, rows, odd, odd_rows):
    assert kept(similar_dedup(docs)) == expected(rows)
    assert similar_dedup(odd).columns == odd.columns and kept(similar_dedup(odd)) == expected(odd_rows)


def test_empty(empty):
    assert similar_dedup(empty).collect() == []
