import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from structura.llm.manifest import Forest, manifest

from .conftest import SCHEMA, plain


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, index):
    """The siblings left and right of a leaf, level by level."""
    out = []
    for level in levels[:-1]:
        run = index // 16 * 16
        out.append(("".join(level[run:index]), "".join(level[index + 1 : run + 16])))
        index //= 16
    return out


def expected(rows):
    """rows of (doc_id, text, lang, source, n_chars)."""
    hashed = [(source, i, H(*map(field, (i, source, lang, n, text))), text, lang, n) for i, text, lang, source, n in rows]
    hashed.sort(key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    sources = []
    for r in hashed:
        if not sources or sources[-1] != r[0]:
            sources.append(r[0])
    trees = [up([r[2] for r in hashed if r[0] == s]) for s in sources]
    top = up([t[-1][0] for t in trees])
    root, seen, out = top[-1][0], {}, []
    for source, i, leaf, text, lang, n in hashed:
        k = sources.index(source)
        at = seen[k] = seen.get(k, -1) + 1
        path = way(trees[k], at) + way(top, k)
        tampered = i is not None and text is not None and zlib.crc32(str(i).encode()) % 5 == 0
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if tampered else text
        h = H(*map(field, (i, source, lang, n, low)))
        for left, right in path:
            h = H(left, h, right)
        out.append((i, leaf, trees[k][-1][0], root, H(*[a + b for a, b in path]), h, h == root))
    return sorted(out, key=repr)


def tampered(c="doc_id"):
    return F.crc32(F.col(c).cast("string")) % 5 == 0


def data(seed, sizes):
    rng = random.Random(seed)
    rows, i = [], 0
    for source, n in sizes:
        for _ in range(n):
            i += 1
            text = rng.choice([None, "", "Ünïcode ÄB", "low", " ".join(rng.choice(["Word", "aB", "c", "Éa"]) for _ in range(30))])
            rows.append((rng.choice([i, i, i, i * 7919]), text, rng.choice([None, "en"]), source, rng.choice([None, len(text or "")])))
    rows += [(None, "Null Id", "en", "src1", 7), (None, None, None, None, None), rows[0], rows[0], (-5, "ABC", "de", "src1", 3)]
    rng.shuffle(rows)
    return rows


SIZES = [("one", 1), ("sixteen", 16), ("seventeen", 17), ("many", 700), (None, 33), ("", 2), ("é", 5), ("Z", 257), ("src1", 3), *[(f"s{k}", 1 + k % 3) for k in range(30)]]


def test_against_brute_force(spark):
    rows = data(1, SIZES)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = plain(manifest(df, changed=tampered()))
    assert got == expected(rows)
    assert {r[-1] for r in got} == {True, False}


def test_many_partitions(spark):
    rows = data(2, [("a", 900), ("b", 4)])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        assert plain(manifest(df, changed=tampered())) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("sizes", [[("one", 1)], [("a", 1), ("b", 1)], [("a", 16)], [(None, 5)]])
def test_small(spark, sizes):
    rows = [(k, f"Text {k}", "en", s, 6) for s, n in sizes for k in range(n)]
    assert plain(manifest(spark.createDataFrame(rows, SCHEMA), changed=tampered())) == expected(rows)


def test_untampered_all_verify(docs):
    assert manifest(docs).where("not verified").count() == 0


def test_odd(spark, docs, rows, empty):
    assert manifest(empty).collect() == []
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("leaf", "tree", "index", "group", "part", "_at", "size")])
    assert plain(manifest(clash)) == plain(manifest(docs)) == expected_all_verified(rows)


def expected_all_verified(rows):
    full = expected([(i, t, "en", "src0", len(t or "")) for i, t in rows])
    return sorted([(*r[:5], r[3], True) for r in full], key=repr)


def test_fragments_join_in_any_order():
    rng = random.Random(3)
    sizes = [1, 5, 40, 300]
    nodes = [(t, n, 0, k, H(str(t), str(k))) for t, n in enumerate(sizes) for k in range(n)]

    def joined(order, pieces):
        done, fragments = [], [Forest(len(sizes)) for _ in range(pieces)]
        for k, node in enumerate(order):
            done += fragments[k % pieces].add(*node)
        while len(fragments) > 1:
            rng.shuffle(fragments)
            for node in fragments.pop().nodes():
                done += fragments[0].add(*node)
        assert not list(fragments[0].nodes())
        return sorted(done)

    once = joined(nodes, 1)
    for pieces in (2, 3, 9):
        order = nodes[:]
        rng.shuffle(order)
        assert joined(order, pieces) == once
