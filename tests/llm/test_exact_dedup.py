import hashlib
import re
from collections import defaultdict

from structura.llm.exact_dedup import exact_dedup, exact_groups

from .conftest import plain


def norm(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for key, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), k == 0, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups(docs, rows):
    assert plain(exact_groups(docs)) == expected(rows)


def test_odd_rows(odd, odd_rows):
    assert plain(exact_groups(odd)) == expected(odd_rows)


def test_group_over_many_partitions(spark):
    rows = [(k, "same text" + " " * (k % 3)) for k in range(500)] + [(1000 + k, f"other {k}") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert plain(exact_groups(df)) == expected(rows)
    assert sorted(r.doc_id for r in exact_dedup(df).collect()) == sorted({r[1] for r in expected(rows)})


def test_dedup_keeps_columns(odd, odd_rows):
    kept = exact_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        {k: v for k, v in ((e[4], (e[0], next(t for i, t in odd_rows if i == e[0] and hashlib.sha256(norm(t).encode()).hexdigest() == e[4]))) for e in expected(odd_rows) if e[3])}.values(), key=repr
    )


def test_empty(empty):
    assert exact_groups(empty).collect() == [] and exact_dedup(empty).collect() == []


def test_hot_group_over_more_partitions_than_files(spark):
    """Scratch tables have 64 files here at most: several range partitions run in one task."""
    rows = [(k, "same text" + " " * (k % 3)) for k in range(3000)] + [(5000 + k, f"other {k}") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert plain(exact_groups(df)) == expected(rows)
        assert sorted(r.doc_id for r in exact_dedup(df).collect()) == sorted({r[1] for r in expected(rows)})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
