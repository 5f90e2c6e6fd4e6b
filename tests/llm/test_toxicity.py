import random
import zlib

import pytest

from structura.llm import toxicity as X

from .conftest import SCHEMA, words


def corpus(n=1500, seed=4):
    """Invented prose, of which a fifth has a few words of a small list inserted."""
    rng = random.Random(seed)
    bad = ["vilkrat", "morbune", "skragging", "pultosh"]
    rows = []
    for i in range(n):
        own = " ".join(rng.choice("th nd er ing on re an the of and".split()) + rng.choice("ou ed es ti ar".split()) for _ in range(rng.randint(20, 200))).split(" ")
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 6)):
                own.insert(rng.randrange(len(own)), rng.choice(bad))
        rows.append((i, " ".join(own), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], SCHEMA).repartition(3)
    return rows, docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(labelled):
    rows, docs, labels = labelled
    model = X.fit(docs, labels)
    got = {r.doc_id: r for r in X.toxicity(docs, model).collect()}
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows)
    held = [i for i in got if got[i].held_out]
    assert set(held) == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_filter_agrees_with_scores(labelled):
    _, docs, labels = labelled
    model = X.fit(docs, labels)
    kept = X.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in X.toxicity(docs, model).where("predicted = 0").collect()}


def test_labels_of_held_out_rows_are_not_read(labelled, spark):
    rows, docs, labels = labelled
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert X.fit(docs, labels) == X.fit(docs, flipped)


def test_odd_and_empty(odd, docs, empty, labelled, spark):
    model = X.fit(labelled[1], labelled[2])
    assert X.toxicity(odd, model).count() == odd.count() and X.drop_toxic(odd, model).columns == odd.columns
    assert X.toxicity(empty, model).collect() == [] and X.drop_toxic(empty, model).collect() == []
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert X.fit(docs, nothing) is None
    assert {r.score for r in X.toxicity(docs, None).collect()} == {0.0}
    assert words(random.Random(1), 2)
