import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from structura.llm import suffix_dedup, toxicity
from structura.llm.queries import ORACLE_SQL, QUERIES

from .test_similar import expected as near_kept

SF = "/root/testdata/sf0.001"


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [*(f"op{k}" for k in range(1, 11)), "pipeline"]
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    if model:
        rows = {i: t for i, t in rows.items() if toxicity.score(t.encode(), model) < 0.5}
    groups = {}
    for i, t in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        groups.setdefault("".join(t.split()), i)
    rows = {i: rows[i] for i in groups.values()}
    rows = {i: rows[i] for _, i in near_kept(list(rows.items()))}  # a likeness of 0.8 or more, by comparing all pairs
    spans = dict(zip(rows, suffix_dedup.brute_force(list(rows.values()), C.PASSAGE)))
    rows = {i: suffix_dedup.cut(t.encode(), np.array(spans[i], np.int64)).decode("utf-8", "ignore") for i, t in rows.items()}
    from structura.llm.bpe import encode

    tokens = {i: len(encode(P.path("byte_bpe_50k.json"), P.PATTERN, t)) + 1 for i, t in rows.items()}
    got = C.run(spark, SF).groupBy("doc_id").agg(F.sum("length")).collect()
    assert {r[0]: r[1] for r in got} == tokens


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_stage_on_odd_rows(spark, odd, empty, name, stage):
    more = odd.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    out = stage(spark, more, SF)
    assert stage(spark, empty, SF).count() == 0
    if stage is not C.STAGES[-1][1]:
        assert out.columns == C.COLUMNS and stage(spark, empty, SF).columns == C.COLUMNS


def test_exact_and_near_stages_keep_what_they_should(spark, odd, odd_rows):
    more = odd.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    best = {}
    for i, t in odd_rows:
        norm = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        order = (-len(t or ""), i is None, i or 0)
        best[norm] = min(best.get(norm, order), order)
    got = C.drop_exact_copies(spark, more, SF).collect()
    assert sorted((-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in got) == sorted(best.values())
    near = C.drop_near_copies(spark, more, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near) == near_kept(odd_rows)
