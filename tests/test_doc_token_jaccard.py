import re

from structura.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def words(text):
    return {w for w in re.split(r"[^\w]+", text.lower()) if w}


def test_likest_of_all_items(spark):
    read = lambda name, i: {r[i]: words(r["text"]) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()}
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    want = {}
    for d, w in docs.items():
        scored = [(-round(len(w & v) / len(w | v), 6), i) for i, v in items.items() if w & v]
        if scored:
            want[d] = min(scored)
    got = {r.doc_id: (-r.score, r.item_id) for r in QUERIES["doc_token_jaccard"](spark, SF).collect()}
    assert got == want and len(want) > 0
