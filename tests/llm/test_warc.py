import base64
import gzip
import hashlib
import random

import pytest

from structura.llm import warc as W


def pages(spark):
    rng = random.Random(3)
    big = "<html>" + "ä" * 700
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a/9", big), (3, None, None), (4, "http://b\r\nX: y", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", "x" * 999), (8, "u", "x" * 999), (10, "u", "y" * 1000), (11, "u", "y" * 1000), (9, "http://a/9", big), (None, "n", big)]
    rows += [(k, f"http://c/{k}", "".join(rng.choice("abc <>\r\n\r\nWARC/1.1\x1f\x8b\x08") for _ in range(rng.randint(0, 3000)))) for k in range(20, 90)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def expected(rows):
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        keep = max((j for j, _, x in rows if (x or "") == (h or "") and j is not None), default=None)
        revisit = len(raw) >= 1000 and keep is not None and (i is None or i < keep)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [97, 4096, 1 << 20])
def test_round_trip(spark, tmp_path, split):
    rows, df = pages(spark)
    assert W.write_warc(df, str(tmp_path / "w")) == len(rows)
    got = []
    for r in W.read_warc(spark, str(tmp_path / "w"), split=split).collect():
        number = lambda s: int(s.split(":")[-1]) if s and "none" not in s else None
        if r.payload is not None:
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest
        got.append((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)))
    assert sorted(got, key=repr) == expected(rows)


def test_archives_are_plain_gzip(spark, tmp_path):
    rows, df = pages(spark)
    W.write_warc(df, str(tmp_path / "w"))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.warc.gz")))
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)
    assert b"sha1:" + base64.b32encode(hashlib.sha1(b"small").digest()) in text


def test_reader_passes_over_what_is_no_record(spark, tmp_path):
    one = W.record("urn:page:1", "u", b"payload", hashlib.sha1(b"payload").hexdigest())
    two = W.record("urn:page:2", "u", b"other" * 5000, hashlib.sha1(b"other" * 5000).hexdigest())
    junk = b"\x1f\x8b\x08junk" + gzip.compress(b"not a record") + b"\x1f\x8b\x08\x00"
    (tmp_path / "x.warc.gz").write_bytes(junk + one + junk + two + one[:20])
    for split in (10, 50, 10**6):
        assert sorted(r.record_id for r in W.read_warc(spark, str(tmp_path), split=split).collect()) == ["urn:page:1", "urn:page:2"]


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    (tmp_path / "w").mkdir()
    assert W.write_warc(df, str(tmp_path / "w")) == 0 and W.read_warc(spark, str(tmp_path / "w")).collect() == []
