import hashlib
from collections import Counter

from structura.llm.merkle import differing, edited, fingerprint_documents, fingerprint_with_next, likeness, tree

from .conftest import plain

BLANK = b" \t\n\x0b\x0c\r"


def digest(kind, data):
    return hashlib.blake2b(data, digest_size=16, person=kind).digest()


def phrases(text):
    """By a walk over the bytes, without the module's arrays."""
    out, begin = [], 0
    for k in range(1, len(text) + 1):
        ends_word = k < len(text) and text[k] in BLANK and text[k] != 10 and text[k - 1] not in BLANK
        a, b, c = (text[max(k - j, 0)] for j in (1, 2, 3))
        chosen = ends_word and ((a * 31 + b * 17 + c) * 2654435761 % 2**32 >> 24) % 3 == 0
        if chosen or text[k - 1] == 10 or k == len(text):
            out += [text[a : min(a + 128, k)] for a in range(begin, k, 128)]
            begin = k
    return out


def root(text):
    sections, section, paragraph = [], [], []
    line = b""
    own = phrases(text)
    for k, p in enumerate(own):
        paragraph.append(digest(b"phrase", p))
        line += p
        if p.endswith(b"\n") or k == len(own) - 1:
            section.append(digest(b"paragraph", b"".join(paragraph)))
            if section[-1][0] % 8 == 0 or not line.strip(BLANK) or k == len(own) - 1:
                sections.append(digest(b"section", b"".join(section)))
                section = []
            paragraph, line = [], b""
    return digest(b"root", b"".join(sections))


def alike(a, b):
    """Bytes of common phrases, all of them compared: equal branches hold equal phrases, so the descent gives the same."""
    if not a and not b:
        return 1.0
    x, y = Counter(phrases(a)), Counter(phrases(b))
    return 2 * sum(len(p) * n for p, n in (x & y).items()) / (len(a) + len(b))


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        new = t[: n - n // 2] + after[: n // 2]
        a, b, c = (x.encode() for x in (t, new, after))
        out.append((i, n, hashlib.sha256(b).hexdigest(), root(a).hex(), root(b).hex(), round(alike(a, b), 9), round(alike(a, c), 9)))
    return sorted(out, key=repr)


def rounded(df):
    return sorted([(*r[:5], round(r[5], 9), round(r[6], 9)) for r in plain(df)], key=repr)


def test_half_edited_texts_are_half_alike(spark):
    got = fingerprint_with_next(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    long = got.where("n_chars > 1000 and near_next < 0.05").collect()
    assert len(long) > 20 and all(0.3 < r.near_edited < 0.75 for r in long)


def test_all_identifiers_null(spark):
    one = spark.createDataFrame([(None, "only")], "doc_id long, text string")
    assert rounded(fingerprint_with_next(one)) == expected([(None, "only")])
    rows = [(None, f"row {k} of some") for k in range(9)]
    assert rounded(fingerprint_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == expected(rows)


def test_with_next(docs, rows):
    assert rounded(fingerprint_with_next(docs)) == expected(rows)


def test_odd_rows(odd, odd_rows):
    assert rounded(fingerprint_with_next(odd)) == expected(odd_rows)


def test_single_row(spark):
    df = spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")
    assert rounded(fingerprint_with_next(df)) == expected([(4, "abcdef")])


def test_tree_locates_an_edit():
    lines = [f"line {k} of some length\n" for k in range(200)]
    a = "".join(lines).encode()
    lines[77] = "another line\n"
    b = "".join(lines).encode()
    x, y = differing(tree(a), tree(b))
    assert len(x) == len(y) == 1
    assert a[slice(*x[0])] in b"line 77 of some length\n" and b"77" in a[slice(*x[0])] and b[slice(*y[0])] in b"another line\n"
    assert differing(tree(a), tree(a)) == ([], [])


def test_roots_and_phrases(rows):
    roots = {}
    for _, t in rows:
        raw = (t or "").encode()
        own = tree(raw)
        assert roots.setdefault(own.digest, raw) == raw and own.digest == root(raw)
        assert b"".join(raw[p.begin : p.end] for s in own.children for g in s.children for p in g.children) == raw
        assert likeness(own, tree(raw)) == 1.0
    assert edited("abcde", "XYZ") == "abcXY" and edited("abcd", "X") == "abX"


def test_nodes(docs, rows):
    got = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        assert got[i].fingerprint == root(raw).hex()
        for kind in ("section", "paragraph", "phrase"):
            assert b"".join(raw[n.first_byte : n.end_byte] for n in got[i].nodes if n.kind == kind) == raw


def test_empty(empty):
    assert fingerprint_with_next(empty).collect() == []
