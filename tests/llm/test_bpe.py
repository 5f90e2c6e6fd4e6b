import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from structura.llm.bpe import decode, encode, encode_documents, load_ranks
from structura.llm.token_counts import brute_force, length_histogram, quantile, truncated_total, with_suffix_sums

from .conftest import plain, words

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


def expected(rows, own):
    out = []
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_whole_and_chunked(docs, rows, own):
    want = expected(rows, own)
    assert plain(encode_documents(docs, RANKS, P.PATTERN)) == want
    assert plain(encode_documents(docs, RANKS, P.PATTERN, chunk=300, overlap=40)) == want


def test_odd_rows(odd, odd_rows, own):
    assert plain(encode_documents(odd, RANKS, P.PATTERN, chunk=200, overlap=30)) == expected(odd_rows, own)


def test_chunks_of_awkward_texts(spark, own):
    rng = random.Random(2)
    texts = ["'s" * 900, " " * 700 + "a" + "\n" * 900, "ab'll " * 500, "\n \n" * 600 + "x", "é'd" * 500, "".join(rng.choice(" \n'sdl1aé!") for _ in range(4000)), "a" * 3000 + " b " * 400]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk, overlap in ((100, 20), (64, 63), (257, 11)):
        assert plain(encode_documents(df, RANKS, P.PATTERN, chunk=chunk, overlap=overlap)) == expected(rows, own)


def test_json_vocabulary_is_as_tokenizers_has_it(rows):
    t = Tokenizer.from_file(JSON)
    for _, text in rows:
        ids = encode(JSON, P.PATTERN, text or "")
        assert ids == t.encode(text or "", add_special_tokens=False).ids
        assert decode(JSON, P.PATTERN, ids).decode() == (text or "")


def test_token_counts(docs, rows, own):
    sums = with_suffix_sums(length_histogram(docs, RANKS, P.PATTERN)).cache()
    lengths = [len(own.encode_ordinary(t or "")) for _, t in rows]
    for r in sums.collect():
        assert (r.docs_over, r.tokens_over, r.truncated_tokens) == brute_force(lengths, r.n_tokens)
        assert r.n_docs == lengths.count(r.n_tokens) and r.total_tokens == sum(lengths)
        assert r.first_doc == min(i for (i, _), n in zip(rows, lengths) if n == r.n_tokens)
    for limit in (0, 1, 7, 100, 2048, 10**6):
        assert truncated_total(sums, limit) == brute_force(lengths, limit)[2]
    for share in (0.01, 0.5, 0.9, 1.0):
        assert quantile(sums, share) == sorted(lengths)[int(np.ceil(share * len(lengths))) - 1]


def test_empty(empty):
    assert encode_documents(empty, RANKS, P.PATTERN).collect() == []
    sums = with_suffix_sums(length_histogram(empty, RANKS, P.PATTERN))
    assert sums.collect() == [] and truncated_total(sums, 5) == 0 and quantile(sums, 0.5) is None


def test_words_helper():
    assert words(random.Random(1), 3)
