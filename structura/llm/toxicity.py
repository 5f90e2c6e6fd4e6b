"""Toxicity by compression distance.

Zstandard trains two dictionaries on labelled rows: one on the windows of ordinary texts, one on those spans of toxic texts
that a likelihood ratio of byte n-grams (of several lengths) favours, each as often as it occurs: a toxic document is
ordinary in most of its words, and a dictionary of whole toxic texts would hold those. When windows are compressed, the
toxic dictionary has the ordinary one before it, so what is ordinary compresses alike with either, and the difference of
the two lengths is what the toxic spans save. A document's features are its largest difference, the sum of those beyond a
threshold and its number of windows; a logistic curve, fitted on labelled rows that neither dictionary saw, makes them a
score. Labels, language, source and identifier are no inputs of a score.
"""

from __future__ import annotations

import functools
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structura.llm.common import byte_views, crc_mod, lean, texts

#: The bound of the training sample: so many rows of each class at most, by hash of the identifier, and of each row's text
#: so many code points at most (longer rows aren't sampled). Scoring knows no such bound.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 2000, 4000, 16_384
#: Words in a window, the shortest match that counts, bytes of the two dictionaries.
WINDOW, MATCH, ORDINARY_BYTES, TOXIC_BYTES = 8, 6, 8192, 2048
#: Lengths of n-grams. One is toxic if so large a share of toxic documents has it, and so many times the share of ordinary ones.
GRAMS, SHARE, TIMES = (5, 6, 7, 8), 0.006, 20
#: Spans in a sample that zstandard trains on, and how often one span is repeated in samples at most.
SPANS, REPEATS = 16, 200
#: No text's words contain it: they are split at white space and control characters are rare.
SEPARATOR = b"\x00"
#: Differences from this on add to a document's sum.
GAIN = 2


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, float, float, float]


def _normal(text: bytes) -> bytes:
    return b" " + b" ".join(text.lower().split()) + b" "


def _windows(text: bytes, width: int = WINDOW) -> list[bytes]:
    words = text.lower().split()
    return [b" " + b" ".join(words[k : k + width]) + b" " for k in range(0, len(words), width)]


def _grams(text: bytes) -> set[bytes]:
    """N-grams of each word between two blanks: spans stay within words."""
    out: set[bytes] = set()
    for word in set(text.split()):
        word = b" " + word + b" "
        for n in GRAMS:
            out.update(word[k : k + n] for k in range(len(word) - n + 1))
    return out


def _trained(samples: list[bytes], size: int, fallback: bytes, segment: int = 48) -> bytes:
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except z.ZstdError:  # too few or too short samples to train on
        return fallback[-size:]


def _apart(group: list[bytes]) -> list[bytes]:
    """The texts less those that share passages with an earlier one: a group of copies must not count as many documents."""
    seen: set[int] = set()
    out = []
    for text in group:
        words = text.lower().split()
        own = {h for h in (zlib.crc32(b" ".join(words[k : k + 6])) for k in range(max(1, len(words) - 5))) if h % 8 == 0}
        if len(own & seen) * 4 <= len(own):
            out.append(text)
        seen |= own
    return out


def toxic_spans(toxic: list[bytes], ordinary: list[bytes]) -> Counter:
    """Maximal runs of toxic n-grams in the words of toxic texts, and how often each occurs."""
    in_toxic, in_ordinary = Counter(g for t in toxic for g in _grams(t)), Counter(g for t in ordinary for g in _grams(t))
    least = max(3, SHARE * len(toxic))
    marked = {g for g, n in in_toxic.items() if n >= least and n / len(toxic) >= TIMES * (in_ordinary[g] + 0.5) / len(ordinary)}
    spans: Counter = Counter()
    for word, times in Counter(w for t in toxic for w in t.split()).items():
        word = b" " + word + b" "
        covered = np.zeros(len(word) + 2, np.int8)
        for n in GRAMS:
            for k in range(len(word) - n + 1):
                if word[k : k + n] in marked:
                    covered[k + 1 : k + n + 1] = 1
        edges = np.flatnonzero(np.diff(covered)).tolist()
        for begin, end in zip(edges[::2], edges[1::2]):
            spans[word[begin:end]] += times
    return spans


def _span_samples(spans: Counter) -> list[bytes]:
    """What zstandard trains the toxic dictionary on: the spans in a fixed shuffled order, some in each sample."""
    each = [s for s, n in sorted(spans.items()) for _ in range(min(n, REPEATS))]
    order = np.random.default_rng(42).permutation(len(each)).tolist()
    return [SEPARATOR.join(each[i] for i in order[k : k + SPANS]) for k in range(0, len(order), SPANS)]


def _compressor(content: bytes):
    import zstandard as z

    p = z.ZstdCompressionParameters(
        window_log=17, chain_log=15, hash_log=15, search_log=6, min_match=MATCH, target_length=64, strategy=z.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return z.ZstdCompressor(dict_data=d, compression_params=p)


@functools.lru_cache(maxsize=4)
def _compressors(toxic: bytes, ordinary: bytes):
    return _compressor(toxic), _compressor(ordinary)


def features(text: bytes, toxic: bytes, ordinary: bytes) -> tuple[float, float, float]:
    with_toxic, with_ordinary = _compressors(toxic, ordinary)
    top = total = 0
    windows = _windows(text)
    for w in windows:
        gain = len(with_ordinary.compress(w)) - len(with_toxic.compress(w))
        top = max(top, gain)
        total += gain if gain >= GAIN else 0
    return float(top), float(np.log1p(total)), float(np.log1p(len(windows)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(x.shape[1]), x.T @ (y - p) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(toxic: list[str], ordinary: list[str]) -> Model | None:
    """A model from whole texts of either class, or None where one is missing. Each fourth text calibrates the curve."""
    raw = [_apart([t.encode() for t in own]) for own in (toxic, ordinary)]
    if min(map(len, raw)) < 4:
        return None
    fit = [[t for k, t in enumerate(own) if k % 4] for own in raw]
    held = [[t for k, t in enumerate(own) if k % 4 == 0] for own in raw]
    spans = toxic_spans([_normal(t) for t in fit[0]], [_normal(t) for t in fit[1]])
    windows = [w for t in fit[1] for w in _windows(t, 2 * WINDOW)]
    common = _trained(windows[:: max(1, len(windows) // 50_000)], ORDINARY_BYTES, b"".join(windows))
    # Separators keep matches from running over two spans. Padding keeps the distances of ordinary matches equal.
    listed = SEPARATOR.join(s for s, _ in sorted(spans.items(), key=lambda x: (x[1], x[0])))
    own = _trained(_span_samples(spans), TOXIC_BYTES, listed, 64)
    common, own = common + SEPARATOR * len(own), common + own
    x = np.array([(1.0, *features(t, own, common)) for group in held for t in group])
    y = np.array([1.0] * len(held[0]) + [0.0] * len(held[1]))
    return Model(own, common, tuple(_logistic(x, y)))


def score(text: bytes, model: Model) -> float:
    z = float(np.dot(model.weights, (1.0, *features(text, model.toxic, model.ordinary))))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> Model | None:
    """Train on a bounded sample of the labelled rows whose crc32 of the identifier as text isn't 0 modulo folds.

    Null labels, identifiers and texts aren't sampled; a repeated identifier counts once, with its least text.
    """
    known = labels.where((crc_mod(id_col, folds) != 0) & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = texts(docs.where(F.col(text_col).isNotNull()), id_col, text_col).where(F.length("text") <= SAMPLE_CHARS)
    ids = None
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY)):
        own = known.where(F.col("label") == label).groupBy("doc_id", "label").agg(F.count("*")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "label")
        ids = own if ids is None else ids.unionByName(own)
    found = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # so many identifiers at most
    picked: dict[int, list[str]] = {0: [], 1: []}
    for r in sorted(found.withColumn("h", F.xxhash64("doc_id")).collect(), key=lambda r: (r.h, r.doc_id)):
        picked[r.label].append(r.text)
    return train(picked[1], picked[0])


_STATE: dict[bytes, Model] = {}


def _model(raw: bytes) -> Model | None:
    if raw not in _STATE:
        _STATE.clear()
        _STATE[raw] = pickle.loads(raw)
    return _STATE[raw]


def toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out (the remainder is 0), score, predicted: one row per input row, over whole texts.

    A null text scores as an empty one. Without a model (too few labelled rows) every score is 0. A null identifier isn't held out.
    """
    raw = pickle.dumps(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(raw)
        for batch in batches:
            scores = [score(bytes(v), m) if m else 0.0 for v in byte_views(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = texts(docs, id_col, text_col).mapInArrow(lean(apply), "doc_id long, score double")
    held = F.coalesce(crc_mod("doc_id", folds) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below 0.5, with all their columns. Nothing is shuffled."""
    if model is None:
        return docs
    raw = pickle.dumps(model)

    def rate(text):
        import pandas as pd

        m = _model(raw)
        return pd.Series([score((t or "").encode(), m) < 0.5 for t in text])

    return docs.where(F.pandas_udf(rate, "boolean")(F.col(text_col)))
