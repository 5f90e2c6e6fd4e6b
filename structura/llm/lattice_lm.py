"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary span a lattice over each word, with a blank mark before it. A forward recursion in log
space sums over all segmentations, so a word's probability is marginal, not that of one best cut. Piece weights are how
often the vocabulary's own scores choose each piece over the distinct words of the training rows, which rounds of
expectation-maximisation may refine. Words seen in training have one more arc over their whole length with an absolutely
discounted share; the mass set free goes to the lattice. A share of each token's probability that rises with its position
repeats the document's earlier words. All parts and the end token make a proper distribution over texts.

Counts are over all training documents. Scoring looks the most frequent words up in a broadcast table of a fixed number of
rows; all other words of a document meet the full word table in a join.
"""

from __future__ import annotations

import functools
import math
import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structura.llm.common import Scratch, byte_views, crc_mod, drawn_part, lean, shuffle_partitions, texts

#: Rows of the broadcast word table at most, and bytes of the longest word in it: the bound of what is broadcast.
HOT, HOT_BYTES = 300_000, 32
#: Rounds of expectation-maximisation, the Zipf law's offset for an empty training set, and each piece's count before any.
ROUNDS, OFFSET, PRIOR = 0, 3.0, 0.01
#: The share that repeats earlier words: REPEAT * t / (t + RAMP) after t words.
REPEAT, RAMP = 0.25, 30.0
#: A task's counter is emptied at so many distinct words.
FLUSH = 400_000
LOG10 = math.log(10.0)
_MARK = "▁"


@dataclass(frozen=True)
class Pieces:
    """Log weights: of pieces that begin a word (without their mark), of others, of single bytes; of the bare mark."""

    first: dict[str, tuple[int, float]]
    inner: dict[str, tuple[int, float]]
    byte: list[tuple[int, float]]
    longest: int
    size: int


@functools.lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[tuple[str, ...], tuple[float, ...], tuple[bool, ...]]:
    sp = _processor(path)
    n = sp.get_piece_size()
    usable = tuple(not (sp.is_control(k) or sp.is_unknown(k)) for k in range(n))
    return tuple(sp.id_to_piece(k) for k in range(n)), tuple(sp.get_score(k) for k in range(n)), usable


def initial_weights(path: str) -> np.ndarray:
    """Log weights from the vocabulary's scores: the k-th best piece has a weight in proportion to 1 / (k + OFFSET)."""
    _, scores, usable = _vocabulary(path)
    order = sorted((k for k, ok in enumerate(usable) if ok), key=lambda k: (-scores[k], k))
    w = np.zeros(len(scores))
    w[order] = 1.0 / (np.arange(len(order)) + OFFSET)
    with np.errstate(divide="ignore"):
        return np.log(w / w.sum())


def build(path: str, weights: np.ndarray) -> Pieces:
    pieces, _, usable = _vocabulary(path)
    first, inner, byte = {}, {}, [(0, -1e9)] * 256
    for k, piece in enumerate(pieces):
        if not usable[k]:
            continue
        w = (k, float(weights[k]))
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            byte[int(piece[3:5], 16)] = w
        elif piece.startswith(_MARK) and _MARK not in piece[1:]:
            first[piece[1:]] = w
        elif _MARK not in piece:
            inner[piece] = w
    return Pieces(first, inner, byte, max(map(len, [*first, *inner]), default=1), len(pieces))


def _arcs(word: str, p: Pieces) -> list[list[tuple[int, tuple[int, ...], float]]]:
    """For each end position the arcs (start, piece ids, log weight). Position 0 is after the mark, -1 before it."""
    n = len(word)
    out: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(n + 1)]
    first, inner, most = p.first, p.inner, p.longest
    if "" in first:
        out[0].append((-1, (first[""][0],), first[""][1]))
    for b in range(1, n + 1):
        own = out[b]
        for a in range(max(0, b - most), b):
            part = word[a:b]
            if a == 0 and part in first:
                own.append((-1, (first[part][0],), first[part][1]))
            if part in inner:
                own.append((a, (inner[part][0],), inner[part][1]))
        if word[b - 1] not in inner:  # no piece for this character: its bytes
            raw = [p.byte[x] for x in word[b - 1].encode("utf-8", "surrogatepass")]
            own.append((b - 1, tuple(k for k, _ in raw), sum(w for _, w in raw)))
    return out


def log_probability(word: str, p: Pieces) -> float:
    """Natural log of the sum over all segmentations of the marked word: forward recursion in log space."""
    n, first, inner, most = len(word), p.first, p.inner, p.longest
    exp, log = math.exp, math.log
    alpha = [-1e300] * (n + 1)
    alpha[0] = first[""][1] if "" in first else -1e9
    for b in range(1, n + 1):
        terms = []
        part = word[:b]
        if b <= most and part in first:
            terms.append(first[part][1])
        for a in range(b - most if b > most else 0, b):
            w = inner.get(word[a:b])
            if w is not None:
                terms.append(alpha[a] + w[1])
        if word[b - 1] not in inner:
            terms.append(alpha[b - 1] + sum(p.byte[x][1] for x in word[b - 1].encode("utf-8", "surrogatepass")))
        top = max(terms)
        alpha[b] = top if len(terms) == 1 else top + log(sum([exp(t - top) for t in terms]))
    return alpha[n]


def segment_counts(words: list[str], path: str) -> np.ndarray:
    """Uses of each piece when the vocabulary's scores segment each word once."""
    sp, n = _processor(path), len(_vocabulary(path)[0])
    ids = sp.encode(words, num_threads=1)
    flat = np.fromiter((k for own in ids for k in own), np.int64)
    return np.bincount(flat, minlength=n).astype(np.float64)


def expected_counts(words: list[str], p: Pieces) -> np.ndarray:
    """Expected uses of each piece over the segmentations of the words, each word once: forward and backward in log space."""
    counts = np.zeros(p.size)
    for word in words:
        arcs, n = _arcs(word, p), len(word)
        alpha, beta = [-1e300] * (n + 2), [-1e300] * (n + 2)  # index: position + 1
        alpha[0] = beta[n + 1] = 0.0
        for b in range(n + 1):
            terms = [alpha[a + 1] + w for a, _, w in arcs[b]]
            if terms:
                top = max(terms)
                alpha[b + 1] = top + math.log(sum([math.exp(t - top) for t in terms]))
        total = alpha[n + 1]
        for b in range(n, -1, -1):
            out = beta[b + 1]
            if out <= -1e299:
                continue
            for a, ids, w in arcs[b]:
                t = w + out
                u = alpha[a + 1] + t - total
                if u > -40:
                    u = math.exp(u)
                    for k in ids:
                        counts[k] += u
                x = beta[a + 1]
                beta[a + 1] = t if x <= -1e299 else (max(x, t) + math.log1p(math.exp(-abs(x - t))))
    return counts


@dataclass(frozen=True)
class Totals:
    """Over training tokens: all, distinct (end token included), training documents, words seen once and twice."""

    tokens: int
    distinct: int
    documents: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once else 0.0

    @property
    def free(self) -> float:
        """The share of the lattice."""
        return self.discount * self.distinct / self.tokens if self.tokens else 1.0

    def base(self, count: float) -> float:
        return math.log10((count + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def log10(self, count: int, lattice: float) -> float:
        """Of a token with this training count and this natural log probability in the lattice."""
        whole = (count - self.discount) / self.tokens if count > 0 else 0.0
        share = max(self.free, 1e-9) if self.tokens else 1.0
        sub = math.log(share) + lattice
        if whole <= 0:
            return sub / LOG10
        whole = math.log(whole)
        top = max(whole, sub)
        return (top + math.log(math.exp(whole - top) + math.exp(sub - top))) / LOG10


def word_counts(rows: DataFrame, parts: int) -> DataFrame:
    """(word, c): all words of rows (text, held_out) with their counts in training rows, 0 for others' words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            words = [*train, *(w for w in other if w not in train)]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([train.get(w, 0) for w in words], pa.int64())], names=["word", "n"])

        train: Counter = Counter()
        other: set = set()
        for batch in batches:
            for v, held in zip(byte_views(batch.column("text")), batch.column("held_out").to_pylist()):
                (other if held else train).update(bytes(v).lower().split())
                if len(train) + len(other) > FLUSH:
                    yield flush()
                    train, other = Counter(), set()
        yield flush()

    # Each task has counted its own rows, so a word comes once from each task at most.
    partial = rows.select("text", "held_out").mapInArrow(lean(count), "word binary, n long")
    return partial.repartition(parts, "word").groupBy("word").agg(F.sum("n").alias("c"))


def fit(counts: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the pieces from the distinct training words; what is summed is one row a piece and task."""
    usable = np.array(_vocabulary(path)[2])
    weights = None
    for _ in range(rounds + 1):
        raw = None if weights is None else weights.tobytes()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = None if raw is None else build(path, np.frombuffer(raw))
            total = np.zeros(len(_vocabulary(path)[0]))
            for batch in batches:
                words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
                total += segment_counts(words, path) if p is None else expected_counts(words, p)
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], names=["piece", "n"])

        found = counts.where("c > 0").select("word").mapInArrow(lean(count), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).orderBy("piece").collect()
        total = np.where(usable, PRIOR, 0.0)
        for r in found:
            if usable[r.piece]:
                total[r.piece] += r.n
        with np.errstate(divide="ignore"):
            weights = np.log(total / total.sum())
    return weights


def repeat_share(t: np.ndarray) -> np.ndarray:
    return REPEAT * t / (t + RAMP)


def ranks(ids: np.ndarray) -> np.ndarray:
    """How often each value occurred before."""
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    begins = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1)) if len(own) else np.zeros(0, np.int64)
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(ids)]))))
    return out


def _cutoff(words: DataFrame, most: int) -> int:
    """The least count that at most so many words reach, to an eighth of an octave: from a histogram of a few hundred rows."""
    step = F.floor(F.log2("c") * 8).cast("int")
    bins = words.where((F.col("c") > 0) & (F.length("word") <= HOT_BYTES)).groupBy(step.alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("least"))
    cutoff, total = 1 << 62, 0
    for r in sorted(bins.collect(), key=lambda r: -r.k):
        total += r.n
        if total > most:
            break
        cutoff = r.least
    return cutoff


def language_scores(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    A null text is an empty one: its only token is the end. A null identifier isn't held out. Repeated rows count each
    time. Without training rows the lattice alone, with its initial weights, gives the score. Empty table: no rows.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    scratch = Scratch(spark, "lm")
    rows = texts(df, id_col, text_col).withColumn("held_out", F.coalesce(crc_mod("doc_id", folds) == 0, F.lit(False)))
    counts = scratch.save(word_counts(rows, parts), "counts")
    s = counts.agg(F.sum("c"), F.sum(F.when(F.col("c") > 0, 1)), F.sum(F.when(F.col("c") == 1, 1)), F.sum(F.when(F.col("c") == 2, 1))).first()
    documents = rows.where(~F.col("held_out")).count()
    n_words = int(s[0] or 0)
    totals = Totals(n_words + documents, int(s[1] or 0) + (documents > 0), documents, int(s[2] or 0), int(s[3] or 0))
    weights = fit(counts, path) if n_words else initial_weights(path)
    # Pieces are drawn until one begins a new word, so the lattice sums to 1 over words; the end takes its share of tokens first.
    end = math.log(max(documents, 1) / (max(documents, 1) + max(n_words, 1)))
    rest = math.log1p(-math.exp(end)) if end < 0 else -50.0
    shared = spark.sparkContext.broadcast(weights.tobytes())

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = build(path, np.frombuffer(shared.value))
        for batch in batches:
            c = batch.column("c").to_pylist()
            words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            lp = [totals.log10(n, log_probability(w, p) + rest) for w, n in zip(words, c)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(lp, pa.float64())], names=["word", "c", "lp"])

    words = scratch.save(counts.mapInArrow(lean(rate), "word binary, c long, lp double"), "words")
    top = words.where((F.length("word") <= HOT_BYTES) & (F.col("c") >= _cutoff(words, hot))).toPandas()
    table = spark.sparkContext.broadcast(pickle.dumps((b"\n".join(map(bytes, top["word"])), top["c"].to_numpy(np.int64), top["lp"].to_numpy(np.float64))))
    token = uuid.uuid4().hex  # a Python worker may serve several queries
    end_base, end_score, end_known = totals.base(documents), totals.log10(documents, end), int(documents > 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = drawn_part(), 0
        known, base, p = _table(table)
        for batch in batches:
            out = []
            for doc_id, held, v in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), byte_views(batch.column("text"))):
                tokens = bytes(v).lower().split()
                at = np.fromiter(map(known.get, tokens, repeat(-1)), np.int64, len(tokens))
                t = np.flatnonzero(at >= 0)
                hit = at[t]
                share = repeat_share(t)
                total = float(np.log10((1 - share) * p[hit] + share * ranks(hit) / np.maximum(t, 1)).sum())
                rare: dict[bytes, list[int]] = {}
                for k in np.flatnonzero(at < 0).tolist():
                    rare.setdefault(tokens[k], []).append(k)
                last = end_score + math.log10(1 - float(repeat_share(len(tokens))))
                seen = int((base[1][hit] > 0).sum())
                out.append((part, n, doc_id, held, len(tokens) + 1, seen + end_known, float(base[0][hit].sum()) + end_base, total + last, list(rare), list(rare.values())))
                n += 1
            columns = list(zip(*out)) if out else [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[f for f, _ in fields])

    def _table(shared_table):
        if _CACHE.get("id") != token:
            joined, c, lp = pickle.loads(shared_table.value)
            _CACHE.clear()
            _CACHE["id"] = token
            b = np.log10((c + 0.1) / (totals.tokens + 0.1 * (totals.distinct + 1)))
            _CACHE["table"] = ({w: k for k, w in enumerate(joined.split(b"\n"))} if len(c) else {}, (b, c), 10.0**lp)
        return _CACHE["table"]

    fields = [("part", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary())), ("at", pa.list_(pa.list_(pa.int32())))]
    found = scratch.save(rows.mapInArrow(lean(score), "part long, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>, at array<array<int>>"), "scored")
    rare = found.select("part", "row", F.explode(F.arrays_zip("rare", "at")).alias("w")).select("part", "row", F.col("w.rare").alias("word"), F.col("w.at").alias("at"))
    base = F.log10((F.col("c") + 0.1) / F.lit(totals.tokens + 0.1 * (totals.distinct + 1)))
    share = lambda t: F.lit(REPEAT) * t / (t + F.lit(RAMP))
    # The first occurrence in log space: a long word's probability may be too small for a double.
    each = F.transform("at", lambda t, j: F.when(j == 0, F.col("lp") + F.log10(1 - share(t))).otherwise(F.log10((1 - share(t)) * F.pow(F.lit(10.0), F.col("lp")) + share(t) * j / t)))
    sums = rare.join(words, "word").groupBy("part", "row").agg(
        F.sum(F.when(F.col("c") > 0, F.size("at")).otherwise(0)).alias("k"), F.sum(base * F.size("at")).alias("b"), F.sum(F.aggregate(each, F.lit(0.0), lambda a, x: a + x)).alias("s")
    )
    return found.join(sums, ["part", "row"], "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )


_CACHE: dict = {}
