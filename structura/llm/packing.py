"""Best-fit packing by patterns that a non-negative least squares fit repeats.

Documents longer than a sequence are cut into full pieces, the first of them shorter. The histogram of piece lengths has a
bin for each length and so a fixed size. On the driver, patterns of two or three lengths that fill a sequence are
enumerated, repeat counts are fitted to the histogram by non-negative least squares, rounded while pieces last, and what is
left is packed best-fit decreasing, whole counts at a time. The plan is a list of ranges: of the pieces of one length, in
order, these go to those sequences at that offset. Executors number the pieces of each length and look their places up.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structura.llm.bpe import encode
from structura.llm.common import Scratch, drawn_part, lean, shuffle_partitions, texts

#: Lengths in triples are enumerated in steps, so that a long sequence has a bounded number of patterns.
PATTERNS = 400_000
ITERATIONS = 200


def patterns(size: int, counts: np.ndarray) -> np.ndarray:
    """Rows of three lengths, descending, that sum to size; 0 for none. Only lengths that occur, PATTERNS at most.

    Where there are more, triples whose longest length is a multiple of the smallest step that fits are left.
    """
    have = np.flatnonzero(counts[: size + 1])
    have = have[have > 0]
    present = np.zeros(size + 1, bool)
    present[have] = True
    pairs = [(a, size - a, 0) for a in have[have * 2 >= size].tolist() if size - a > 0 and present[size - a]]
    total = max(1, len(have) * len(have) // 12)
    step = -(-total // PATTERNS)
    rows = [np.array(pairs, dtype=np.int32).reshape(-1, 3)]
    for a in have[have * 3 >= size][::step].tolist():
        rest = size - a
        b = have[(have <= min(a, rest - 1)) & (have * 2 >= rest)]
        b = b[present[rest - b]]
        rows.append(np.stack([np.full(len(b), a), b, rest - b], axis=1).astype(np.int32))
    return np.concatenate(rows)


def fit(rows: np.ndarray, counts: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, by accelerated projected gradients on the sparse matrix A."""
    if not len(rows):
        return np.zeros(0)
    n, target = len(counts), counts.astype(np.float64)
    weight = (rows > 0).astype(np.float64)
    target[0] = 0.0

    def times(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(rows[:, k], x * weight[:, k], n) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[rows[:, k]] * weight[:, k] for k in range(3))

    v = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue of A'A bounds the step
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1.0 / (1.05 * norm)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(iterations):
        after = np.maximum(0.0, y - step * back(times(y) - target))
        t_after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


def plan(counts: np.ndarray, size: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges (length, first rank, number, first sequence, offset) that place all pieces: counts[k] of length k, k <= size.

    The n-th piece of a range goes to the n-th sequence from its first one, at its offset.
    """
    left = counts.astype(np.int64).copy()
    used = np.zeros(len(counts), np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(lengths: list[int], times: int) -> None:
        nonlocal sequences
        at = 0
        for length in lengths:
            out.append((length, int(used[length]), times, sequences, at))
            used[length] += times
            left[length] -= times
            at += length
        sequences += times

    if left[size]:
        place([size], int(left[size]))
    rows = patterns(size, left)
    x = fit(rows, left)
    for k in np.argsort(-x, kind="stable").tolist():
        wanted = int(np.ceil(x[k] - 1e-6))
        if wanted <= 0:
            break
        lengths = [int(a) for a in rows[k] if a]
        if all(left[a] for a in lengths):
            most = min(int(left[a]) // lengths.count(a) for a in lengths)
            if most > 0:
                # A pattern that names a length twice takes two runs of its pieces.
                place(lengths, min(wanted, most))
    _best_fit(left, place, size)
    return out


def _best_fit(left: np.ndarray, place, size: int) -> None:
    """What is left, longest first: each open pattern takes the longest piece that still fits, as often as counts allow."""
    while True:
        have = np.flatnonzero(left)
        have = have[have > 0]
        if not len(have):
            return
        room, lengths, taken = size, [], {}
        while room > 0:
            fits = have[: np.searchsorted(have, room, side="right")]
            pick = next((int(a) for a in fits[::-1] if left[a] > taken.get(int(a), 0)), 0)
            if not pick:
                break
            lengths.append(pick)
            taken[pick] = taken.get(pick, 0) + 1
            room -= pick
        place(lengths, min(int(left[a]) // n for a, n in taken.items()))


def split(n_tokens: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: one if the document fits, else full ones after a first that may be shorter."""
    if n_tokens <= size:
        return [(0, n_tokens)]
    first = n_tokens % size or size
    return [(0, first), *[(s, size) for s in range(first, n_tokens, size)]]


def pack(df: DataFrame, path: str, pattern: str, end_id: int = 0, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece of every row of df.

    A document is its ids and then end_id, so a null or empty text has one token. Documents keep no order. Repeated rows
    are packed each. Null identifiers stay null. Empty table: no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = drawn_part(), np.zeros(size + 1, np.int64)
        kinds = [("part", pa.int64()), ("rank", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(path, pattern, text), end_id], dtype="<u4")
                for k, (start, length) in enumerate(split(len(ids), size)):
                    out.append((part, int(seen[length]), doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    seen[length] += 1
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])

    pieces = scratch.save(texts(df, id_col, text_col).mapInArrow(lean(cut), "part long, rank long, doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    # Each partition has numbered its own pieces of each length. What comes before a partition's is a sum over partitions, not over pieces.
    per_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `size` rows
        counts[r.length] = r.n
    ranges = np.array(plan(counts, size), dtype=np.int64).reshape(-1, 5)
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    # At most three ranges a pattern and what best-fit adds: bounded by PATTERNS and the number of lengths.
    shared = spark.sparkContext.broadcast(pickle.dumps(ranges))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pickle.loads(shared.value)
        shift = np.int64(1) << np.int64(48)
        keys = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            length = batch.column("length").to_numpy()
            at = table[np.searchsorted(keys, length * shift + rank, side="right") - 1] if len(table) else table
            own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(at[:, 3] + rank - at[:, 1]), pa.array(at[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = pieces.repartition(shuffle_partitions(spark), "part", "length").join(bases, ["part", "length"])
    return numbered.mapInArrow(lean(look_up), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
