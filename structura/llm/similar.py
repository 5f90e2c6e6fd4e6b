"""Near-duplicates by Jaccard: texts whose sets of word shingles have a likeness of LEAST or more are linked.

Candidates come from two coverings. SimHash fingerprints of the shingles meet at their anchors (simhash.links: all pairs
within its threshold). As sets of likeness 0.8 differ in 4 to 16 bits, more than anchors can cover, a set also has the
minima of BANDS x ROWS hashes as BANDS keys of ROWS minima each: two sets of likeness 0.8 share none of them with a
probability of (1 - 0.8 ** ROWS) ** BANDS = 4e-9, so what the keys leave out is nothing that a corpus would show.
Texts that share a key or are linked, directly or through others, form a candidate group. Every link lies within one group,
whose sets meet in one task, once, and are compared exactly: a search from set to set, as in simhash, so that a group of
near copies takes a comparison each. A group is as large as its texts are many: its sets have to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structura.llm.common import Scratch, byte_views, lean, shuffle_partitions, texts
from structura.llm.simhash import components, keep_first, links, majority, shingle_hashes

LEAST = 0.8
BANDS, ROWS = 64, 6
SLOTS = 1 << 22
_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(text, words))


def name(shingles: np.ndarray) -> int:
    """A set's name: the XXH64 hash of its bytes."""
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes(), 42)


def keys(shingles: np.ndarray) -> np.ndarray:
    """The set's BANDS keys of 64 bits. Equal minima in a band give equal keys."""
    low, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 1024):
        least = np.minimum(least, (low[k : k + 1024, None] * _TIMES + _PLUS).min(axis=0))
    mixed = (least.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(31)
    return mixed * np.uint64(0x9E3779B97F4A7C15)


def candidates(distinct: DataFrame, parts: int) -> DataFrame:
    """(src, dst): each set (columns fp, keys) that shares a key with others and the smallest of those."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(v, np.uint64) for v in byte_views(batch.column("keys"))]
            if not own:
                continue
            key, value = np.concatenate(own), np.repeat(batch.column("fp").to_numpy(), BANDS)
            bucket = (key >> np.uint64(40)) % np.uint64(parts)
            order = np.argsort(bucket, kind="stable")
            key, value, bucket = key[order], value[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            rows = [(int(bucket[a]), k.tobytes(), v.tobytes()) for a, k, v in zip(np.concatenate(([0], cuts)), np.split(key, cuts), np.split(value, cuts))]
            b, k, v = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(v, pa.binary())], names=["bucket", "keys", "fps"])

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fps = [], []
        for batch in batches:
            own += [np.frombuffer(v, np.uint64) for v in byte_views(batch.column("keys"))]
            fps += [np.frombuffer(v, np.int64) for v in byte_views(batch.column("fps"))]
        if not own:
            return
        key, value = np.concatenate(own), np.concatenate(fps)
        order = np.lexsort((value, key))
        key, value = key[order], value[order]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
        least = np.repeat(value[starts], np.diff(np.concatenate((starts, [len(key)]))))
        other = least != value
        if other.any():
            pairs = np.unique(np.stack([least[other], value[other]]), axis=1)
            for k in range(0, pairs.shape[1], 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0, k : k + (1 << 16)]), pa.array(pairs[1, k : k + (1 << 16)])], names=["src", "dst"])

    arrays = distinct.select("fp", "keys").mapInArrow(lean(replicate), "bucket int, keys binary, fps binary")
    return arrays.repartition(parts, "bucket").select("keys", "fps").mapInArrow(lean(star), "src long, dst long").distinct()


def anchored(distinct: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """(src, dst): links between sets (columns fp, sim) whose fingerprints are equal or within simhash's threshold."""
    heads = scratch.save(distinct.groupBy("sim").agg(F.min("fp").alias("head")), "heads")
    star = distinct.select("sim", "fp").join(heads, "sim").where("fp <> head").select(F.col("head").alias("src"), F.col("fp").alias("dst"))
    found = links(heads.select(F.col("sim").alias("fp")), parts)
    end = lambda c: heads.select(F.col("sim").alias(c), F.col("head").alias(f"{c}_head"))
    return star.unionByName(found.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_head").alias("src"), F.col("dst_head").alias("dst")))


def connect(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """The number of each set's component, where sets of that likeness or more are linked. Sets aren't empty."""
    label = np.full(len(sets), -1)
    sizes = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    marked = np.zeros(len(values), bool)
    left = np.arange(len(sets))
    packed, starts = flat, bounds[:-1]
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first] = first
        queue = [first]
        while queue:
            x = queue.pop()
            keep = label[left] < 0
            if keep.sum() * 2 < len(left):  # the reached go once they are half
                left = left[keep]
                packed = np.concatenate([flat[bounds[i] : bounds[i + 1]] for i in left]) if len(left) else flat[:0]
                starts = np.concatenate(([0], np.cumsum(sizes[left])[:-1])) if len(left) else bounds[:0]
            if not len(left):
                break
            own = flat[bounds[x] : bounds[x + 1]]
            marked[own] = True
            shared = np.add.reduceat(marked[packed], starts, dtype=np.int64)
            marked[own] = False
            near = left[(shared >= least * (sizes[left] + len(own) - shared) - 1e-9) & (label[left] < 0)]
            label[near] = first
            queue += near.tolist()
    return label


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (label, fp, shingles), sorted by label: (fp, label), now of sets that are linked."""
    held, now = {}, None

    def close() -> pa.RecordBatch:
        fps = np.array(list(held), np.int64)
        found = connect(list(held.values()))
        return pa.RecordBatch.from_arrays([pa.array(fps), pa.array(fps[found])], names=["fp", "label"])

    for batch in batches:
        for label, fp, raw in zip(batch.column("label").to_pylist(), batch.column("fp").to_pylist(), byte_views(batch.column("shingles"))):
            if label != now and held:
                yield close()
                held = {}
            now = label
            if fp not in held:
                held[fp] = np.frombuffer(bytes(raw), np.uint64)
    if held:
        yield close()


def classes(df: DataFrame, fps: DataFrame, scratch: Scratch, id_col: str, text_col: str, words: int) -> DataFrame:
    """(fp, label): for every set of fps (doc_id, fp, keys, sim), the component of sets that links connect."""
    parts = shuffle_partitions(df.sparkSession)
    distinct = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.min("sim").alias("sim")), "distinct")
    filled = distinct.where(F.col("fp") != F.lit(_signed(name(shingle_set(b"")))))
    groups = components(candidates(filled, parts).unionByName(anchored(filled, parts, scratch)), scratch)
    distinct = scratch.save(distinct.select("fp", "rep"), "names")
    scratch.drop("distinct")  # the keys are done
    members = scratch.save(distinct.join(groups, distinct["fp"] == groups["node"]).select(F.col("fp").alias("_fp"), "rep", "label"), "members")

    # Which of SLOTS slots have a name of a set in a group: most other sets stay where they are, those left go in the join.
    slot = F.col("_fp").bitwiseAND(SLOTS - 1)
    used = np.zeros(SLOTS // 64, np.uint64)
    for r in members.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_fp & 63 as int))")).alias("bits")).collect():
        used[r.word] = r.bits & 0xFFFFFFFFFFFFFFFF
    shared = df.sparkSession.sparkContext.broadcast(used.tobytes())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            own = [(i, _signed(name(s)), s.tobytes()) for i, v in zip(batch.column("doc_id").to_pylist(), byte_views(batch.column("text"))) for s in [shingle_set(bytes(v), words)]]
            i, fp, s = zip(*[r for r in own if filled[r[1] & (SLOTS - 1)]]) if any(filled[r[1] & (SLOTS - 1)] for r in own) else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(fp, pa.int64()), pa.array(s, pa.binary())], names=["doc_id", "fp", "shingles"])

    # One text of each set in a group, found by the pair of identifier and name, which no group of copies makes hot.
    tagged = texts(df, id_col, text_col).mapInArrow(lean(sets), "doc_id long, fp long, shingles binary")
    grouped = tagged.join(members, (tagged["fp"] == members["_fp"]) & tagged["doc_id"].eqNullSafe(members["rep"])).select("label", "fp", "shingles")
    confirmed = scratch.save(grouped.repartition(parts, "label").sortWithinPartitions("label").mapInArrow(lean(_confirm), "fp long, label long"), "confirmed")
    return distinct.select("fp").join(confirmed.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp"), "left").select("fp", F.coalesce("label", "fp").alias("label"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def similar_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """The rows of df less all but one of each component: the one with the smallest identifier stays.

    Texts whose shingle sets have a Jaccard likeness of LEAST or more are linked, and so are texts without words. Rows that
    repeat an identifier and a set count as copies. A null identifier stays only if all are null. Empty table: no rows.
    """
    scratch = Scratch(df.sparkSession, "similar")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(bytes(v), words) for v in byte_views(batch.column("text"))]
            own = [np.unique(h) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([_signed(name(s)) for s in own], pa.int64()), pa.array([keys(s).tobytes() for s in own], pa.binary()), pa.array([_signed(majority(h)) for h in hashes], pa.int64())],
                names=["doc_id", "fp", "keys", "sim"],
            )

    fps = scratch.save(texts(df, id_col, text_col).mapInArrow(lean(apply), "doc_id long, fp long, keys binary, sim long"), "fps")
    found = classes(df, fps, scratch, id_col, text_col, words)
    own = scratch.save(fps.select("doc_id", "fp"), "own")
    scratch.drop("fps")
    return keep_first(df, own, found, lambda t: name(shingle_set(t, words)), scratch, id_col, text_col)
