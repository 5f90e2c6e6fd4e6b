"""SimHash fingerprints and near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 1 bit in one of their 32-bit halves. The anchors
of a half are the words of a covering code: the [31, 26] Hamming code, whose covering radius is 1, with one free bit. A
fingerprint goes to every anchor within covering radius plus threshold (1 + 1) of its half, which is 17 anchors or fewer a
half, and is compared with the others there: the anchor next to the one fingerprint is within reach of the other.

Only distinct fingerprints are replicated, as arrays bucketed by anchor. Within an anchor a search from fingerprint to
fingerprint emits the edges of a spanning forest, so links are as many as fingerprints at most, whatever a group's size.
Components come from rounds of star contraction over the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structura.llm.common import Scratch, byte_views, lean, shuffle_partitions, texts

THRESHOLD = 3
#: Anchors with more fingerprints than this are searched through sixteen-bit blocks, one of which two near ones share.
CROWDED = 4096


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 hashes (seed 42) of a text's shingles, repeats included; a shorter text is one shingle, one without words none."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return np.zeros(0, "<u8")
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = min(words, len(parts))
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], 42) for a, b in zip(starts[: len(parts) - n + 1].tolist(), ends[n - 1 :].tolist())], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):  # a megabyte of bits at a time, however long the text
        counts += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = 3) -> int:
    """A text's fingerprint: the majority of its shingles' hashes; zero for a text without words."""
    return majority(shingle_hashes(text, words))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row. Empty and null texts: zero."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(bytes(v), words) for v in byte_views(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _signed(fps)], names=["doc_id", "fp"])

    return texts(df, id_col, text_col).mapInArrow(lean(apply), "doc_id long, fp long")


def _syndromes(half: np.ndarray) -> np.ndarray:
    """Hamming syndrome of the low 31 bits: the exclusive or of the (one-based) positions that are set; 0 for a code word."""
    out = np.zeros(len(half), dtype=np.uint32)
    for position in range(1, 32):
        out ^= ((half >> np.uint32(position - 1)) & np.uint32(1)) * np.uint32(position)
    return out


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the value, anchor) for every anchor within distance 2 of each 32-bit value.

    Flipping the positions of a set whose exclusive or is the syndrome gives a code word: the empty set for syndrome 0, the
    syndrome itself, or a pair of positions. The free bit is kept, or flipped if at most one other bit was.
    """
    n, low = np.arange(len(half)), half & np.uint32(0x7FFFFFFF)
    s = _syndromes(low)
    bit = lambda p: np.where(p > 0, np.uint32(1) << (np.maximum(p, 1) - 1).astype(np.uint32), np.uint32(0))
    near = half ^ bit(s)  # the home: distance 0 or 1
    index, found = [n, n], [near, near ^ np.uint32(1 << 31)]
    off = s > 0
    for a in range(1, 32):
        b = s ^ np.uint32(a)
        pair = off & (b > a)  # each pair once; b = 0 would be the syndrome itself
        index.append(n[pair])
        found.append((half ^ bit(np.full(len(half), a, np.uint32)) ^ bit(b))[pair])
    return np.concatenate(index), np.concatenate(found)


def _search(fps: np.ndarray, out: list[np.ndarray]) -> None:
    """Edges of a spanning forest of the fingerprints at an anchor: each step compares one with all not yet reached."""
    left = fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= THRESHOLD
            if near.any():
                hit = left[near]
                out.append(np.stack([np.full(len(hit), x), hit]))
                queue += list(hit)
                left = left[~near]


def _forest(fps: np.ndarray, out: list[np.ndarray]) -> None:
    if len(fps) <= CROWDED:
        return _search(fps, out)
    for shift in (0, 16, 32, 48):  # at most three bits differ, so one of four blocks is equal
        block = (fps >> np.uint64(shift)) & np.uint64(0xFFFF)
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                _search(fps[group], out)
    return None


def links(distinct: DataFrame, parts: int) -> DataFrame:
    """(src, dst): links between distinct fingerprints (column fp) that connect all those within the threshold."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for step in range(0, len(fps), 1 << 16):
                own = fps[step : step + (1 << 16)]
                keys, values = [], []
                for side in (0, 1):
                    i, a = anchors((own >> np.uint64(32 * side)).astype(np.uint32))
                    keys.append(a.astype(np.uint64) | np.uint64(side << 32))
                    values.append(own[i])
                key, value = np.concatenate(keys), np.concatenate(values)
                bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)
                order = np.argsort(bucket, kind="stable")
                key, value, bucket = key[order], value[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                firsts = np.concatenate(([0], cuts)) if len(bucket) else np.zeros(0, int)
                rows = [(int(bucket[a]), k.tobytes(), v.tobytes()) for a, k, v in zip(firsts, np.split(key, cuts), np.split(value, cuts))]
                if rows:
                    b, k, v = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(v, pa.binary())], names=["bucket", "anchors", "fps"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = [], []
        for batch in batches:
            keys += [np.frombuffer(v, np.uint64) for v in byte_views(batch.column("anchors"))]
            values += [np.frombuffer(v, np.uint64) for v in byte_views(batch.column("fps"))]
        if not keys:
            return
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        found: list[np.ndarray] = []
        small = sizes <= 8
        for step in range(1, 8):  # small groups all at once: each row with the one `step` behind it
            a = np.flatnonzero(np.repeat(small, sizes))
            a = a[a + step < len(key)]
            a = a[(key[a] == key[a + step]) & (np.bitwise_count(value[a] ^ value[np.minimum(a + step, len(key) - 1)]) <= THRESHOLD)]
            if len(a):
                found.append(np.stack([value[a], value[a + step]]))
        for start, size in zip(starts[~small].tolist(), sizes[~small].tolist()):
            _forest(value[start : start + size], found)
        if found:
            pairs = np.unique(np.sort(np.concatenate(found, axis=1).view(np.int64), axis=0), axis=1)
            for k in range(0, pairs.shape[1], 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0, k : k + (1 << 16)]), pa.array(pairs[1, k : k + (1 << 16)])], names=["src", "dst"])

    arrays = distinct.select("fp").mapInArrow(lean(replicate), "bucket int, anchors binary, fps binary")
    return arrays.repartition(parts, "bucket").select("anchors", "fps").mapInArrow(lean(compare), "src long, dst long").where("src <> dst").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the component of every node that has an edge, labelled by its smallest node.

    Each round sends every larger neighbour to the smallest (large star), then every smaller one (small star), until the
    edges are stars, however many rounds that takes (their number grows with the logarithm of the edges). Joins are on nodes,
    minima are combined before they move, and only counts come to the driver.
    """
    now, seen, k = scratch.save(edges.select("src", "dst"), "edges0"), None, 0
    while True:
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").select(F.col("dst").alias("a"), F.col("src").alias("b"), "m")
        star = small.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("m").alias("dst")), F.struct(F.col("b").alias("src"), F.col("m").alias("dst")))).alias("e")).select("e.*").where("src <> dst").distinct()
        after = scratch.save(star, f"edges{k + 1}")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if k:
            scratch.drop(f"edges{k}")
        now, k = after, k + 1
        if seen == state:
            break
        seen = state
    return now.select(F.col("src").alias("node"), F.col("dst").alias("label")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("label"))).distinct()


def classes(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, label, component_id): for every fingerprint of fps (doc_id, fp), its component and the smallest identifier there."""
    parts = shuffle_partitions(fps.sparkSession)
    distinct = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    joined = components(links(distinct, parts), scratch)
    named = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    return named.join(least, "label").select("fp", "label", "component_id")


def labelled(fps: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """fps (doc_id, fp) with what found (fp, ...) says of each fingerprint.

    Fingerprints that many rows share don't make a join's partition large: at most four a shuffle partition have more than
    a fourth of a partition's share of rows, and what is found of those is broadcast.
    """
    most = 4 * shuffle_partitions(fps.sparkSession)
    n = fps.groupBy("fp").agg(F.count("*").alias("n"))
    least = (n.agg(F.sum("n")).first()[0] or 0) / most
    hot = scratch.save(n.where((F.col("n") > least) & (F.col("n") > 1000)).join(found, "fp").drop("n"), "hot")
    rest = [c for c in found.columns if c != "fp"]
    marked = fps.join(F.broadcast(hot.select(F.col("fp").alias("_hot"), *[F.col(c).alias(f"_{c}") for c in rest])), F.col("fp") == F.col("_hot"), "left")
    few = marked.where("_hot is null").select(*fps.columns).join(found, "fp").select(*fps.columns, *rest)
    return marked.where("_hot is not null").select(*fps.columns, *[F.col(f"_{c}").alias(c) for c in rest]).unionByName(few)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest identifier reachable through links, itself included).

    One row per input row. Fingerprints that differ in 3 bits or fewer are linked, equal ones too, and so are those of
    texts without words (zero). A null identifier is never a component's smallest unless all are null. Empty table: no rows.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    fps = scratch.save(fingerprints(df, id_col, text_col, words), "fps")
    found = classes(fps, scratch)
    return labelled(fps, found.select("fp", "component_id"), scratch).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, fps: DataFrame, found: DataFrame, tag: Callable[[bytes], int], scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """The rows of df that come first in their component: fps (doc_id, fp) has what tag gives for each text, found (fp, label) the components."""
    from pyspark.sql import Window

    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fp")
    grouped = labelled(fps, found.select("fp", "label"), scratch)
    keeper = grouped.groupBy("label").agg(F.min(order).alias("first"))
    drop = scratch.save(grouped.join(keeper, "label").where(order != F.col("first")).select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).distinct(), "drop")

    def apply(text):  # the fingerprint again, beside the whole row
        import pandas as pd

        return pd.Series(np.array([tag((t or "").encode()) for t in text], dtype=np.uint64).view(np.int64))

    tagged = df.withColumns({"_fp": F.pandas_udf(apply, "long")(F.col(text_col)), "_id": F.col(id_col).cast("long")})
    left = tagged.join(drop.withColumn("_drop", F.lit(True)), (tagged["_id"].eqNullSafe(drop["_id"])) & (tagged["_fp"] == drop["_fp"]), "left").where("_drop is null").select(tagged["*"])
    first = Window.partitionBy("_id", "_fp").orderBy(F.lit(1))
    return left.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*df.columns)


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The rows of df less all but one of each component: the one with the smallest identifier stays.

    Decisions are small rows (identifier, fingerprint) and meet the texts on that pair, which no group of copies makes hot.
    Rows that repeat an identifier and a fingerprint count as copies: one stays.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    fps = scratch.save(fingerprints(df, id_col, text_col, words), "fps")
    found = classes(fps, scratch)
    return keep_first(df, fps, found, lambda t: fingerprint(t, words), scratch, id_col, text_col)
