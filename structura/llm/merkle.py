"""Document fingerprints: Merkle trees over phrases, paragraphs and sections.

Leaves are phrases, cut at line ends and at words that their own bytes choose, so that an edit moves no later cut. Phrases
make paragraphs (lines), paragraphs sections (up to a blank line, or to a paragraph that its digest chooses), sections the
root. A node's digest is taken of its children's, so roots test equality of every byte. Where roots differ, two trees are
compared from the top: equal branches are left aside, differing ones are entered. The phrases that no equal branch holds
locate the edits, and the bytes in equal branches are the likeness.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structura.llm.common import lean, shuffle_partitions

#: One word in so many ends a phrase; one paragraph in so many ends a section. Bytes of the longest phrase.
PHRASE, SECTION, LONGEST = 3, 8, 128
DIGEST = 16
#: Buckets of neighbouring identifiers for each shuffle partition.
BUCKETS = 4


class Node(NamedTuple):
    digest: bytes
    begin: int
    end: int
    #: Of the root sections, of a section paragraphs, of a paragraph phrases, of a phrase none.
    children: tuple[Node, ...] = ()


#: Nodes of a level below the root: sections, paragraphs, phrases.
LEVELS = ("section", "paragraph", "phrase")


def _digest(kind: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST, person=kind).digest()


def _above(kind: bytes, children: list[Node]) -> Node:
    return Node(_digest(kind, b"".join([c.digest for c in children])), children[0].begin, children[-1].end, tuple(children))


def phrase_ends(text: bytes) -> np.ndarray:
    """Where phrases end: after each line end, after words whose last bytes choose so, at the end of the text, and after LONGEST bytes."""
    if not text:
        return np.zeros(0, np.int64)
    flat = np.frombuffer(text, np.uint8)
    blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
    words = np.flatnonzero(blank[1:] & ~blank[:-1] & (flat[1:] != 10)) + 1
    mixed = flat[words - 1].astype(np.uint32) * 31 + flat[np.maximum(words - 2, 0)] * np.uint32(17) + flat[np.maximum(words - 3, 0)]
    chosen = words[(mixed * np.uint32(2654435761) >> np.uint32(24)) % PHRASE == 0]
    ends = np.unique(np.concatenate((chosen, np.flatnonzero(flat == 10) + 1, [len(flat)])))
    begins = np.concatenate(([0], ends[:-1]))
    wide = np.flatnonzero(ends - begins > LONGEST)  # words that repeat, or bytes without blanks: no word ends these
    return np.sort(np.concatenate((ends, *[np.arange(begins[k] + LONGEST, ends[k], LONGEST) for k in wide])))


def tree(text: bytes) -> Node:
    """A text's tree, by its root. Phrases keep white space, so the root stands for every byte. The empty text has a root too."""
    sections: list[Node] = []
    paragraphs: list[Node] = []
    phrases: list[Node] = []
    blake, begin = hashlib.blake2b, 0
    for end in phrase_ends(text).tolist():
        phrases.append(Node(blake(text[begin:end], digest_size=DIGEST, person=b"phrase").digest(), begin, end))
        begin = end
        if text[end - 1] == 10 or end == len(text):
            own = _above(b"paragraph", phrases)
            paragraphs.append(own)
            phrases = []
            if own.digest[0] % SECTION == 0 or end == len(text) or not text[own.begin : own.end].strip():
                sections.append(_above(b"section", paragraphs))
                paragraphs = []
    return _above(b"root", sections) if sections else Node(_digest(b"root", b""), 0, 0)


def _lone(own: list[Node], other: list[Node]) -> list[Node]:
    """The nodes that no node of the other has for itself by digest."""
    have = Counter([n.digest for n in other])
    out = []
    for n in own:
        if have[n.digest] > 0:
            have[n.digest] -= 1
        else:
            out.append(n)
    return out


def descend(a: Node, b: Node) -> tuple[list[Node], list[Node]]:
    """The phrases of each tree that are left when equal branches are taken away in pairs, level by level from the root."""
    if a.digest == b.digest:
        return [], []
    own, other = [a], [b]
    for _ in LEVELS:
        own, other = ([c for n in nodes for c in n.children] for nodes in (own, other))
        own, other = _lone(own, other), _lone(other, own)
    return own, other


def differing(a: Node, b: Node) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Byte ranges of each text in branches that the other's tree lacks, neighbours joined."""

    def ranges(nodes: list[Node]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for n in nodes:
            if out and out[-1][1] == n.begin:
                out[-1] = (out[-1][0], n.end)
            else:
                out.append((n.begin, n.end))
        return out

    own, other = descend(a, b)
    return ranges(own), ranges(other)


def likeness(a: Node, b: Node) -> float:
    """The share of both texts' bytes that lies in equal branches: 1 for equal texts, two empty ones too."""
    total = a.end + b.end
    if a.digest == b.digest or not total:
        return 1.0
    own, other = descend(a, b)
    return 1.0 - sum(n.end - n.begin for nodes in (own, other) for n in nodes) / total


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by the first as many of the next text, or all where it has fewer."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _ordered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in buckets of neighbouring identifiers, each bucket with the first row after it (tail), in order.

    Bucket bounds are identifiers that occur, so the row after a bucket is the next bucket's first: it is sent to both.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    wanted = max(1, parts * BUCKETS)
    shares = [k / wanted for k in range(wanted)]
    found = df.agg(F.min(F.col(id_col).cast("long")).alias("least"), F.percentile_approx(F.col(id_col).cast("long"), shares, 20 * wanted).alias("cuts")).first()
    bounds = sorted({found.least, *(found.cuts or [])} - {None})
    edges = spark.sparkContext.broadcast(np.array(bounds, dtype=np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = edges.value
        last = max(len(at) - 1, 0)
        for batch in batches:
            ids = batch.column("doc_id")
            known = np.array(ids.is_valid())
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            bucket = np.where(known, np.searchsorted(at, values, side="right") - 1, last).astype(np.int32)
            first = np.flatnonzero(known & np.isin(values, at)) if len(at) else np.arange(len(values))
            take = pa.array(np.concatenate((np.arange(len(values)), first)))
            before = np.where(bucket[first] > 0, bucket[first] - 1, last).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((bucket, before)).astype(np.int32)), pa.array(np.arange(len(values) + len(first)) >= len(values)), ids.take(take), batch.column("text").take(take)],
                names=["bucket", "tail", "doc_id", "text"],
            )

    dealt = rows.mapInArrow(lean(deal), "bucket int, tail boolean, doc_id long, text string")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.asc_nulls_last("doc_id"), "text")


_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row per input row.

    The next row is the one with the next identifier (null identifiers come last, ties are ordered by text), after the last
    the first; a single row is its own next. A null text is an empty one. Empty table: no rows.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        held = None  # bucket, doc_id, text, tree of the row whose next isn't known yet

        for batch in batches:
            for bucket, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text"))):
                own = tree(text.encode())
                if held is not None and held[0] == bucket:
                    kept.append(_compared(*held[1:], text, own))
                held = None if tail else (bucket, doc_id, text, own)
                if len(kept) >= 2000:
                    yield _rows(kept)
                    kept = []
        if kept:
            yield _rows(kept)

    return _ordered(df, id_col, text_col).mapInArrow(lean(apply), _DDL)


def _compared(doc_id, text: str, own: Node, after: str, following: Node) -> tuple:
    raw = edited(text, after).encode()
    new = tree(raw)
    return doc_id, len(text), hashlib.sha256(raw).hexdigest(), own.digest.hex(), new.digest.hex(), likeness(own, new), likeness(own, following)


def _rows(kept: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in _DDL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept), kinds)], names=names)


def _walk(node: Node, level: int) -> Iterator[tuple[str, Node]]:
    for child in node.children:
        yield LEVELS[level], child
        yield from _walk(child, level + 1)


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and the tree's nodes (kind, digest, first_byte, end_byte) of every row; nothing is shuffled."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [tree((t or "").encode()) for t in batch.column("text").to_pylist()]
            nodes = [[{"kind": kind, "digest": n.digest.hex(), "first_byte": n.begin, "end_byte": n.end} for kind, n in _walk(t, 0)] for t in trees]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("digest", pa.string()), ("first_byte", pa.int64()), ("end_byte", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.digest.hex() for t in trees], pa.string()), pa.array(nodes, kind)], names=["doc_id", "fingerprint", "nodes"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(apply), "doc_id long, fingerprint string, nodes array<struct<kind: string, digest: string, first_byte: long, end_byte: long>>")
