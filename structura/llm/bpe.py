"""Byte-level BPE over public rank files, long texts in overlapping chunks.

A text longer than two chunks is cut into chunks that overlap. Every chunk is split into pre-tokens on its own, in
parallel, from wherever it happens to begin. Two neighbours are stitched at the first position in their overlap where both
begin a pre-token: the pattern keeps no state between matches, so from there on they agree. The pieces between the
stitches are then encoded in parallel and the ids joined in order. Neighbours that never meet in their overlap (one
pre-token longer than it) are encoded as one piece. Texts of up to two chunks are one piece from the start.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structura.llm.common import lean, shuffle_partitions, texts

#: Code points in a chunk, and those by which it reaches into the next.
CHUNK, OVERLAP = 1 << 15, 512


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a tiktoken rank file, or from the vocabulary of a byte-level BPE in tokenizers' JSON (ids are ranks there)."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        return {bytes(byte_of[c] for c in piece): rank for piece, rank in vocab.items()}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
    """A tiktoken encoding, made once in each Python worker."""
    import tiktoken

    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens=dict(special))


@functools.lru_cache(maxsize=4)
def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """Added tokens of a tokenizers file: where a text contains their strings, tokenizers gives their ids."""
    with open(path, encoding="utf-8") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f).get("added_tokens", []))


def encode(path: str, pattern: str, text: str) -> list[int]:
    """Ids of a text: special strings count as ordinary text with a rank file, and get their ids with a JSON file."""
    if path.endswith(".json"):
        special = added_tokens(path)
        enc = encoder(path, pattern, special)
        if any(s in text for s, _ in special):
            return enc.encode(text, allowed_special="all")
        return enc.encode_ordinary(text)
    return encoder(path, pattern).encode_ordinary(text)


def decode(path: str, pattern: str, ids: list[int]) -> bytes:
    """The concatenated raw bytes of ids."""
    special = added_tokens(path) if path.endswith(".json") else ()
    return encoder(path, pattern, special).decode_bytes(ids)


def _summary(doc_id, ids: list[int], path: str, pattern: str, want_ids: bool) -> tuple:
    raw = np.array(ids, dtype="<u4").tobytes()
    return doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decode(path, pattern, ids)).hexdigest(), raw if want_ids else None


_FIELDS = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary())]
_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _bounds(pattern: str, text: str) -> list[int]:
    import regex

    return [m.start() for m in regex.finditer(pattern, text)]


def _long_pieces(long: DataFrame, pattern: str, chunk: int, overlap: int, parts: int) -> DataFrame:
    """(row, doc_id, first, piece): the pieces of every long text in order, cut where chunks resynchronise."""
    cut = long.select(
        "row", "doc_id",
        F.posexplode(F.transform(F.sequence(F.lit(0), ((F.length("text") - 1) / chunk).cast("int")), lambda k: F.substring("text", k * chunk + 1, F.lit(chunk + overlap)))).alias("k", "part"),
    ).repartition(parts, "row", "k")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("row", pa.string()), ("doc_id", pa.int64()), ("k", pa.int32()), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32())), ("part", pa.string())]
        for batch in batches:
            rows = []
            for row, doc_id, k, part in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "k", "part"))):
                starts = _bounds(pattern, part)
                more = len(part) > chunk
                # Positions count from the next chunk's beginning. The last two matches of a cut chunk may depend on its end,
                # and a piece may not end in white space, which would be split otherwise than before more text.
                tail = [p - chunk for p in starts[:-2] if p >= chunk and not part[p - 1].isspace()] if more else []
                rows.append((row, doc_id, k, [p for p in starts if p < overlap], tail, part))
            yield _batch(rows, fields)

    split = cut.mapInArrow(lean(bounds), "row string, doc_id long, k int, head array<int>, tail array<int>, part string")
    by_doc = Window.partitionBy("row").orderBy("k")
    # array_intersect keeps the order of its first argument, so the first element is the first common position.
    met = split.withColumn("sync", F.when(F.col("k") == 0, 0).otherwise(F.try_element_at(F.array_intersect(F.lag("tail").over(by_doc), "head"), F.lit(1))))
    # A chunk that meets its neighbour begins a piece there. One that doesn't goes on with the piece before it, and so do
    # all later ones: only from a stitch on are a chunk's own positions known to be right.
    proven = F.min(F.col("sync").isNotNull()).over(by_doc.rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("sync", F.when(proven, F.col("sync")))
    own = met.select("row", "doc_id", "k", "sync", F.lead("sync").over(by_doc).alias("next_sync"), F.lead("k").over(by_doc).isNotNull().alias("more"), "part")
    # Without a next chunk, or where it wasn't met, the chunk's own share is its first `chunk` characters; a met one gives way at the stitch.
    start = F.coalesce("sync", F.lit(0))
    share = F.substring("part", start + 1, F.when(~F.col("more"), F.lit(chunk + overlap)).otherwise(F.lit(chunk) + F.coalesce("next_sync", F.lit(0)) - start))
    pieces = own.select("row", "doc_id", "k", share.alias("share"), F.sum(F.col("sync").isNotNull().cast("int")).over(by_doc).alias("piece"))
    return pieces


def encode_documents(
    df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", want_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (binary, little-endian unsigned 32-bit integers).

    One row per input row, repeated rows included. A null text is an empty one: no ids. The hashes are over the ids' bytes
    and over the bytes to which they decode. An empty table gives an empty result.
    """
    rows = texts(df, id_col, text_col)
    is_long = F.length("text") > 2 * chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_summary(i, encode(path, pattern, t), path, pattern, want_ids) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())], _FIELDS)

    short = rows.where(~is_long).mapInArrow(lean(whole), _DDL)

    # Rows of long texts are told apart by identifier and digest; a row that repeats in full is encoded once and counted.
    long = rows.where(is_long).withColumn("row", F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(F.col("text").cast("binary"), 256)))
    copies = long.groupBy("row").agg(F.count("*").alias("copies"))
    parts = shuffle_partitions(df.sparkSession)
    pieces = _long_pieces(long.dropDuplicates(["row"]), pattern, chunk, overlap, parts).repartition(parts, "row", "piece")

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("row", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int64()), ("ids", pa.binary())]
        for batch in batches:
            rows = [(r, d, p, np.array(encode(path, pattern, t), dtype="<u4").tobytes()) for r, d, p, t in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "piece", "share")))]
            yield _batch(rows, fields)

    shares = pieces.groupBy("row", "doc_id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "share"))), lambda x: x["share"]), "").alias("share"))
    encoded = shares.mapInArrow(lean(encode_pieces), "row string, doc_id long, piece long, ids binary")
    joined = encoded.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("pieces")).join(copies, "row")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, pieces, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "pieces", "copies"))):
                out += [_summary(d, np.frombuffer(b"".join(p["ids"] for p in pieces), dtype="<u4").tolist(), path, pattern, want_ids)] * n
            yield _batch(out, _FIELDS)

    result = short.unionByName(joined.select("doc_id", "pieces", "copies").mapInArrow(lean(assemble), _DDL))
    return result if want_ids else result.drop("ids")


def count_tokens(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row; a null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(encode(path, pattern, t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return texts(df, id_col, text_col).mapInArrow(lean(count), "doc_id long, n_tokens long")
