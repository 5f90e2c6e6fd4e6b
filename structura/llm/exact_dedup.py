"""Exact duplicates by a content sort.

Rows are range-partitioned by their normalised content (its first characters, then its digest, so that shared openings
can't make a partition large), then by length and identifier, with sampled splitters. An external sort puts equal texts
side by side, and neighbours whose digests agree are compared in full. As the identifier is part of the key, a group of
copies of any size spreads over as many partitions as it needs; what runs over a partition's edge is settled with one
small row for each edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structura.llm.common import BLANK, Scratch, byte_views, drawn_part, lean, shuffle_partitions

_BLANK = BLANK.encode()
#: Characters of the normalised text in the sort key. Ties go on to the digest.
PREFIX = 24


def _keyed(df: DataFrame, id_col: str, text_col: str, payload: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("_id"), text.alias("_text"), F.col(text_col).isNull().alias("_null"),
        *[F.col(c).alias(f"_p{k}") for k, c in enumerate(payload)],
    )
    rows = rows.withColumn("_norm", F.translate("_text", BLANK, ""))
    return rows.select(
        F.substring("_norm", 1, PREFIX).alias("_prefix"), F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"),
        F.length("_text").cast("long").alias("_chars"), *[c for c in rows.columns if c != "_norm"],
    )


def _sorted(keyed: DataFrame, parts: int) -> DataFrame:
    key = [F.col("_prefix"), F.col("_sha"), F.col("_chars").desc(), F.asc_nulls_last("_id")]
    return keyed.repartitionByRange(parts, *key).sortWithinPartitions(*key)


_GROUPS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("chars", T.LongType()),
        T.StructField("keep_id", T.LongType()),
        T.StructField("keep_chars", T.LongType()),
        T.StructField("group_size", T.LongType()),
        T.StructField("head", T.BooleanType()),
        T.StructField("edge", T.BooleanType()),
        T.StructField("part", T.LongType()),
    ]
)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[int]]]:
    """For each batch the rows that begin a run of equal texts, by comparing each row with the one before it in full."""
    last_sha, last_text = None, b""
    for batch in batches:
        if not batch.num_rows:
            continue
        shas, views = batch.column("_sha").to_pylist(), byte_views(batch.column("_text"))
        starts = []
        for i, sha in enumerate(shas):
            same = sha == last_sha and bytes(views[i]).translate(None, _BLANK) == (last_text if i == 0 else bytes(views[i - 1]).translate(None, _BLANK))
            if not same:
                starts.append(i)
            last_sha = sha
        last_text = bytes(views[-1]).translate(None, _BLANK)
        yield batch, starts, batch.column("_id").to_pylist()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = drawn_part()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_sha256", pa.string()), ("chars", pa.int64()), ("keep_id", pa.int64()), ("keep_chars", pa.int64()), ("group_size", pa.int64()), ("head", pa.bool_()), ("edge", pa.bool_()), ("part", pa.int64())]
    )
    ids, chars, sha, first = [], [], None, True  # the open run: slim values only

    def close(edge: bool) -> list[tuple]:
        return [(i, sha, c, ids[0], chars[0], len(ids), k == 0, edge, part) for k, (i, c) in enumerate(zip(ids, chars))]

    ready: list[tuple] = []
    for batch, starts, own in _runs(batches):
        lengths, shas = batch.column("_chars").to_pylist(), batch.column("_sha").to_pylist()
        for a, b in zip([0, *starts], [*starts, len(own)]):
            if a in starts[:1] or a > 0 or not ids:
                if ids and b > a:
                    ready += close(first)
                    first, ids, chars = False, [], []
            if b > a:
                sha = shas[a]
                ids += own[a:b]
                chars += lengths[a:b]
        if len(ready) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), schema.types)], schema=schema)
            ready = []
    if ids:
        ready += close(True)
    if ready:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), schema.types)], schema=schema)


def _edges(groups: DataFrame) -> DataFrame:
    """One row for each text at an edge: at most two texts a partition, so small enough to broadcast whatever the input."""
    rank = F.struct((-F.col("keep_chars")).alias("c"), F.col("keep_id").isNull().alias("n"), F.col("keep_id").alias("i"), F.col("part").alias("p"))
    per_part = groups.where("edge and head").groupBy("text_sha256", "part").agg(F.min(rank).alias("rank"), F.max("group_size").alias("size"))
    return per_part.groupBy(F.col("text_sha256").alias("edge_sha")).agg(F.min("rank").alias("rank"), F.sum("size").alias("edge_size"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group equal texts: doc_id, keep_id, group_size, kept, text_sha256; one row per input row.

    Texts are equal when identical after deleting white space `[\\x20\\x09-\\x0D]`; a null text is an empty one, and empty
    texts equal each other. The row with the most code points stays, then the one with the smallest identifier (null
    identifiers last); of rows that repeat in full, one is kept. An empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "exact")
    rows = _sorted(_keyed(df, id_col, text_col, []), shuffle_partitions(spark))
    groups = scratch.save(rows.select("_id", "_sha", "_chars", "_text").mapInArrow(lean(_grouped), _GROUPS), "groups")
    joined = groups.join(F.broadcast(_edges(groups)), F.col("edge") & (F.col("text_sha256") == F.col("edge_sha")), "left")
    at_edge = F.col("edge_sha").isNotNull()
    return joined.select(
        "doc_id",
        F.when(at_edge, F.col("rank.i")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("edge_size", "group_size").alias("group_size"),
        (F.col("head") & (~at_edge | (F.col("part") == F.col("rank.p")))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that exact_groups keeps, with all their columns. Same rules."""
    spark = df.sparkSession
    scratch = Scratch(spark, "exact")
    payload = [c for c in df.columns if c not in (id_col, text_col)]
    rows = _sorted(_keyed(df, id_col, text_col, payload), shuffle_partitions(spark)).drop("_prefix")
    schema = T.StructType([*rows.schema.fields, T.StructField("edge", T.BooleanType()), T.StructField("part", T.LongType())])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held = drawn_part(), True, None
        for batch, starts, _ in _runs(batches):
            if not starts:
                continue
            if held is not None:
                yield _flagged(held, first, part)
                first, held = False, None
            if len(starts) > 1:
                own = batch.take(pa.array(starts[:1]))
                yield _flagged(own, first, part)
                first = False
                if len(starts) > 2:
                    yield _flagged(batch.take(pa.array(starts[1:-1])), False, part)
            held = batch.take(pa.array(starts[-1:]))
        if held is not None:
            yield _flagged(held, True, part)

    found = scratch.save(rows.mapInArrow(lean(heads), schema), "heads")
    rank = F.struct(-F.col("_chars"), F.col("_id").isNull(), F.col("_id"), F.col("part").alias("p"))
    seams = found.where("edge").groupBy(F.col("_sha").alias("edge_sha")).agg(F.min(rank).getField("p").alias("edge_part"))
    kept = found.join(F.broadcast(seams), F.col("edge") & (F.col("_sha") == F.col("edge_sha")), "left").where("edge_sha is null or part = edge_part")
    values = {id_col: F.col("_id").cast(df.schema[id_col].dataType), text_col: F.when(~F.col("_null"), F.col("_text"))} | {c: F.col(f"_p{k}") for k, c in enumerate(payload)}
    return kept.select(*[values[c].alias(c) for c in df.columns])


def _flagged(batch: pa.RecordBatch, edge: bool, part: int) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array([edge] * n, pa.bool_()), pa.array([part] * n, pa.int64())], names=[*batch.schema.names, "edge", "part"]
    )
