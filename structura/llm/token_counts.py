"""Token counts for every context limit, from an exact histogram of encoded lengths.

Documents are aggregated by encoded length where they are read, so what moves is a row for each task and length. Suffix
sums over the histogram then answer totals, quantiles and truncated totals for any limit without the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structura.llm.bpe import encode
from structura.llm.common import Scratch, lean, texts

#: Lengths are summed in buckets of so many first, so that no window runs over all of them.
BUCKET = 1024


def length_histogram(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs, first_doc: the number of documents of each encoded length and the smallest identifier among them.

    A null text counts as empty (length 0); repeated rows count each time; null identifiers count but are never first_doc.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n = len(encode(path, pattern, text))
                entry = seen.setdefault(n, [0, None])
                entry[0] += 1
                if doc_id is not None and (entry[1] is None or doc_id < entry[1]):
                    entry[1] = doc_id
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int64()), pa.array([n for n, _ in seen.values()], pa.int64()), pa.array([d for _, d in seen.values()], pa.int64())],
            names=["n_tokens", "n_docs", "first_doc"],
        )

    # A row for each task and length, saved: suffix sums read the histogram twice, and it must not encode all texts twice.
    partial = Scratch(df.sparkSession, "lengths").save(texts(df, id_col, text_col).mapInArrow(lean(count), "n_tokens long, n_docs long, first_doc long"), "partial")
    return partial.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Add, for the limit that each length is: docs_over, tokens_over (of documents longer than it), truncated_tokens
    (of all documents, each cut at the limit), and docs_share (documents of at most this length over all, the quantile).

    Sums are taken within buckets of lengths and over the buckets' totals, so the largest window is one bucket or one row a bucket.
    """
    tokens = (F.col("n_tokens") * F.col("n_docs")).alias("tokens")
    rows = histogram.select("*", tokens, F.floor(F.col("n_tokens") / BUCKET).alias("bucket"))
    totals = rows.groupBy("bucket").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("toks"))
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = totals.select(
        "bucket", F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_later"), F.coalesce(F.sum("toks").over(after), F.lit(0)).alias("toks_later"),
        F.sum("docs").over(every).alias("all_docs"), F.sum("toks").over(every).alias("all_toks"),
    )
    within = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.join(later, "bucket").select(
        "*", (F.coalesce(F.sum("n_docs").over(within), F.lit(0)) + F.col("docs_later")).alias("docs_over"), (F.coalesce(F.sum("tokens").over(within), F.lit(0)) + F.col("toks_later")).alias("tokens_over")
    )
    return summed.select(
        "n_tokens", "n_docs", "first_doc", "docs_over", "tokens_over",
        (F.col("all_toks") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_tokens"),
        F.col("all_toks").alias("total_tokens"), ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("docs_share"),
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens of all documents when each is cut at limit; 0 for an empty histogram."""
    at = sums.where(F.col("n_tokens") <= limit).orderBy(F.desc("n_tokens")).select("truncated_tokens", "docs_over", "n_tokens").first()
    if at is None:  # every document is longer
        return limit * int(sums.agg(F.sum("n_docs")).first()[0] or 0)
    return int(at.truncated_tokens + at.docs_over * (limit - at.n_tokens))


def quantile(sums: DataFrame, share: float) -> int | None:
    """The smallest length that at least this share of documents doesn't exceed; None for an empty histogram."""
    at = sums.where(F.col("docs_share") >= share).orderBy("n_tokens").select("n_tokens").first()
    return None if at is None else int(at.n_tokens)


def brute_force(lengths: list[int], limit: int) -> tuple[int, int, int]:
    """Documents over a limit, their tokens, and all tokens when cut at it: what the tests hold the sums against."""
    a = np.array(lengths, dtype=np.int64)
    return int((a > limit).sum()), int(a[a > limit].sum()), int(np.minimum(a, limit).sum())
