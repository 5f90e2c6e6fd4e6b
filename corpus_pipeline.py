"""From raw documents to packed sequences: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structura.llm import exact_dedup, packing, similar, suffix_dedup, toxicity
from structura.llm.common import fewer_files, shared_dir, small_batches

#: Bytes of a passage that repeats: what 50 words take at least.
PASSAGE = 256
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that score as toxic go."""
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return fewer_files(toxicity.drop_toxic(docs.select(*COLUMNS), model))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group of equal texts stays."""
    small_batches(spark)
    return fewer_files(exact_dedup.exact_dedup(docs.select(*COLUMNS)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, widened to a likeness of 0.8 or more of sets of five-word shingles: of each component the document with the smallest identifier stays."""
    small_batches(spark)
    return fewer_files(similar.similar_dedup(docs.select(*COLUMNS), words=5))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: bytes of passages that repeat go; a character that a cut splits goes whole. Every document stays."""
    import pyarrow as pa

    small_batches(spark)
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    fields = docs.select(*COLUMNS).schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out = []
            for text, raw in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                out.append(suffix_dedup.cut(text.encode(), np.frombuffer(raw, np.int64).reshape(-1, 2)).decode("utf-8", "ignore") if raw else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), batch.column("carried")], names=["doc_id", "text", "rest"])

    # Other columns ride along with the text.
    carried = docs.select("doc_id", "text", F.struct(*rest).alias("rest"))
    kept = suffix_dedup.repeated_spans(carried, length=PASSAGE, carry="rest", finish=keep, schema=f"doc_id long, text string, rest {carried.schema['rest'].dataType.simpleString()}")
    values = {"doc_id": F.col("doc_id").cast(fields["doc_id"].dataType), "text": F.col("text"), **{c: F.col(f"rest.{c}") for c in rest}, "n_chars": F.length("text").cast(fields["n_chars"].dataType)}
    return fewer_files(kept.select(*[values[c].alias(c) for c in COLUMNS]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: pieces of at most 2048 tokens in as few sequences as it can."""
    small_batches(spark)
    return fewer_files(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack),
]

#: The stages hold a classifier, fingerprints and a suffix sort, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
