"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structura.llm import bpe, exact_dedup, lattice_lm, manifest, merkle, negatives, ngram_join, packing, simhash, suffix_dedup, token_counts, toxicity, warc
from structura.llm.common import Scratch, small_batches

RANKS, TOKENIZER, PIECES = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back."""
    folder = Scratch(spark, "warc").path("archives")
    warc.write_warc(_table(spark, sf_dir, "pages"), folder)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return warc.read_warc(spark, folder, want_payload=False).select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to")
    )


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_with_next(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, end_id=0, size=2048)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.length_histogram(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return token_counts.with_suffix_sums(lengths)


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.language_scores(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_sets(_table(spark, sf_dir, "documents"), words=3, need=90)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, checked after every document whose crc32 five divides has its text in lower case."""
    return manifest.manifest(_table(spark, sf_dir, "documents"), changed=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose identifier is divisible by 100; where 7 divides it, the label is the next one."""
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_warc, op2_merkle_fingerprints, op3_byte_bpe, op4_exact_dedup, op5_simhash, op6_best_fit_packing, op7_suffix_dedup, op8_toxicity, op9_token_counts, op10_lattice_lm, op11_ngram_join, op12_merkle_manifest, op13_hard_negatives, pipeline)}


def _manifest_sql(depth: int = 5) -> str:
    """Both trees level by level: r<k> holds the runs of level k, and every document's way folds them, left joins where a tree has ended."""
    text = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    row = lambda t: "sha256(" + " || ".join(map(text, ("doc_id", "source", "lang", "n_chars", t))) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda crc, byte: {bits}), 4294967295)"
    out = f"""
        WITH d AS (SELECT doc_id, source, {row("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {row(low)} ELSE {row("text")} END AS bad FROM documents),
             l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t FROM d),
             a0 AS (SELECT t, i, leaf AS h FROM l)"""
    for name, first in (("a", "a0"), ("b", "b0")):
        if name == "b":  # the trees' roots are what no level has hashed further
            kept = " UNION ALL ".join(f"SELECT t, h FROM a{k} WHERE t IN (SELECT t FROM a{k} GROUP BY t HAVING count(*) = 1)" for k in range(depth + 1))
            out += f", roots AS ({kept}), b0 AS (SELECT 0 AS t, t AS i, h FROM roots)"
        for k in range(depth):
            out += f""",
             {name}r{k} AS (SELECT t, i // 16 AS run, list(h ORDER BY i) AS hs FROM {name}{k} WHERE t IN (SELECT t FROM {name}{k} GROUP BY t HAVING count(*) > 1) GROUP BY 1, 2),
             {name}{k + 1} AS (SELECT t, run AS i, sha256(array_to_string(hs, '')) AS h FROM {name}r{k})"""
    ends = " UNION ALL ".join(f"SELECT h FROM b{k} WHERE (SELECT count(*) FROM b{k}) = 1" for k in range(depth + 1))
    out += f", top AS ({ends}), p0 AS (SELECT *, bad AS f, '' AS way FROM l)"
    steps = [("a", k, "t", "i") for k in range(depth)] + [("b", k, "0", "t") for k in range(depth)]
    for n, (name, k, tree, at) in enumerate(steps):
        place = f"(p.{at} // {16**k}) % 16"
        left, right = f"coalesce(array_to_string(r.hs[1:{place}], ''), '')", f"coalesce(array_to_string(r.hs[{place} + 2:], ''), '')"
        tree = "0" if tree == "0" else "p.t"
        out += f""",
             p{n + 1} AS (SELECT p.* EXCLUDE (f, way), CASE WHEN r.hs IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f, way || {left} || {right} AS way
                          FROM p{n} p LEFT JOIN {name}r{k} r ON r.t = {tree} AND r.run = p.{at} // {16 ** (k + 1)})"""
    return out + f"""
        SELECT doc_id, leaf, roots.h AS subroot, top.h AS root, sha256(way) AS proof_sha256, f AS folded_root, f = top.h AS verified
        FROM p{len(steps)} p JOIN roots ON roots.t = p.t JOIN top ON true
    """


ORACLE_SQL = {
    "op12_merkle_manifest": _manifest_sql(),
    "op13_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS alike, list_sum(list_transform(list_zip(a.q, e.q), lambda z: z[1] * z[2]))::BIGINT AS score
                   FROM e AS a JOIN e ON true WHERE a.vec_id % 100 = 0),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike AND vec_id IS DISTINCT FROM anchor_id
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
             n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
                   FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """,
    "op1_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, coalesce(html, '') AS html FROM pages),
             k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < keep THEN keep END AS refers_to
        FROM k
    """,
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents),
             k AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
    """,
}
