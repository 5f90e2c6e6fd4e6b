"""Merkle manifest of a dataset: one root over all rows, a subroot per group, a proof per row.

Rows of a group, in order, are the leaves of a tree in which every ARITY consecutive nodes become their hash; the groups'
roots are the leaves of one more tree. A row's place is known beforehand (its rank, from a range sort and one count for each
partition and group), and so is every run's length. A fragment of the forest is therefore a set of nodes by (tree, level,
index), and joining two fragments is an associative and commutative operation: put the nodes together, and whenever a run of
siblings is complete, put its hash one level up instead (Forest). Tasks make fragments of their rows, in which only the
nodes at the edges of a range stay open; a tree of merges joins FAN fragments at a time until one is left, whose only
content is the root. Proofs go the other way: each level's runs join the paths of the level above by run, so no group,
however large, is one key.

Leaves, proofs and the check of a changed row are SQL functions; only merging runs in Python, on digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structura.llm.common import Scratch, shuffle_partitions

ARITY, FAN = 16, 16
#: The number of the tree over the groups' roots; groups are numbered from 0.
TOP = -1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PIECES = "part int, open boolean, tree long, size long, level int, at long, digests array<string>"


def leaf_hash(values: list[Column]) -> Column:
    """The hash of a row: for each value `-` if null, else its UTF-8 length, `:` and the value."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]), 256)


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


class Forest:
    """A fragment: open nodes by run. add() takes a node and gives what it completes; fragments join by adding one's nodes to the other."""

    def __init__(self, groups: int):
        self.groups, self.open = groups, {}

    def add(self, tree: int, size: int, level: int, index: int, digest: str) -> Iterator[tuple]:
        """Completed runs as (tree, size, level, run, digests), ascending; a group's root goes on as a leaf of the top tree."""
        while True:
            nodes = -(-size // ARITY**level)
            if nodes == 1:
                if tree == TOP:
                    return
                tree, size, level, index = TOP, self.groups, 0, tree
                continue
            run = index // ARITY
            key = (tree, size, level, run)
            held = self.open.setdefault(key, {})
            held[index] = digest
            if len(held) < min(ARITY, nodes - run * ARITY):
                return
            digests = [d for _, d in sorted(self.open.pop(key).items())]
            yield (*key, digests)
            level, index, digest = level + 1, run, hashlib.sha256("".join(digests).encode()).hexdigest()

    def nodes(self) -> Iterator[tuple]:
        """The open nodes as (tree, size, level, index, digest)."""
        for (tree, size, level, _), held in self.open.items():
            for index, digest in held.items():
                yield tree, size, level, index, digest


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=["part", "open", "tree", "size", "level", "at", "digests"])


def _merged(groups: int):
    """An Arrow stage: nodes (part, tree, size, level, at, digest) of a part become its completed runs and what stays open."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, Forest] = {}
        for batch in batches:
            ready = []
            for part, tree, size, level, at, digest in zip(*[batch.column(c).to_pylist() for c in ("part", "tree", "size", "level", "at", "digest")]):
                forest = parts.setdefault(part, Forest(groups))
                ready += [(part, False, *run) for run in forest.add(tree, size, level, at, digest)]
            yield _rows(ready)
        for part, forest in parts.items():
            yield _rows([(part, True, *node[:4], [node[4]]) for node in forest.nodes()])

    return stage


def numbered(rows: DataFrame, scratch: Scratch, name: str, order: list[Column]) -> DataFrame:
    """rows in that order, saved, with _at: partition number and place there, ascending through the whole table."""
    return scratch.save(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)


def _part() -> Column:
    """The number of the partition that _at speaks of."""
    return F.shiftright("_at", 33).cast("int")


def _before(by: list[str]) -> Column:
    """How many rows the partitions before this one have of the same group."""
    return F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def placed(leaves: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int, int]:
    """leaves (group, doc_id, leaf, ...) with tree, size and index; the groups (tree, size); their number; the largest size.

    Groups are numbered in UTF-8 order, null first; the leaves of one ascend by identifier, null first, then by hash.
    """
    ordered = numbered(leaves, scratch, "ordered", [F.col("group").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()])
    counts = scratch.save(ordered.groupBy("group", _part().alias("part")).agg(F.count("*").alias("n"), F.min("_at").alias("first")), "counts")
    groups = numbered(counts.groupBy("group").agg(F.sum("n").alias("size")), scratch, "groups", [F.col("group").asc_nulls_first()])
    offsets = groups.groupBy(_part().alias("part")).agg(F.count("*").alias("n"), F.min("_at").alias("first")).select("part", (_before([]) - F.col("first")).alias("shift"))
    trees = scratch.save(groups.withColumn("part", _part()).join(offsets, "part").select(F.col("group").alias("_group"), (F.col("_at") + F.col("shift")).alias("tree"), "size"), "trees")
    starts = counts.join(trees, F.col("group").eqNullSafe(F.col("_group"))).select("_group", F.col("part").alias("_part"), "tree", "size", (_before(["tree"]) - F.col("first")).alias("shift"))
    rows = ordered.join(starts, F.col("group").eqNullSafe(F.col("_group")) & (_part() == F.col("_part"))).withColumn("index", F.col("_at") + F.col("shift"))
    n, largest = trees.agg(F.count("*"), F.max("size")).first()
    return rows.select(*[c for c in leaves.columns if c != "group"], "tree", "size", "index"), trees.select("tree", "size"), n, largest or 0


def forest(rows: DataFrame, groups: int, scratch: Scratch) -> DataFrame:
    """All completed runs (tree, size, level, at = number of the run, digests) of rows (tree, size, index, leaf).

    Fragments are numbered by the task that made them, and FAN numbers at a time become one until no node is open.
    """
    nodes = rows.sortWithinPartitions("tree", "index").select(F.spark_partition_id().alias("part"), "tree", "size", F.lit(0).alias("level"), F.col("index").alias("at"), F.col("leaf").alias("digest"))
    done, k = [], 0
    while True:
        pieces = scratch.save(nodes.mapInArrow(_merged(groups), _PIECES), f"pieces{k}")
        done.append(pieces.where("not open").drop("part", "open"))
        left, last = pieces.where("open").agg(F.count("*"), F.max("part")).first()
        if not left:
            break
        parts = last // FAN + 1
        nodes = pieces.where("open").select(F.expr(f"part div {FAN}").cast("int").alias("part"), "tree", "size", "level", "at", F.col("digests")[0].alias("digest")).repartition(min(parts, shuffle_partitions(rows.sparkSession)), "part")
        k += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def height(size: int) -> int:
    """Levels above the leaves."""
    h = 0
    while ARITY**h < size:
        h += 1
    return h


def _side(digests: str, pos: str) -> Column:
    """The digests before and after a place, as text."""
    return F.expr(f"struct(array_join(slice({digests}, 1, cast({pos} as int)), '') as left, array_join(slice({digests}, cast({pos} as int) + 2, {ARITY}), '') as right)")


def _down(runs: DataFrame, level: int, above: DataFrame) -> DataFrame:
    """Paths (tree, index, path) of a level's nodes from those of the level above. A path goes from the node to the root."""
    up = above.select(F.col("tree").alias("_tree"), F.col("index").alias("_run"), F.col("path").alias("_path"))
    met = runs.where(F.col("level") == level).join(up, (F.col("tree") == F.col("_tree")) & (F.col("at") == F.col("_run")))
    each = met.select("tree", "at", "digests", "_path", F.posexplode("digests").alias("pos", "_digest"))
    return each.select("tree", (F.col("at") * ARITY + F.col("pos")).alias("index"), F.concat(F.array(_side("digests", "pos")), "_path").alias("path"))


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", id_col: str = "doc_id", text_col: str = "text", changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per input row, repeated ones too.

    proof_sha256 is the hash of a row's siblings on the way to the root; folded_root is what the way gives for the row as it
    is after tampering (where changed holds, its text has A-Z in lower case), and verified says if that is the root. Null
    values of any field are hashed as such; a null group is a group of its own, before all others, and differs from an empty
    one. Rows of a group that have the same identifier are ordered by hash. Columns other than fields count for nothing.
    Empty table: no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "manifest")
    changed = F.lit(False) if changed is None else F.coalesce(changed, F.lit(False))
    own = [F.col(c) for c in fields]
    bad = [F.when(changed, lowered(F.col(c))).otherwise(F.col(c)) if c == text_col else F.col(c) for c in fields]
    leaves = scratch.save(df.select(F.col(group).cast("string").alias("group"), F.col(id_col).alias("doc_id"), leaf_hash(own).alias("leaf"), leaf_hash(bad).alias("bad")), "leaves")
    rows, trees, groups, largest = placed(leaves, scratch)
    rows = scratch.save(rows, "rows")
    if not groups:
        return leaves.select("doc_id", "leaf", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.col("leaf").alias("proof_sha256"), F.col("leaf").alias("folded_root"), F.lit(True).alias("verified")).where("false")
    runs = forest(rows, groups, scratch)

    hashed = F.sha2(F.array_join("digests", ""), 256)
    lone = rows.where("size = 1").select("tree", F.col("leaf").alias("subroot"))
    subroots = runs.where(f"tree <> {TOP} and at = 0 and size > pow({ARITY}, level) and size <= pow({ARITY}, level + 1)").select("tree", hashed.alias("subroot")).unionByName(lone)
    top = height(groups)
    found = runs.where(f"tree = {TOP} and level = {top - 1}").select(hashed.alias("root")) if top else subroots.select(F.col("subroot").alias("root"))
    root = found.first()[0]

    no_path = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    above = spark.createDataFrame([(TOP, 0)], "tree long, index long").withColumn("path", no_path)
    for level in reversed(range(top)):
        above = _down(runs.where(f"tree = {TOP}"), level, above)
    roots = scratch.save(trees.join(above.select(F.col("index").alias("_index"), "path"), F.col("tree") == F.col("_index")).join(subroots, "tree").select("tree", "size", "subroot", "path"), "roots")
    levels = height(largest)
    at_root = lambda h: roots.where(f"size <= {ARITY**h}" + (f" and size > {ARITY ** (h - 1)}" if h else "")).select("tree", F.lit(0).cast("long").alias("index"), "path")
    below, above = runs.where(f"tree <> {TOP}"), at_root(levels)
    for level in reversed(range(1, levels)):
        above = _down(below, level, above).unionByName(at_root(level))
    last = below.where("level = 0").select("tree", "at", "digests")
    heads = last.join(above.select(F.col("tree").alias("_tree"), F.col("index").alias("_run"), "path"), (F.col("tree") == F.col("_tree")) & (F.col("at") == F.col("_run"))).select("tree", "at", "digests", "path")
    heads = heads.unionByName(at_root(0).select("tree", F.col("index").alias("at"), F.lit(None).cast("array<string>").alias("digests"), "path"))

    met = rows.join(heads.select(F.col("tree").alias("_tree"), F.col("at").alias("_run"), "digests", "path"), (F.col("tree") == F.col("_tree")) & (F.expr(f"index div {ARITY}") == F.col("_run")))
    full = met.select("doc_id", "leaf", "bad", "tree", F.when(F.col("digests").isNull(), F.col("path")).otherwise(F.concat(F.array(_side("digests", f"index % {ARITY}")), "path")).alias("path"))
    folded = F.aggregate("path", F.col("bad"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    proved = full.select("doc_id", "leaf", "tree", proof.alias("proof_sha256"), folded.alias("folded_root"))
    # Groups may be few and large, so their roots meet rows by broadcast where Spark finds them small, else by a join that it can split.
    return proved.join(roots.select(F.col("tree").alias("_tree"), "subroot"), F.col("tree") == F.col("_tree")).select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified")
    )
