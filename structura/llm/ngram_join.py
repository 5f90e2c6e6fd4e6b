"""Jaccard join of sets of word n-grams by grouped prefixes.

Two sets of at least NEED percent likeness share one of their rarest tokens: of n tokens in a common order, one of the first
n - ceil(NEED n / 100) + 1 (the prefix). The order is by how often a token's slot of a sketch occurs in the whole corpus (rare
first, ties by hash), so what thousands of texts share comes late; any order gives right results.

Equal sets are one class. Classes of equal size with equal prefixes are one group, and candidate pairs are pairs of groups: they
share a prefix token, their sizes allow the likeness, so does what comes after the shared token, and, for groups of one, so do
256-bit parities of their tokens. Pairs expand to members. Parities of as many bits as a set's size asks for then leave out what
256 bits can't tell apart in long texts; of the pairs that remain, which are links or of nearly that likeness, the full sets are compared.

Tokens that a few groups share bring these together in pairs. Others are dealt to buckets by size. Only connected texts are
asked for, so a dense bucket isn't taken apart into all its pairs at first: its first and last group, as leaders, meet the others (pairs grow in proportion to the tokens), and so do the first member of a group and its others. A
few more leaders, drawn for each bucket, meet what these links leave unconnected in it; what is still left, and only that,
meets in pairs. Sets come from the texts again, only for classes in a pair and once for each; a class in many pairs spreads
over as many keys as it needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structura.llm.common import Scratch, byte_views, lean, shuffle_partitions, texts
from structura.llm.simhash import components, labelled

NEED = 90
#: Slots of the sketch, and the pieces in which tasks hand theirs over.
SLOT_BITS, PIECES = 20, 64
#: Groups beyond which a token or a bucket is dense, and the leaders drawn for it in the second round.
DENSE, DRAWN = 32, 4
#: Pairs that one key of a comparison holds.
PAIRS = 512
#: Slots of the filter of rows whose sets are wanted.
FILTER_BITS = 22
#: Distinct words whose hashes a worker keeps, and the longest of them.
WORDS, LONGEST = 1 << 19, 64
_TIMES = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """The XXH64 hash of each word; short words are kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.clear()
            self[word] = found
        return found


_hashes = _Hashes()


def shingles(text: bytes, words: int = 3) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending: A-Z lower-cased, words between white space. A shorter text is one shingle, one without words none."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    each = np.array([_hashes[w] for w in parts], np.uint64)
    n = min(words, len(parts))
    out = np.full(len(parts) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * _TIMES + each[k : len(parts) - n + 1 + k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefix_length(n: int, need: int = NEED) -> int:
    """Of a set of n tokens: how many of the first ones hold one that any set alike also has among its first."""
    return n - -(-need * n // 100) + 1 if n else 0


def least_shared(a, b, need: int = NEED):
    """The tokens that sets of a and b tokens share at least if they are alike."""
    return -(-need * (a + b) // (100 + need))


def parities(tokens: np.ndarray) -> np.ndarray:
    """Of each class of tokens by their lowest bits, whether a set has an odd number: as many bits (a power of two, 256 at least) as tokens or more, in 64-bit words."""
    m = max(256, 1 << len(tokens).bit_length())
    odd = np.bincount((tokens & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, length: int) -> np.ndarray:
    """Parities in fewer words, as if made so."""
    while len(words) > length:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def sketch(rows: DataFrame, words: int) -> np.ndarray:
    """For every slot the number of (text, token) pairs in the whole corpus, up to 2**32 - 1."""
    width = (1 << SLOT_BITS) // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in batches:
            for v in byte_views(batch.column("text")):
                at = slots(shingles(bytes(v), words))  # ascending, as the tokens are
                counts[at] += 1
                again = np.flatnonzero(at[1:] == at[:-1])  # several tokens of a text in a slot
                if len(again):
                    np.add.at(counts, at[again], 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([counts[k * width : (k + 1) * width].tobytes() for k in range(PIECES)], pa.binary())], names=["piece", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, raw in zip(batch.column("piece").to_pylist(), byte_views(batch.column("counts"))):
                held[piece] = held.get(piece, 0) + np.frombuffer(raw, np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([np.minimum(c, 0xFFFFFFFF).astype(np.uint32).tobytes() for c in held.values()], pa.binary())], names=["piece", "counts"])

    form = "piece int, counts binary"
    merged = rows.select("text").mapInArrow(lean(count), form).repartition(PIECES, "piece").mapInArrow(lean(merge), form)
    out = np.zeros(1 << SLOT_BITS, np.uint32)
    for r in merged.collect():  # a table of fixed size, whatever the corpus
        out[r.piece * width : (r.piece + 1) * width] = np.frombuffer(r.counts, np.uint32)
    return out


def prefixes(rows: DataFrame, words: int, need: int, counts: np.ndarray) -> DataFrame:
    """doc_id, n, fp (a 128-bit hash of the set), prefix (tokens in order), b0 to b3 (parities of the set's tokens), bits (longer ones of larger sets)."""
    shared = rows.sparkSession.sparkContext.broadcast(counts.tobytes())

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        often = np.frombuffer(shared.value, np.uint32)
        for batch in batches:
            n, fps, firsts, short, long = [], [], [], [], []
            for v in byte_views(batch.column("text")):
                own = shingles(bytes(v), words)
                n.append(len(own))
                fps.append(xxhash.xxh3_128_digest(own.tobytes()))
                firsts.append(own[np.lexsort((own, often[slots(own)]))[: prefix_length(len(own), need)]].tobytes())
                odd = parities(own)
                short.append(folded(odd, 4).view(np.int64))
                long.append(odd.tobytes() if len(odd) > 4 else None)
            quarters = np.array(short, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(fps, pa.binary()), pa.array(firsts, pa.binary()), *[pa.array(quarters[:, k]) for k in range(4)], pa.array(long, pa.binary())],
                names=["doc_id", "n", "fp", "prefix", "b0", "b1", "b2", "b3", "bits"],
            )

    return rows.mapInArrow(lean(stage), "doc_id long, n int, fp binary, prefix binary, b0 long, b1 long, b2 long, b3 long, bits binary")


def entries(groups: DataFrame) -> DataFrame:
    """(token, pos, gid, n): a row for each token of each group's prefix."""
    rest = ["gid", "n"]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                tokens = [np.frombuffer(v, np.int64) for v in byte_views(part.column("prefix"))]
                sizes = np.array([len(t) for t in tokens])
                at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(pos, pa.int32()), *[part.column(c).take(at) for c in rest]], names=["token", "pos", *rest])

    return groups.select("prefix", *rest).mapInArrow(lean(stage), "token long, pos int, gid long, n int")


def _fits(a: str, b: str, need: int) -> Column:
    """Whether sizes and parities allow two sets (columns n, b0 to b3 of both) to be alike; no parities: nothing said."""
    apart = " + ".join(f"bit_count({a}.b{k} ^ {b}.b{k})" for k in range(4))
    return _sizes(a, b, need) & F.expr(f"coalesce({apart}, 0) <= {a}.n + {b}.n - 2 * {least_shared_sql(f'({a}.n + {b}.n)', need)}")


def _sizes(a: str, b: str, need: int) -> Column:
    return F.expr(f"100 * least({a}.n, {b}.n) >= {need} * greatest({a}.n, {b}.n)")


def least_shared_sql(total: str, need: int) -> str:
    return f"(({need} * {total} + {99 + need}) div {100 + need})"


def _positions(a: str, b: str, need: int) -> Column:
    """Whether enough may follow a shared token: right for the first that two sets share, which is in both prefixes."""
    return F.expr(f"least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {least_shared_sql(f'({a}.n + {b}.n)', need)}")


def likely(pairs: DataFrame, named: DataFrame, need: int) -> DataFrame:
    """Those pairs (a, b) of classes that may be alike by their long parities: the shorter ones of two sets differ in no more bits than the sets in tokens."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (byte_views(batch.column(c)) for c in ("x_bits", "y_bits"))
            total = batch.column("total").to_numpy()
            apart = total - 2 * least_shared(total, 0, need)  # what sets alike differ in at most
            keep = np.ones(batch.num_rows, bool)
            for k, (v, w) in enumerate(zip(left, right)):
                if len(v) and len(w):
                    x, y = np.frombuffer(v, np.uint64), np.frombuffer(w, np.uint64)
                    least = min(len(x), len(y))
                    keep[k] = int(np.bitwise_count(folded(x, least) ^ folded(y, least)).sum()) <= apart[k]
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("a", "b")], names=["a", "b"])

    own = named.select("cid", "n", "bits")
    x, y = (own.select(*[F.col(c).alias(f"{s}_{c}") for c in own.columns]) for s in "xy")
    both = pairs.join(x, F.col("a") == F.col("x_cid")).join(y, F.col("b") == F.col("y_cid"))
    return both.select("a", "b", F.expr("x_n + y_n").cast("long").alias("total"), "x_bits", "y_bits").mapInArrow(lean(check), "a long, b long")


class Sets:
    """The token sets of classes, from the texts, written once for each class that is asked for."""

    def __init__(self, rows: DataFrame, classes: DataFrame, words: int, scratch: Scratch):
        self.rows, self.classes, self.words, self.scratch, self.tables = rows, classes, words, scratch, []

    def of(self, wanted: DataFrame) -> DataFrame:
        """(cid, shingles) of at least the classes of wanted (cid)."""
        for table in self.tables:
            wanted = wanted.join(table.select("cid"), "cid", "left_anti")
        name, scratch, words = f"sets{len(self.tables)}", self.scratch, self.words
        wanted = scratch.save(wanted.distinct().join(self.classes.select("cid", "fp", "rep"), "cid"), f"{name}_wanted")
        slot = F.expr(f"coalesce(xxhash64(rep), 0) & {(1 << FILTER_BITS) - 1}")
        used = np.zeros((1 << FILTER_BITS) // 64, np.uint64)
        for r in wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).collect():
            used[r.word] = r.bits & 0xFFFFFFFFFFFFFFFF
        shared = self.rows.sparkSession.sparkContext.broadcast(used.tobytes())

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            filled = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
            for batch in batches:
                use = np.flatnonzero(filled[batch.column("slot").to_numpy()])
                views = byte_views(batch.column("text"))
                own = [shingles(bytes(views[k]), words).tobytes() for k in use.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(use)), pa.array([xxhash.xxh3_128_digest(s) for s in own], pa.binary()), pa.array(own, pa.binary())], names=["rep", "fp", "shingles"])

        found = texts(self.rows).withColumnRenamed("doc_id", "rep").select("rep", slot.alias("slot"), "text").mapInArrow(lean(sets), "rep long, fp binary, shingles binary")
        own = wanted.select("cid", F.col("fp").alias("_fp"), F.col("rep").alias("_rep"))
        self.tables.append(scratch.save(found.join(own, (found["fp"] == own["_fp"]) & found["rep"].eqNullSafe(own["_rep"])).select("cid", "shingles"), name))
        out = self.tables[0]
        for table in self.tables[1:]:
            out = out.unionByName(table)
        return out


def compared(pairs: DataFrame, sets: Sets, need: int, name: str) -> DataFrame:
    """(src, dst) of the pairs (a, b) of classes that are alike, by their sets."""
    scratch = sets.scratch
    parts = shuffle_partitions(pairs.sparkSession)
    held = sets.of(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))))
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).alias("salts"))
    dealt = scratch.save(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt")), f"{name}_dealt")
    # Both sides of a comparison ask for their sets in one join, so the sets are exchanged once.
    heads = dealt.select("a", "salt").distinct().select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("asked"))
    asked = heads.unionByName(dealt.select("a", "salt", "b", F.col("b").alias("asked")))
    rows = asked.join(held, F.col("asked") == F.col("cid")).select("a", "salt", "b", "shingles")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = None, None
        for batch in batches:
            src, dst = [], []
            for a, b, raw in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), byte_views(batch.column("shingles"))):
                own = np.frombuffer(raw, np.uint64)
                if b is None:
                    now, base = a, own.copy()
                elif a == now and 100 * min(len(own), len(base)) >= need * max(len(own), len(base)):
                    at = np.minimum(np.searchsorted(base, own), len(base) - 1)
                    if int((base[at] == own).sum()) >= least_shared(len(base), len(own), need):
                        src.append(a)
                        dst.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    met = rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return scratch.save(met.mapInArrow(lean(check), "src long, dst long"), name)


_PARITIES = ["b0", "b1", "b2", "b3"]


class _Groups:
    """Classes of equal size and prefix as groups, and what is known of their components so far."""

    def __init__(self, classes: DataFrame, need: int, scratch: Scratch):
        self.need, self.scratch = need, scratch
        alone = [F.when(F.col("members") == 1, F.col(c)).alias(c) for c in _PARITIES]
        self.all = scratch.save(classes.groupBy("n", "prefix").agg(F.min("cid").alias("gid"), F.count("*").alias("members"), *[F.min(c).alias(c) for c in _PARITIES]).select("gid", "n", "prefix", "members", *alone), "groups")
        several = self.all.where("members > 1").select(F.col("gid").alias("_gid"), F.col("n").alias("_n"), F.col("prefix").alias("_prefix"))
        self.members = scratch.save(classes.join(several, (F.col("n") == F.col("_n")) & (F.col("prefix") == F.col("_prefix"))).select(F.col("_gid").alias("gid"), "cid", "n", *_PARITIES), "members")

    def shared(self) -> tuple[DataFrame, DataFrame]:
        """entries() of tokens that a few groups share, and those of the others (dense tokens) in buckets of sizes.

        A dense row has step (its size's bucket), bucket (its own or the next, as sizes that allow the likeness lie in one or in
        neighbours), size (groups there, several at least), first and last (of those).
        """
        each = entries(self.all)
        common = each.groupBy(F.col("token").alias("_token")).agg(F.count("*").alias("sharing")).where("sharing > 1")  # a group has a token once
        shared = self.scratch.save(each.join(common, F.col("token") == F.col("_token")).drop("_token"), "shared")
        step = F.floor(F.log("n") / (math.log(100 / self.need) * 1.0001)).cast("int")
        bucketed = shared.where(F.col("sharing") > DENSE).drop("sharing").withColumn("step", step).withColumn("bucket", F.explode(F.array("step", F.col("step") + 1)))
        one = F.struct("gid", "n", "pos")
        several = bucketed.groupBy(F.col("token").alias("_token"), F.col("bucket").alias("_bucket")).agg(F.min(one).alias("first"), F.max(one).alias("last"), F.count("*").alias("size")).where("size > 1")
        crowded = bucketed.join(several, (F.col("token") == F.col("_token")) & (F.col("bucket") == F.col("_bucket"))).drop("_token", "_bucket")
        return shared.where(F.col("sharing") <= DENSE).drop("sharing"), self.scratch.save(crowded, "crowded")

    def leading(self, shared: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes: the first and last group of each dense bucket with its others, and a group's first member with its others."""
        each = shared.where(F.col("size") > DENSE).select("gid", "n", "pos", F.explode(F.array("first", "last")).alias("l")).select(F.struct("gid", "n", "pos").alias("x"), "l")
        met = each.where(F.expr("x.gid <> l.gid") & _sizes("x", "l", self.need) & _positions("x", "l", self.need)).select(F.col("l.gid").alias("g"), F.col("x.gid").alias("h")).distinct()
        x, y = (self.all.select("gid", "n", *_PARITIES).alias(s) for s in "xy")
        near = met.join(x, F.expr("g = x.gid")).join(y, F.expr("h = y.gid")).where(_fits("x", "y", self.need)).select(F.col("g").alias("a"), "h")
        expanded = near.join(self.members.select("gid", "cid"), F.col("h") == F.col("gid"), "left").select("a", F.coalesce("cid", "h").alias("b"))
        return expanded.unionByName(self.members.where("cid <> gid").select(F.col("gid").alias("a"), F.col("cid").alias("b"))).distinct()

    def labelled(self, joined: DataFrame, name: str) -> DataFrame:
        """(gid, cid, n, b0 to b3, label) of all classes that may have a partner."""
        single = self.all.where("members = 1").select("gid", F.col("gid").alias("cid"), "n", *_PARITIES)
        every = self.members.unionByName(single).join(joined.select(F.col("node").alias("_node"), F.col("label").alias("_label")), F.col("cid") == F.col("_node"), "left")
        return self.scratch.save(every.select("gid", "cid", "n", *_PARITIES, F.coalesce("_label", "cid").alias("label")), name)

    def open_pairs(self, sparse: DataFrame, shared: DataFrame, known: DataFrame, drawn: bool, name: str) -> DataFrame:
        """Pairs of groups (g < h) that share a token, aren't both in one component and may be alike: drawn leaders of dense buckets and the others, or all.

        Dense buckets lose their rows first where they are one component by now; in the others no more than DENSE rows meet.
        """
        one = F.count("*") == 1
        state = known.groupBy(F.col("gid").alias("_gid")).agg(F.min("label").alias("low"), F.max("label").alias("high"), *[F.when(one, F.min(c)).alias(c) for c in _PARITIES])
        slim = shared.select("token", "bucket", "step", "size", "gid", "n", "pos")
        attach = lambda rows: rows.join(state, F.col("gid") == F.col("_gid")).drop("_gid")
        dense = attach(slim.where(F.col("size") > DENSE))
        open_ = dense.groupBy(F.col("token").alias("_token"), F.col("bucket").alias("_bucket")).agg(F.min("low").alias("_low"), F.max("high").alias("_high")).where("_low < _high").select("_token", "_bucket")
        rows = dense.join(open_, (F.col("token") == F.col("_token")) & (F.col("bucket") == F.col("_bucket"))).drop("_token", "_bucket")
        rows = self.scratch.save(rows, f"{name}_dense")
        apart = F.expr("x.token = y.token and not (x.low = x.high and x.low = y.low and y.low = y.high)") & _fits("x", "y", self.need) & _positions("x", "y", self.need)
        if drawn:
            order = Window.partitionBy("token", "bucket").orderBy(F.xxhash64("token", "gid"), "gid")
            leaders = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= DRAWN)
            met = rows.alias("x").join(leaders.alias("y"), F.expr("x.bucket = y.bucket and x.gid <> y.gid") & apart)
        else:
            rows = rows.unionByName(self.scratch.save(attach(slim.where(F.col("size") <= DENSE)), f"{name}_sparse"))
            met = rows.alias("x").join(rows.alias("y"), F.expr("x.bucket = y.bucket and x.gid < y.gid and x.bucket = greatest(x.step, y.step)") & apart)
        pair = (F.least("x.gid", "y.gid").alias("g"), F.greatest("x.gid", "y.gid").alias("h"))
        met = met.select(*pair)
        if not drawn:
            few = self.scratch.save(attach(sparse), f"{name}_few")
            met = met.unionByName(few.alias("x").join(few.alias("y"), F.expr("x.gid < y.gid") & apart).select(*pair))
        met = met.distinct()
        return met if drawn else met.unionByName(state.where("low < high").select(F.col("_gid").alias("g"), F.col("_gid").alias("h")))

    def expanded(self, met: DataFrame, named: DataFrame) -> DataFrame:
        """Pairs of members (a < b) of pairs of groups (g, h), of different components, that parities allow."""
        left, right = (named.select(*[F.col(c).alias(f"{s}_{c}") for c in named.columns]) for s in "xy")
        side = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("n", *_PARITIES)]).alias(s)
        grown = met.join(left, F.col("g") == F.col("x_gid")).join(right, F.col("h") == F.col("y_gid")).where("x_label <> y_label and (g <> h or x_cid < y_cid)")
        grown = grown.select(F.least("x_cid", "y_cid").alias("a"), F.greatest("x_cid", "y_cid").alias("b"), side("x"), side("y"))
        return grown.where(_fits("x", "y", self.need)).select("a", "b").distinct()


def linked(rows: DataFrame, classes: DataFrame, named: DataFrame, words: int, need: int, scratch: Scratch) -> DataFrame:
    """(node, label): the component of every class (cid, n, prefix, b0 to b3) that is linked with another. named: cid, fp, rep, n, bits."""
    groups = _Groups(classes, need, scratch)
    scratch.drop("classes")
    sets = Sets(rows, named, words, scratch)
    sparse, shared = groups.shared()
    pairs = scratch.save(likely(groups.leading(shared), named, need), "leading")
    links = compared(pairs, sets, need, "leading_links")
    joined = components(links, scratch)
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for turn in ("drawn", "rest"):
        known = groups.labelled(joined, f"{turn}_known")
        met = groups.open_pairs(sparse, shared, known, turn == "drawn", turn)
        pairs = scratch.save(likely(groups.expanded(met, known).join(tried, ["a", "b"], "left_anti"), named, need), turn)
        if pairs.isEmpty():
            continue
        links = links.unionByName(compared(pairs, sets, need, f"{turn}_links"))
        tried = tried.unionByName(pairs)
        joined = components(links, scratch)
    return joined


def similar_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, need: int = NEED) -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (smallest identifier reachable through links, itself included).

    One row per input row, repeated ones too. Two texts are linked when 100 times the tokens that their sets share are `need`
    (50 or more) times those of the union or more. A text without words (null, empty, blanks only) has an empty set and is linked with
    nothing, not even an equal one: its component is its own identifier. A null identifier is never a component's smallest
    unless all are null. Sets are of 64-bit hashes. Empty table: no rows. Other columns count for nothing.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "ngrams")
    rows = texts(df, id_col, text_col)
    counts = sketch(rows, words)
    docs = scratch.save(prefixes(rows, words, need, counts), "docs")
    kept = ["n", "prefix", "b0", "b1", "b2", "b3"]
    classes = docs.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), *[F.min(c).alias(c) for c in [*kept, "bits"]])
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    slim = scratch.save(docs.select("doc_id", "n", "fp"), "own")
    named = scratch.save(classes.select("cid", "fp", "rep", "n", "bits"), "class_names")
    scratch.drop("docs")
    joined = linked(rows, classes, named, words, need, scratch)
    labels = scratch.save(named.join(joined, F.col("cid") == F.col("node"), "left").select("fp", "rep", F.coalesce("label", "cid").alias("label")), "labels")
    least = labels.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = labels.join(least, "label").select("fp", "component_id")
    full = labelled(slim.where("n > 0"), found, scratch).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return full.unionByName(slim.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
