"""Hard negatives by a Voronoi-partitioned nearest-neighbour join.

A row's score with an anchor is the integer inner product of their vectors. With one more component, sqrt(M - |y|^2) for
rows (M: the largest squared norm) and 0 for anchors, every row has the norm sqrt(M) and |x - y|^2 = |x|^2 + M - 2 score: the
best scores are the nearest points. Pivots, from a bounded sample, cut the space into Voronoi cells; anchors of near cells
form a group, those of a crowded cell several.

Each search (an anchor's positives, then its negatives below each positive) is two joins. In the first every row meets the
group of its own cell, which bounds how far any anchor still has to look. A cell of a group has the maximum of its anchors'
distance from the pivot and reach as its bound, and in the second join a row goes to those groups that have a cell within
whose bound it lies (for negatives also beyond an inner one, as a negative may not beat its positive): a group that it
doesn't go to can't need it, by the triangle inequality, so the result is exact. Within a group rows are dealt to blocks, as
many as its rows take, so that a crowded one spreads; a block keeps the best of each search, and those of all blocks meet in
a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structura.llm.common import Scratch, lean, shuffle_partitions

#: Rows of the sample that pivots come from, pivots at most, and rounds of moving them to the middle of their cells.
SAMPLE, CELLS, ROUNDS = 1024, 256, 5
#: Anchors of a group: at least the first number, a share of all, at most the last.
GROUP_LEAST, GROUP_SHARE, GROUP_MOST = 256, 64, 1 << 16
#: Labels fall into so many slots, each with a bound of its own.
SLOTS = 16
#: Searches that one step compares with a batch of rows, and candidates held before they are thinned to the best.
STEP, HELD = 1024, 1 << 18
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

_ROWS = "vec_id long, label long, q binary, norm2 double"
_FOUND = "uid long, rank int, score long, vec_id long"


def quantised(df: DataFrame, id_col: str, vector_col: str, label_col: str, anchor) -> DataFrame:
    """vec_id, label, q (32-bit integers floor(256 x)), norm2, anchor of the rows that take part."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            if not len(vectors):
                continue
            ends, values = np.asarray(vectors.offsets), vectors.values.to_numpy(zero_copy_only=False)  # a null component is NaN
            wrong = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            use = np.flatnonzero(wrong[ends[1:]] == wrong[ends[:-1]])
            with np.errstate(invalid="ignore"):
                whole = np.floor(values * 256.0)
            raw, norms = [], []
            for i in use.tolist():
                own = whole[ends[i] : ends[i + 1]]
                if len(own) and np.abs(own).max() >= 1 << 31:
                    raise ValueError("components of 2**23 or more give scores that don't fit a long")
                raw.append(own.astype("<i4").tobytes())
                norms.append(float(own @ own))
            rest = [batch.column(c).take(pa.array(use)) for c in ("vec_id", "label", "anchor")]
            yield pa.RecordBatch.from_arrays([*rest[:2], pa.array(raw, pa.binary()), pa.array(norms, pa.float64()), rest[2]], names=["vec_id", "label", "q", "norm2", "anchor"])

    own = df.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor")
    )
    return own.where("label is not null and vector is not null").mapInArrow(lean(stage), f"{_ROWS}, anchor boolean")


def _matrix(column, dim: int) -> np.ndarray:
    """A binary column of 32-bit integers as rows of dim doubles; shorter vectors end in zeros."""
    raw = column.to_pylist()
    if all(len(r) == 4 * dim for r in raw):
        return np.frombuffer(b"".join(raw), "<i4").reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(raw), dim))
    for k, r in enumerate(raw):
        own = np.frombuffer(r, "<i4")
        out[k, : len(own)] = own
    return out


class Space:
    """Pivots in the space with one more component."""

    def __init__(self, sample: list[bytes], dim: int, most: float, cells: int):
        self.dim, self.most = dim, most
        points = self.rows(_matrix(pa.array(sample, pa.binary()), dim)) if sample else np.zeros((1, dim + 1))
        points = np.unique(points, axis=0)
        points = points[np.random.default_rng(1).permutation(len(points))]
        self.pivots = points[:cells].copy()
        for _ in range(ROUNDS):
            home = self.distances(points).argmin(axis=1)
            for k in range(len(self.pivots)):
                if (home == k).any():
                    self.pivots[k] = points[home == k].mean(axis=0)
        self.slack = 1e-6 * (1 + np.sqrt(most) + np.sqrt((self.pivots**2).sum(axis=1).max()))

    def rows(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q, np.sqrt(np.maximum(0.0, self.most - (q * q).sum(axis=1)))[:, None]], axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        square = (points * points).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None] - 2.0 * points @ self.pivots.T
        return np.sqrt(np.maximum(0.0, square))


def anchored(anchors: DataFrame, space: Space) -> DataFrame:
    """anchors (uid, vec_id, label, q, norm2) with their cell and the distance du from its pivot."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("q"), space.dim)
            apart = space.distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1))
            cell = apart.argmin(axis=1) if len(q) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(apart[np.arange(len(q)), cell], pa.float64())], names=[*batch.schema.names, "cell", "du"])

    return anchors.mapInArrow(lean(stage), f"uid long, {_ROWS}, cell int, du double")


def grouped(counts: dict[int, int], space: Space) -> tuple[np.ndarray, np.ndarray]:
    """For every cell its (first) group and the number of its groups: near cells share one until it is full, a crowded one has several."""
    most = min(max(GROUP_LEAST, -(-sum(counts.values()) // GROUP_SHARE)), GROUP_MOST)
    n = len(space.pivots)
    first, groups, held, next_group = np.zeros(n, int), np.ones(n, int), 0, 0
    apart, left, at = space.distances(space.pivots), set(range(n)), 0
    while left:
        left.remove(at)
        own = counts.get(at, 0)
        if own > most:
            groups[at] = -(-own // most)
            next_group += held > 0
            first[at] = next_group
            next_group, held = next_group + groups[at], 0
        else:
            if held and held + own > most:
                next_group, held = next_group + 1, 0
            first[at], held = next_group, held + own
            held = max(held, 1)
        if left:
            at = min(left, key=lambda k: (apart[at, k], k))
    return first, groups


def routed(rows: DataFrame, space: Space, first: np.ndarray, groups: np.ndarray, bounds: dict | None) -> DataFrame:
    """rows (row, vec_id, label, q) once for each group that they meet: that of their own cell, or, given bounds, the others within reach.

    bounds: by (group, cell) the inner bound and the outer bound of each slot.
    """
    table = {}
    if bounds is not None:
        keys = sorted(bounds)
        table = {"group": np.array([g for g, _ in keys], int), "cell": np.array([c for _, c in keys], int), "inner": np.array([bounds[k][0] for k in keys]), "outer": np.array([bounds[k][1] for k in keys]).reshape(-1, SLOTS)}
        table["starts"] = np.flatnonzero(np.concatenate(([True], np.diff(table["group"]) > 0))) if keys else np.zeros(0, int)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            apart = space.distances(space.rows(_matrix(batch.column("q"), space.dim)))
            cell, number = apart.argmin(axis=1), batch.column("row").to_numpy()
            home = first[cell] + number % groups[cell]
            if bounds is None:
                at, group = np.arange(n), home
            elif not len(table["group"]):
                continue
            else:
                slot = batch.column("label").to_numpy() % SLOTS
                far = apart[:, table["cell"]]
                near = (far <= table["outer"][:, slot].T + space.slack) & (far >= table["inner"][None] - space.slack)
                meets = np.logical_or.reduceat(near, table["starts"], axis=1)
                each = table["group"][table["starts"]]
                meets &= each[None] != home[:, None]
                at, k = np.nonzero(meets)
                group = each[k]
            for k in range(0, len(at), 4096):
                own = batch.take(pa.array(at[k : k + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(group[k : k + 4096], pa.int32()), *own.columns], names=["group", *own.schema.names])

    return rows.select("row", "vec_id", "label", "q").mapInArrow(lean(stage), "group int, row long, vec_id long, label long, q binary")


class _Best:
    """The k best of each search: by score, then identifier, null ones last."""

    def __init__(self, searches: int, k: int, low: np.ndarray):
        self.k, self.low, self.held, self.n = k, low.copy(), [], 0

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        self.held.append((search, score, ids, null))
        self.n += len(search)
        if self.n > HELD:
            self.thin()

    def thin(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return tuple(np.zeros(0, t) for t in (int, np.int64, np.int64, bool))
        search, score, ids, null = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((ids, null, -score, search))
        search, score, ids, null = (c[order] for c in (search, score, ids, null))
        starts = np.flatnonzero(np.concatenate(([True], np.diff(search) > 0)))
        place = np.arange(len(search)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(search)]))))
        keep = place < self.k
        full = place == self.k - 1
        self.low[search[full]] = np.maximum(self.low[search[full]], score[full])
        out = tuple(c[keep] for c in (search, score, ids, null))
        self.held, self.n = [out], int(keep.sum())
        return out


def _searching(dim: int, k: int, same: bool, exact: bool):
    """An Arrow stage: rows sorted by (group, block, kind), anchors (kind 0) before rows, become the k best of each search in each block."""
    number = np.float64 if exact else np.int64  # doubles hold all scores exactly, or integers do

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, ready = None, [], None

        def begin() -> tuple:
            uid, ids, labels, q = (np.concatenate(c) for c in zip(*(own[:4] for own in anchors)))
            ranks, lows, highs = ([x for own in c for x in own] for c in zip(*(own[4:] for own in anchors)))
            owner = np.repeat(np.arange(len(uid)), [len(r) for r in ranks])
            flat = lambda c, t: np.array([x for own in c for x in own], t)
            low = flat(lows, np.int64).astype(number)
            return uid, ids, labels, q.astype(number), owner, flat(ranks, np.int32), flat(highs, np.int64).astype(number), _Best(len(owner), k, low)

        def close() -> Iterator[pa.RecordBatch]:
            if ready is None:
                return
            search, score, ids, null = ready[-1].thin()
            if len(search):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ready[0][ready[4][search]]), pa.array(ready[5][search]), pa.array(score.astype(np.int64)), pa.array(ids, mask=null)], names=["uid", "rank", "score", "vec_id"]
                )

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("group", "block", "kind")])
            cuts = np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                place, own = tuple(key[:2, a]), batch.slice(a, b - a)
                if place != now:
                    yield from close()
                    now, anchors, ready = place, [], None
                ids = own.column("vec_id")
                null = np.asarray(ids.is_null())
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                labels, q = own.column("label").to_numpy(), _matrix(own.column("q"), dim)
                if key[2, a] == 0:
                    anchors.append((own.column("uid").to_numpy(), ids, labels, q, *(own.column(c).to_pylist() for c in ("ranks", "lows", "highs"))))
                    continue
                if ready is None:
                    if not anchors:
                        continue
                    ready = begin()
                uid, own_ids, own_labels, points, owner, _, highs, best = ready
                for s in range(0, len(owner), STEP):
                    mine = owner[s : s + STEP]
                    low = best.low[s : s + STEP]
                    first, last = mine[0], mine[-1] + 1
                    scores = (points[first:last] @ q.astype(number).T)[mine - first]
                    alike = own_labels[mine][:, None] == labels[None]
                    fits = (scores >= low[:, None]) & (scores <= highs[s : s + STEP, None]) & (alike == same)
                    if same:
                        fits &= null[None] | (own_ids[mine][:, None] != ids[None])
                    if scores.shape[1] > k:  # no more than the k best of the batch, ties included
                        kth = np.partition(np.where(fits, scores, number(LOWEST)), -k, axis=1)[:, -k]
                        fits &= scores >= kth[:, None]
                    search, at = np.nonzero(fits)
                    if len(search):
                        best.add(search + s, scores[search, at], ids[at], null[at])
        yield from close()

    return stage


def _search(routes: DataFrame, anchors: DataFrame, space: Space, k: int, same: bool, scratch: Scratch, name: str) -> DataFrame:
    """(uid, rank, score, vec_id): the k best of each search among the rows routed to its group, of each block of them.

    anchors: uid, vec_id, label, q, group, ranks, lows, highs (a search each, its scores from low to high).
    """
    spark = routes.sparkSession
    parts = shuffle_partitions(spark)
    per_group = routes.groupBy("group").agg(F.count("*").alias("n")).collect()  # as many as groups
    size = max(1024, sum(r.n for r in per_group) // (4 * parts))
    blocks = F.broadcast(spark.createDataFrame([(r.group, -(-r.n // size)) for r in per_group], "group int, blocks int"))
    left = anchors.join(blocks, "group").select(
        F.lit(0).alias("kind"), "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "uid", "vec_id", "label", "q", "ranks", "lows", "highs"
    )
    right = routes.join(blocks, "group").select(
        F.lit(1).alias("kind"), "group", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"), F.lit(0).cast("long").alias("uid"), "vec_id", "label", "q",
        F.lit(None).cast("array<int>").alias("ranks"), F.lit(None).cast("array<long>").alias("lows"), F.lit(None).cast("array<long>").alias("highs"),
    )
    met = left.unionByName(right).repartition(parts, "group", "block").sortWithinPartitions("group", "block", "kind")
    return scratch.save(met.mapInArrow(lean(_searching(space.dim, k, same, space.most < 1 << 53)), _FOUND), name)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid", "rank").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _bounds(anchors: DataFrame, labelled: bool) -> dict:
    """By (group, cell): the inner bound, and the outer bound of each slot. anchors: group, cell, label, du, nearest, reach (null: none to look for)."""
    slot = F.pmod("label", F.lit(SLOTS)) if labelled else F.lit(0)
    out: dict = {}
    for r in anchors.where("reach is not null").groupBy("group", "cell", slot.cast("int").alias("slot")).agg(F.min(F.col("nearest") - F.col("du")).alias("inner"), F.max(F.col("reach") + F.col("du")).alias("outer")).collect():
        inner, outer = out.setdefault((r.group, r.cell), (np.inf, np.full(SLOTS, -np.inf)))
        outer[slice(None) if not labelled else r.slot] = r.outer
        out[(r.group, r.cell)] = (min(inner, r.inner), outer)
    return out


def hard_negatives(df: DataFrame, anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor (a condition) says which rows are anchors. An anchor's positives are its first `positives` other rows of the same
    label, by score, then identifier; for each, the first `negatives` rows of another label whose score is at most the
    positive's and at least least[0] / least[1] of it. Where a positive's score is below zero there are none.

    Rows with a null label, a null vector or a null or non-finite component take no part. A null identifier comes after all
    others among ties and is no anchor; rows that have the anchor's identifier aren't its positives. Rows that repeat
    otherwise count each time, anchors that repeat in full once. The end of a shorter vector counts as zeros. Components of
    2**23 or more raise an error. Few rows give fewer pairs, an empty table none. Other columns count for nothing.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = scratch.save(quantised(df, id_col, vector_col, label_col, anchor).withColumn("row", F.monotonically_increasing_id()), "rows")
    anchors = scratch.save(rows.where("anchor and vec_id is not null").groupBy("vec_id", "label", "q").agg(F.first("norm2").alias("norm2")).withColumn("uid", F.monotonically_increasing_id()), "anchors")
    most, length, n = rows.agg(F.max("norm2"), F.max(F.length("q")), F.count("*")).first()
    count = anchors.count()
    if most is not None and most >= 1 << 62:
        raise ValueError("norms of 2**31 or more give scores that don't fit a long")
    cells = min(CELLS, max(8, count // 8))
    sample = [r.q for r in rows.orderBy(F.xxhash64("row", "q"), "row").select(F.col("q")).limit(SAMPLE).collect()]
    space = Space([bytes(q) for q in sample], max(1, (length or 0) // 4), most or 0.0, cells)

    placed = scratch.save(anchored(anchors.select("uid", "vec_id", "label", "q", "norm2"), space), "placed")
    first, groups = grouped({r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}, space)
    where = F.broadcast(spark.createDataFrame([(k, int(first[k]), int(groups[k])) for k in range(len(first))], "cell int, _first int, _groups int"))
    placed = placed.join(where, "cell").withColumn("group", (F.col("_first") + F.pmod("uid", "_groups")).cast("int")).drop("_first", "_groups")
    reach = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("norm2") + F.lit(float(most or 0)) - 2.0 * score))

    def both(searches: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """searches: anchors with ranks, lows, highs. Meets home rows, then those within reach."""
        near = _search(routed(rows, space, first, groups, None), searches, space, k, same, scratch, f"{name}_near")
        full = _top(near, k).groupBy("uid", "rank").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(f"n = {k}").groupBy(F.col("uid").alias("_uid")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("known"))
        tighter = searches.join(full, F.col("uid") == F.col("_uid"), "left").withColumn("lows", F.expr("transform(ranks, (r, i) -> greatest(coalesce(known[r], lows[i]), lows[i]))")).drop("_uid", "known")
        tighter = scratch.save(tighter, f"{name}_searches")
        low, high = F.array_min("lows"), F.array_max("highs")
        nearest = F.lit(0.0) if same else reach(high)
        far = F.when(low == LOWEST, F.lit(float("inf"))).otherwise(reach(low))
        bounds = _bounds(tighter.where("size(ranks) > 0").select("group", "cell", "label", "du", nearest.alias("nearest"), far.alias("reach")), same)
        rest = _search(routed(rows, space, first, groups, bounds), tighter, space, k, same, scratch, f"{name}_far")
        return _top(near.unionByName(rest), k)

    open_ended = placed.withColumns({"ranks": F.array(F.lit(0)), "lows": F.array(F.lit(LOWEST).cast("long")), "highs": F.array(F.lit(HIGHEST).cast("long"))})
    pos = scratch.save(both(open_ended, positives, True, "positives").select("uid", F.col("place").alias("prank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    a, b = least
    low = F.expr(f"cast(-((-{a} * positive_score) div {b}) as long) + if(({a} * positive_score) % {b} > 0, 1, 0)")
    wanted = pos.where("positive_score >= 0").groupBy(F.col("uid").alias("_uid")).agg(F.sort_array(F.collect_list(F.struct("prank", low.alias("low"), F.col("positive_score").alias("high")))).alias("s"))
    limited = placed.join(wanted, F.col("uid") == F.col("_uid")).drop("_uid").withColumns({"ranks": F.col("s.prank"), "lows": F.col("s.low"), "highs": F.col("s.high")}).drop("s")
    neg = both(scratch.save(limited, "limited"), negatives, False, "negatives").select(F.col("uid").alias("_uid"), F.col("rank").alias("_rank"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = neg.join(pos, (F.col("_uid") == F.col("uid")) & (F.col("_rank") == F.col("prank"))).drop("uid")
    return named.join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), F.col("_uid") == F.col("uid")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
