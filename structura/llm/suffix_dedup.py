"""Repeated passages by a difference-cover suffix sort of bounded depth.

A byte goes if it lies in a string of LENGTH bytes that also starts elsewhere. The order of suffixes beyond LENGTH bytes is
of no matter, so prefixes are named to that depth only:

1. Sampled suffixes. Positions whose residue modulo V lies in a difference cover D are sampled. For any two positions there
   is a shift below V that takes both to sampled ones, so two equal windows share sampled suffixes with equal prefixes of
   LENGTH - V + 1 bytes. Sampled suffixes are dealt out by the name of that prefix and sorted by it; neighbours with equal
   names are kept, and those whose names of the whole window agree too are settled.
2. Open samples. A kept sample is open if a window that reaches it isn't covered by what is settled. Those that share its
   name learn how far before the sample such windows start, as one of them may be reached by an equal window.
3. Remaining suffixes. A window that starts between samples can only repeat if a sampled suffix that it reaches was kept.
   Windows that start so far before an open sample are named in full, sorted, and compared with their neighbours.

Before that, windows are thinned out exactly: each has a minimizer, the least hash of its strings of GRAM bytes, which
equal windows share; a window whose minimizer occurs once is dropped, and so most of a corpus never gets to the sort.

A name is a pair of polynomial hashes of 64 and 32 bits, of which equal strings have equal ones; a false match takes a
96-bit collision. Names come from prefix sums, so they cost the same for any depth. Tasks exchange arrays, not a row a suffix: a
task combines what it has seen itself, so a passage in a third of all documents moves once from each task.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structura.llm.common import Scratch, flat_bytes, lean, shuffle_partitions

LENGTH = 400
#: Bytes of the strings whose least hash stands for a window, half a window at most.
GRAM = 200
#: A difference cover: every residue modulo V is a difference of two members of D.
V, D = 133, (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
#: Bytes that are hashed at a time, and entries that a task gathers before it sends them.
STRETCH, HELD = 1 << 19, 1 << 19
#: Names that occur more often than this are open without asking: no task is asked about a name more often.
CROWD = 64
#: Flags of an entry: repeats by name; by both names; occurs often; is only reported on. From COUNT on, its number here.
NEAR, FULL, LOUD, TOLD, COUNT = 1, 2, 4, 8, 16
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_NONE = np.uint32(0xFFFFFFFF)


@functools.lru_cache(maxsize=4)
def _tables(which: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, and powers of the base and of its inverse modulo 2**64."""
    base = _BASES[which]
    values = np.random.default_rng(1000 + which).integers(1, 2**64, 256, dtype=np.uint64)
    power = np.full(size + 1, base, np.uint64)
    inverse = np.full(size + 1, pow(base, -1, 2**64), np.uint64)
    power[0] = inverse[0] = 1
    return values, np.multiply.accumulate(power), np.multiply.accumulate(inverse)


class Names:
    """Names of any substring of some bytes, by prefix sums."""

    def __init__(self, flat: np.ndarray, which: int = 0):
        # A group's size is below two stretches and a window; longer bytes, in tests, get tables of their own.
        usual = 2 * STRETCH + 2 * LENGTH
        values, power, self.inverse = _tables(which, usual if len(flat) <= usual else len(flat))
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(values[flat] * power[: len(flat)], out=self.sums[1:])

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        h = (self.sums[start + length] - self.sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        h = (self.sums[length:] - self.sums[:n]) * self.inverse[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _short(h: np.ndarray) -> np.ndarray:
    """The upper half, never _NONE."""
    return ((h >> np.uint64(32)) & np.uint64(0xFFFFFFFE)).astype(np.uint32)


def _slide(values: np.ndarray, width: int, take: np.ufunc) -> np.ndarray:
    """take (minimum or maximum) over values[s : s + width] for each s: spans double, and two that overlap make the width."""
    span, out = 1, values
    while 2 * span <= width:
        out, span = take(out[:-span], out[span:]), 2 * span
    return out if span == width else take(out[: len(values) - width + 1], out[width - span :])


def minimizers(flat: np.ndarray, valid: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the least GRAM-byte hashes of the valid windows (a flag for each start)."""
    width = length - gram + 1
    h = Names(flat).all(gram)
    least = _slide(h, width, np.minimum)
    least[~valid[: len(least)]] = 0
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    most = _slide(padded, width, np.maximum)
    at = np.flatnonzero(most == h[: len(most)])
    return at, h[at]


def stretches(bounds: np.ndarray, length: int = LENGTH, size: int = STRETCH) -> Iterator[list[tuple[int, int, int, int]]]:
    """Groups of (value, first byte in it, begin, end in the flat bytes), so many bytes together that windows of every value
    start in exactly one. Values shorter than a window are left out; long ones are cut, with an overlap of one window less a byte."""
    group, held = [], 0
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b - a < length:
            continue
        for s in range(a, b - length + 1, size):
            e = min(b, s + size + length - 1)
            group.append((k, s - a, s, e))
            held += e - s
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group


def _gathered(flat: np.ndarray, group: list[tuple[int, int, int, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A group's bytes side by side: (bytes, value of each byte, position of each byte in its value, whether a window starts there)."""
    sizes = np.array([e - s for _, _, s, e in group])
    out = np.concatenate([flat[s:e] for _, _, s, e in group])
    begins = np.cumsum(sizes) - sizes
    first = np.array([f for _, f, _, _ in group])
    value = np.repeat(np.array([k for k, *_ in group], np.int32), sizes)
    position = np.arange(len(out)) + np.repeat(first - begins, sizes)
    valid = np.zeros(len(out), bool)
    for b, n in zip(begins.tolist(), (sizes - length + 1).tolist()):
        valid[b : b + n] = True
    return out, value, position, valid


def _in_intervals(group: list[tuple[int, int, int, int]], intervals: list[np.ndarray], length: int) -> np.ndarray:
    """Of a group's bytes side by side, the places of windows that start in one of their value's half-open intervals."""
    begins, ends, at = [], [], 0
    for k, first, s, e in group:
        own = intervals[k]
        if len(own) and e - s >= length:
            inner = np.clip(own - first, 0, e - s - length + 1) + at
            begins.append(inner[:, 0])
            ends.append(inner[:, 1])
        at += e - s
    if not begins:
        return np.zeros(0, np.int64)
    edge = np.zeros(at + 1, np.int32)
    np.add.at(edge, np.concatenate(begins), 1)
    np.add.at(edge, np.concatenate(ends), -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def merged(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Half-open intervals joined where they overlap or touch: n x 2."""
    if not len(begin):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order].astype(np.int64), np.maximum.accumulate(end[order].astype(np.int64))
    cut = np.flatnonzero(begin[1:] > end[:-1])
    return np.stack([begin[np.concatenate(([0], cut + 1))], end[np.concatenate((cut, [len(end) - 1]))]], axis=1)


class _Exchange:
    """Sends (name, second name, key, position) arrays to buckets of names and returns those that occur more than once.

    For each key, what repeats by name goes to `near`; what repeats by both names goes to `full`.
    """

    DDL = "bucket int, name binary, second binary, key binary, position binary, known binary"
    NAMES = ["bucket", "name", "second", "key", "position", "known"]

    def __init__(self, parts: int):
        self.parts = parts

    def sender(self) -> tuple[Callable, Callable]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def add(name, second, key, position) -> Iterator[pa.RecordBatch]:
            nonlocal count
            held.append((name, second, key.astype(np.int64), position.astype(np.int64)))
            count += len(name)
            if count >= HELD:
                yield from flush()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            if not count:
                return
            columns = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            count = 0
            name, second, key, position = (c[np.lexsort((columns[1], columns[0]))] for c in columns)
            near, full = _repeats(name, second)
            begins = np.concatenate(([0], np.flatnonzero(name[1:] != name[:-1]) + 1))
            sizes = np.diff(np.concatenate((begins, [len(name)])))
            known = near * NEAR + full * FULL + np.repeat(sizes > CROWD, sizes) * LOUD
            times = np.repeat(np.minimum(sizes, CROWD + 1), sizes)
            # Of a name that repeats here, report all and send one of each second name on, so that others hear of it.
            first = np.concatenate(([True], (name[1:] != name[:-1]) | (second[1:] != second[:-1])))
            yield from self._rows(name[first], second[first], key[first], position[first], known[first] + times[first] * COUNT)
            rest = ~first
            if rest.any():
                yield from self._rows(name[rest], second[rest], key[rest], position[rest], known[rest] + TOLD)

        return add, flush

    def _rows(self, name, second, key, position, known) -> Iterator[pa.RecordBatch]:
        # What is only reported (4 and more) needs no meeting by name, but names keep the dealing even.
        bucket = ((name * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(self.parts)
        if known[0] & TOLD:
            bucket = key.view(np.uint64) % np.uint64(self.parts)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        firsts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        arrays = [c[order] for c in (name, second, key, position.astype(np.uint32), known.astype(np.uint16))]
        blobs = [[c[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:])] for c in arrays]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[firsts[:-1]].astype(np.int32)), *[pa.array(b, pa.binary()) for b in blobs]], names=self.NAMES)

    def returned(self, sent: DataFrame) -> DataFrame:
        """(key, near, names, flags): for each key the positions that repeat by name, their names, and FULL and LOUD flags."""
        return self._answered(sent, _compared, {"near": np.uint32, "names": np.uint64, "flags": np.uint8})

    def repeated(self, sent: DataFrame, column: str) -> DataFrame:
        """(key, column): for each key the positions that repeat by both names."""
        return self._answered(sent, _both, {column: np.uint32})

    def _answered(self, sent: DataFrame, compare: Callable, kinds: dict[str, type]) -> DataFrame:
        """What compare makes of each bucket of names, as (keys, arrays), dealt out by key and put together: a row for each key."""
        parts, names = self.parts, list(kinds)
        fields = ", ".join(f"{c} binary" for c in names)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, arrays = compare(_received(batches))
            bucket = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
            order = np.argsort(bucket, kind="stable")
            bucket, key = bucket[order], key[order]
            if len(key):
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])).tolist()
                blobs = [pa.array([c[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for c in (key, *(x[order] for x in arrays))]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), *blobs], names=["bucket", "keys", *names])

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, list[np.ndarray]] = {c: [] for c in ("keys", *names)}
            for batch in batches:
                for c in held:
                    held[c].append(np.frombuffer(flat_bytes(batch.column(c))[0].tobytes(), np.int64 if c == "keys" else kinds[c]))
            if held["keys"]:
                key = np.concatenate(held.pop("keys"))
                order = np.argsort(key, kind="stable")
                yield from _by_key(key[order], [np.concatenate(held.pop(c))[order] for c in names], names)

        met = sent.repartition(parts, "bucket").mapInArrow(lean(meet), f"bucket int, keys binary, {fields}")
        return met.repartition(parts, "bucket").mapInArrow(lean(gather), f"key long, {fields}")

    def open_sender(self) -> tuple[Callable, Callable]:
        """As sender, for (name, key, position, least and greatest distance of unsettled windows, flags)."""
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def add(name, key, position, least, most, flags) -> Iterator[pa.RecordBatch]:
            nonlocal count
            held.append((name, key.astype(np.int64), position.astype(np.int64), least, most, flags))
            count += len(name)
            if count >= HELD:
                yield from flush()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            if not count:
                return
            columns = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            count = 0
            name, key, position, least, most, flags = (c[np.argsort(columns[0], kind="stable")] for c in columns)
            # A frequent name is open at any distance; its samples know, and one for each task tells the others.
            loud = (flags & LOUD) > 0
            least, most = np.where(loud, 0, least), np.where(loud, V - 1, most)
            again = np.concatenate(([False], (name[1:] == name[:-1]) & loud[:-1]))
            at = np.flatnonzero(~(loud & again))
            if len(at):
                yield from self._rows(name[at], (least + most * 256).astype(np.uint32)[at], key[at], position[at], loud[at] * NEAR)

        return add, flush

    def opened(self, sent: DataFrame) -> DataFrame:
        """(key, opened, ranges): positions whose names are open, and the least and greatest distance there."""
        return self._answered(sent, _opened, {"opened": np.uint32, "ranges": np.uint16})


def _repeats(name: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted names: which equal a neighbour's, and which do so with their second names (_NONE equals none)."""
    same = name[1:] == name[:-1]
    both = same & (second[1:] == second[:-1]) & (second[1:] != _NONE)
    spread = lambda x: np.concatenate((x, [False])) | np.concatenate(([False], x))
    return spread(same), spread(both)


def _received(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    kinds = {"name": np.uint64, "second": np.uint32, "key": np.int64, "position": np.uint32, "known": np.uint16}
    columns: dict[str, list[np.ndarray]] = {c: [np.zeros(0, kind)] for c, kind in kinds.items()}
    for batch in batches:
        for c, kind in kinds.items():
            flat, _ = flat_bytes(batch.column(c))
            columns[c].append(np.frombuffer(flat.tobytes(), kind))
    return tuple(np.concatenate(columns.pop(c)) for c in kinds)


def _by_key(key: np.ndarray, arrays: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a key and its share of each array; the key's values are side by side."""
    if not len(key):
        return
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)])).tolist()
    for k in range(0, len(cuts) - 1, 20_000):
        part = list(zip(cuts[:-1], cuts[1:]))[k : k + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([int(key[a]) for a, _ in part], pa.int64()), *[pa.array([c[a:b].tobytes() for a, b in part], pa.binary()) for c in arrays]], names=["key", *names])


def _compared(entries: tuple[np.ndarray, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    name, second, key, position, known = entries
    near, full, loud = ((known & flag) > 0 for flag in (NEAR, FULL, LOUD))
    at = np.flatnonzero((known & TOLD) == 0)
    at = at[np.lexsort((second[at], name[at]))]
    n, f = _repeats(name[at], second[at])
    # One that repeats within another task makes all its equals repeated, and is itself already.
    near[at] |= n
    full[at] |= f
    if len(at):
        begins = np.concatenate(([0], np.flatnonzero(name[at][1:] != name[at][:-1]) + 1))
        # Entries of one task and name, with other second names, each hold its count; too high a sum does no harm.
        times = np.add.reduceat((known[at] // COUNT).astype(np.int64), begins)
        loud[at] |= np.repeat(times > CROWD, np.diff(np.concatenate((begins, [len(at)]))))
    keep = np.flatnonzero(near)
    return key[keep], [position[keep], name[keep], (full[keep] * FULL + loud[keep] * LOUD).astype(np.uint8)]


def _both(entries: tuple[np.ndarray, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    key, (position, _, flags) = _compared(entries)
    full = (flags & FULL) > 0
    return key[full], [position[full]]


def _opened(entries: tuple[np.ndarray, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    name, pair, key, position, known = entries
    if not len(name):
        return key, [position, np.zeros(0, np.uint16)]
    order = np.argsort(name, kind="stable")
    name, pair, key, position, known = (c[order] for c in (name, pair, key, position, known))
    begins = np.concatenate(([0], np.flatnonzero(name[1:] != name[:-1]) + 1))
    sizes = np.diff(np.concatenate((begins, [len(name)])))
    # A sample without unsettled windows has a least distance beyond its greatest.
    least = np.repeat(np.minimum.reduceat(pair & np.uint32(255), begins), sizes)
    most = np.repeat(np.maximum.reduceat(pair >> np.uint32(8), begins), sizes)
    keep = np.flatnonzero((least <= most) & (known == 0))
    return key[keep], [position[keep], (least + most * np.uint32(256)).astype(np.uint16)[keep]]


def _positions(column: list) -> list[np.ndarray]:
    return [np.sort(np.frombuffer(x or b"", np.uint32).astype(np.int64)) for x in column]


def _samples(near: list, names: list, flags: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row positions, names and flags, in the order of positions."""
    out = []
    for p, n, f in zip(near, names, flags):
        p, n, f = (np.frombuffer(x or b"", k) for x, k in ((p, np.uint32), (n, np.uint64), (f, np.uint8)))
        order = np.argsort(p, kind="stable")
        out.append((p[order].astype(np.int64), n[order], f[order]))
    return out


def _intervals(column: list) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", np.int64).reshape(-1, 2) for x in column]


def _keyed(df: DataFrame, id_col: str, text_col: str, carry: str | None, scratch: Scratch) -> DataFrame:
    """(key, doc_id, text, carried): the identifier is the key if it is one, else rows are written with one of their own."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.col(carry) if carry else F.lit(None).cast("boolean")).alias("carried"))
    odd = rows.select("doc_id").groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if odd:
        rows = scratch.save(rows.withColumn("key", F.monotonically_increasing_id()), "keyed")
    else:
        rows = rows.withColumn("key", F.col("doc_id"))
    return rows.select("key", "doc_id", "text", "carried")


def repeated_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: str | None = None, finish: Callable | None = None, schema: str = ""
) -> DataFrame:
    """(doc_id, text, spans, and as `carried` the column that carry names): a row per input row; spans (binary) holds the byte ranges to remove as pairs of 64-bit integers.

    Null for texts without any. A null text is empty. Rows that repeat in full are occurrences of their own. Matches never
    cross rows and are judged on the texts as they are given. Empty table: no rows.

    finish, if given, is applied to the batches of these columns where they are made, and returns batches of schema: a
    second Python stage after this one would take a second worker for each task.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    scratch = Scratch(spark, "suffix")
    exchange = _Exchange(parts)
    docs = _keyed(df, id_col, text_col, carry, scratch)
    kind = docs.schema["carried"].dataType.simpleString()
    gram = min(GRAM, length // 2)
    width, prefix = length - gram + 1, length - V + 1

    def thin_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, flush = exchange.sender()
        for batch in batches:
            flat, bounds = flat_bytes(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for group in stretches(bounds, length):
                own, value, position, valid = _gathered(flat, group, length)
                at, h = minimizers(own, valid, length, gram)
                # Windows of neighbouring stretches may choose the same one; it must not count as its own repetition.
                place = np.unique(value[at].astype(np.int64) * (1 << 40) + position[at], return_index=True)[1]
                at, h = at[place], h[place]
                yield from add(h, np.zeros(len(h), np.uint32), keys[value[at]], position[at])
        yield from flush()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = [merged(np.maximum(p - width + 1, 0), p + 1).tobytes() if len(p) else None for p in _positions(batch.column("near").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "doc_id", "text", "carried")] + [pa.array(starts, pa.binary()), batch.column("size")], names=["key", "doc_id", "text", "carried", "starts", "size"])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, flush = exchange.sender()
        chosen = np.zeros(V, bool)
        chosen[list(D)] = True
        for batch in batches:
            flat, bounds = flat_bytes(batch.column("text"))
            keys = batch.column("key").to_numpy()
            reach = [np.stack([iv[:, 0], iv[:, 1] + V - 1], axis=1) for iv in _intervals(batch.column("starts").to_pylist())]
            reach = [merged(iv[:, 0], iv[:, 1]) for iv in reach]
            for group in stretches(bounds, prefix):
                own, value, position, _ = _gathered(flat, group, prefix)
                at = _in_intervals(group, reach, prefix)
                at = at[chosen[position[at] % V]]
                first, other = Names(own), Names(own, 1)
                size = bounds[value[at] + 1] - bounds[value[at]]
                whole = (position[at] + length <= size) & (at + length <= len(own))
                # A stretch's end may cut a window that its text has: that one is left to the second step.
                whole &= value[np.minimum(at + length - 1, len(own) - 1)] == value[at]
                whole &= position[np.minimum(at + length - 1, len(own) - 1)] == position[at] + length - 1
                second = np.full(len(at), _NONE)
                second[whole] = _short(other.at(at[whole], length))
                yield from add(first.at(at, prefix), second, keys[value[at]], position[at])
        yield from flush()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, flush = exchange.open_sender()
        for batch in batches:
            rows = _samples(*(batch.column(c).to_pylist() for c in ("near", "names", "flags")))
            for key, size, (p, n, f) in zip(batch.column("key").to_pylist(), batch.column("size").to_pylist(), rows):
                yield from add(n, np.full(len(p), key), p, *_unsettled(p, f, size, length), f)
        yield from flush()

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach, settled = [], []
            rows = _samples(*(batch.column(c).to_pylist() for c in ("near", "names", "flags")))
            for (p, _, f), opened, ranges in zip(rows, *(batch.column(c).to_pylist() for c in ("opened", "ranges"))):
                loud, full = p[(f & LOUD) > 0], p[(f & FULL) > 0]
                q, r = np.frombuffer(opened or b"", np.uint32).astype(np.int64), np.frombuffer(ranges or b"", np.uint16).astype(np.int64)
                begin, end = np.concatenate((loud - V + 1, q - (r >> 8))), np.concatenate((loud + 1, q - (r & 255) + 1))
                reach.append(merged(np.maximum(begin, 0), np.maximum(end, 0)).tobytes())
                settled.append(merged(full, full + length).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(reach, pa.binary()), pa.array(settled, pa.binary())], names=["key", "reach", "settled"])

    def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, flush = exchange.sender()
        for batch in batches:
            flat, bounds = flat_bytes(batch.column("text"))
            keys = batch.column("key").to_numpy()
            reach = _intervals(batch.column("reach").to_pylist())
            for group in stretches(bounds, length):
                at = _in_intervals(group, reach, length)
                if len(at):
                    own, value, position, _ = _gathered(flat, group, length)
                    yield from add(Names(own).at(at, length), _short(Names(own, 1).at(at, length)), keys[value[at]], position[at])
        yield from flush()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, p in zip(_intervals(batch.column("settled").to_pylist()), _positions(batch.column("full").to_pylist())):
                own = merged(np.concatenate((own[:, 0], p)), np.concatenate((own[:, 1], p + length)))
                out.append(own.tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "text", "carried")] + [pa.array(out, pa.binary())], names=["doc_id", "text", "carried", "spans"])

    once = exchange.returned(docs.select("key", "text").mapInArrow(lean(thin_out), exchange.DDL))
    thinned = docs.join(once.select("key", "near"), "key", "left").withColumn("size", F.octet_length("text").cast("long")).mapInArrow(lean(candidates), f"key long, doc_id long, text string, carried {kind}, starts binary, size long")
    thinned = scratch.save(thinned, "thinned")
    left = thinned.where("starts is not null")
    sampled = scratch.save(exchange.returned(left.select("key", "text", "starts").mapInArrow(lean(sample), exchange.DDL)), "sampled")
    asked = sampled.join(left.select("key", "size"), "key").mapInArrow(lean(ask), exchange.DDL)
    plans = sampled.join(exchange.opened(asked), "key", "left").mapInArrow(lean(plan), "key long, reach binary, settled binary")
    plans = scratch.save(plans, "plans")
    scratch.drop("sampled")
    reached = left.select("key", "text").join(plans.where(F.octet_length("reach") > 0).select("key", "reach"), "key")
    rest = scratch.save(exchange.repeated(reached.mapInArrow(lean(remaining), exchange.DDL), "full"), "rest")
    found = left.select("key", "doc_id", "text", "carried").join(plans.select("key", "settled").join(rest, "key", "full"), "key", "left").drop("key")
    other = thinned.where("starts is null").select("doc_id", "text", "carried", F.lit(None).cast("binary").alias("spans"))
    if finish is None:
        return other.unionByName(found.mapInArrow(lean(spans), f"doc_id long, text string, carried {kind}, spans binary"))
    return other.mapInArrow(lean(finish), schema).unionByName(found.mapInArrow(lean(lambda batches: finish(spans(batches))), schema))


def _unsettled(p: np.ndarray, flags: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sample the least and the greatest distance back to a window that what is settled doesn't cover.

    Where there is none, the least is beyond the greatest.
    """
    full = p[(flags & FULL) > 0]
    settled = merged(full, full + length)
    first, last = np.maximum(p - V + 1, 0), np.minimum(p, size - length)
    if len(settled):
        # Windows inside a settled span start in [begin, end - length].
        begin, end = settled[:, 0], settled[:, 1] - length
        k = np.searchsorted(begin, first, side="right") - 1
        first = np.where((k >= 0) & (first <= end[np.maximum(k, 0)]), end[np.maximum(k, 0)] + 1, first)
        k = np.searchsorted(begin, last, side="right") - 1
        last = np.where((k >= 0) & (last <= end[np.maximum(k, 0)]), begin[np.maximum(k, 0)] - 1, last)
    some = first <= last
    return np.where(some, p - last, 255), np.where(some, p - first, 0)


def cut(text: bytes, spans: np.ndarray) -> bytes:
    """The bytes outside the spans (n x 2, disjoint, ascending)."""
    ends = [0, *spans.reshape(-1).tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: the digest columns of repeated_spans, one row per input row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        for batch in batches:
            rows = []
            for doc_id, text, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                text, own = text.encode(), np.frombuffer(raw or b"", np.int64).reshape(-1, 2)
                rows.append((doc_id, len(text), int((own[:, 1] - own[:, 0]).sum()), len(own), hashlib.sha256(cut(text, own)).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])

    return repeated_spans(df, id_col, text_col, length, finish=digest, schema="doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def brute_force(texts: list[str], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """The spans of each text by looking every window up: what the tests hold the operator against."""
    seen: dict[bytes, int] = {}
    raw = [t.encode() for t in texts]
    for t in raw:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    out = []
    for t in raw:
        hit = np.array([k for k in range(len(t) - length + 1) if seen[t[k : k + length]] > 1], dtype=np.int64)
        out.append([tuple(x) for x in merged(hit, hit + length).tolist()])
    return out
