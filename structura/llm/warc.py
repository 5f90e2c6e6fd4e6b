"""WARC archives: a writer with revisit records, and a splittable reader.

The reader cuts archives into byte ranges. A task scans its range for the gzip magic, validates each candidate member by
decoding its beginning as a WARC header, and owns the records that start inside the range, reading past its end to finish
the last one. So archives need no index, and one large archive is read by many tasks.

Archives lie in the shared folder; tasks write and read them through pyarrow's file systems. A task writes under a name of
its own and then renames, so that one that runs again leaves the same file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structura.llm.common import byte_views, lean, shuffle_partitions

#: Bytes of an archive in a task's range, and bytes read at a time.
SPLIT, BLOCK = 8 << 20, 1 << 20
#: Equal payloads of fewer bytes are each written in full.
REVISIT_FROM = 1000
MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str):
    """pyarrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = re.sub(r"^file:/*", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _line(value: str) -> str:
    """A header value without control characters, which are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One gzip member with one record: a response, or a revisit without the payload if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_line(uri)}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = REVISIT_FROM) -> int:
    """Write one record for each row of pages to archives in folder; returns how many were written.

    Of rows with equal payloads of at least revisit_from bytes, that with the largest identifier is a response and the
    others revisit it; rows that share the largest identifier are all responses. Null identifiers are never the largest; if
    a group has no other, its rows are responses. A null payload is empty, a null address is left out.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    # Decisions are made on small rows. SHA-1 can be made to collide, so length and another hash go with it.
    slim = rows.select("id", "digest", F.octet_length("payload").alias("n"), F.xxhash64("payload").alias("h")).where(F.col("n") >= revisit_from)
    groups = slim.groupBy("digest", "n", "h").agg(F.max("id").alias("keep"), F.count("*").alias("rows")).where("rows > 1 and keep is not null")
    revisits = slim.join(groups, ["digest", "n", "h"]).where("id is null or id < keep").select("id", "digest", "n", "h", "keep").distinct()
    ready = rows.withColumns({"n": F.octet_length("payload"), "h": F.xxhash64("payload")}).alias("r").join(
        revisits.alias("v"), F.col("r.id").eqNullSafe(F.col("v.id")) & (F.col("r.digest") == F.col("v.digest")) & (F.col("r.n") == F.col("v.n")) & (F.col("r.h") == F.col("v.h")), "left"
    ).select("r.id", "r.url", "r.payload", "r.digest", "v.keep")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        name, own, n = f"{root}/part-{task.partitionId():06d}.warc.gz", f"{root}/.part-{task.partitionId():06d}-{uuid.uuid4().hex}", 0
        with system.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for k, (i, url, digest, keep) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "url", "digest", "keep")))):
                    if k == 0:
                        views = byte_views(batch.column("payload"))
                    name_of = f"urn:page:{i}" if i is not None else f"urn:page:none:{uuid.uuid4()}"
                    out.write(record(name_of, url, bytes(views[k]), digest, None if keep is None else f"urn:page:{keep}"))
                    n += 1
        if n:
            system.move(own, name)
        else:
            system.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return int(ready.mapInArrow(lean(write), "n long").agg(F.sum("n")).first()[0] or 0)


def members(read, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the records that start in [start, end). read(at, n) gives up to n bytes from at."""
    at, held = start, b""  # held: bytes from position `at` on
    while at < end:
        if len(held) < len(MAGIC):
            held = read(at, BLOCK)
            if not held:
                return
        k = held.find(MAGIC)
        if k < 0:
            keep = len(MAGIC) - 1
            at, held = at + max(len(held) - keep, 1), b""  # the magic may lie over two blocks
            continue
        at, held = at + k, held[k:]
        if at >= end:
            return
        z, out, more, good = zlib.decompressobj(31), [], at + len(held), True
        chunk, got = held, 0
        try:
            while True:
                part = z.decompress(chunk)
                if got < 7 and part:
                    begin = (b"".join(out) + part)[:7]
                    if not b"WARC/1.".startswith(begin[:7]):
                        good = False
                        break
                out.append(part)
                got += len(part)
                if z.eof:
                    break
                chunk = read(more, BLOCK)
                if not chunk:
                    good = False  # a cut member
                    break
                more += len(chunk)
        except zlib.error:
            good = False
        if good and got >= 7:
            yield at, b"".join(out)
            held = z.unused_data
            at = more - len(held)
        else:
            at, held = at + 1, held[1:]


def parse(raw: bytes) -> dict | None:
    """A record's fields; None if its header isn't one. Payload is None for a revisit."""
    head, mark, block = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        block = block[: int(fields.get("content-length", "0"))]
    except ValueError:
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    kind = fields.get("warc-type", "")
    said = re.fullmatch(r"sha1:([A-Z2-7]{32})", fields.get("warc-payload-digest", ""), re.I)
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>"),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
        "payload_bytes": int(length[1]) if kind == "revisit" and length else len(payload),
        "payload_digest": base64.b32decode(said[1].upper()).hex() if kind == "revisit" and said else hashlib.sha1(payload).hexdigest(),
        "payload": None if kind == "revisit" else payload,
    }


_DDL = "path string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def read_warc(spark: SparkSession, folder: str, want_payload: bool = True, split: int = SPLIT) -> DataFrame:
    """A row for each record of the *.warc.gz archives in folder; bytes that aren't records are passed over.

    payload_digest is bare hexadecimal SHA-1: of the payload where there is one, as the header says for a revisit.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"))
    dealt = ranges.repartition(shuffle_partitions(spark), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _DDL.split(", ")]
        for batch in batches:
            for path, length, start in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "start"))):
                system, at = _open(path)
                rows: list[tuple] = []
                held = 0
                with system.open_input_file(at) as f:
                    for offset, raw in members(lambda a, n, f=f: f.read_at(max(0, min(n, length - a)), a) if a < length else b"", length, start, min(start + split, length)):
                        r = parse(raw)
                        if r is None:
                            continue
                        if not want_payload:
                            r["payload"] = None
                        rows.append((path, offset, *(r[c] for c in names[2:])))
                        held += len(raw)
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=names)

    return dealt.mapInArrow(lean(read), _DDL)
