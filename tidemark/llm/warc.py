"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing.  A page becomes a response record (an HTTP response whose body is the html in UTF-8) or, when another
page with the same payload is the response, a revisit record that refers to it and holds the HTTP head alone.  Of
pages with equal payloads of at least `min_bytes` bytes the largest page id is the response; smaller payloads are
responses all.  Every record is a gzip member of its own, or plain.

Reading.  Files are cut into byte ranges.  A task looks for the magic of a record anywhere in its range, checks that
a record can be parsed there, and emits candidate and successor offsets; a payload that holds the bytes of a record
makes false candidates.  Inside a range chains are contracted to (entry, exit); over ranges, pointer jumping from
the start of the file doubles the length of the known paths each round.  Only records reachable from the start are
read.  A file that is cut short or damaged gives the records before the damage.

Null html is an empty payload; null urls are left out; null page ids make records without a page, which never are
referred to.  Pages that share id and payload are responses alike when theirs is the largest id.  Pages of very long
html make long records and may cross ranges.  Empty tables make no file and give an empty result.  Other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import AtomicOutput, open_input
from .scratch import Scratch, parts

# Fixed values of the WARC 1.1 and gzip formats.
VERSION = b"WARC/1.1"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
GZIP_MAGIC = re.compile(rb"\x1f\x8b\x08")
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Every record's WARC-Date; runs make equal bytes.
DATE = b"2024-01-01T00:00:00Z"
RANGE_BYTES = 4 << 20
#: Bytes read for a plain record's header at first.
HEAD_BYTES = 1 << 16
_STEP = 1 << 18


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record if `refers_to` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = [VERSION, b"WARC-Type: " + (b"response" if refers_to is None else b"revisit")]
    head.append(b"WARC-Record-ID: <urn:page:%s>" % (b"unknown" if page_id is None else b"%d" % page_id))
    head.append(b"WARC-Date: " + DATE)
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode()))
    head.append(b"WARC-Payload-Digest: sha1:" + payload_digest(payload).encode())
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: " + REVISIT_PROFILE]
    head.append(b"Content-Type: application/http;msgtype=response")
    head.append(b"Content-Length: %d" % len(body))
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(root: str, compress: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{root}/part-{part:06d}.warc{'.gz' if compress else ''}"
        out, n = None, 0
        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    page, url, html, to = (batch.column(c)[k].as_py() for c in range(4))
                    if out is None:
                        out = AtomicOutput(path)
                    data = record_bytes(page, url, (html or "").encode(), to)
                    out.write(gzip_member(data) if compress else data)
                    n += 1
        except BaseException:
            if out is not None:
                out.abandon()
            raise
        if out is not None:
            out.commit()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([out.size], pa.int64()), "records": pa.array([n], pa.int64())})

    return run


def write_warc(pages: DataFrame, root: str, compress: bool = True, min_bytes: int = 0, file_bytes: int = 32 << 20) -> DataFrame:
    """Write (page_id, url, html) below `root`; returns the files: path, bytes, records."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    # payloads too small to be referred to get keys of their own, none of which comes twice in `repeated`
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= min_bytes, F.sha2("html", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    repeated = rows.filter(~F.col("digest").startswith("-")).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "response")
    marked = rows.join(repeated, "digest", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("b")).first()["b"]
    if size > file_bytes * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        marked = marked.repartition(parts(pages.sparkSession, size, file_bytes))
    return marked.mapInArrow(_write(root, compress), "path string, bytes long, records long")


class _Window:
    """Bytes of a file, read as they are asked for."""

    def __init__(self, stream, start: int, size: int):
        self.stream, self.start, self.size, self.data = stream, start, size, bytearray()

    def upto(self, end: int) -> bytearray:
        end = min(end, self.size)
        have = self.start + len(self.data)
        if end > have:
            self.stream.seek(have)
            self.data += self.stream.read(max(end - have, min(_STEP, self.size - have)))
        return self.data


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields by lower-case name and the offset of the block; None if no record starts here."""
    if not MAGIC.match(data):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if fields.get("content-length", "").isdigit() else None


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The gzip member that starts at `at`: its content and where it ends."""
    z = zlib.decompressobj(31)
    out, pos = [], at
    try:
        while not z.eof:
            data = window.upto(pos + _STEP)
            piece = data[pos - window.start : pos - window.start + _STEP]
            if not piece:
                return None
            out.append(z.decompress(piece))
            pos += len(piece)
            if len(out) == 1 and not out[0].startswith(b"WARC/1.") and len(out[0]) >= 7:
                return None
    except zlib.error:
        return None
    return b"".join(out), pos - len(z.unused_data)


def _plain_head(window: _Window, at: int) -> tuple[dict[str, str], int] | None:
    """The header of a plain record at `at`, as far as it reaches."""
    size = HEAD_BYTES
    while True:
        data = bytes(window.upto(at + size)[at - window.start : at - window.start + size])
        if b"\r\n\r\n" in data:
            return parse_head(data)
        if not MAGIC.match(data) or at + size >= window.size or any(b":" not in line for line in data.split(b"\r\n")[1:-1]):
            return None
        size *= 4


def _record(window: _Window, at: int, compress: bool) -> tuple[dict[str, str], bytes, int] | None:
    """Fields, block and end of the record at `at`."""
    if compress:
        got = _member(window, at)
        head = parse_head(got[0]) if got else None
        if not head:
            return None
        n = int(head[0]["content-length"])
        return head[0], got[0][head[1] : head[1] + n], got[1]
    head = _plain_head(window, at)
    if not head:
        return None
    lo = at + head[1]
    hi = lo + int(head[0]["content-length"])
    if hi + 4 > window.size:
        return None
    data = window.upto(hi + 4)
    return head[0], bytes(data[lo - window.start : hi - window.start]), hi + 4


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each range (path, bytes, lo, hi), in order, with successors and the chains' exits."""
    for batch in batches:
        for f in batch.to_pylist():
            compress = f["path"].endswith(".gz")
            at, next_ = [], []
            with open_input(f["path"]) as stream:
                window = _Window(stream, f["lo"], f["bytes"])
                data = window.upto(f["hi"] + 16)
                for start in [m.start() for m in (GZIP_MAGIC if compress else MAGIC).finditer(data)]:
                    pos = f["lo"] + start
                    if pos >= f["hi"]:
                        break
                    if compress:
                        got = _record(window, pos, True)
                        end = got[2] if got else None
                    else:  # the block needn't be read
                        head = _plain_head(window, pos)
                        end = pos + head[1] + int(head[0]["content-length"]) + 4 if head else None
                    if end is not None and end <= f["bytes"]:
                        at.append(pos)
                        next_.append(end)
            exit_: dict[int, int] = {}
            for a, b in zip(reversed(at), reversed(next_), strict=True):
                exit_[a] = b if b >= f["hi"] else exit_.get(b, -1)
            yield pa.RecordBatch.from_pylist(
                [{**f, "at": at, "next": next_, "exit": [exit_[a] for a in at]}],
                pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), *((x, pa.list_(pa.int64())) for x in ("at", "next", "exit"))]),
            )


def _verified(ranges: DataFrame, scratch: Scratch) -> DataFrame:
    """The ranges with the offset at which the chain from the file's start enters each: by pointer jumping.

    A round adds the offsets that one hop from the known ones reaches, and then doubles the hops: from all offsets
    less than n hops away to all less than 2n.  Hops that lead past the end go, so there never are more than at first.
    """
    hops = ranges.select("path", F.explode(F.arrays_zip("at", "exit")).alias("x")).select("path", F.col("x.at").alias("at"), F.col("x.exit").alias("to"))
    ends = hops.select("path", F.col("to").alias("at")).distinct()
    hops = hops.filter("at = 0").unionByName(hops.filter("at > 0").join(ends, ["path", "at"], "left_semi"))
    hops = scratch.save(hops.filter("to >= 0").distinct(), "hops")
    reached = scratch.save(ranges.select("path", F.lit(0).cast("long").alias("at")).distinct(), "reached")
    while not hops.isEmpty():
        onward = hops.join(reached, ["path", "at"]).select("path", F.col("to").alias("at"))
        more = scratch.save(reached.unionByName(onward).distinct(), "reached")
        next_ = hops.select("path", F.col("at").alias("to"), F.col("to").alias("beyond"))
        twice = scratch.save(hops.join(next_, ["path", "to"]).select("path", "at", F.col("beyond").alias("to")), "hops")
        scratch.drop(reached, hops)
        reached, hops = more, twice
    entry = ranges.join(reached.withColumnRenamed("at", "entry"), "path").filter("entry >= lo and entry < hi")
    return entry.groupBy("path", "lo").agg(F.min("entry").alias("entry"))


def _chain_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each range that are reached."""
    for batch in batches:
        for f in batch.to_pylist():
            following, pos, n = dict(zip(f["at"], f["next"], strict=True)), f["entry"], 0
            while pos in following:
                pos, n = following[pos], n + 1
            yield pa.RecordBatch.from_pydict({"path": [f["path"]], "n": pa.array([n], pa.int64())})


def _check_records(files: DataFrame, wanted: DataFrame) -> None:
    """Fail if a file has other than the records that `files` states."""
    reached = wanted.select("path", "at", "next", "entry").mapInArrow(_chain_lengths, "path string, n long").groupBy("path").agg(F.sum("n").alias("n"))
    wrong = files.join(reached, "path", "left").filter(F.col("records") != F.coalesce("n", F.lit(0))).select("path", "records", "n").first()
    if wrong is not None:
        raise ValueError(f"{wrong['path']}: {wrong['n'] or 0} of {wrong['records']} records can be read")


def _extract(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                following = dict(zip(f["at"], f["next"], strict=True))
                pos, rows = f["entry"], []
                with open_input(f["path"]) as stream:
                    window = _Window(stream, pos, f["bytes"])
                    while pos in following:
                        fields, block, _ = _record(window, pos, f["path"].endswith(".gz"))
                        rows.append(_row(f["path"], pos, fields, block, with_payload))
                        pos = following[pos]
                        if pos - window.start > 4 * _STEP:
                            window = _Window(stream, pos, f["bytes"])
                        if len(rows) >= 200:
                            yield pa.RecordBatch.from_pylist(rows, _ROW)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ROW)

    return run


_ROW = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def _page(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def _row(path: str, pos: int, fields: dict[str, str], block: bytes, with_payload: bool) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type", "")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        size, digest = len(payload), payload_digest(payload)
        if stated and stated != digest:
            raise ValueError(f"{path} at {pos}: the payload doesn't have its digest")
    else:
        m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
        size, digest = int(m[1]) if m else None, stated
    return {
        "path": path, "offset": pos, "page_id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": size,
        "payload_digest": digest, "refers_to": _page(fields.get("warc-refers-to")), "payload": payload if with_payload and kind == "response" else None,
    }


def read_warc(files: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the files (path, bytes), verified: path, offset, page_id, url, record_type, payload_bytes,
    payload_digest, refers_to, payload (null for revisits, and without `with_payload`).

    If `files` states its `records`, as a manifest does, a file with other than these is an error."""
    spark = files.sparkSession
    scratch = Scratch(spark, "warc")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lo = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("lo")
    cut = files.filter("bytes > 0").select("path", "bytes", lo).withColumn("hi", F.least(F.col("lo") + range_bytes, F.col("bytes")))
    kind = "path string, bytes long, lo long, hi long, at array<long>, next array<long>, exit array<long>"
    ranges = scratch.save(cut.repartition(n, "path", "lo").mapInArrow(_scan, kind), "ranges")
    entry = scratch.save(_verified(ranges, scratch), "entries")
    wanted = ranges.join(entry, ["path", "lo"]).select("path", "bytes", "at", "next", "entry")
    if "records" in files.columns:
        _check_records(files, wanted)
    return wanted.repartition(n, "path", "entry").mapInArrow(_extract(with_payload), "path string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame, compress: bool = True, min_bytes: int = 0) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    scratch = Scratch(pages.sparkSession, "warc")
    files = scratch.save(write_warc(pages, scratch.path("archives"), compress, min_bytes), "files")
    return read_warc(files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


__all__ = ["gzip_member", "parse_head", "read_warc", "record_bytes", "round_trip", "write_warc"]
