"""WARC archives: writing one gzip member per record, and a reader that splits files.

Archives are written by Spark's own text writer, with its commit protocol and on
any file system it knows: each row is the bytes of a member but the last one,
which is zero in every member we make and stands in as the line separator.

The reader cuts files into byte ranges. A task looks for gzip magic in its range,
takes a candidate as a member only if it decodes and begins with a WARC header,
and owns the records of the members that start inside, reading past the end of
its range where the last of them does.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import attach_groups, fold
from lodestone.session import stored

LEAST_RANGE, MOST_RANGE = 4 * 2**20, 128 * 2**20
_AHEAD = 64 * 2**10
_MAGIC = b"\x1f\x8b\x08"
_BATCH_BYTES = 4 * 2**20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LEVEL = 5

RECORD = (
    "file string, start long, warc_type string, headers map<string,string>, payload_bytes long, "
    "payload_digest string, payload binary"
)


def _key(page_id: Column, payload: Column) -> Column:
    return F.concat_ws(":", F.sha2(payload, 256), page_id.cast("string"))


def _verdicts(rows: DataFrame, least: int) -> DataFrame:
    """For each key of a payload that several rows have: the page all of them refer to."""
    sha = F.substring("key", 1, 64).alias("sha")
    narrow = stored(rows.filter(F.octet_length("payload") >= least).select("key", sha, "page_id"), "payloads")
    groups = narrow.groupBy("sha").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
    groups = stored(groups.filter("n > 1 and response_id is not null"), "repeats")
    return attach_groups(narrow.distinct(), groups, ["sha"], "n").select("key", "response_id")


def _record_id(page_id, place: int, extra: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{place}:{extra}')}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member, without its last byte, which is zero."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    raw = gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", _LEVEL, mtime=0)
    # The last byte is the highest of the length; from 16 MiB on an empty member follows to end in zero.
    return (raw if raw[-1] == 0 else raw + gzip.compress(b"", mtime=0))[:-1]


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_record(page_id, url, payload: bytes, response_id, place: int, date: str) -> bytes:
    digest = _digest(payload)
    revisit = response_id is not None and not (page_id == response_id and place == 0)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    unnamed = "" if page_id is not None else f"{digest}:{url}"
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, place, unnamed)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", " ".join(url.split())))
    if page_id is not None:
        headers.append(("Page-ID", str(page_id)))
    if revisit:
        headers += [
            ("WARC-Refers-To", _record_id(response_id, 0)),
            ("Refers-To-Page-ID", str(response_id)),
            ("WARC-Profile", _PROFILE),
        ]
    return _member(headers, http.encode() + (b"" if revisit else payload))


def write_archives(
    pages: DataFrame,
    path: str,
    least: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> None:
    """Write one record per row of ``pages`` to archives under ``path``.

    Of rows with equal payloads of at least ``least`` bytes the one with the
    largest id is written whole, as a response; the others are revisits of it.
    Of rows that repeat id and payload one is the response. Rows without an id
    revisit a row that has one; if none has, all are responses. Null html is an
    empty payload. No rows: no record.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(fold(html), "UTF-8").alias("payload")
    ).withColumn("key", _key(F.col("page_id"), F.col("payload")))
    known = rows.join(_verdicts(rows.select("key", "page_id", "payload"), least), "key", "left")
    place = F.expr("row_number() over (partition by key order by url) - 1")
    full = known.select("page_id", "url", "payload", "response_id", place.alias("place"))

    def members(batches):
        first = True
        for batch in batches:
            out, held = [], 0
            if first:
                info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)]
                out.append(_member([*info, ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                first = False
            for i in range(batch.num_rows):
                out.append(_page_record(*(c[i].as_py() for c in batch.columns), date))
                held += len(out[-1])
                if held > _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = full.mapInArrow(members, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def parse_records(data: bytes):
    """The records in decoded bytes: type, headers by lower-case name, block."""
    at = 0
    while data.startswith(b"WARC/", at):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers.get("content-length", 0))
        yield headers.get("warc-type", ""), headers, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def _decode(read, window: bytes, base: int, at: int, size: int) -> tuple[bytes, int] | None:
    """The member at ``at``: its decoded bytes and where it ends; None if there is none that begins a record.

    ``window`` holds the file from ``base`` on. What lies past it is read a piece
    at a time, and no piece is kept once it is decoded.
    """
    decoder, out, head, place = zlib.decompressobj(31), [], b"", at
    try:
        while not decoder.eof:
            inside = place - base
            piece = window[inside : inside + _AHEAD] or read(place, min(_BATCH_BYTES, size - place))
            if not piece:
                return None
            out.append(decoder.decompress(piece))
            place += len(piece)
            if len(head) < 5:
                head += out[-1][: 5 - len(head)]
                if not b"WARC/".startswith(head):
                    return None
    except zlib.error:
        return None
    return b"".join(out), place - len(decoder.unused_data)


def scan(read, start: int, end: int, size: int):
    """Members that start in ``[start, end)`` of a file of ``size`` bytes: place and decoded bytes.

    ``read(at, n)`` gives bytes of the file. Magic inside a member's compressed
    data is passed over, as members are followed from end to end; where a range
    begins inside a member, a false start there doesn't decode to a WARC header.
    Besides the member at hand a task holds one piece of the range.
    """
    at = base = start
    window = b""
    while at < end:
        if at + len(_MAGIC) > base + len(window):
            if at + len(_MAGIC) > size:
                return
            base, window = at, read(at, min(_BATCH_BYTES, size - at))
        i = window.find(_MAGIC, at - base)
        if i < 0:
            at = base + len(window) - len(_MAGIC) + 1
            continue
        at = base + i
        if at >= end:
            return
        member = _decode(read, window, base, at, size)
        if member is None:
            at += 1
            continue
        if member[0]:
            yield at, member[0]
        at = member[1]


def _opener(uri: str):
    """A file of any file system that Arrow can open, by the URI Spark gives it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _payload(kind: str, headers: dict, block: bytes) -> tuple[int, str | None, bytes]:
    """Length and digest of the full payload, and the payload if it is here."""
    http, _, body = block.partition(b"\r\n\r\n") if "http" in headers.get("content-type", "") else (b"", b"", block)
    if kind != "revisit":
        return len(body), _digest(body), body
    fields = (line.partition(b":") for line in http.split(b"\r\n"))
    length = next((int(v) for k, _, v in fields if k.strip().lower() == b"content-length"), None)
    return length, headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, b""


def _read_ranges(with_payload: bool):
    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for file, start, end, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opener(file) as f:
                    for place, data in scan(lambda at, n: f.read_at(n, at), start, end, size):
                        for kind, headers, block in parse_records(data):
                            length, digest, body = _payload(kind, headers, block)
                            kept = body if with_payload else None
                            rows.append((file, place, kind, list(headers.items()), length, digest, kept))
                            held += len(kept or b"") + 500
                        if held > _BATCH_BYTES:
                            yield _record_batch(rows)
                            rows, held = [], 0
        if rows:
            yield _record_batch(rows)

    return run


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [
        pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary(),
    ]
    names = [field.split()[0] for field in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
    )


def _range_bytes(spark: SparkSession, total: int) -> int:
    """The length of ranges: a share per core, but neither tiny nor more than a task should read."""
    return min(MOST_RANGE, max(LEAST_RANGE, math.ceil(total / spark.sparkContext.defaultParallelism)))


def read_archives(
    spark: SparkSession, path: str, range_bytes: int | None = None, with_payload: bool = True
) -> DataFrame:
    """The records of all archives under ``path``, in the columns of ``RECORD``.

    ``payload_bytes`` and ``payload_digest`` are of the full payload: computed
    for records that carry it, from the headers of revisits. A member may hold
    several records. Bytes that belong to no member are passed over. Each range
    of ``range_bytes``, by default a share per core within fixed limits, is
    read by a task of its own; the number of tasks is given, so that ranges,
    which are short rows, are not merged into few tasks.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    size = range_bytes or _range_bytes(spark, files.agg(F.sum("length")).first()[0] or 0)
    count = files.agg(F.sum(F.ceil(F.col("length") / size))).first()[0] or 1
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    ranges = files.select("path", "length", first.alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + size, "length").alias("end"), "length")
    return ranges.repartitionByRange(count, "path", "start").mapInArrow(_read_ranges(with_payload), RECORD)


def page_records(records: DataFrame) -> DataFrame:
    """Per record of a page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return records.filter("warc_type in ('response', 'revisit')").select(
        F.col("headers")["page-id"].cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        F.col("headers")["refers-to-page-id"].cast("long").alias("refers_to"),
    )
