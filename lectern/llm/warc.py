"""WARC archives: written by Spark from a page table, and read back by a salvage reader.

Writing: payload digests are computed in the JVM; of equal payloads the one of largest
page_id becomes a response, the others revisits that refer to it. Each record is a gzip member
of its own, in files of a bounded number of records.

Reading: ``salvage`` takes files as bytes, gzip (of one or many members) or plain. A record
must begin with a version line, be as long as it says, end with two line breaks and match its
digests. After a failed check the reader searches for the next gzip member that inflates, or
the next version line, goes on from there, and logs the bytes in between as a quarantined
gap. Nothing is raised: every byte of a file is part of a record or of a gap.

Cases: a null html is an empty payload; rows that share payload and the largest page_id are
all responses; a null page_id is smaller than any and written as empty; a null or broken url
is replaced by a urn or stripped of line breaks; empty files give no rows; other columns of
the page table are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.session import broadcast_if_small

MIN_BYTES = 0
RECORDS_PER_FILE = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
_MEMBER = b"\x1f\x8b\x08"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string: five hex digits make four of base 32."""
    digits = F.sha1(F.encode(text, "UTF-8"))
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def typed(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest, bytes, and ``refers_to`` for revisits.

    Only digests that occur twice are joined: a written table, broadcast if it is measured to be
    small, so that no page's text is shuffled; else Spark splits the pages of a frequent one.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    counted = rows.select("page_id", "digest").groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    repeated = broadcast_if_small(counted.where("n > 1 and largest is not null").select("digest", "largest"))
    found = rows.join(repeated, "digest", "left")
    revisit = (F.col("bytes") >= min_bytes) & F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return found.withColumn("refers_to", F.when(revisit, F.col("largest"))).drop("largest")


def record(date: str) -> Column:
    """A whole record but for its terminator, from the columns of ``typed``."""
    again = F.col("refers_to").isNotNull()
    block = F.when(again, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("payload")))
    ident = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.coalesce(F.regexp_replace("url", r"[\r\n]+", ""), F.concat(F.lit("urn:page:"), ident))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), ident, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        F.when(again, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(block))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def member(body: bytes) -> bytes:
    """A record as gzip bytes whose last one is zero: the top of the length they end with.

    A record of 16 MB or more is followed by an empty member, whose length ends so.
    """
    packed = gzip.compress(body, 6, mtime=0)
    return packed if packed[-1] == 0 else packed + gzip.compress(b"", 6, mtime=0)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, per_file: int = RECORDS_PER_FILE, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record per page under ``path``, each a gzip member of its own.

    Spark's text writer ends a record with its line separator, here the zero byte that every
    member ends with; a damaged byte therefore costs one record.
    """
    rows = typed(pages, min_bytes).select(F.concat(record(date), F.lit(_END.decode())).alias("value"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                bodies = [member(v.as_py().encode())[:-1] for v in batch.column(0).slice(at, 256)]
                yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary())], names=["value"])

    lines = rows.mapInArrow(packed, "value binary").select(F.col("value").cast("string").alias("value"))
    writer = lines.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file)
    writer.mode("errorifexists").text(path)


def _digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def _record_at(body: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """Headers, block and end of the record at ``at``, or why there is none."""
    version = _VERSION.match(body, at)
    if not version:
        return "no version line"
    stop = body.find(_END, version.end() - 2)
    if stop < 0:
        return "headers do not end"
    headers = {}
    for line in body[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line and not colon:
            return "broken header"
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not size.isdigit():
        return "no length"
    begin = stop + len(_END)
    end = begin + int(size)
    if body[end : end + len(_END)] != _END:
        return "length does not fit"
    block = body[begin:end]
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != _digest(block):
        return "block digest differs"
    return headers, block, end + len(_END)


def records(body: bytes) -> Iterator[tuple]:
    """("record", offset, length, headers, block) and ("gap", offset, length, reason, None) of plain bytes."""
    at = 0
    while at < len(body):
        found = _record_at(body, at)
        if isinstance(found, str):
            after = next((m.start() for m in _VERSION.finditer(body, at + 1) if body[m.start() - 1 : m.start()] == b"\n"), len(body))
            # a version line inside a payload is passed over if no record starts there: it joins the gap
            while after < len(body) and isinstance(_record_at(body, after), str):
                after = next((m.start() for m in _VERSION.finditer(body, after + 1) if body[m.start() - 1 : m.start()] == b"\n"), len(body))
            yield "gap", at, after - at, found, None
            at = after
        else:
            headers, block, end = found
            yield "record", at, end - at, headers, block
            at = end


def _inflate(body: bytes, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member at ``at`` gives, where it ends, and whether it is whole."""
    reader = zlib.decompressobj(31)
    out, place = [], at
    try:
        while place < len(body) and not reader.eof:
            out.append(reader.decompress(body[place : place + (1 << 16)]))
            place += 1 << 16
    except zlib.error:
        return b"".join(out), at, False
    return b"".join(out), min(place, len(body)) - len(reader.unused_data), reader.eof


def members(body: bytes) -> Iterator[tuple]:
    """As ``records``, for gzip bytes: offsets and gaps are those of the compressed file.

    A damaged member's first, still readable records are kept; its rest is the gap.
    """
    at = 0
    while at < len(body):
        text, end, whole = _inflate(body, at) if body.startswith(_MEMBER, at) else (b"", at, False)
        if not whole:
            end = body.find(_MEMBER, at + 1)
            while end >= 0 and not _inflate(body, end)[2]:
                end = body.find(_MEMBER, end + 1)
            end = len(body) if end < 0 else end
        for kind, _, length, what, block in records(text):
            if kind == "record":
                yield kind, at, length, what, block
            elif whole:
                yield kind, at, end - at, what, None
        if not whole:
            yield "gap", at, end - at, "damaged member" if body.startswith(_MEMBER, at) else "no member", None
        at = end


FOUND = (
    "path string, kind string, offset long, length long, reason string, page_id string, url string, record_type string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary"
)


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    http = headers.get("content-type", "").startswith("application/http")
    return block[block.find(_END) + len(_END) :] if http and _END in block else block


def salvage(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of archive files (path, content): see ``FOUND``."""
    bare = lambda value: re.sub(r"^<urn:page:(.*)>$", r"\1", value) if value is not None else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                path, body = batch.column(0)[n].as_py(), batch.column(1)[n].as_py() or b""
                rows: list[dict] = []
                for kind, offset, length, what, block in members(body) if body.startswith(_MEMBER) else records(body):
                    row = {"path": path, "kind": kind, "offset": offset, "length": length}
                    if kind == "gap":
                        row["reason"] = what
                    else:
                        again = what.get("warc-type") == "revisit"
                        payload = b"" if again else _payload(what, block)
                        told = what.get("warc-payload-digest", "").removeprefix("sha1:")
                        if not again and told and told != _digest(payload):
                            row |= {"kind": "gap", "reason": "payload digest differs"}
                        else:
                            size = what.get("x-payload-length", "") if again else str(len(payload))
                            row |= {
                                "page_id": bare(what.get("warc-record-id")),
                                "url": what.get("warc-target-uri"),
                                "record_type": what.get("warc-type"),
                                "refers_to": bare(what.get("warc-refers-to")),
                                "payload_bytes": int(size) if size.isdigit() else None,
                                "payload_digest": told if again else _digest(payload),
                                "payload": payload if with_payload else None,
                            }
                    rows.append(row)
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_pylist(rows, schema=_FOUND_ARROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_FOUND_ARROW)

    return files.select("path", "content").mapInArrow(read, FOUND)


_FOUND_ARROW = pa.schema(
    [(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (f.split() for f in FOUND.split(", "))]
)


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Salvage all files under a folder."""
    files = spark.read.format("binaryFile").load(path)
    return salvage(files, with_payload)
