"""WARC archives through a chunked record table: oversized payloads are segment rows, digests are carried along."""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import salted_left_join
from tidewake.scratch import fresh, saved

#: Most payload bytes in one record; larger payloads continue in further records (segments).
SEGMENT = 256 * 1024
#: Payloads below this are never written as revisits.
LEAST_REVISIT = 1000
#: Records are laid together in lots of about LOT compressed bytes; an archive has FILE_LOTS of them at most, so that neither
#: many small records nor few large ones make it larger than about 24 MB.
LOT, FILE_LOTS = 128 * 1024, 64
#: The tables have no crawl dates; records carry this one.
DATE = "1970-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def classified(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``(page_id, url, html, digest, bytes, refers_to)``; html is NULL for revisits, refers_to for responses.

    Only (digest, length) of repeated payloads meet the pages again, with salted keys: a payload that a third of all
    pages have is dealt to many tasks.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    repeated = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")
    both = salted_left_join(rows, repeated, ["digest", "bytes"], F.struct("page_id", "url"))
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return both.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "bytes", F.when(revisit, F.col("largest")).alias("refers_to"))


def _record(headers: dict, block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def record(page_id, url, digest, size, refers_to, row, part, chunk: bytes, segment: int = SEGMENT) -> bytes:
    """The WARC record of one chunk (from 0) of a page's payload, or of a revisit."""
    name = f"urn:x-page:{'null' if page_id is None else page_id}:{row}"
    url = (url or b"").decode("utf-8", "surrogateescape")  # bytes that are no UTF-8 stay as they are
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or name
    common = {"WARC-Target-URI": uri, "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is not None:
        return _record({"WARC-Type": "revisit", "WARC-Record-ID": f"<{name}>", **common, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:x-page:{refers_to}>", "X-Payload-Length": size}, b"")
    own = {"WARC-Type": "continuation" if part else "response", "WARC-Record-ID": f"<{name}:{part + 1}>" if part else f"<{name}>", **common, "Content-Type": None if part else "application/http; msgtype=response"}
    if size > segment:
        ends = (part + 1) * segment >= size
        own |= {"WARC-Segment-Number": part + 1, "WARC-Segment-Origin-ID": f"<{name}>" if part else None, "WARC-Segment-Total-Length": len(_HTTP.format(size)) + size if part and ends else None}
    return _record(own, (b"" if part else _HTTP.format(size).encode()) + chunk)


def write(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Writes ``pages(page_id, url, html)`` as WARC files under ``path``: one gzip member per record, by Spark's text writer.

    Payloads are cut into chunk rows where they are read, so that a worker sees ``segment`` bytes of one at a time.  The
    last byte of a gzip member is the highest of its length, 0 for records below 16 MiB; the writer's line end supplies it.
    """

    def lots(it):
        held, size = [], 0
        for batch in it:
            for values in zip(*batch.columns):
                *head, chunk = values
                tool = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record(*(x.as_py() for x in head), chunk.as_py() or b"", segment)
                held.append(tool.compress(raw) + tool.flush())
                size += len(held[-1])
                if size >= LOT:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

    if segment > 1 << 23:
        raise ValueError("segments are 8 MiB at most")
    rows = classified(pages).withColumn("row", F.monotonically_increasing_id()).withColumn("body", F.col("html").cast("binary"))
    last = F.when(F.col("body").isNull() | (F.col("bytes") == 0), 0).otherwise(F.floor((F.col("bytes") - 1) / F.lit(segment))).cast("int")
    chunk = F.substring(F.col("body"), F.col("part") * segment + 1, F.lit(segment))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), last))).select("page_id", F.col("url").cast("binary"), "digest", "bytes", "refers_to", "row", "part", chunk.alias("chunk"))
    rows.mapInArrow(lots, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", FILE_LOTS).text(path)


_ROW = pa.schema([("record", pa.string()), ("page_id", pa.int64()), ("seq", pa.int64()), ("total", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stated", pa.string()), ("chunk", pa.binary())])
_ROW_DDL = "record string, page_id long, seq long, total long, record_type string, refers_to long, payload_bytes long, payload_digest string, stated string, chunk binary"


class _Stream:
    """Bytes of the gzip members of an archive, inflated as they are asked for."""

    def __init__(self, packed):
        self.packed, self.at, self.tool, self.held = memoryview(packed), 0, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.tool.eof:
            self.tool = zlib.decompressobj(31)
        if self.at >= len(self.packed):
            return False
        piece = self.packed[self.at : self.at + 16384]
        self.held += self.tool.decompress(piece)
        self.at += len(piece) - len(self.tool.unused_data)
        return True

    def head(self) -> bytes | None:
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends within a header")
                return None
        out = bytes(self.held[:end])
        del self.held[: end + 4]
        return out

    def body(self, size: int):
        while size:
            if not self.held and not self._more():
                raise ValueError("the archive ends within a record")
            got = bytes(self.held[:size])
            del self.held[: len(got)]
            size -= len(got)
            yield got


def parse(packed):
    """Rows of one archive: a whole record is digested as it streams by; a segment is a chunk row of its payload."""
    stream = _Stream(packed)
    while (head := stream.head()) is not None:
        first, *lines = head.decode("utf-8", "surrogateescape").strip().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        h = dict(line.split(": ", 1) for line in lines)
        kind, name = h["WARC-Type"], h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"])[1:-1]
        page = name.split(":")[2]
        row = dict.fromkeys(_ROW.names) | {"record": name, "page_id": None if page == "null" else int(page), "seq": int(h.get("WARC-Segment-Number", 1)), "record_type": "revisit" if kind == "revisit" else "response", "stated": h["WARC-Payload-Digest"].removeprefix("sha1:")}
        size, digest, kept, start = int(h["Content-Length"]), hashlib.sha1(), bytearray(), bytearray()
        whole = "WARC-Segment-Number" not in h
        skipped, seen = kind != "response", 0
        for piece in stream.body(size):
            if not skipped:  # the HTTP header of a response
                start += piece
                if (end := start.find(b"\r\n\r\n")) < 0:
                    continue
                piece, skipped = bytes(start[end + 4 :]), True
            seen += len(piece)
            if whole:
                digest.update(piece)
            else:
                kept += piece
        for _ in stream.body(4):
            pass
        if kind == "revisit":
            row |= {"refers_to": int(h["WARC-Refers-To"][1:-1].split(":")[2]), "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": row["stated"]}  # read() holds them against the response
        elif whole:
            row |= {"payload_bytes": seen, "payload_digest": digest.hexdigest()}
        else:
            row |= {"chunk": bytes(kept), "total": int(t) if (t := h.get("WARC-Segment-Total-Length")) else None}
        yield row


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: one row per record, or per segment with its part of the payload."""

    def rows(it):
        for batch in it:
            for packed in batch.column(0):
                out, held = [], 0
                for row in parse(packed.as_buffer()):
                    out.append(row)
                    held += 200 + len(row["chunk"] or b"")
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(out, _ROW)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, _ROW)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(rows, _ROW_DDL)


_OUT = pa.schema([_ROW.field(n) for n in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every record under ``path``.

    Segments come to one task in order and their digest is carried from row to row, so no payload is ever whole in
    memory.  A payload whose digest isn't the stated one, or that lacks a segment, is an error; so is a revisit of
    which no response has the page, digest and length that it states.
    """

    def ended(row: dict, digest, seen: int, count: int) -> dict:
        if row["payload_digest"] is None:
            row = row | {"payload_bytes": seen, "payload_digest": digest.hexdigest()}
            if row["seq"] != count or row["total"] is None:
                raise ValueError(f"{row['record']} lacks segments")
        if row["payload_digest"] != row["stated"]:
            raise ValueError(f"{row['record']}: digest {row['payload_digest']}, stated {row['stated']}")
        return {n: row[n] for n in _OUT.names}

    def carried(it):
        last, digest, seen, count = None, hashlib.sha1(), 0, 0
        for batch in it:
            out = []
            for row in batch.to_pylist():
                if last and last["record"] != row["record"]:
                    out.append(ended(last, digest, seen, count))
                    digest, seen, count = hashlib.sha1(), 0, 0
                chunk = row.pop("chunk")
                digest.update(chunk or b"")
                seen, count, last = seen + len(chunk or b""), count + 1, row
            yield pa.RecordBatch.from_pylist(out, _OUT)
        if last:
            yield pa.RecordBatch.from_pylist([ended(last, digest, seen, count)], _OUT)

    table = chunk_table(spark, path).repartition("record").sortWithinPartitions("record", "seq")
    found = saved(table.mapInArrow(carried, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "records")
    stated = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest", "payload_bytes").distinct()
    if lost := stated.join(found.where("record_type = 'response'"), ["page_id", "payload_digest", "payload_bytes"], "left_anti").first():
        raise ValueError(f"no response of page {lost.page_id} has the payload that a revisit of it states")
    return found


def round_trip(pages: DataFrame, path: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Writes archives (in the shared folder unless ``path`` is given) and reads them back; see :func:`read`.

    Of records with equal payloads of LEAST_REVISIT bytes or more, that with the largest page_id is the response.

    * NULL html is an empty payload.  NULL url: the record's own name is its target.
    * NULL page_id: revisits a payload that a numbered page has; if none has, all are responses.
    * Rows that repeat a page_id each give a record; those with the largest page_id of a payload are all responses.
    * Empty table: no rows.  Other columns are ignored.
    """
    path = path or fresh(pages.sparkSession, "warc")
    write(pages, path, segment)
    return read(pages.sparkSession, path)


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) d FROM pages),
r AS (SELECT d, n, max(page_id) largest FROM p WHERE n >= {LEAST_REVISIT} GROUP BY d, n)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN largest IS NULL OR largest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN largest <> page_id THEN largest END AS refers_to
FROM p LEFT JOIN r USING (d, n)
"""
