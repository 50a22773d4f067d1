"""Web archives (WARC 1.1): writing with revisits, chunked framing and segments, and reading back."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domweave.functions.skew import join_per_key
from domweave.llm.common import measured_broadcast, utf8
from domweave.session import written

VERSION = b"WARC/1.1\r\n"


def frame_chunks(payload: bytes, size: int) -> bytes:
    """Chunked transfer coding: hexadecimal length, data, for each chunk, and an empty last chunk."""
    parts = []
    for at in range(0, len(payload), size):
        chunk = payload[at : at + size]
        parts += [b"%x\r\n" % len(chunk), chunk, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def decode_chunks(framed: bytes) -> bytes:
    """The payload of chunked framing, with chunk extensions and trailers skipped; ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(framed[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(framed) or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(framed[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return VERSION + lines + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def records_of(data: bytes):
    """(headers with lower-case names, block) of every record of an archive; lengths decide, so blocks may hold anything."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        start = end + 4
        stop = start + int(headers["content-length"])
        if stop > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, data[start:stop]
        at = stop


def page_records(key: int, page_id, url, payload: bytes, digest: str, first, chunk: int, segment: int):
    """The records of one page: a response (with continuations if long), or a revisit of the record of key ``first``."""
    name = f"<urn:page:{key}>"
    common = [("WARC-Record-ID", name), ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A"))]
    if page_id is not None:
        common.append(("X-Page-Id", page_id))
    common.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if first is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", f"<urn:page-id:{first}>"), ("WARC-Profile", profile),
                      ("Content-Type", "application/http;msgtype=response")], http)
        return
    block = http + frame_chunks(payload, chunk)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    typed = [("WARC-Type", "response"), *common, ("Content-Type", "application/http;msgtype=response")]
    if len(parts) == 1:
        yield record(typed, block)
        return
    yield record([*typed, ("WARC-Segment-Number", 1)], parts[0])
    for number, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if number == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{key}:{number}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
                      ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number), *last], part)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 1000,
                   archive_bytes: int = 8_000_000, chunk: int = 8192, segment: int = 65_536) -> None:
    """Writes WARC archives of about ``archive_bytes`` each as rows (archive) of a binary table below ``path``.

    A table rather than single files, as any file system that Spark writes to can then hold them;
    each row is a complete archive.  Of pages with equal payloads of ``least`` bytes or more
    that with the largest id is a response, the others are revisits of it.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url"), utf8(html).alias("payload"))
    rows = rows.withColumns({"bytes": F.length("payload"), "digest": F.sha1("payload")})
    shared = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    # payloads that occur once need no join; the others are few or, if not, joined by shuffle with salts
    shared = written(shared.where("n > 1 and first is not null").drop("n"), "payloads")
    hint = measured_broadcast(shared, 200_000)
    if hint is shared:
        rows = join_per_key(rows, shared, ["digest", "bytes"], ["page_id"], "left")
    else:
        rows = rows.join(hint, ["digest", "bytes"], "left")
    first = F.when(F.col("page_id") == F.col("first"), F.lit(None)).otherwise(F.col("first"))
    rows = rows.select(F.monotonically_increasing_id().alias("key"), "page_id", "url", "payload", "digest", first.alias("first"))

    def write(batches):
        held, n = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for part in page_records(*row, chunk, segment):
                    if n and n + len(part) > archive_bytes:
                        yield pa.RecordBatch.from_pydict({"archive": [b"".join(held)]})
                        held, n = [], 0
                    held.append(part)
                    n += len(part)
        if held:
            yield pa.RecordBatch.from_pydict({"archive": [b"".join(held)]})

    rows.mapInArrow(write, "archive binary").write.parquet(path)


_RECORD = pa.schema([("record_id", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("type", pa.string()),
                     ("uri", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("refers_to", pa.string()), ("block", pa.binary())])
_RECORD_DDL = ("record_id string, origin string, segment int, total long, type string, uri string, page_id long, digest string, "
               "refers_to string, block binary")
_PAGE_DDL = "record_id string, type string, uri string, page_id long, digest string, refers_to string, payload binary, problem string"


def read_records(archives: DataFrame, column: str = "archive") -> DataFrame:
    """One row per record; a broken archive gives its good records and one row of type ``broken``."""
    def read(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, size = [], 0
                try:
                    for h, block in records_of(data or b""):
                        number = lambda k: int(h[k]) if h.get(k, "").lstrip("-").isdigit() else None  # noqa: B023, E731
                        rows.append({
                            "record_id": h.get("warc-record-id"), "origin": h.get("warc-segment-origin-id", h.get("warc-record-id")),
                            "segment": number("warc-segment-number"), "total": number("warc-segment-total-length"), "type": h.get("warc-type"),
                            "uri": h.get("warc-target-uri"), "page_id": number("x-page-id"), "digest": h.get("warc-payload-digest"),
                            "refers_to": h.get("warc-refers-to"), "block": block})
                        size += len(block)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                            rows, size = [], 0
                except ValueError as problem:
                    rows.append({"type": "broken", "block": str(problem).encode()})
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return archives.select(column).mapInArrow(read, _RECORD_DDL)


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    chunked = any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(b"\r\n"))
    return decode_chunks(body) if chunked else body


def read_pages(archives: DataFrame, column: str = "archive") -> DataFrame:
    """record_id, type, uri, page_id, digest, refers_to, payload, problem of every response and revisit.

    Segments are grouped by the id of their origin, ordered by segment number, and joined if the numbers are
    complete and the length is the stated total; only segmented records are shuffled.  Chunked
    framing is decoded, the SHA-1 digest checked.  What fails keeps its row, with the
    ``problem`` told and no payload.
    """
    rows = written(read_records(archives, column), "records")
    plain = rows.where("segment is null and type in ('response', 'revisit')")
    parts = rows.where("segment is not null").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "total", "block"))).alias("parts"),
        F.max(F.when(F.col("segment") == 1, F.struct("record_id", "type", "uri", "page_id", "digest", "refers_to"))).alias("head"))
    whole = plain.select("record_id", "type", "uri", "page_id", "digest", "refers_to", F.array(
        F.struct(F.lit(1).alias("segment"), F.lit(None).cast("long").alias("total"), F.col("block"))).alias("parts"))
    joined = whole.union(parts.select(
        F.coalesce("head.record_id", "origin"), F.coalesce("head.type", F.lit("response")), "head.uri", "head.page_id", "head.digest",
        "head.refers_to", "parts"))

    def assemble(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                segments, payload, problem = row.pop("parts"), None, None
                block = b"".join(s["block"] for s in segments)
                if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
                    problem = "segments missing or repeated"
                elif len(segments) > 1 and segments[-1]["total"] != len(block):
                    problem = "segments do not add up to the stated length"
                else:
                    try:
                        payload = None if row["type"] == "revisit" else _payload(block)
                    except ValueError as broken:
                        problem = str(broken)
                if payload is not None and (row["digest"] or "").startswith("sha1:") and row["digest"][5:] != hashlib.sha1(payload).hexdigest():
                    payload, problem = None, "digest differs"
                out.append(row | {"payload": payload, "problem": problem})
            yield pa.RecordBatch.from_pylist(out, schema=_PAGE)

    return joined.mapInArrow(assemble, _PAGE_DDL)


_PAGE = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()),
                   ("refers_to", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])


def archived_pages(pages: DataFrame, path: str, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to after writing ``pages`` to ``path`` and reading back.

    Null html is an empty payload, null ids revisit or respond like others but are never referred to.  Repeated
    rows are written each; if the largest id is repeated, all its rows are responses.  Other columns are
    ignored; an empty table gives no rows.  A revisit has the length of the response it refers to.
    """
    write_archives(pages, path, **options)
    spark = pages.sparkSession
    read = read_pages(spark.read.schema("archive binary").parquet(path))
    slim = written(read.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"),
        F.col("type").alias("record_type"), F.regexp_extract(F.coalesce("refers_to", F.lit("")), r"^<urn:page-id:(-?\d+)>$", 1).alias("to"), "problem"),
        "pages")
    slim = slim.withColumn("refers_to", F.when(F.col("to") != "", F.col("to").cast("long"))).drop("to")
    answers = slim.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("own_bytes"))
    referred = slim.where("record_type = 'revisit'").select("refers_to").distinct()
    answers = answers.join(referred, "refers_to", "left_semi").groupBy("refers_to").agg(F.max("own_bytes").alias("own_bytes"))
    return join_per_key(slim, answers, ["refers_to"], ["page_id"], "left").select(
        "page_id", F.coalesce("payload_bytes", "own_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "problem")
