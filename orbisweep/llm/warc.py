"""WARC archives: a writer, and a reader that salvages what is left of damaged ones.

The writer goes through Spark's text writer, so it works on any storage Spark can write to, and failed or repeated
tasks leave nothing behind. One row is one record without its last bytes, which the line separator supplies:
`\\r\\n\\r\\n` ends a plain record; a gzip member ends with the top byte of its 32-bit length, zero below 16 MiB.

Of records with equal payloads one is a `response`; the others are `revisit` records that name it and
carry no payload.

The reader checks every record: member and trailer of gzip, version line, header lines, Content-Length, the end
of the record and the digests. After a failed check it looks for the next place from where a whole valid record can
be read, a gzip member or a version line; the bytes passed over are reported as a gap with
the first reason. Records after a gap are read as usual.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize, work_path

VERSION, MAGIC = b"WARC/1.", b"\x1f\x8b\x08"
_FLUSHED = zlib.compressobj(9, zlib.DEFLATED, 31)
EMPTY_MEMBER = _FLUSHED.compress(b"") + _FLUSHED.flush()
FILE_RECORDS = 20_000
STEP = 16 << 10
LEVEL = 4


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record(page_id: int | None, copy: int, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool,
           date: str) -> bytes:
    """One record up to and without the final CR LF CR LF. Rows with equal key, url and payload differ in `copy`."""
    name = lambda p, n: f"<urn:page:{'none' if p is None else p}:{digest[:10]}:{n}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id, copy)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url) if url else f'urn:page:{page_id}'}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {name(refers_to, 0)}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block


def _records(compress: bool, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                out = []
                for r in batch.slice(lo, 512).to_pylist():
                    digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                    body = record(r["page_id"], r["copy"], r["url"], r["payload"] or b"", digest, r["bytes"], r["refers_to"], r["revisit"], date)
                    if compress:
                        member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        body = member.compress(body + b"\r\n\r\n") + member.flush()
                        body = (body if body[-1] == 0 else body + EMPTY_MEMBER)[:-1]
                    out.append(body)
                yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    return run


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", compress: bool = True,
          date: str = "2026-01-01T00:00:00Z") -> None:
    """Writes every row as a record below `path`.

    The payload is the html in UTF-8, null as empty. Among equal payloads, empty ones included, the row with the smallest
    key is the response (null keys last; of repeated rows, one); the others refer to it. Equality is that of
    SHA-1 and length. Other columns are ignored; an empty table writes an empty archive.

    Which row is the response is settled on digests alone, so a payload that a third of all pages share never meets
    itself; then only the responses' payloads are picked, by a key unique to them.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    rows = rows.withColumn("same", F.xxhash64("page_id", "url", "digest"))
    # one row per different page and the number of its copies
    groups = materialize(
        rows.select("page_id", "url", "digest", "same", F.octet_length("payload").cast("long").alias("bytes"))
        .groupBy("page_id", "url", "digest", "same", "bytes").agg(F.count("*").alias("copies")),
        "warc-pages",
    )
    first = groups.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", "url", "same")).alias("f")).select(
        "digest", F.col("f.page_id").alias("first_id"), F.col("f.same").alias("first_same")
    )
    columns = ["page_id", "copy", "url", "payload", "digest", "bytes", "refers_to", "revisit"]
    responses = rows.join(first.select("digest", F.col("first_same").alias("same")), ["digest", "same"], "left_semi").dropDuplicates(["digest", "same"]).select(
        "*", F.lit(0).cast("long").alias("copy"), F.octet_length("payload").cast("long").alias("bytes"), F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit")
    )
    own = F.when(F.col("same") == F.col("first_same"), 1).otherwise(0).cast("long")  # this copy is the response
    revisits = groups.join(first, "digest").where(F.col("copies") > own).select(
        "*", F.explode(F.sequence(own, F.col("copies") - 1)).alias("copy"), F.lit(None).cast("binary").alias("payload"),
        F.col("first_id").alias("refers_to"), F.lit(True).alias("revisit"),
    )
    out = responses.select(*columns).unionByName(revisits.select(*columns)).mapInArrow(_records(compress, date), "record binary")
    # the text writer writes a string's bytes as they are
    out.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\x00" if compress else "\r\n\r\n").option(
        "maxRecordsPerFile", FILE_RECORDS).mode("overwrite").text(path)


class Damaged(Exception):
    pass


def _headers(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        out[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def _plain(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the uncompressed record at `at`, and where it ends."""
    if not data.startswith(VERSION, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers do not end")
    headers = _headers(data[at:end])
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no Content-Length")
    stop = end + 4 + int(length)
    if data[stop: stop + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where it should")
    block = data[end + 4: stop]
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != base32_sha1(block):
        raise Damaged("block digest differs")
    return headers, block, stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    opened, body, read = zlib.decompressobj(31), [], at
    try:
        while not opened.eof and read < len(data):  # in steps: what is left over after the end is copied
            body.append(opened.decompress(data[read: read + STEP]))
            read += STEP
    except zlib.error as e:
        raise Damaged(f"gzip member: {str(e)[:60]}") from None
    if not opened.eof:
        raise Damaged("gzip member does not end")
    return b"".join(body), min(read, len(data)) - len(opened.unused_data)


def _at(data: bytes, at: int) -> tuple[dict[str, str] | None, bytes, int]:
    if data.startswith(MAGIC, at):
        body, end = _member(data, at)
        if not body:
            return None, b"", end
        headers, block, used = _plain(body, 0)
        if used != len(body):
            raise Damaged("bytes after the record in its member")
        return headers, block, end
    return _plain(data, at)


def _candidates(data: bytes, at: int) -> Iterator[int]:
    """Places after `at` where a gzip member or a version line may begin, in order."""
    zipped, plain = data.find(MAGIC, at), data.find(VERSION, at)
    while zipped >= 0 or plain >= 0:
        if plain < 0 or 0 <= zipped < plain:
            yield zipped
            zipped = data.find(MAGIC, zipped + 1)
        else:
            yield plain  # anywhere: what was cut off before it need not end a line
            plain = data.find(VERSION, plain + 1)


def parse(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive in order: kind, start, end, and headers and block or the reason."""
    at = 0
    while at < len(data):
        try:
            headers, block, end = _at(data, at)
            if headers is not None:
                yield {"kind": "record", "start": at, "end": end, "headers": headers, "block": block}
            at = end
            continue
        except Damaged as e:
            reason = str(e)
        resume = len(data)
        for place in _candidates(data, at + 1):
            try:
                _at(data, place)
            except Damaged:
                continue
            resume = place
            break
        yield {"kind": "gap", "start": at, "end": resume, "reason": reason}
        at = resume


def _page(name: str) -> int | None:
    part = name.strip("<>").split(":")
    return int(part[2]) if len(part) == 5 and part[2] not in ("", "none") else None


def describe(found: dict, payloads: bool) -> dict:
    """A row of `read` for what `parse` found."""
    out = {"kind": found["kind"], "start": found["start"], "end": found["end"], "reason": found.get("reason")}
    if found["kind"] == "gap":
        return out
    h, block = found["headers"], found["block"]
    kind, head, payload = h.get("warc-type", ""), {}, block
    if h.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        try:
            head = _headers(top)
        except Damaged:
            head = {}
    size, digest = len(payload), f"sha1:{base32_sha1(payload)}"
    if kind == "revisit":  # the payload is with the record it refers to
        length = head.get("content-length", "")
        size, digest = (int(length) if length.isdigit() else None), h.get("warc-payload-digest")
    elif "warc-payload-digest" in h and h["warc-payload-digest"] != digest:
        out["reason"] = "payload digest differs"
    refers = h.get("warc-refers-to", "")
    return out | {
        "record_type": kind, "record_id": h.get("warc-record-id"), "page_id": _page(h.get("warc-record-id", "")), "target_uri": h.get("warc-target-uri"),
        "date": h.get("warc-date"), "refers_to": _page(refers) if refers else None, "payload_bytes": size,
        "payload_digest": (digest or "").removeprefix("sha1:"), "payload": payload if payloads and kind != "revisit" else None,
    }


FIELDS = [
    ("file", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()),
    ("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
]
_NAMES = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record (kind 'record') and per quarantined gap (kind 'gap') of all archives below `path`.

    `start` and `end` are byte positions in the file. A response whose payload digest differs though the rest holds is
    returned with a reason. Records within a damaged record's payload count as records. An archive is read
    whole by one task; the writer bounds archives by their number of records.
    """
    schema = pa.schema(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data, rows = batch["path"][i].as_py(), batch["content"][i].as_py(), []
                for found in parse(data):
                    rows.append({"file": name} | describe(found, payloads))
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, ", ".join(f"`{n}` {_NAMES[t]}" for n, t in FIELDS))


def records(found: DataFrame) -> DataFrame:
    return found.where("kind = 'record'").drop("kind")


def gaps(found: DataFrame) -> DataFrame:
    return found.where("kind = 'gap'").select("file", "start", "end", "reason")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes `pages` to archives in the shared folder and reads them back: one row per record."""
    path = work_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return records(read(pages.sparkSession, path))
