"""WARC archives: a writer with one gzip member per record, and a splittable reader.

The reader's tasks take byte ranges. A task looks for gzip magic from its range's start, takes a candidate for a
record only if its header decodes and the member inflates to the end, and owns the records that start in its range;
the last of them it reads past the end. After a record the next one starts where its member ended, so magic within a
member's data is never looked at.
"""

from __future__ import annotations

import base64
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, materialize, scratch, table

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 4 << 20
BLOCK = 1 << 16
MOST_TASKS = 20_000
#: Payloads of at least so many bytes become revisits of equal ones.
REVISIT_FROM = 0
#: Repeated payloads up to which their table is broadcast (about 100 bytes each), and rows that meet one copy of a payload.
BROADCAST_PAYLOADS, HOT = 500_000, 5000
_NAMES = uuid.UUID("6f0a5f8e-3c51-4b0e-9a55-2d1f2c6d9b10")


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, str(page_id))}>"


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _line(value) -> str:
    return "".join(c if c >= " " else " " for c in str(value if value is not None else ""))


def record(page_id, url, payload: bytes, digest: str, n: int, refers_to) -> bytes:
    """A response record, or a revisit of the record of page refers_to, with the full payload's size and digest."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def parse(data: bytes) -> dict | None:
    """Header fields of a record by lower-case name, with `block`; None if data is no whole record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        return None
    fields = dict(x.partition(":")[::2] for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) < int(size):
        return None
    return fields | {"block": rest[: int(size)]}


def open_store(uri: str):
    """File system and path of a URI; what Arrow has no file system for raises."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def revisits(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, html, digest (hex SHA-1), n, refers_to, again (whether the row is a revisit).

    Of equal payloads the row with the smallest page_id is the response, null ids last; of rows that share that id,
    one. A null html is the empty payload; an empty table stays empty; other columns do not matter. Which payloads
    repeat is found by partial aggregation. Where those are few they are broadcast and html stays where it is; else
    html meets them in a join in which a payload that more than HOT rows share is in several salted copies.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html").cast("long"))
    row = F.monotonically_increasing_id()
    rows = rows.withColumn("rank", F.struct(F.col("page_id").isNull().alias("none"), "page_id", row.alias("row")))
    first = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("copies"))
    first = materialize(first.where("copies > 1"), "repeated_payloads")
    if first.count() <= BROADCAST_PAYLOADS:
        joined = rows.join(F.broadcast(first.select("digest", "first")), "digest", "left")
    else:
        hot = few(materialize(first.where(F.col("copies") > HOT).select("digest", F.ceil(F.col("copies") / HOT).alias("salts")), "hot_payloads"))
        salt = F.coalesce(F.pmod(F.xxhash64("rank.row"), F.col("salts")), F.lit(0).cast("long")).alias("salt")
        salted = rows.join(hot, "digest", "left").select(*rows.columns, salt)
        salts = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("copies") / HOT) - 1)
        joined = salted.join(first.select("digest", "first", F.explode(salts).alias("salt")), ["digest", "salt"], "left")
    again = F.col("first").isNotNull() & (F.col("n") >= least) & (F.col("rank") != F.col("first"))
    return joined.select("page_id", "url", "html", "digest", "n", F.when(again, F.col("first.page_id")).alias("refers_to"), again.alias("again"))


def write_warc(pages: DataFrame, folder: str, least: int = REVISIT_FROM) -> DataFrame:
    """Writes pages (page_id, url, html) as .warc.gz files under folder; returns (file, bytes, records).

    A task writes under a name of its own attempt and then renames, so a task that is run again leaves one file. Nulls,
    repeated rows and an empty table as in revisits(); an empty table writes no records.
    """

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, at = open_store(folder)
        store.create_dir(at, recursive=True)
        name = f"part-{task.partitionId():06d}.warc.gz"
        draft, size, n = f"{at}/_{name}.{task.taskAttemptId()}", 0, 0
        with store.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    member = record(row["page_id"], row["url"], row["html"].encode(), base32_sha1(row["digest"]), row["n"], row["refers_to"] if row["again"] else None)
                    size, n = size + out.write(member), n + 1
        store.move(draft, f"{at}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["file", "bytes", "records"])

    return materialize(revisits(pages, least).mapInArrow(run, "file string, bytes long, records long"), "warc_files").where("records > 0")


def members(read, size: int, start: int, end: int):
    """Records (as parse() gives them) whose members start in [start, end). read(at, n) gives up to n bytes."""
    at = start
    while at < end:
        window = read(at, BLOCK + 2)
        hit = window.find(MAGIC)
        if hit < 0 or at + hit >= end:
            if hit >= 0 or at + BLOCK >= min(end, size):
                return
            at += BLOCK
            continue
        found, stop = _inflate(read, size, at + hit)
        if found is None:
            at += hit + 1
        else:
            yield found
            at = stop


def _inflate(read, size: int, at: int) -> tuple[dict | None, int]:
    """The record in the member at `at` and the place after it, or None. A false candidate fails within a block."""
    inflate, out, place = zlib.decompressobj(31), bytearray(), at
    try:
        while not inflate.eof:
            if place >= size:
                return None, at
            block = read(place, BLOCK)
            out += inflate.decompress(block)
            place += len(block)
            if len(out) >= 7 and not out.startswith(b"WARC/1."):
                return None, at
    except zlib.error:
        return None, at
    return parse(bytes(out)), place - len(inflate.unused_data)


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_warc(files: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the files (file, bytes) in folder. A response's payload is hashed again; a wrong digest fails the task.

    No files give no records; a record without a page id has a null page_id.
    """
    last = F.greatest(F.col("bytes") - 1, F.lit(0))
    ranges = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(range_bytes).cast("long"))).alias("start"))
    n = files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    # as many tasks as ranges: rows this small would otherwise be taken together in one
    ranges = ranges.repartition(min(int(n), MOST_TASKS), "file", "start")

    def run(batches):
        import hashlib

        store, at = open_store(folder)
        number = lambda x: int(x) if x not in (None, "") else None
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                with store.open_input_file(f"{at}/{row['file']}") as f:
                    read = lambda place, n: f.read_at(n, place)  # noqa: B023, E731
                    for r in members(read, row["bytes"], row["start"], row["start"] + range_bytes):
                        http, _, body = r["block"].partition(b"\r\n\r\n")
                        n = int(http.decode().rpartition("Content-Length: ")[2].split("\r\n")[0])
                        digest = r["warc-payload-digest"].removeprefix("sha1:")
                        if r["warc-type"] == "response" and (len(body) != n or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                            raise ValueError(f"{row['file']}: payload of {r['warc-record-id']} differs from its digest")
                        out.append((number(r.get("x-page-id")), r["warc-target-uri"], n, digest, r["warc-type"], number(r.get("x-refers-to-page-id")), body if with_payload else None))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, kinds)], [x.split()[0] for x in RECORDS.split(", ")])

    return ranges.select("file", "bytes", "start").mapInArrow(run, RECORDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written and read back; nulls, repeated rows and an empty table as in revisits()."""
    folder = scratch(spark, "warc")
    files = write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(files, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP9 = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i:
    array_to_string(list_transform(range(0, 4), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT >> (15 - 5 * j)::INT) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to
FROM m
"""
