"""Media columns stored as content-defined chunks.

A payload's stored form is an 8-bit mono WAV file. A rolling gear hash cuts it where 11 bits of the hash are zero, so
equal passages give equal chunks wherever they lie. Chunk digests are counted by Spark; a chunk that occurs more than
once is kept once, in the chunk table, under its digest, and the others lie in their document's row. Which digests
repeat goes to the tasks as a Bloom filter, sized by their number up to MOST_FILTER_BITS: a false positive only sends a
chunk through the chunk table, so that a filter which cannot grow further costs a shuffle of chunks and no result.
Reading joins the recipes' digests with the chunk table, puts the chunks in order and verifies the result. A digest that
more than HOT rows want is in several salted copies in that join, so that no task fetches it for all of them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, materialize, scratch, table

UNIT = 64
RATE = 8000
LEAST, CUT_BITS, MOST = 512, 11, 16384
#: Bits of the Bloom filter for each repeated digest; the least and most of the whole, a broadcast of 64 kB to 256 MB.
BITS_PER_DIGEST, LEAST_FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 19, 1 << 31
#: Rows that fetch one copy of a chunk.
HOT = 5000
WAV_HEADER = 44

_GEAR = np.frombuffer(b"".join(hashlib.sha256(b"gear%d" % i).digest()[:4] for i in range(256)), "<u4").astype(np.uint32)


def payload(text: str | None) -> bytes:
    b = (text or "").encode()
    return b + b"\0" * (-len(b) % UNIT if b else UNIT)


def to_wav(samples: bytes) -> bytes:
    n = len(samples)
    return b"RIFF" + struct.pack("<I", 36 + n & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n & 0xFFFFFFFF) + samples


def from_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("not an 8-bit WAV of this store")
    return media[WAV_HEADER:]


def cut_places(data: bytes) -> list[int]:
    """Ends of the chunks of data: h = (h << 1) + gear[byte] mod 2^32, cut after a byte with the top bits of h zero.

    A byte leaves a 32-bit h after 32 steps, so h is a sum over the last 32 bytes: five doublings instead of a loop.
    """
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        if len(h) > width:
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    hits = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    out, start, n = [], 0, len(data)
    while start < n:
        k = int(np.searchsorted(hits, start + LEAST))
        start = min(int(hits[k]) if k < len(hits) else n, start + MOST)
        out.append(start)
    return out


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, chunk) in order."""
    ends = cut_places(data)
    return [(hashlib.sha256(data[s:e]).digest(), data[s:e]) for s, e in zip([0, *ends], ends)]


def _shared(words: np.ndarray, digest: bytes) -> bool:
    """Whether the filter holds the digest: its two 4-byte halves of 8 bytes, as places in the filter."""
    bits = 64 * len(words)
    return all(int(words[s >> 6]) >> (s & 63) & 1 for s in (int.from_bytes(digest[:4], "big") % bits, int.from_bytes(digest[4:8], "big") % bits))


def _filter_of(many: DataFrame) -> bytes:
    """Bloom filter of a written table of digests. The driver gets the filter's words, at most MOST_FILTER_BITS of bits."""
    need = many.count() * BITS_PER_DIGEST
    size = min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, 1 << max(0, need - 1).bit_length()))
    part = lambda at: F.conv(F.hex(F.substring("digest", at, 4)), 16, 10).cast("long") % size
    slots = many.select(F.explode(F.array(part(1), part(5))).alias("slot"))
    words = slots.groupBy((F.col("slot") / 64).cast("long").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
    out, got = np.zeros(size // 64, np.int64), words.toArrow()
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.tobytes()


def _repeated(docs: DataFrame) -> DataFrame:
    """(digest, n): the digests that occur more than once."""

    def digests(batches):
        for batch in batches:
            found = [d for t in batch.column(0).to_pylist() for d, _ in chunks(to_wav(payload(t)))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["digest"])

    return docs.select("text").mapInArrow(digests, "digest binary").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


MEDIA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("digests", T.ArrayType(T.BinaryType())),
        T.StructField("inline", T.ArrayType(T.BinaryType())),
        T.StructField("sha256", T.BinaryType()),
        T.StructField("refs", T.IntegerType()),
    ]
)


STORE = ["digest", "chunk", "copies"]


def write_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stores the media of docs (doc_id, text); returns the written media and chunk tables.

    media: one row per document, `digests` its chunks in order and `inline` the chunks kept in the row, null for
    those in the chunk table (digest, chunk, copies: how many salted copies a reader is to make of it). A null text is
    the empty one; a null doc_id stays null; each row is stored for itself, equal rows share chunks; an empty table
    gives two empty tables. Other columns do not matter.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    many = materialize(_repeated(docs), "repeated_digests")
    known = spark.sparkContext.broadcast(_filter_of(many))

    def rows(batches):
        words = np.frombuffer(known.value, np.int64)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                media = to_wav(payload(text))
                parts = chunks(media)
                inline = [None if _shared(words, d) else c for d, c in parts]
                n = len((text or "").encode())
                out.append((doc_id, n, [d for d, _ in parts], inline, hashlib.sha256(media).digest(), sum(c is None for c in inline)))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, kinds)], MEDIA.names)

    def kept(batches):
        words = np.frombuffer(known.value, np.int64)
        for batch in batches:
            own = {d: c for t in batch.column(0).to_pylist() for d, c in chunks(to_wav(payload(t))) if _shared(words, d)}
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.binary())], ["digest", "chunk"])

    at = scratch(spark, "media")
    docs.mapInArrow(rows, MEDIA).write.option("compression", "zstd").parquet(f"{at}/media")
    store = docs.select("text").mapInArrow(kept, "digest binary, chunk binary").dropDuplicates(["digest"])
    hot = few(materialize(many.where(F.col("n") > HOT).select("digest", F.ceil(F.col("n") / HOT).cast("int").alias("copies")), "hot_digests"))
    store.join(hot, "digest", "left").select(*STORE).write.option("compression", "zstd").parquet(f"{at}/chunks")
    return spark.read.schema(MEDIA).parquet(f"{at}/media"), spark.read.schema("digest binary, chunk binary, copies int").parquet(f"{at}/chunks")


def _feature(samples: bytes) -> str:
    """Mean, deviation and zero crossings per thousand of the samples around 128, and their most frequent value."""
    n = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    values, total = np.arange(256), len(samples)
    mean = int((n * values).sum()) * 1000 // total
    square = int((n * (values - mean // 1000) ** 2).sum()) * 1000 // total
    signs = np.frombuffer(samples, np.uint8) >= 128
    crossings = int((signs[1:] != signs[:-1]).sum()) * 1000 // total
    return f"mean={mean};var={square};zc={crossings};mode={int(n.argmax())}"


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(media: DataFrame, store: DataFrame) -> DataFrame:
    """Rebuilds each document's media from its chunks and computes its features; a wrong or missing chunk fails the task.

    One row per row of media, those of repeated rows alike; empty tables give none.
    """

    def features(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                got = dict(row.get("fetched") or ())
                parts = [got[d] if c is None else c for d, c in zip(row["digests"], row["inline"])]
                whole = b"".join(parts)
                if hashlib.sha256(whole).digest() != row["sha256"]:
                    raise ValueError(f"media of document {row['doc_id']} differs from what was stored")
                p = from_wav(whole)
                out.append((row["doc_id"], row["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(whole), row["sha256"].hex(), _feature(p)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = [x.split()[0] for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 8, kinds)], names)

    alone = media.where("refs = 0").mapInArrow(features, FEATURES)
    mixed = media.where("refs > 0").withColumn("_row", F.monotonically_increasing_id())
    wanted = mixed.select("_row", F.explode(F.arrays_zip("digests", F.transform("inline", lambda c: c.isNull()).alias("out"))).alias("x")).where("x.out")
    wanted = wanted.select("_row", F.col("x.digests").alias("digest")).distinct()
    # hot digests are few: at most one for HOT chunks of the input
    hot = few(materialize(store.where("copies is not null").select("digest", "copies"), "hot_chunks"))
    salted = wanted.join(hot, "digest", "left").select("_row", "digest", F.coalesce(F.pmod(F.xxhash64("_row"), F.col("copies").cast("long")), F.lit(0)).cast("int").alias("salt"))
    copied = store.select("digest", "chunk", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("copies") - 1, F.lit(0)))).alias("salt"))
    found = salted.join(copied, ["digest", "salt"]).groupBy("_row").agg(F.collect_list(F.struct("digest", "chunk")).alias("fetched"))
    joined = mixed.join(found, "_row").withColumn("fetched", F.map_from_entries("fetched")).drop("_row")
    return alone.unionByName(joined.mapInArrow(features, FEATURES))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's media, written and read back; nulls, repeated rows and an empty table as in write_media()."""
    return read_media(*write_media(table(spark, sf_dir, "documents")))
