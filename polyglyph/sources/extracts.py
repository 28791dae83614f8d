"""Binary map extracts (PBF) as a data source: files of blocks, which tasks find by themselves in ranges of bytes.

    spark.dataSource.register(MapExtract)
    spark.read.format("map_extract").option("keys", "website").load(path)
    elements.write.format("map_extract").mode("append").save(folder)

A block holds elements of one kind, its own table of strings, and ids, places and references as differences in zig-zag
form. A range owns the blocks whose headers start inside it: it looks for the first and goes on from block to block.
What is asked of the source is tested on a block's strings and ids before any element is made: `kinds` of elements, `keys`
(one of these tags must be there) and `ids`. These are options and not filters that Spark hands over: in Spark 4.1 two
different filters on one DataFrame reach the same reader of a Python source, which then loses rows of one of them.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "type string, id long, tags map<string,string>, lat double, lon double, nodes array<long>, members array<struct<type: string, ref: long, role: string>>"
KINDS = ("node", "way", "relation")
#: Kinds of the elements that have a field of their own, by its number.
SINGLE = {1: "node", 3: "way", 4: "relation"}
_MEMBER = pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
ARROW = pa.schema([("type", pa.string()), ("id", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("lat", pa.float64()), ("lon", pa.float64()), ("nodes", pa.list_(pa.int64())), ("members", pa.list_(_MEMBER))])
#: Bytes of a range, elements of a block that is written, ids that are sent to the reader, rows of a batch.
RANGE_BYTES, BLOCK_ELEMENTS, MOST_IDS, BATCH_ROWS = 32 << 20, 8000, 1_000_000, 20_000
#: Numbers or bytes below which a run is read or written one by one.
SHORT = 64
# Fixed values of the format: how a block's header begins, the most bytes of a header and of a block, units of a degree.
MARK, MOST_HEADER, MOST_BLOCK, UNITS = b"\x0a\x07OSMData", 64 << 10, 64 << 20, 1_000_000_000


# --- numbers and fields of the wire format ---------------------------------------------------------------------------


def varints(data: bytes) -> np.ndarray:
    """The numbers of a run of variable length: seven bits a byte, the low ones first, the high bit where more follow."""
    if len(data) < SHORT:  # whole arrays pay for long runs only
        out, at = [], 0
        while at < len(data):
            n, at = _number(data, at)
            out.append(n)
        return np.array(out, np.uint64)
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.uint64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        on = first + k <= last
        out[on] |= (b[first[on] + k] & np.uint64(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


#: The numbers of one byte.
_ONE = [bytes([n]) for n in range(128)]


def _put_number(n: int) -> bytes:
    if 0 <= n < 128:
        return _ONE[n]
    n, out = int(n) & (1 << 64) - 1, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def put_varints(numbers) -> bytes:
    if len(numbers) < SHORT:
        return b"".join(map(_put_number, numbers))
    left = np.asarray(numbers).astype(np.int64).astype(np.uint64)
    columns, on = [], np.ones(len(left), bool)
    while on.any():
        low, left = left & np.uint64(127), left >> np.uint64(7)
        more = left > 0
        columns.append((np.where(more, low | np.uint64(128), low).astype(np.uint8), on))
        on = on & more
    if not columns:
        return b""
    return np.stack([c for c, _ in columns], axis=1)[np.stack([o for _, o in columns], axis=1)].tobytes()


def signed(numbers: np.ndarray) -> np.ndarray:
    """Zig-zag form: 0, -1, 1, -2 ... as 0, 1, 2, 3."""
    return (numbers >> np.uint64(1)).astype(np.int64) ^ -(numbers & np.uint64(1)).astype(np.int64)


def zigzag(numbers) -> np.ndarray:
    n = np.asarray(numbers, np.int64)
    return (n << 1) ^ (n >> 63)


def deltas(data: bytes) -> np.ndarray:
    return np.cumsum(signed(varints(data)))


def put_deltas(numbers) -> bytes:
    if len(numbers) < SHORT:
        steps = [b - a for a, b in zip([0, *numbers], numbers)]
        return b"".join(_put_number((n << 1) ^ (n >> 63)) for n in map(int, steps))
    return put_varints(zigzag(np.diff(np.asarray(numbers, np.int64), prepend=0)))


def _few(data: bytes) -> list[int]:
    """varints() of a run as a list, which most runs of a way are too short to make arrays of."""
    if len(data) >= SHORT:
        return varints(data).tolist()
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        if byte < 128:
            out.append(value)
            value = shift = 0
        else:
            shift += 7
    return out


def _few_deltas(data: bytes) -> list[int]:
    """deltas() of a run as a list."""
    if len(data) >= SHORT:
        return deltas(data).tolist()
    return list(accumulate((n >> 1) ^ -(n & 1) for n in _few(data)))


def _number(data, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: numbers, or bytes."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _number(data, at)
        elif kind == 2:
            n, at = _number(data, at)
            value, at = data[at : at + n], at + n
            if len(value) < n:
                raise ValueError("a field is cut short")
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"no field of kind {kind}")
        yield tag >> 3, value


def put(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _put_number(number << 3) + _put_number(value)
    return _put_number(number << 3 | 2) + _put_number(len(value)) + value


# --- blocks ----------------------------------------------------------------------------------------------------------


def header_at(data: bytes, at: int) -> tuple[str, int, int] | None:
    """(type, bytes of the length and the header, bytes of the blob) of a block's header at `at`; None if there is none."""
    if at + 4 > len(data):
        return None
    n = struct.unpack(">I", data[at : at + 4])[0]
    if not 0 < n <= MOST_HEADER or at + 4 + n > len(data):
        return None
    try:
        parts = dict(fields(data[at + 4 : at + 4 + n]))
        kind, size = parts[1].decode(), parts[3]
    except (ValueError, IndexError, KeyError, AttributeError):
        return None
    return (kind, 4 + n, size) if isinstance(size, int) and 0 < size <= MOST_BLOCK else None


def find_block(file, start: int, end: int, size: int) -> int | None:
    """Where the first data block of a file begins from `start` on and before `end`; it must be followed by a block or by the end."""
    at = start
    while at < end:
        file.seek(at)
        window = file.read(min(1 << 20, size - at))
        place = window.find(MARK)
        while place >= 0:
            begin = at + place - 4
            if begin >= end:
                return None
            if begin >= start:
                file.seek(begin)
                head = header_at(file.read(min(MOST_HEADER + 4, size - begin)), 0)
                if head is not None:
                    follows = begin + head[1] + head[2]
                    file.seek(follows)
                    if follows == size or (follows < size and header_at(file.read(min(MOST_HEADER + 4, size - follows)), 0)):
                        return begin
            place = window.find(MARK, place + 1)
        if at + len(window) >= size:
            return None
        at += len(window) - len(MARK) - 4
    return None


def blocks(file, start: int, end: int, size: int) -> Iterator[bytes]:
    """The data blocks of a file that begin in [start, end)."""
    at = find_block(file, start, end, size)
    while at is not None and at < min(end, size):
        file.seek(at)
        head = header_at(file.read(min(MOST_HEADER + 4, size - at)), 0)
        if head is None:
            raise ValueError(f"no block at byte {at}")
        kind, skip, n = head
        if kind == "OSMData":
            file.seek(at + skip)
            blob = dict(fields(file.read(n)))
            if 1 not in blob and 3 not in blob:
                raise ValueError("only blocks that are plain or packed by zlib are covered")
            yield blob[1] if 1 in blob else zlib.decompress(blob[3])
        at += skip + n


@dataclass
class Wanted:
    """What is asked of the elements: kinds, sorted ids (None: all), and tags of which one must be there (none: all)."""

    kinds: tuple[str, ...] = KINDS
    ids: np.ndarray | None = None
    keys: tuple[str, ...] = ()

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Which elements are asked for by their ids."""
        if self.ids is None or not len(self.ids):
            return np.full(len(ids), self.ids is None)
        return self.ids[np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)] == ids

    def has(self, ident: int) -> bool:
        """Whether one element is asked for by its id."""
        if self.ids is None or not len(self.ids):
            return self.ids is None
        return self.ids[min(int(self.ids.searchsorted(ident)), len(self.ids) - 1)] == ident


def elements(block: bytes, wanted: Wanted) -> Iterator[tuple]:
    """Rows (of SCHEMA) of a block's elements."""
    parts: dict[int, list] = {}
    for number, value in fields(block):
        parts.setdefault(number, []).append(value)
    strings = [s for n, s in fields(parts[1][0]) if n == 1]
    keys = {i for i, s in enumerate(strings) if s.decode(errors="replace") in wanted.keys}
    if wanted.keys and not keys:
        return
    text = [s.decode(errors="replace") for s in strings]
    unit, south, west = (parts.get(n, [d])[0] for n, d in ((17, 100), (19, 0), (20, 0)))
    south, west = (x - (1 << 64) if x >> 63 else x for x in (south, west))

    def degrees(n, base: int):
        return (base + unit * n) / UNITS

    def tags(k, v):
        return list(dict(zip((text[i] for i in k), (text[i] for i in v))).items())

    for group in parts.get(2, ()):
        for number, value in fields(group):
            if number == 2 and "node" in wanted.kinds:
                d = dict(fields(value))
                ids, lat, lon = (deltas(d.get(n, b"")) for n in (1, 8, 9))
                said = varints(d.get(10, b"")).astype(np.int64)
                # strings are numbered from 1, so a zero ends a node's keys and values; without any no node has tags
                ends = np.flatnonzero(said == 0) if len(said) else np.zeros(len(ids), int)
                starts = np.concatenate([[0], ends[:-1] + 1]) if len(said) else ends
                for i in np.flatnonzero(wanted.of(ids)).tolist():
                    kv = said[starts[i] : ends[i]].tolist()
                    if not wanted.keys or keys.intersection(kv[::2]):
                        yield "node", int(ids[i]), tags(kv[::2], kv[1::2]), degrees(int(lat[i]), south), degrees(int(lon[i]), west), None, None
            elif number in SINGLE and SINGLE[number] in wanted.kinds:
                kind = SINGLE[number]
                d = dict(fields(value))
                ident = (d[1] >> 1) ^ -(d[1] & 1) if kind == "node" else d[1] - (1 << 64) if d[1] >> 63 else d[1]
                if not wanted.has(ident):
                    continue
                k, v = _few(d.get(2, b"")), _few(d.get(3, b""))
                if wanted.keys and not keys.intersection(k):
                    continue
                if kind == "node":
                    lat, lon = ((d[n] >> 1) ^ -(d[n] & 1) for n in (8, 9))
                    yield kind, ident, tags(k, v), degrees(lat, south), degrees(lon, west), None, None
                elif kind == "way":
                    yield kind, ident, tags(k, v), None, None, _few_deltas(d.get(8, b"")), None
                else:
                    roles, refs, types = _few(d.get(8, b"")), _few_deltas(d.get(9, b"")), _few(d.get(10, b""))
                    yield kind, ident, tags(k, v), None, None, None, [{"type": KINDS[t], "ref": r, "role": text[s]} for t, r, s in zip(types, refs, roles)]


def block_of(rows: list[tuple]) -> bytes:
    """A block of elements of one kind, sorted by id. A null place is refused, as the format has none."""
    kind = rows[0][0]
    numbers: dict[str, int] = {"": 0}
    number = lambda s: numbers.setdefault(s or "", len(numbers))
    pairs = [[(number(k) or number("\0empty"), number(v) or number("\0empty")) for k, v in (row[2] or ())] for row in rows]
    if kind == "node":
        if any(row[3] is None or row[4] is None for row in rows):
            raise ValueError("a node without a place")
        place = lambda c: put_deltas([round(row[c] * UNITS / 100) for row in rows])
        said = put_varints([n for p in pairs for kv in p + [(0,)] for n in kv]) if any(pairs) else b""
        body = put(1, put_deltas([row[1] for row in rows])) + put(8, place(3)) + put(9, place(4)) + (put(10, said) if said else b"")
        group = put(2, body)
    else:
        parts = []  # joined once, as bytes that grow are copied each time
        for row, kv in zip(rows, pairs):
            one = put(1, row[1]) + put(2, put_varints([k for k, _ in kv])) + put(3, put_varints([v for _, v in kv]))
            if kind == "way":
                one += put(8, put_deltas(row[5] or []))
            else:
                m = row[6] or []
                one += put(8, put_varints([number(x["role"]) for x in m])) + put(9, put_deltas([x["ref"] for x in m])) + put(10, put_varints([KINDS.index(x["type"]) for x in m]))
            parts.append(put(3 if kind == "way" else 4, one))
        group = b"".join(parts)
    table = b"".join(put(1, "".encode() if s == "\0empty" else s.encode()) for s in numbers)
    return put(1, table) + put(2, group)


def framed(kind: str, block: bytes) -> bytes:
    blob = put(2, len(block)) + put(3, zlib.compress(block))
    head = put(1, kind.encode()) + put(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


FILE_HEADER = framed("OSMHeader", put(4, b"OsmSchema-V0.6") + put(4, b"DenseNodes"))


# --- the source ------------------------------------------------------------------------------------------------------


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


class MapExtract(DataSource):
    """Options: path (a file or a folder); for reading kinds and keys (with commas between), ids (of pack_ids()) and bytes (of a range); for writing elements (of a block)."""

    @classmethod
    def name(cls) -> str:
        return "map_extract"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ExtractReader:
        return ExtractReader(self.options)

    def writer(self, schema, overwrite: bool) -> ExtractWriter:
        if overwrite:
            raise ValueError("a map extract is appended to; choose a new folder")
        return ExtractWriter(self.options)


class ExtractReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.bytes = options["path"], int(options.get("bytes", RANGE_BYTES))
        self.keys = tuple(k.strip() for k in options.get("keys", "").split(",") if k.strip())
        self.kinds = tuple(options["kinds"].split(",")) if "kinds" in options else KINDS
        self.ids = deltas(zlib.decompress(base64.b64decode(options["ids"]))) if "ids" in options else None

    def partitions(self) -> list[Range]:
        system, path = _system(self.path)
        info = system.get_file_info(path)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else []
        if not files and info.type != fs.FileType.Directory:
            raise FileNotFoundError(self.path)
        data = sorted((f.path, f.size) for f in files if f.is_file and not f.base_name.startswith(("_", ".")))
        return [Range(p, s, min(s + self.bytes, n), n) for p, n in data for s in range(0, n, self.bytes)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range):
        wanted = Wanted(self.kinds, self.ids, self.keys)
        if not partition.size:
            return
        system = _system(self.path)[0]
        rows: list[tuple] = []
        with system.open_input_file(partition.path) as file:
            for block in blocks(file, partition.start, partition.end, partition.size):
                for row in elements(block, wanted):
                    rows.append(row)
                    if len(rows) >= BATCH_ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


@dataclass
class Part(WriterCommitMessage):
    path: str


class ExtractWriter(DataSourceArrowWriter):
    """A file a task, its blocks of one kind each and sorted by id; files of tasks that did not end well are deleted."""

    def __init__(self, options):
        self.path, self.elements = options["path"], int(options.get("elements", BLOCK_ELEMENTS))

    def write(self, iterator) -> Part:
        system, folder = _system(self.path)
        system.create_dir(folder, recursive=True)
        path = f"{folder}/part-{uuid.uuid4().hex}.osm.pbf"
        held: dict[str, list[tuple]] = {k: [] for k in KINDS}
        with system.open_output_stream(path, compression=None) as out:
            out.write(FILE_HEADER)
            for batch in iterator:
                columns = [batch.column(f.name).to_pylist() for f in ARROW]
                for row in zip(*columns):
                    held[row[0]].append(row)
                    if len(held[row[0]]) >= self.elements:
                        out.write(framed("OSMData", block_of(sorted(held[row[0]], key=lambda r: r[1]))))
                        held[row[0]] = []
            for rows in held.values():
                if rows:
                    out.write(framed("OSMData", block_of(sorted(rows, key=lambda r: r[1]))))
        return Part(path)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        system = _system(self.path)[0]
        for m in messages:
            if m is not None:
                system.delete_file(m.path)


def pack_ids(ids) -> str:
    """Sorted ids as the option that hands them to the reader."""
    return base64.b64encode(zlib.compress(put_deltas(ids))).decode()


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    spark.dataSource.register(MapExtract)


def read_extract(spark: SparkSession, path: str, keys: tuple[str, ...] = (), range_bytes: int = RANGE_BYTES, ids: str | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The elements of an extract (a file or a folder of them): of some kinds, with any of the tags `keys`, of the `ids` (pack_ids()) if given."""
    register(spark)
    source = spark.read.format("map_extract").option("keys", ",".join(keys)).option("bytes", range_bytes).option("kinds", ",".join(kinds))
    return (source if ids is None else source.option("ids", ids)).load(path)


def write_extract(rows: DataFrame, path: str, elements: int = BLOCK_ELEMENTS) -> None:
    """Elements (of SCHEMA) as an extract: a new folder of files. Tags and roles that are null become empty; nodes need a place."""
    register(rows.sparkSession)
    rows.select(*[x.split(" ")[0] for x in ("type", "id", "tags", "lat", "lon", "nodes", "members")]).write.format("map_extract").option("elements", elements).mode("append").save(path)


def scan_wanted(spark: SparkSession, path: str, wanted: DataFrame, most: int = MOST_IDS, **options) -> DataFrame:
    """The elements of an extract whose (type, id) are wanted.

    Up to `most` distinct ids are handed to the reader, which then makes no other element; more are joined. A kind that
    nobody wants is not read in either case.
    """
    pairs = wanted.select("type", "id").where("type is not null and id is not null").distinct()
    ids = sorted(r[0] for r in pairs.select("id").distinct().limit(most + 1).collect())
    kinds = [r[0] for r in pairs.where(F.col("type").isin(*KINDS)).select("type").distinct().collect()]  # three at most
    df = read_extract(spark, path, ids=pack_ids(ids) if len(ids) <= most else None, kinds=tuple(kinds), **options)
    return df.join(pairs, ["type", "id"], "left_semi")
