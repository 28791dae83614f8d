"""SentencePiece encoding that keeps source offsets, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map holds; each normalised byte keeps
the source byte it comes from. Pieces tile the normalised bytes, so the alignment projects every piece to a span of
bytes of the source. Merges never cross from another character to a space sign (checked against the model's pieces), so
a normalised text is cut there, and words that repeat are looked up.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "piece_bpe_32k.model"
#: What stands for a space in pieces.
SPACE = "▁"
#: Entries of a worker's cache of encoded words, emptied when full; characters of the longest word kept; bytes of text whose results are sent on together.
CACHE_WORDS, CACHED_CHARACTERS, SEND_BYTES = 300_000, 64, 4 << 20
_WORDS = re.compile(" +[^ ]*|[^ ]+")

ENCODED = "doc_id long, ids binary, starts array<int>, ends array<int>, decoded string"


class CharacterMap:
    """A compiled character map: the size of a double array as 32 bits, the array's 32-bit units, then strings ended by zeros.

    The array is a trie over UTF-8 bytes; a leaf's value is the place of a string, which replaces the bytes that lead
    there.
    """

    def __init__(self, compiled: bytes):
        size = struct.unpack("<I", compiled[:4])[0] if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.strings = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest entry that data starts with at `at`."""
        units, found = self.units, None
        if not units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
        node = step(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= step(unit)
            if unit & 0x100:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        return found and (found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])])


class Normalizer:
    """A model's normalisation; a space stands for itself in the result, and counts as one byte."""

    def __init__(self, spec):
        if not spec.escape_whitespaces:
            raise ValueError("models that do not escape spaces are not covered")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the byte of the source it comes from."""
        if self.map.units or self.squeeze:
            return self._by_prefixes(text.encode())
        sign = SPACE in text
        out = text.replace(SPACE, " ") if sign else text
        if not out:
            return "", np.zeros(1, np.int64)
        align = np.arange(len(text.encode()) + 1)
        if sign:  # three bytes of the source are one of the result
            source = np.frombuffer(text.encode(), np.uint8)
            at = np.flatnonzero((source[:-2] == 0xE2) & (source[1:-1] == 0x96) & (source[2:] == 0x81))
            align = np.delete(align, np.concatenate([at + 1, at + 2]))
        return (" " + out, np.concatenate([[0], align])) if self.prefix else (out, align)

    def _by_prefixes(self, data: bytes) -> tuple[str, np.ndarray]:
        parts: list[tuple[bytes, int, int]] = []
        at, after_space = 0, self.squeeze
        while at < len(data):
            taken, out = self.map.longest(data, at) or (0, b"")
            if not taken:
                taken = 1
                while at + taken < len(data) and data[at + taken] & 0xC0 == 0x80:
                    taken += 1
                out = data[at : at + taken]
            if after_space:
                out = out.lstrip(b" ")
            if out:
                parts.append((out.replace(SPACE.encode(), b" "), at, at + taken))
                after_space = self.squeeze and out.endswith(b" ")
            at += taken
        end = len(data)
        while self.squeeze and parts and not parts[-1][0].rstrip(b" "):
            end = parts.pop()[1]
        if self.squeeze and parts and parts[-1][0].endswith(b" "):
            out, a, end = parts.pop()
            parts.append((out.rstrip(b" "), a, end))
        if not parts:
            return "", np.zeros(1, np.int64)
        starts = np.repeat([a for _, a, _ in parts], [len(out) for out, _, _ in parts])
        text = b"".join(out for out, _, _ in parts).decode()
        first = [parts[0][1]] if self.prefix else []
        return (" " + text if self.prefix else text), np.concatenate([first, starts, [end]]).astype(np.int64)


class PieceEncoder:
    """Ids as the sentencepiece library gives them, and their spans of source bytes."""

    def __init__(self, model: str = MODEL):
        import public_tokenizers
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(public_tokenizers.path(model), "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        kinds = type(proto.pieces[0])
        if not proto.trainer_spec.byte_fallback or any(p.type == kinds.USER_DEFINED or SPACE in p.piece.lstrip(SPACE) for p in proto.pieces):
            raise ValueError("only models with byte pieces, without user-defined pieces and with spaces at the front of pieces are covered")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.normalize = Normalizer(proto.normalizer_spec)
        #: Bytes of every piece, a space for its sign; a byte piece is its byte, control pieces are empty.
        self.bytes = [bytes([int(p.piece[3:-1], 16)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else b"" for p in proto.pieces]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.begin, self.end = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        spec = proto.normalizer_spec
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.words = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.known: dict[str, bytes] = {}

    def normalized(self, text: str) -> np.ndarray:
        """Ids of a normalised text."""
        words, get = _WORDS.findall(text), self.known.get
        ids = list(map(get, words))
        if None in ids:
            new = list({w for w, i in zip(words, ids) if i is None})
            fresh = {w: np.array(i, "<u4").tobytes() for w, i in zip(new, self.words.encode(new, num_threads=1))}
            ids = [fresh[w] if i is None else i for i, w in zip(ids, words)]
            if len(self.known) + len(fresh) > CACHE_WORDS:
                self.known.clear()
            self.known.update((w, i) for w, i in fresh.items() if len(w) <= CACHED_CHARACTERS)
        return np.frombuffer(b"".join(ids), "<u4")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends) without begin and end ids; a byte piece spans its own byte of the normalised text."""
        normal, align = self.normalize(text)
        ids = self.normalized(normal)
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        if ends[-1] + 1 != len(align):
            raise ValueError("pieces do not tile the normalised text")
        return ids, align[ends[:-1]], align[ends[1:]]


_encoders: dict[str, PieceEncoder] = {}


def encoder(model: str = MODEL) -> PieceEncoder:
    """One per Python worker."""
    if model not in _encoders:
        _encoders[model] = PieceEncoder(model)
    return _encoders[model]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), starts, ends (bytes of the text's UTF-8), decoded: every document, with begin and end ids.

    The begin id spans nothing at 0, the end id nothing at the text's end; the sign a model puts before a text spans
    nothing either. A null or empty text is the begin and end ids alone and decodes to the empty text. A null doc_id
    stays null; repeated rows are rows of their own; an empty table gives none. Only doc_id and text are read, so other
    columns cannot clash.
    """
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
    names = ["doc_id", "ids", "starts", "ends", "decoded"]

    def run(batches):
        code = encoder(model)
        mark = lambda a, i: np.concatenate([[a], i]).astype("<u4")
        for batch in batches:
            rows, size = [], 0
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                ids, starts, ends = code.encode(text)
                last = len(text.encode())
                ids = np.append(mark(code.begin, ids), np.uint32(code.end)).astype("<u4")
                starts, ends = (np.concatenate([[0], x, [last]]).astype(np.int32) for x in (starts, ends))
                rows.append((doc_id, ids.tobytes(), starts, ends, code.library.decode(ids.tolist())))
                size += last
                if size > SEND_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids, digests of ids and decoded text, source bytes and a hash of the spans; edge cases as in encode()."""
    done = encode(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return done.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), digest(F.encode("decoded", "UTF-8")).alias("decoded_sha256"),
        F.element_at("ends", -1).cast("long").alias("n_bytes"), F.xxhash64("starts", "ends").alias("spans_hash"),
    )
