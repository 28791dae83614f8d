"""Best-fit packing of tokenized documents by hierarchical residual packing.

Groups of bounded size pack their pieces best-fit, longest first; full pieces are sequences of their own. Nearly
full bins are done. The others are items of the next round, in fewer and other groups, until one group has held all
that can still be merged or a round merges nothing. No task ever holds more than one group.
"""

from __future__ import annotations

import base64
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

MAX_TOKENS = 2048
TOKENIZER = "byte_bpe_50k"
GROUP_ITEMS = 4096
#: A bin at least this full is emitted at once.
NEARLY_FULL = 0.99
#: Entries of a worker's cache of encoded words; it is emptied when full.
CACHE_WORDS = 300_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of byte_bpe_50k.json, without added special tokens, as little-endian unsigned 32-bit bytes.

    Its pre-tokenizer never joins text across one space or line feed between non-spaces, so such a text is the
    concatenation of its words' ids, each word with the white space before it; words are encoded once, by the same
    merges as ranks. A text with any other white space (a run, a tab, a no-break or wide space) is encoded whole,
    since tokens may reach into the run; one that spells a special token goes through the JSON tokenizer.
    tests/llm/test_packing.py holds the ids against those of the JSON tokenizer.
    """

    def __init__(self, name: str = TOKENIZER):
        import public_tokenizers
        import tiktoken

        self.json = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("polyglyph", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.slow = None

    def whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def exact(self, text: str) -> bytes:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if "<|endoftext|>" in text:
            return self.exact(text)
        if " ".join(text.split()) != text.replace("\n", " "):
            return self.whole(text)
        out, get = [], self.known.get
        for n, line in enumerate(text.split("\n")):
            head, *rest = line.split(" ")
            out.append(self.word("\n" + head) if n else self.whole(head))
            ids = list(map(get, rest))
            out += [self.word(w, " ") if i is None else i for i, w in zip(ids, rest)] if None in ids else ids
        return b"".join(out)

    def word(self, word: str, before: str = "") -> bytes:
        """Ids of a word after `before`, kept for the next time."""
        ids = self.known.get(word)
        if ids is None:
            ids = self.whole(before + word)
            if len(word) <= 64:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                self.known[word] = ids
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(name: str = TOKENIZER) -> Encoder:
    """One per Python worker."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def cut(n: int, most: int = MAX_TOKENS):
    """(start, length) of each piece of n tokens: all `most` long but the first, which may be shorter."""
    first = n % most or most
    return [(0, min(n, first)), *((s, most) for s in range(first, n, most))]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, max_tokens: int = MAX_TOKENS, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document.

    A null or empty text is the end token alone. A null doc_id stays null; repeated rows are cut each for itself; an
    empty table has no pieces. Only doc_id and text are read, so other columns cannot clash.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        code = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = code.encode(text.as_py() or "") + end
                rows += [(doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, max_tokens))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: each item's bin and offset, and each bin's fill. Bit r of `open_` is set if a bin has room r."""
    order = np.argsort(-np.asarray(lengths), kind="stable")
    bins, offsets, fill = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), []
    open_, by_room = 0, [[] for _ in range(capacity + 1)]
    for i in order.tolist():
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_ ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room > n:
            if not by_room[room - n]:
                open_ |= 1 << (room - n)
            by_room[room - n].append(b)
    return bins, offsets, np.array(fill, np.int64)


def _pack_groups(items: DataFrame, length: str, order: list[str], groups: int, round_: int, spread, max_tokens: int) -> DataFrame:
    """items with bin, offset and fill; bins are numbered by round, group and place."""
    dealt = items.withColumn("_group", F.pmod(spread, F.lit(groups)).cast("long"))
    names = [*items.columns, "bin", "offset", "fill"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, *order], kind="stable")
        b, o, fill = best_fit(pdf[length].to_numpy(), max_tokens)
        return pdf.assign(bin=(round_ << 54) + (int(pdf["_group"].iloc[0]) << 14) + b, offset=o, fill=fill[b])[names]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", bin long, offset long, fill long"
    return dealt.groupBy("_group").applyInPandas(run, schema)


def pack(items: DataFrame, max_tokens: int = MAX_TOKENS, group_items: int = GROUP_ITEMS, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """items (a `length` from 1 to max_tokens and any other columns) with sequence_id and offset.

    Items that share a sequence lie in it without gaps from offset 0. An empty table stays empty; rows alike are
    items of their own; the columns _row, _group, bin, fill, sequence_id and offset are the operator's.
    """
    assert group_items <= 1 << 13
    items = materialize(items.drop("sequence_id", "offset").withColumn("_row", F.monotonically_increasing_id()), "items")
    keep = [c for c in items.columns if c != "_row"]
    full = items.where(F.col("length") >= max_tokens).select(*keep, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = items.where(F.col("length") < max_tokens)
    groups = max(1, math.ceil(part.count() / group_items))
    packed = materialize(_pack_groups(part, "length", ["_row"], groups, 1, F.xxhash64("_row"), max_tokens), "packed")
    #: where each bin of the first round has gone
    moved = None
    left = packed.where((F.col("offset") == 0) & (F.col("fill") < int(nearly_full * max_tokens))).select(F.col("bin").alias("item"), F.col("fill").alias("length"))
    for round_ in range(2, 64):
        n, least = left.agg(F.count(F.lit(1)), F.min("length")).first()
        if n < 2:
            break
        left = left.where(F.col("length") + F.lit(least) <= max_tokens)  # fuller ones cannot merge with anything
        n = left.count()
        if n < 2:
            break
        groups = max(1, math.ceil(n / group_items))
        merged = materialize(_pack_groups(left, "length", ["item"], groups, round_, F.xxhash64("item", F.lit(round_)), max_tokens), f"round{round_}")
        step = merged.select("item", F.col("bin").alias("to"), F.col("offset").alias("by"))
        if moved is None:
            moved = step.select(F.col("item").alias("bin"), F.col("to"), F.col("by"))
        else:
            step = step.select(F.col("item").alias("to"), F.col("to").alias("to2"), F.col("by").alias("by2"))
            moved = moved.join(step, "to", "left").select("bin", F.coalesce("to2", "to").alias("to"), (F.col("by") + F.coalesce("by2", F.lit(0))).alias("by"))
        moved = materialize(moved, f"moved{round_}")
        bins = merged.where(F.col("offset") == 0).count()
        if groups == 1 or bins == n:
            break
        left = merged.where((F.col("offset") == 0) & (F.col("fill") < int(nearly_full * max_tokens))).select(F.col("bin").alias("item"), F.col("fill").alias("length"))
    if moved is None:
        done = packed.select(*keep, F.col("bin").alias("sequence_id"), "offset")
    else:
        done = packed.join(moved, "bin", "left").select(*keep, F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
    return full.unionByName(done)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places, as pieces() and pack() give them; nulls and repeated rows as there."""
    return pack(pieces(table(spark, sf_dir, "documents")))
