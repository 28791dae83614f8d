"""Alignment of two tokenizers' tokens over the bytes of the same text, and corpus-wide counts of linked token ids.

The spans of a text's B tokens are a static interval index; the span of each A token stabs it by bisection and gets the
B tokens it overlaps. Offsets at which tokens of both end, the gaps that no token spans, bound the groups.

Neither tokenizer joins text across a single space between words, so a word with the space before it is aligned once and
kept; a text with other white space is one such unit as a whole. Documents are taken in blocks of bounded bytes. A
block's links are counted by unit and id pair before anything is shuffled, pairs are summed over all blocks by key, and
the sums return to the blocks that asked for them, not to every link.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, sentencepieces
from .common import materialize, table

#: Characters of text of a block; a longer text is a block of its own. Documents of a block.
BLOCK_SIZE, BLOCK_DOCS = 4 << 20, 20_000
#: Units, and characters of them, that a worker keeps from one block to the next.
CACHE_UNITS, CACHE_CHARACTERS = 400_000, 16 << 20
#: New units that are aligned together, and those of them that are encoded as one string.
TOGETHER, STRING = 20_000, 100
#: A pair of ids (a, b) is the number a * PAIR + b.
PAIR = 1 << 32

ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, sizes binary, places binary, pairs array<long>, counts array<long>"
SCORES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def stab(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A span the range [first, last) of B spans that overlap it; B's spans are sorted, disjoint and not empty."""
    return np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")


def align(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that tile the same bytes -> each A token's range [first, last) of B tokens, and the group of each A and B token."""
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    if ends_a[-1] != ends_b[-1]:
        raise ValueError("tokens do not tile the same bytes")
    first, last = stab(ends_a - lengths_a, ends_a, ends_b - lengths_b, ends_b)
    gaps = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return first, last, np.searchsorted(gaps, ends_a), np.searchsorted(gaps, ends_b)


class Tokenizers:
    """The two tokenizers of a Python worker and the units it has aligned.

    A unit is a number: its place in `texts`, which are its groups, and in numbers().
    """

    def __init__(self, a: str, b: str):
        self.a, self.b = packing.encoder(a), sentencepieces.encoder(b)
        self.lengths_a = np.array([len(self.a.bpe.decode_single_token_bytes(i)) for i in range(self.a.bpe.n_vocab)], np.int64)
        self.lengths_b = self.b.lengths
        #: An id as text before another of its list, before the other list, and at its group's end.
        self.words = [f"{i}{sign}" for sign in ",|;" for i in range(max(len(self.lengths_a), len(self.lengths_b)))]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self._pairs: list[np.ndarray] = []
        self._numbers: list[np.ndarray] = []
        self.size = 0

    def numbers(self) -> np.ndarray:
        """For each unit its tokens of A and of B, groups and links."""
        self._numbers = [np.concatenate([np.zeros((0, 4), np.int64), *self._numbers])]
        return self._numbers[0]

    def pairs(self) -> np.ndarray:
        """The links of all units, one unit after the other."""
        self._pairs = [np.concatenate([np.zeros(0, np.int64), *self._pairs])]
        return self._pairs[0]

    def align_units(self, units: list[str], strings: list[str]) -> None:
        """Aligns units, each a text with the space before it, and keeps them; `strings` are the same text, cut as it is to be encoded."""
        ids_a, ids_b = map(self.a.bpe.encode_ordinary, strings), self.b.words.encode(strings, num_threads=1)
        a, b = (np.concatenate([np.array(i, np.int64) for i in x]) for x in (ids_a, ids_b))
        lengths_a, lengths_b = self.lengths_a[a], self.lengths_b[b]
        first, last, group_a, group_b = align(lengths_a, lengths_b)
        n = last - first
        ends = np.concatenate([[0], np.cumsum(n)])
        self._pairs.append(np.repeat(a, n) * PAIR + b[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])])
        borders = np.cumsum([0, *[len(u.encode()) for u in units]])
        cuts_a, cuts_b = (np.searchsorted(np.concatenate([[0], np.cumsum(x)]), borders) for x in (lengths_a, lengths_b))
        groups = np.append(group_a, group_a[-1] + 1)[cuts_a]
        self._numbers.append(np.diff(np.stack([cuts_a, cuts_b, groups, ends[cuts_a]], axis=1), axis=0))
        words, cuts = self.group_words(a, b, group_a, group_b), (cuts_a + cuts_b).tolist()
        self.known.update(zip(units, range(len(self.texts), len(self.texts) + len(units))))
        self.texts += ["".join(words[i:j]) for i, j in zip(cuts, cuts[1:])]
        self.size += int(borders[-1])

    def group_words(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
        """The ids of each group in order, A's before B's, each with the sign that comes after it."""
        n, groups = len(self.words) // 3, np.arange(group_a[-1] + 1)
        words = np.empty(len(a) + len(b), np.int64)
        sign = lambda g, last: np.append(g[1:] != g[:-1], True) * (last * n)
        words[np.arange(len(a)) + np.searchsorted(group_b, groups)[group_a]] = a + sign(group_a, 1)
        words[np.arange(len(b)) + np.searchsorted(group_a, groups, "right")[group_b]] = b + sign(group_b, 2)
        return list(map(self.words.__getitem__, words.tolist()))

    def units(self, texts: list[str]) -> list[list[int]]:
        """The units of space + text, for each text; none where A's or B's tokens do not give back its bytes.

        A's tokens always give back their text; B's give back the normalised text, with spaces for its signs.
        """
        words, new, odd = [], {}, {}
        for text in texts:
            if not text or self.b.normalize(text)[0] != " " + text:
                words.append([])
            elif " ".join(text.split()) == text.replace("\n", " "):
                mine = [" " + w for w in text.split(" ")]
                new.update((w, None) for w in mine if w not in self.known)
                words.append(mine)
            else:
                odd[" " + text] = None
                words.append([" " + text])
        fresh = list(new)
        for k in range(0, len(fresh), TOGETHER):
            part = fresh[k : k + TOGETHER]
            self.align_units(part, ["".join(part[i : i + STRING]) for i in range(0, len(part), STRING)])
        for text in odd:
            if text not in self.known:
                self.align_units([text], [text])
        return [list(map(self.known.__getitem__, w)) for w in words]


_tokenizers: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a: str, b: str) -> Tokenizers:
    """One pair per Python worker."""
    if (a, b) not in _tokenizers:
        _tokenizers[a, b] = Tokenizers(a, b)
    return _tokenizers[a, b]


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as compressed little-endian unsigned 32-bit ones."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").tobytes())


def _expanded(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data) if data else b"", "<u4")


def align_block(ids: list, texts: list[str], code: Tokenizers) -> tuple[list[tuple], tuple]:
    """Per document (doc_id, n_a, n_b, n_groups, n_links, digest, units), and the block's (sizes, places, pairs, counts).

    A document's units are sorted places among the block's units; `sizes` are these units' numbers of links and `places`
    the links' places among the block's pairs, which `counts` has how many links of.
    """
    found = code.units(texts)
    lengths = np.array([len(f) for f in found], np.int64)
    used, where, often = np.unique(np.fromiter(chain.from_iterable(found), np.int64, int(lengths.sum())), return_inverse=True, return_counts=True)
    every = code.numbers()
    numbers = every[used]
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    running = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(numbers[where], axis=0)])
    totals = (running[cuts[1:]] - running[cuts[:-1]]).tolist()
    sorted_ = np.sort((np.repeat(np.arange(len(texts)), lengths) << 32) + where) & 0xFFFFFFFF
    digest = lambda f: hashlib.sha256("".join(map(code.texts.__getitem__, f))[:-1].encode()).hexdigest() if f else ""
    rows = [(i, *totals[k], digest(f), _squeezed(sorted_[cuts[k] : cuts[k + 1]])) for k, (i, f) in enumerate(zip(ids, found))]
    sizes = numbers[:, 3]
    starts = np.concatenate([[0], np.cumsum(every[:, 3])])[used]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    links = code.pairs()[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
    pairs, places = np.unique(links, return_inverse=True)
    counts = np.bincount(places, np.repeat(often, sizes), len(pairs)).astype(np.int64)
    return rows, (_squeezed(sizes), _squeezed(places), pairs, counts)


def aligned(docs: DataFrame, a: str, b: str, block_size: int = BLOCK_SIZE) -> DataFrame:
    """A row per document (pairs null) and one per block (doc_id null; its pairs and what its units are)."""
    names = [x.split()[0] for x in ALIGNED.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] + [pa.binary()] * 3 + [pa.list_(pa.int64())] * 2

    def run(batches):
        from pyspark import TaskContext

        code, block = tokenizers(a, b), TaskContext.get().partitionId() << 33

        def send(ids, texts):
            done, whole = align_block(ids, texts, code)
            rows = [(block, *r, None, None, None, None) for r in done] + [(block, *[None] * 7, *whole)]
            if len(code.texts) > CACHE_UNITS or code.size > CACHE_CHARACTERS:
                code.forget()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        held: tuple[list, list] = ([], [])
        size = 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                if held[0] and (size + len(text) > block_size or len(held[0]) >= BLOCK_DOCS):
                    yield send(*held)
                    held, size, block = ([], []), 0, block + 1
                held[0].append(doc_id)
                held[1].append(text)
                size += len(text)
        if held[0]:
            yield send(*held)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ALIGNED)


def _score(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """A block's documents with the corpus-wide counts of the block's pairs."""
    names = [x.split()[0] for x in SCORES.split(", ")]
    own = rows["sizes"].notna()
    if not own.any():
        return pd.DataFrame(columns=names)
    sizes, places = (_expanded(rows.loc[own, c].iloc[0]).astype(np.int64) for c in ("sizes", "places"))
    unit = np.repeat(np.arange(len(sizes)), sizes)
    at = known["place"].to_numpy()
    sums = []
    for c in ("best", "count"):
        of = np.zeros(len(at), np.int64)
        of[at] = known[c].to_numpy()
        total = np.zeros(len(sizes), np.int64)
        np.add.at(total, unit, of[places])
        sums.append(total)
    docs = rows[~own]
    mine = [_expanded(u) for u in docs["units"]]
    return docs.assign(n_best=[int(sums[0][u].sum()) for u in mine], count_sum=[int(sums[1][u].sum()) for u in mine])[names]


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(block, place, pair, n) -> (pair, count, best): how many links hold the pair in all, and 1 if no pair of its B id has more.

    There are at most as many B ids as B has tokens, so their highest counts are broadcast.
    """
    counts = materialize(blocks.groupBy("pair").agg(F.sum("n").alias("count")), "pair_counts")
    b_id = F.col("pair") % PAIR
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), b_id == F.col("b_id")).select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))


def cross_tokenizer(docs: DataFrame, a: str = packing.TOKENIZER, b: str = sentencepieces.MODEL, block_size: int = BLOCK_SIZE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    A text that is null or empty, or that a tokenizer does not give back byte by byte, has zeros and the digest ''. A
    null doc_id stays null; repeated rows are rows of their own and count as often; an empty table gives none. Ties for
    a B id's highest count are all best. Only doc_id and text are read, so other columns cannot clash.
    """
    rows = materialize(aligned(docs, a, b, block_size), "aligned")
    blocks = rows.where(F.col("pairs").isNotNull()).select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p"))
    blocks = blocks.select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    known = blocks.select("block", "place", "pair").join(pair_counts(blocks), "pair").select(F.col("block").alias("home"), "place", "count", "best")
    mine = rows.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "units", "sizes", "places")
    return mine.groupBy("block").cogroup(known.groupBy("home")).applyInPandas(_score, SCORES)


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, groups, links and the corpus-wide counts of its links; edge cases as in cross_tokenizer()."""
    return cross_tokenizer(table(spark, sf_dir, "documents"))
