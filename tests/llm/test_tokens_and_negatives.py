"""Hard negatives, SentencePiece encoding and cross-tokenizer alignment against plain recomputations."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from polyglyph.llm import alignment, hard_negatives, queries, sentencepieces

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  a  b ", "▁a ▁▁b", "<s> x </s> <unk> <0x41>", "\t\n\r a", "日本語 é 🎉👨‍👩‍👧 \x00 z", "x" * 5000, " " * 100, "a" + " " * 50 + "b", "  a　b", "▁", "<|endoftext|> z", "a\n\nb c", "same", "same"]
DOCS = "doc_id long, text string, lang string, ids string, block string, pair string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i % 5 else None, t, None, "x", "y", "z") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def texts():
    return [t for (t,) in duckdb.connect().execute(f"select text from '{SF}/documents.parquet'").fetchall()]


def encoded(library, text):
    return [library.bos_id(), *library.encode(text or ""), library.eos_id()]


def test_pieces_equal_the_library(spark, odd, library):
    rows = sentencepieces.encode(odd).collect()
    want = sorted((i if i % 5 else -1, encoded(library, t), library.decode(encoded(library, t))) for i, t in enumerate(ODD))
    assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in rows) == want
    for r in rows:
        assert len(r.starts) == len(r.ends) == len(r.ids) // 4 and r.starts[0] == r.ends[0] == 0
        assert r.starts[2:] == r.ends[1:-1]  # pieces follow each other over the whole source
    assert sentencepieces.encode(odd.limit(0)).count() == 0


def test_spans_equal_the_library(library, texts):
    """Spans of pieces that are not bytes; the library gives all bytes of a character to the last of its byte pieces."""
    code, checked = sentencepieces.encoder(), 0
    for text in [t for t in ODD if t] + texts[:40]:
        ids, starts, ends = code.encode(text)
        proto = library.encode(text, return_type="proto").pieces
        for i, a, b, p in zip(ids.tolist(), starts.tolist(), ends.tolist(), proto):
            if not library.is_byte(i):
                assert (i, a, b) == (p.id, p.begin, p.end)
                checked += 1
    assert checked > 10000


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normalisation_equals_the_library(rule, texts):
    """Texts and alignments through compiled character maps; the library counts characters."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    ours = sentencepieces.Normalizer(pb.ModelProto.FromString(theirs.serialized_model_proto()).normalizer_spec)
    for text in ["  ﬁ ①  Ａｂ  x  ", "㌀㌢ ｶﾞ ", "ﷺ   x​ y", "é 가", "x ", *[t for t in ODD if t], *texts[:40]]:
        want, offsets = theirs.normalize(text, with_offsets=True)
        got, align = ours(text)
        assert got.replace(" ", "▁") == want
        place = {len(text[:i].encode()): i for i in range(len(text) + 1)}
        ends = np.cumsum([0, *[len(c.encode()) for c in got]])
        assert [place[int(align[e])] for e in ends] == offsets


def test_op12(spark, library, texts):
    got = queries.QUERIES["op12_sentencepiece"](spark, SF).collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    docs = duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = {(i, len(e), digest(np.array(e, "<u4").tobytes()), digest(library.decode(e).encode()), len(t.encode())) for i, t in docs for e in [encoded(library, t)]}
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(docs)


def plain_alignment(texts, library):
    """By loops over bytes, with the JSON tokenizer."""
    import public_tokenizers
    from tokenizers import Tokenizer, decoders

    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    letters = {c: b for b, c in byte_letters().items()}
    assert isinstance(a_tok.decoder, decoders.ByteLevel)
    parts, counts = [], Counter()
    for text in texts:
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = library.encode(text or "")
        bytes_a = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:-1], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, library.id_to_piece(i)) for i in b)]
        data = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            parts.append(None)
            continue
        owner = lambda pieces: [n for n, p in enumerate(pieces) for _ in p]
        links = sorted(set(zip(owner(bytes_a), owner(bytes_b))))
        ends = lambda pieces: set(np.cumsum([len(p) for p in pieces]).tolist())
        both, groups, at = sorted(ends(bytes_a) & ends(bytes_b)), [], 0
        for end in both:
            side = lambda ids, pieces: ",".join(str(i) for i, e in zip(ids, np.cumsum([len(p) for p in pieces])) if at < e <= end)  # noqa: B023, E731
            groups.append(side(a, bytes_a) + "|" + side(b, bytes_b))
            at = end
        pairs = [(a[i], b[j]) for i, j in links]
        counts.update(pairs)
        parts.append((len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if p is None else (*p[:3], len(p[3]), sum(counts[x] == most[x[1]] for x in p[3]), sum(counts[x] for x in p[3]), p[4]) for p in parts]


def byte_letters():
    """The letters that stand for bytes in the entries: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


def test_alignment_by_loops(spark, odd, library, texts):
    short = [t for t in texts if t and len(t) < 1500][:60]
    rows = ODD[:8] + ODD[9:] + short
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    want = [(i, *r) for i, r in enumerate(plain_alignment(rows, library))]
    for block_size in (alignment.BLOCK_SIZE, 2000):  # links of few and of many blocks
        assert sorted(map(tuple, alignment.cross_tokenizer(docs, block_size=block_size).collect())) == want
    got = alignment.cross_tokenizer(odd)
    assert got.count() == len(ODD) and got.where("doc_id is null").count() == 4
    assert got.where("n_a = 0 and n_links = 0 and groups_sha256 = ''").count() == 4  # null, empty, and two with space signs
    assert alignment.cross_tokenizer(odd.limit(0)).count() == 0


def test_op13_counts_agree_with_its_links(spark):
    rows = queries.QUERIES["op13_cross_tokenizer"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.n_groups <= min(r.n_a, r.n_b) and r.n_links >= max(r.n_a, r.n_b) and r.n_best <= r.n_links <= r.count_sum for r in rows)


def plain_negatives(rows, anchors, k=5, m=3):
    """rows: (vec_id, label, integers)."""
    out = []
    for q, (qi, ql, qv) in enumerate(rows):
        if not anchors(qi):
            continue
        score = [(sum(x * y for x, y in zip(qv, v)), i, n, label) for n, (i, label, v) in enumerate(rows) if n != q and len(v) == len(qv)]
        score.sort(key=lambda s: (-s[0], s[1], s[2]))
        for p in [s for s in score if s[3] == ql][:k]:
            negatives = [s for s in score if s[3] != ql and 50 * p[0] <= 100 * s[0] <= 95 * p[0]][:m]
            out += [(qi, p[1], n + 1, s[1], p[0], s[0]) for n, s in enumerate(negatives)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["random", "clustered", "large", "hot"])
def test_hard_negatives_by_loops(spark, monkeypatch, shape):
    rng = np.random.default_rng(3)
    n, d = 240, 8
    x = rng.normal(size=(n, d))
    label = rng.integers(0, 3, n)
    if shape == "clustered":
        x = rng.normal(size=(6, d))[rng.integers(0, 6, n)] * 4 + rng.normal(size=(n, d)) / 8
    if shape == "large":
        x[::3] *= 1e6  # sums beyond what doubles hold exactly
        x[:, 0] = np.abs(x[:, 0]) * 3
    if shape == "hot":
        label = np.where(rng.random(n) < 0.6, 0, label)
        x[rng.random(n) < 0.3] = x[0]  # many equal rows
    rows = [(i // 2 * 2 if shape == "hot" else i, int(label[i]), x[i].tolist()) for i in range(n)]
    monkeypatch.setattr(hard_negatives, "BLOCK_SIZE", 16)
    monkeypatch.setattr(hard_negatives, "CHUNK_SIZE", 4)
    monkeypatch.setattr(hard_negatives, "CELL_BLOCKS", 3)
    monkeypatch.setattr(hard_negatives, "CELL_CHUNKS", 2)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3).sortWithinPartitions("vec_id")
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    ints = [(i, g, [int(np.floor(v * 256)) for v in e]) for i, g, e in rows]
    want = plain_negatives(ints, lambda i: i % 10 == 0)
    if shape == "hot":  # rows of one id may change places
        assert sorted((r[0], r[1], r[2], r[4], r[5]) for r in got.collect()) == sorted((w[0], w[1], w[2], w[4], w[5]) for w in want)
    else:
        assert sorted(map(tuple, got.collect())) == want and want


def test_hard_negative_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5], "x"), (50, 1, [1.0, 0.5], "x"), (None, 1, [1.0, 1.0], "x"), (1, None, [1.0, 1.0], "x"), (2, 1, None, "x"), (3, 2, [nan, 1.0], "x"), (4, 2, [inf, 1.0], "x"), (5, 2, [None, 1.0], "x"),
            (6, 2, [0.75, 0.25], "x"), (6, 2, [0.75, 0.25], "x"), (7, 2, [1.0], "x"), (8, 2, [], "x"), (9, 3, [0.5, 0.25], "x")]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, rank string")
    got = sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()))
    dot = lambda a, b: sum(int(256 * x) * int(256 * y) for x, y in zip(a, b))
    p, six, nine = (dot([1, 0.5], v) for v in ([1, 0.5], [0.75, 0.25], [0.5, 0.25]))
    one = [(1, 6, six), (2, 6, six), (3, 9, nine)]
    assert got == [(a, b, r, i, p, s) for a, b in ((0, 50), (50, 0)) for r, i, s in one]
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_planes_drop_candidates():
    """On clustered vectors few pairs reach the last plane."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (8, 32))
    x = centres[np.repeat(np.arange(8), 64)] + rng.integers(-9, 9, (512, 32))
    row = type("Row", (), {"rows": np.arange(512).tobytes(), "ids": np.arange(512).tobytes(), "dim": 32, "terms": x.astype("<i2").tobytes()})
    block, seen = hard_negatives.Block(row), []
    q = x[:8]
    exact = q @ x.T
    kth = np.sort(exact, axis=1)[:, -5]

    def wanted(who, low, high):
        seen.append(high.shape)
        return high >= (kth[who][:, None] if high.ndim == 2 else kth[who])

    a, b, score = hard_negatives.scan(q, block, wanted)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*(z.tolist() for z in np.nonzero(exact >= kth[:, None])))) and (score == exact[a, b]).all()
    assert seen[-1][0] < 200 < len(q) * 512
