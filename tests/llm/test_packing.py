"""op2: ids against the JSON tokenizer, pieces and sequences against a plain recomputation."""

import random
import zlib

import numpy as np
import pytest

from polyglyph.llm import packing

SF = "/root/testdata/sf0.001"
SPACES = [" ", "  ", "\n", "\t", " ", "　", "\r\n", " ", "\x1c", "\x85", "​", "\x0b"]
WORDS = ["x", "it's", "'ll", "é", "日本", "don't", "1234", "a-b", "...", "ñandú", "\U0001f600", "́", "ﷺ", "१२", "<|endoftext|>"]


@pytest.fixture(scope="module")
def slow():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_on_runs_of_white_space(slow):
    draw, encode = random.Random(11), packing.encoder().encode
    cases = ["x     y", "a    ", "\n", " ", "", "a\n\n b", "　　x", "tab\t\tx \n"]
    cases += ["".join(draw.choice(SPACES) if draw.random() < 0.5 else draw.choice(WORDS) for _ in range(draw.randint(1, 9))) for _ in range(5000)]
    for text in cases:
        assert encode(text) == slow(text), repr(text)


def test_query_against_recomputation(spark, slow):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = packing.op2_best_fit_packing(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    lengths = []
    for doc_id, text in docs.items():
        ids, at = slow(text or "") + bytes(4), 0
        got = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        for r in got:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
            lengths.append(r.length)
        assert 4 * at == len(ids) and all(r.length == packing.MAX_TOKENS for r in got[1:]) and (len(got) == 1) == (at <= packing.MAX_TOKENS)
    for spans in by_sequence.values():
        at = 0
        for r in sorted(spans, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.MAX_TOKENS
    # one group packed best fit, longest first, is what the rounds are measured against
    _, _, fill = packing.best_fit(np.array(lengths), packing.MAX_TOKENS)
    assert len(by_sequence) <= len(fill) + 1


def test_rounds_come_near_one_group(spark):
    draw = np.random.default_rng(2)
    lengths = draw.integers(1, 2048, 3000).tolist()
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "k long, length long")
    rows = packing.pack(items, group_items=128).collect()
    assert sorted(r.k for r in rows) == list(range(3000))
    whole = len(packing.best_fit(np.array(lengths), packing.MAX_TOKENS)[2])
    assert len({r.sequence_id for r in rows}) <= 1.05 * whole
