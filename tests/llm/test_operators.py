"""Training-data operators against brute force, round trips and edge cases."""

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from polyglyph.llm import langid, media, mixing, packing, quality, queries, simhash, topk, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
EDGE = "doc_id long, text string, lang string, source string, size long, score double"
ROWS = [(1, None, None, None, 9, 0.5), (2, "", "en", "a", 9, 0.5), (3, "same words here", "en", "a", 9, 0.5), (3, "same words here", "en", "a", 9, 0.5), (None, "x " * 30000, "de", "b", None, None), (4, "one", None, None, 1, 1.0)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, EDGE)


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(c.execute(f"select {','.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall(), key=str)


def test_mix_edges(spark, edge):
    sized = edge.drop("size").withColumn("size", mixing.word_count("text"))
    rows = mixing.mix(sized).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 3 * r.size for r in rows)
    taken = {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    # one word or segment of each queue may be under way at the cut, and rows alike share evenly
    assert all(abs(taken[r.source] - r.target) <= mixing.SEGMENT + 1 for r in rows)
    assert mixing.mix(sized.limit(0)).count() == 0


def test_mix_ranges_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", mixing.word_count("text").alias("size"))
    docs = docs.union(docs.where("doc_id % 9 = 0")).union(docs.where("doc_id % 9 = 0").withColumn("size", F.col("size") + 7))
    want = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "SORTED_ROWS", 3)
    monkeypatch.setattr(mixing, "RANGES", 5)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == want
    assert sum(r[5] for r in want) <= sum(r[2] for r in want)


def test_encoder_equals_tokenizer(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    odd = ["", " ", "a  b", "a\n b", " x ", "it's 'll  é\t\n", "a \n\n b  c", "tab\t x", "é" * 5, "日本 語  x   y", "<|endoftext|> z", "\r\n a"]
    for t in [*odd, *texts.values()]:
        assert fast.encode(t) == np.array(slow.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(spark, edge):
    rows = packing.pack(packing.pieces(edge), group_items=2).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.MAX_TOKENS
    assert sorted((r.doc_id or 0, r.piece) for r in rows)[:1] == [(0, 0)]
    assert packing.pack(packing.pieces(edge.limit(0))).count() == 0


def test_simhash(spark, edge, texts):
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = queries.QUERIES["op3_simhash_near_dedup"](spark, SF).collect()
    assert all(int(r.fingerprint, 16) == prints[r.doc_id] and r.component_id == find(r.doc_id) for r in got) and len(got) == len(ids)
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == len(ROWS) and {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}
    assert simhash.near_duplicates(edge.limit(0)).count() == 0


def test_shard_links_lose_nothing():
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 20)]
    keys = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (30, 2))})
    want = {frozenset((a, b)) for a in keys for b in keys if a < b and (a ^ b).bit_count() <= 2}
    group = {k: {k} for k in keys}
    for a, b in ((keys[i], keys[j]) for i, j in simhash.shard_links(keys, 2)):
        assert frozenset((a, b)) in want
        if group[a] is not group[b]:
            group[a] |= group[b]
            for k in group[a]:
                group[k] = group[a]
    assert all(group[min(p)] is group[max(p)] for p in want)


def test_url_filter(spark):
    urls = ["http://a.example.com/en/1?x", "https://www.example.com/en/", "HTTP://X.NET/es/2#t", "ftp://a.org", "no scheme", None, "http://com", "http://b.net/en/"] * 3
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, score string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls) and all(r.verdict in ("allow", "block") for r in got.values())
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(8)] == [
        ("a.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("x.net", "/es/2", "net/es/"), ("a.org", "", None), ("", "", None), ("", "", None), ("com", "", None), ("b.net", "/en/", None)]
    assert (got[0].verdict, got[1].verdict, got[2].verdict) == ("block", "allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0


def _best(vectors, k=5):
    """Every query row's best other rows, by Python's integers."""
    import math

    rows = [(i, v[0], [math.floor(x * 256) for x in v[1]]) for i, v in enumerate(vectors) if v[0] is not None and v[1] and all(x is not None and math.isfinite(x) for x in v[1])]
    out = []
    for i, q, e in rows:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(e, f)), c) for j, c, f in rows if i != j and len(e) == len(f))[:k]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(scored, 1)]
    return sorted(out)


def test_topk_edges(spark):
    v = [(0, [0.1, 0.2], 1), (50, [0.1, 0.2], 2), (1, None, 3), (2, [float("nan"), 0.0], 4), (3, [None, 1.0], 5), (4, [1.0, -1.0], 6), (4, [0.5, 1.0], 7), (4, [0.5, 1.0], 8), (50, [1.0, 0.0], 9), (None, [1.0, 1.0], 0), (5, [0.5], 0), (6, [], 0)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, score int")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect())) == _best(v)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_beyond_longs(spark):
    v = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 2.0]), (4, [1e10, 1e10])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in sorted(topk.top_k(df, F.col("vec_id") == 0).collect(), key=lambda r: r.rank)]
    assert got == [(1, 2**63 - 1), (4, 2**63 - 1), (3, 256 * 512), (2, -(2**63))]


def test_topk_prunes_what_cannot_win(spark):
    draw = np.random.default_rng(5)
    # tight blocks along other directions: only the one around the queries' direction can win
    v = [(i, (np.eye(16)[i // 64] + draw.normal(0, 0.01, 16)).tolist()) for i in range(1024)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    query = F.col("vec_id") < 20
    chunks, blocks, wanted = topk.prune(topk.quantized(df), query, block_size=16)
    assert wanted.count() < 0.5 * blocks.count() * chunks.select("r").distinct().count()
    got = sorted(map(tuple, topk.top_k(df, query, block_size=16).collect()))
    e = np.floor(np.array([x for _, x in v]) * 256).astype(int)
    want = [(q, n, c, -s) for q in range(20) for n, (s, c) in enumerate(sorted((-int(e[q] @ e[c]), c) for c in range(1024) if c != q)[:5], 1)]
    assert got == want


@pytest.mark.parametrize("hot", [media.HOT, 2])
def test_media_round_trip(spark, edge, hot, monkeypatch):
    monkeypatch.setattr(media, "HOT", hot)
    passage = "".join(chr(33 + (i * i * 7 + i // 3) % 90) for i in range(40_000))
    more = spark.createDataFrame([(10 + i, "%d " % i * 300 + passage) for i in range(7)], "doc_id long, text string")
    docs = edge.unionByName(more, allowMissingColumns=True).withColumn("digest", F.lit("clash")).withColumn("inline", F.lit(1))
    written, store = media.write_media(docs)
    assert (store.where("copies > 1").count() > 0) == (hot == 2) and written.where("refs > 0").count() >= 7
    texts = [r.text for r in docs.select("text").collect()]
    want = []
    for t in texts:
        p = media.payload(t)
        m = media.to_wav(p)
        want.append((len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()))
    got = media.read_media(written, store).collect()
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got) == sorted(want)
    assert len({r.payload_sha256 for r in got}) == len({(r.payload_sha256, r.feature) for r in got})
    # the passage is stored once: its chunks are shared by all documents that hold it
    size = store.select(F.sum(F.length("chunk"))).first()[0] + written.select(F.sum(F.aggregate("inline", F.lit(0), lambda a, c: a + F.coalesce(F.length(c), F.lit(0))))).first()[0]
    assert size < 0.6 * sum(w[4] for w in want)


def test_media_empty(spark, edge):
    assert media.read_media(*media.write_media(edge.limit(0))).count() == 0


def test_media_feature():
    p = bytes([0, 255, 128, 128])
    assert media._feature(p) == f"mean={511 * 1000 // 4};var={sum((v - 127) ** 2 for v in p) * 1000 // 4};zc=250;mode=128"


def test_cut_places_is_the_rolling_hash():
    data = np.random.default_rng(3).integers(0, 256, 100_000).astype(np.uint8).tobytes()
    h, start, want = 0, 0, []
    for i, b in enumerate(data, 1):
        h = ((h << 1) + int(media._GEAR[b])) & 0xFFFFFFFF
        if (i - start >= media.LEAST and h >> 21 == 0) or i - start == media.MOST or i == len(data):
            want.append(i)
            start = i
    assert media.cut_places(data) == want


@pytest.mark.parametrize("most,hot", [(warc.BROADCAST_PAYLOADS, warc.HOT), (0, 2)])
def test_warc(spark, tmp_path, most, hot, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", most)
    monkeypatch.setattr(warc, "HOT", hot)
    long = "".join(chr(97 + i * i % 26) for i in range(300_000))
    rows = [(5, "u", "same"), (2, "u\r\nX: y", "same"), (2, None, "same"), (None, "n", "same"), (7, "v", None), (8, "v", ""), (9, "w", "\x1f\x8b\x08" * 999), (11, "x", long), (12, "x", long)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, n int")
    files = warc.write_warc(pages, str(tmp_path))
    got = [r for r in warc.read_warc(files, str(tmp_path), range_bytes=50).collect()]
    key = lambda r: (r.page_id is None, r.page_id, r.record_type)
    assert [(r.page_id, r.record_type, r.refers_to) for r in sorted(got, key=key)] == [
        (2, "response", None), (2, "revisit", 2), (5, "revisit", 2), (7, "response", None), (8, "revisit", 7), (9, "response", None), (11, "response", None), (12, "revisit", 11), (None, "revisit", 2)]
    assert all(r.payload_digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode() for r in got if r.payload_bytes == 4)
    assert [bytes(r.payload).decode() for r in got if r.page_id == 11] == [long]


def test_warc_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(pages, str(tmp_path)), str(tmp_path)).count() == 0


@pytest.mark.parametrize("module,label,good", [(quality, "quality", 0.9), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, label, good):
    sf = "/root/testdata/sf0.1"
    query = quality.op10_quality if module is quality else toxicity.op8_toxicity
    got = {r.doc_id: r for r in query(spark, sf).collect()}
    y = [(i, v) for i, v in duckdb.connect().execute(f"select doc_id, {label} from '{sf}/labels.parquet'").fetchall() if got[i].held_out]
    assert sum(got[i].predicted == v for i, v in y) / len(y) > good and all(0 <= r.score <= 1 for r in got.values())


def test_classifiers_edges(spark, edge):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_quality(edge, quality.fit(edge, labels), to="s").count() == len(ROWS)
    assert toxicity.score_toxicity(edge, toxicity.fit(edge, labels), to="s").count() == len(ROWS)
    got = langid.identify(edge, langid.fit(edge)).collect()
    assert sorted((r.lang_pred == "und") for r in got) == [False] * 4 + [True] * 2 and all(0 <= r.score <= 1 for r in got)


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = dict(duckdb.connect().execute(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall())
    got = [r for r in langid.op7_language_id(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) / len(got) > 0.97
