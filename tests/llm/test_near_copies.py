"""The near-duplicate stage against the similarity of all pairs."""

import random

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
STAGE = dict(P.STAGES)["near_duplicates"]


def shingles(text):
    words = (text or "").lower().encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept_of(rows):
    sets = {r.doc_id: shingles(r.text) for r in rows}
    left, kept = sorted(sets), set()
    while left:
        kept.add(left[0])
        reached, left = [left[0]], left[1:]
        while reached:
            x = sets[reached.pop()]
            near = [j for j in left if similar(x, sets[j])]
            reached, left = reached + near, [j for j in left if j not in near]
    return kept


def test_stage_by_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in STAGE(spark, docs, SF).collect()} == kept_of(docs.collect())


def test_stage_follows_chains_and_keeps_the_rest(spark):
    words = [f"w{i}" for i in range(400)]
    # each replaces ten words in another place: neighbours in the list are similar, its ends are not
    texts = [" ".join(f"x{i}" if 40 * k <= i < 40 * k + 10 or i < 10 * k else w for i, w in enumerate(words)) for k in range(8)]
    docs = spark.createDataFrame([(10 + k, t) for k, t in enumerate(texts)] + [(1, "other words are here to stay"), (2, " ".join(words[200:]))], "doc_id long, text string")
    rows = docs.collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    assert similar(sets[10], sets[11]) and not similar(sets[10], sets[17])
    assert {r.doc_id for r in STAGE(spark, docs, SF).collect()} == kept_of(rows)


def test_stage_edges(spark):
    rows = [(1, None), (2, ""), (3, "Same words"), (4, "same  WORDS"), (None, "x " * 30000), (5, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in STAGE(spark, docs, SF).collect()) == [(False, 1), (False, 3), (False, 5), (True, 0)]
    assert STAGE(spark, docs.limit(0), SF).count() == 0


def test_stage_keeps_different_texts_that_share_an_id(spark):
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven"), (1, "one two three four five six"), (None, "apple pear plum fig"), (None, "apple pear plum fig"), (None, "seven eight nine ten eleven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, map(tuple, STAGE(spark, docs, SF).collect()))) == sorted(map(str, [rows[0], rows[1], rows[3]]))


def test_stage_does_not_depend_on_its_bounds(spark, monkeypatch):
    from polyglyph.llm import simhash

    draw = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for k in range(40):  # texts that share a passage, near copies among them
        words = passage + [f"t{k % 25}w{i}" for i in range(40)]
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(100)] = "changed"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = kept_of(docs.collect())
    assert 20 <= len(want) < 40
    monkeypatch.setattr(simhash, "MOST", 3)
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(simhash, "BROADCAST_NUMBERS", 0)
    assert {r.doc_id for r in STAGE(spark, docs, SF).collect()} == want


def test_fingerprint_links_do_not_depend_on_the_shards(spark, monkeypatch):
    from polyglyph.llm import simhash

    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(12)]
    keys = sorted({b ^ sum(1 << i for i in draw.sample(range(64), draw.randint(0, 2))) for b in base for _ in range(40)})
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    signed = lambda k: k - (1 << 64) if k >> 63 else k
    fps = spark.createDataFrame([(signed(k),) for k in keys], "fp long")
    for shard, most in ((512, 4096), (4, 10), (10**6, 5)):
        monkeypatch.setattr(simhash, "SHARD", shard)
        monkeypatch.setattr(simhash, "MOST", most)
        groups = {}
        for r in simhash.components(simhash.links(fps, 2)).collect():
            groups.setdefault(r.root, {r.root}).add(r.node)
        want = {}
        for k in keys:
            want.setdefault(find(k), set()).add(signed(k))
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, (g for g in want.values() if len(g) > 1)))
    assert simhash.links(fps.limit(0), 2).count() == 0


def test_fingerprint_of_very_long_texts():
    import xxhash

    from polyglyph.llm import simhash

    words = [f"w{i * i % 7919}" for i in range(70_000)]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint("  ".join(words).upper().replace("W", "w")) == want
