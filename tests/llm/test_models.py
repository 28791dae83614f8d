"""op4, op7, op8 and op10 against straight recomputations from their definitions."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from polyglyph.llm import langid, quality, toxicity, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _models(labelled, order=url_filter.ORDER, b=url_filter.SMOOTHING):
    """(longest known string) -> log p_accepted - log p_rejected, by loops over characters."""
    counts = {True: Counter(), False: Counter()}
    for key, good in labelled:
        padded = "^" * order + key
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[good][padded[i - k : i + 1]] += 1
    strings = set(counts[True]) | set(counts[False])
    kinds = len([g for g in strings if len(g) == 1])
    context = {w: Counter() for w in (True, False)}
    for w in (True, False):
        for g, n in counts[w].items():
            context[w][(len(g), g[:-1])] += n
    p = {}

    def prob(g, w):
        if (g, w) not in p:
            below = prob(g[1:], w) if len(g) > 1 else 1 / (kinds + 1)
            p[g, w] = (counts[w][g] + b * below) / (context[w][(len(g), g[:-1])] + b)
        return p[g, w]

    kept = {g for g in strings if len(g) == 1 or counts[True][g] + counts[False][g] >= url_filter.LEAST}
    return {g: math.log(prob(g, True)) - math.log(prob(g, False)) for g in kept}


def _score(key, ratios, order=url_filter.ORDER):
    padded, total = "^" * order + key, 0
    for i in range(order, len(padded)):
        total += next((ratios[padded[i - k : i + 1]] for k in range(order, -1, -1) if padded[i - k : i + 1] in ratios), 0.0)
    return total / len(key) if key else 0.0


def test_url_scores_and_threshold(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages = pages.union(pages.select(F.col("page_id") + 1000, F.concat(F.lit("http://odd.org/"), F.reverse("url")), "html")).union(spark.createDataFrame([(5000, None, "")], "page_id long, url string, html string"))
    got = url_filter.judge(pages).collect()
    host, path = url_filter.host_and_path(F.col("url"))
    _, verdict = url_filter.apply_rules(F.col("host"), F.col("path"))
    keys = pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", F.concat("host", "path").alias("key"), verdict.alias("v"))
    keys = [(r.key, r.v, r.h % 5 == 0) for r in keys.withColumn("h", F.pmod(F.xxhash64("key"), F.lit(5))).collect()]
    ratios = _models([(k, v == "allow") for k, v, apart in keys if v and k and not apart])
    checked = [(math.floor(max(-20, min(20, _score(k, ratios))) * url_filter.PARTS), v == "allow") for k, v, apart in keys if v and k and apart]
    good, bad = max(1, sum(g for _, g in checked)), max(1, sum(not g for _, g in checked))
    errors = {t: sum(g for p, g in checked if p < t) / good + sum(not g for p, g in checked if p >= t) / bad for t, _ in checked}
    threshold = min(errors, key=lambda t: (errors[t], abs(t), t), default=0) / url_filter.PARTS
    for r in got:
        if r.rule is None:
            want = _score(r.host + r.path, ratios)
            assert r.score == pytest.approx(want, abs=1e-6)
            assert (r.verdict == "allow") == (want >= threshold) or abs(want - threshold) < 1e-6
    assert {r.verdict for r in got} == {"allow", "block"} and len(got) == pages.count()


def test_url_models_do_not_depend_on_the_join(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted(map(tuple, url_filter.judge(pages).collect()), key=str)
    monkeypatch.setattr(url_filter, "BROADCAST_GRAMS", 3)
    assert sorted(map(tuple, url_filter.judge(pages).collect()), key=str) == want


def test_languages_by_ranks(spark, documents):
    def grams(text):
        out, word = Counter(), ""
        for c in (text or "").lower() + " ":
            if c.isalpha():
                word += c
            elif word:
                out.update(word)
                edged = "\0" + word + "\0"
                out.update(edged[i : i + 2] for i in range(len(edged) - 1))
                out.update(edged[i : i + 3] for i in range(len(edged) - 2))
                word = ""
        return out

    def ranks(counts, most):
        # ties by n-gram, in the order of 21-bit codes
        code = lambda g: sum((ord(c) or 1) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        return sorted(counts, key=lambda g: (-counts[g], code(g)))[:most]

    rows = documents.select("doc_id", "text", "lang").collect()
    learned = {}
    for r in rows:
        if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            learned.setdefault(r.lang, Counter()).update(grams(r.text))
    profiles = {k: {g: i for i, g in enumerate(ranks(c, langid.PROFILE))} for k, c in learned.items()}
    got = {r.doc_id: r for r in langid.op7_language_id(spark, SF).collect()}
    for r in rows:
        own = ranks(grams(r.text), langid.DOCUMENT_PROFILE)
        if not own:
            assert got[r.doc_id].lang_pred == "und"
            continue
        far = {k: sum(min(abs(p[g] - i), len(p)) if g in p else len(p) for i, g in enumerate(own)) / len(own) / len(p) for k, p in profiles.items()}
        least = min(far.values())
        assert got[r.doc_id].score == pytest.approx(1 - least, abs=1e-9) and far[got[r.doc_id].lang_pred] == pytest.approx(least, abs=1e-12)


def test_toxicity_is_the_machine(spark, documents):
    model = toxicity.fit(*[spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")])
    assert len(model.place) > 0
    terms = toxicity.Terms(model.place)
    for r in toxicity.score_toxicity(documents, model, to="s").collect():
        x = terms(r.text)
        z = model.bias + sum(model.weights[i] for i in x) + sum(float(model.factors[i] @ model.factors[j]) for n, i in enumerate(x) for j in x[:n])
        assert r.s == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def _pair_rows(n, seed):
    """Rows of noise in which class 1 is where one of the terms 1 and 2 is there, and not both."""
    draw = np.random.default_rng(seed)
    a, b, noise = draw.integers(0, 2, n), draw.integers(0, 2, n), draw.integers(100, 400, (n, 30))
    return [sorted({*noise[i].tolist(), *([1] if a[i] else []), *([2] if b[i] else [])}) for i in range(n)], (a ^ b).astype(float)


def test_toxicity_learns_what_only_a_pair_tells():
    x, y = _pair_rows(800, 3)
    rows = toxicity.Rows(np.array([t for r in x for t in r]), np.array([len(r) for r in x]))
    held, truth = _pair_rows(800, 4)
    right = {}
    for pairs in (True, False):
        model = toxicity.learn(rows, y, pairs)
        found = toxicity.predict([[model.place[t] for t in r if t in model.place] for r in held], model.bias, model.weights, model.factors)
        right[pairs] = ((found >= 0.5) == truth).mean()
    assert right[True] > 0.95 > 0.7 > right[False]


def test_quality_is_the_compressed_difference(spark, documents):
    model = quality.fit(*[spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")])
    assert model.good and model.bad and any(model.weights[1:])

    def size(dictionary, data):
        d = zstandard.ZstdCompressionDict(dictionary)
        c = zstandard.ZstdCompressor(dict_data=d, level=quality.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(data[s : s + quality.SEGMENT])) for s in range(0, len(data), quality.SEGMENT))

    scored = quality.score_quality(documents.limit(60), model, to="s").collect()
    for r in scored:
        data = (r.text or "").encode()
        x = 20 * (size(model.bad, data) - size(model.good, data)) / (len(data) + quality.SMOOTHING)
        z = model.weights[0] + model.weights[1] * x + model.weights[2] * x * math.log2(1 + len(data)) / 4
        assert r.s == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_replace_a_column_of_their_name_only(spark, module):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a", 5.0, "x"), (1, "a", 5.0, "x"), (None, None, None, None)], "doc_id long, text string, score double, y string")
    score = quality.score_quality if module is quality else toxicity.score_toxicity
    model = module.fit(docs, labels)
    assert score(docs, model, to="s").columns == ["doc_id", "text", "score", "y", "s"]
    assert sorted(score(docs, model).columns) == ["doc_id", "score", "text", "y"] and score(docs.limit(0), model).count() == 0


def test_languages_of_an_empty_table_and_clashing_columns(spark, documents):
    profiles = langid.fit(documents)
    odd = spark.createDataFrame([(1, "wort und welt", "x", 2.0), (1, "wort und welt", "y", None), (None, None, None, None), (2, "12 !", "z", 0.0)], "doc_id long, text string, lang_pred string, score double")
    rows = langid.identify(odd, profiles).collect()
    assert sorted(r.lang_pred == "und" for r in rows) == [False, False, True, True] and len({(r.doc_id, r.lang_pred) for r in rows if r.doc_id == 1}) == 1
    assert langid.identify(odd.limit(0), profiles).count() == 0 and langid.fit(documents.limit(0)) == {}


def test_scratch_is_cleaned(spark):
    import os

    from polyglyph.llm import common

    kept = common.materialize(spark.range(3), "numbers")
    assert kept.count() == 3
    root = common.scratch_root(spark).removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(root)
    common.clean(spark)
    assert not os.path.exists(root)
