"""Classification within a row, against a plain recomputation and on repeated, null and clashing rows."""

import json
import re
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from polyglyph.functions import html as H
from polyglyph.functions.scripts import BLOCKS, letter_hits, script_chars
from polyglyph.operators import classify as C
from polyglyph.sources.languages import CyrillicSign, Pack, code_map, label_map, load_packs

PACKS = load_packs()
SF = "/root/testdata/sf0.001"


def script_of(c):
    code = ord(c)
    return next((s for s, a, b in BLOCKS if a <= code <= b), "latin" if c.isalpha() else None)


def suppressed(found, packs):
    for p in packs:
        if p.name in found:
            found = found - set(p.suppresses)
    return found


def by_letters(text, packs):
    totals, letters = Counter(filter(None, map(script_of, text))), Counter(c for c in text if script_of(c))
    found = set()
    for p in packs:
        if p.exclusive:
            total, hits = totals[p.exclusive.script], sum(letters[c] for c in p.exclusive.letters)
            if total >= 40 and hits >= p.exclusive.min_hits and hits / total >= p.exclusive.min_share:
                found.add(p.name)
        elif p.script_sufficient and any(totals[s] >= 40 for s in p.scripts):
            found.add(p.name)
    found = suppressed(found, packs)
    if totals["cyrillic"] >= 40:
        gone = Counter()
        for p in packs:
            if p.sign and p.sign.mode == "digraph":
                n = sum(text[i] == p.sign.letter and text[i - 1] in p.sign.leaders for i in range(1, len(text)))
                if n >= p.sign.min_hits:
                    found.add(p.name)
                    gone[p.sign.letter] += n
        for p in packs:
            if p.sign and p.sign.mode == "vowel_share" and not found & set(p.sign.blocked_by):
                if letters[p.sign.letter] and (letters[p.sign.letter] - gone[p.sign.letter]) / totals["cyrillic"] >= p.sign.min_share:
                    found.add(p.name)
    return found


def scores(words, packs):
    there = {s for w in set(words) for c in w if (s := script_of(c))}
    out = {p.name: len(set(words) & set(p.words)) for p in packs if not p.scripts or not there or there & set(p.scripts)}
    return {k: n for k, n in out.items() if n}


def by_words(found):
    top = max(found.values(), default=0)
    return {k for k, n in found.items() if n >= 4 and n >= 0.35 * top}


def content(words, packs):
    return suppressed(by_letters(" ".join(words), packs) | by_words(scores(words, packs)), packs)


TEXTS = [
    "yn yr ar gyda neu wedi mae hwn hyn", "the and of to with for that welcome hours", "", "ґанок їжа та це що був вона він є для як ми не на ", "что это как для на не мы он она было ы э ъ ",
    "це що та є і в на з для " * 3, "това е че за не на всички или при ние " * 3, "καλημέρα σας από την ελλάδα " * 3, "日本語のページへようこそ。お問い合わせはこちら " * 3, "中文网站欢迎您的光临请联系我们了解更多服务内容" * 3,
    "ʻōlelo ʻāina kākou ʻike " * 4, "נחנו כאן בשבילכם " * 6, "нъэ къэ лъэ гъэ хъэ " * 8, "się nie jest oraz przez jak dla tego ale był", "और है के में की से को का पर यह नहीं एक " * 2,
]


def spark_words(spark, texts):
    return spark.createDataFrame([(i, [w for w in t.split() if len(w) > 1]) for i, t in enumerate(texts)], "id long, words array<string>")


@pytest.mark.parametrize("signs", [False, True])
def test_words_by_recomputation(spark, signs):
    packs = PACKS
    if signs:  # two packs of each kind, with one letter and with another
        sign = lambda mode, letter, **k: CyrillicSign(mode, letter, **k)
        more = [Pack("aa", sign=sign("digraph", "ъ", leaders="кг", min_hits=2)), Pack("ab", sign=sign("digraph", "э", leaders="ъ", min_hits=3)), Pack("ba", sign=sign("vowel_share", "ъ", min_share=0.01)), Pack("bb", sign=sign("vowel_share", "э", min_share=0.01, blocked_by=("ba",)))]
        packs = [replace(p, order=i) for i, p in enumerate([*more, *PACKS])]
    df = spark_words(spark, TEXTS)
    got = {r.id: set(r.found) for r in df.select("id", C.classify_words(F.col("words"), packs).alias("found")).collect()}
    for r in df.collect():
        assert got[r.id] == content(r.words, packs), TEXTS[r.id]


def page(i, text, lang="", links=""):
    return f'<html lang="{lang}"><head></head><body class="x">{text} {links}</body></html>'


LINKS = ['<a href="/cy/">Cymraeg</a>', '<a href="/de/x" hreflang="fr">language: français</a>', '<a href="/uk/">change language</a>', '<link rel="alternate" hreflang="pl" href="/pl">', '<a href="/shop">Deutsch</a><a href="/en">In English</a>', ""]


def made_pages():
    rows = [(i, f"https://a.example/{code}x", page(i, text, lang, LINKS[i % len(LINKS)])) for i, (text, lang, code) in enumerate(zip(TEXTS * 2, ["en", "", "cy-GB", "x-default", "ru_RU"] * 6, ["", "cy/", "uk/", "de/", "en/"] * 6))]
    # the same id with another text, and no id: each row by itself
    return rows + [(0, "https://b.example/", page(0, "yn yr cymraeg")), (0, "https://b.example/", page(0, "yn yr cymraeg")), (None, None, page(0, TEXTS[0])), (None, "u", None), (7, "u", "")]


def test_rows_that_share_an_id_answer_for_themselves(spark):
    rows = made_pages()
    df = spark.createDataFrame(rows, "id long, url string, html string")
    got = Counter((r.id, tuple(r.languages)) for r in C.classify(df, PACKS).collect())
    want = Counter()
    for i, (id_, url, html) in enumerate(rows):
        alone = spark.createDataFrame([(i, html)], "id long, html string")
        if i in (0, len(rows) - 5, len(rows) - 4, len(rows) - 3, len(rows) - 2):
            want[id_, tuple(C.classify(alone, PACKS).first().languages)] += 1
    assert got[0, ("english", "welsh")] + got[0, ("welsh",)] >= 1 and sum(got.values()) == len(rows)
    assert not want - got
    assert got[0, ()] == 2  # two words of Welsh are too few, however many rows share their id
    assert C.primary_language(df, PACKS).count() == len(rows) and C.primary_language(df.limit(0), PACKS).count() == 0


def test_primary_by_recomputation(spark):
    rows = [r for r in made_pages() if r[0] is not None and r[2]]
    df = spark.createDataFrame([(i, url, html) for i, (_, url, html) in enumerate(rows)], "id long, url string, html string")
    words = {r.id: r for r in df.select("id", H.visible_words(F.col("html")).alias("_words"), C.switch_languages(F.col("html"), PACKS).alias("_switch")).collect()}
    codes, order = code_map(PACKS), {p.name: p.order for p in PACKS}
    for r in C.classify_snapshots(df, PACKS).collect():
        w, available = words[r.id]._words, sorted(set(words[r.id]._switch) | content(words[r.id]._words, PACKS))
        assert r.available == available and r.words == len(w)
        own, text = scores(w, PACKS), " ".join(w)
        in_words = set(own)
        for p in PACKS:
            if p.exclusive:
                total, hits = sum(script_of(c) == p.exclusive.script for c in text), sum(c in p.exclusive.letters for c in text)
                if total >= 40 and hits >= p.exclusive.min_hits and hits / total >= p.exclusive.min_share:
                    own[p.name] = own.get(p.name, 0) + hits
        said = re.search(r'<html[^>]*\slang="([^"]+)"', r.html)
        declared = codes.get(re.split("[-_]", said.group(1).lower())[0]) if said and said.group(1) != "x-default" else None
        path = re.match(r"https?://[^/]+/([a-z]{2,3})/", r.url)
        path = codes.get(path.group(1)) if path and path.group(1) != "uk" else None
        if len(available) < 2:
            want = available[0] if available else None
        else:
            trusted = [c for c in (path, declared) if c in available and own.get(c)]
            best = max(own, key=lambda k: (own[k], k in available, k in in_words, -order[k])) if own else declared or path or available[0]
            want = trusted[0] if trusted else best
        assert r.primary == want, r


def test_early_languages_by_prefixes(spark):
    long = page(0, " ".join(f"word{i % 7}a and the of to with" for i in range(300)), "en")
    rows = [*[(i, html) for i, (_, _, html) in enumerate(made_pages())], (900, long), (901, "<p>" + long), (902, "x" * 700 + LINKS[0] + LINKS[3])]
    df = spark.createDataFrame(rows, "id long, html string")
    got = {r.id: (r.n_chars, r.languages) for r in C.early_languages(df, PACKS, step=250).collect()}
    cut = [(i, n, (h or "")[: 250 * n]) for i, h in rows for n in range(1, max(1, -(-len(h or "") // 250)) + 1)]
    each = spark.createDataFrame([(k, h) for k, (_, _, h) in enumerate(cut)], "id long, html string")
    words = {r.id: len(r._words) for r in each.select("id", H.visible_words(F.col("html")).alias("_words")).collect()}
    want = {}
    for r in sorted(C.classify(each, PACKS).collect(), key=lambda r: r.id):
        i, n, h = cut[r.id]
        said = r.by_switch if len(r.by_switch) > 1 else r.languages if "<body" in h and words[r.id] == 200 else []
        if said and i not in want:
            want[i] = (len(h), said)
    assert got == want and 900 in got and 902 in got


def test_letters_outside_the_blocks_are_latin(spark):
    text = "ʻōlelo ʼikuʻu ªº aБ日ㇰ"
    got = spark.createDataFrame([(text,)], "t string").select(script_chars(F.col("t"), "latin").alias("l"), script_chars(F.col("t"), "cyrillic").alias("c"), letter_hits(F.col("t"), "ʻ").alias("h")).first()
    assert (got.l, got.c, got.h) == (sum(script_of(c) == "latin" for c in text), 1, 2)


def test_a_language_is_added_by_a_file(spark, tmp_path):
    for p in ("english", "german"):
        (tmp_path / f"{p}.json").write_text(json.dumps({"name": p, "codes": [p[:2]], "words": []}), encoding="utf-8")
    (tmp_path / "volapuk.json").write_text(json.dumps({"name": "Volapük", "codes": ["vo"], "switch_labels": ["Volapük"], "words": ["binon", "nen", "kodü", "äbinom", "sevob"]}), encoding="utf-8")
    packs = load_packs(tmp_path)
    assert code_map(packs)["vo"] == "volapük" and label_map(packs) == {"volapük": "volapük"}
    df = spark.createDataFrame([(1, "<body>binon nen kodü äbinom sevob</body>"), (2, '<a href="/vo/">Volapük</a>')], "id long, html string")
    assert {r.id: r.languages for r in C.classify(df, packs).collect()} == {1: ["volapük"], 2: ["volapük"]}


def test_usable_and_state(spark):
    df = spark.createDataFrame([(25, ["a"], "a"), (24, ["a"], "a"), (25, [], None)], "words int, available array<string>, primary string")
    assert [r.u for r in df.select(C.usable(F.col("words"), F.col("available")).alias("u")).collect()] == [True, False, False]
    row = df.select(C.label_state(F.col("primary"), F.col("available")).alias("p"), C.label_state(F.col("primary"), F.col("available"), "available").alias("a")).first()
    assert row.p == ("a",) and row.a == ("a", ["a"])


def test_codes_of_three_letters(spark):
    codes = code_map(PACKS)
    typed = {"cym": "welsh", "eng": "english", "deu": "german", "ger": "german", "fra": "french", "fre": "french", "ces": "czech", "nob": "norwegian", "crh": "crimean tatar", "zho": "chinese"}
    assert {c: codes[c] for c in typed} == typed and len(codes) == 177 and all({len(c) for c in p.codes} >= ({3} if p.name == "crimean tatar" else {2, 3}) for p in PACKS)
    df = spark.createDataFrame([(1, '<html lang="cym">'), (2, '<link hreflang="deu-AT" href="/x">'), (3, '<a href="/fra/">Français</a>')], "id long, html string")
    assert {r.id: r.languages for r in C.classify(df, PACKS).collect()} == {1: ["welsh"], 2: ["german"], 3: ["french"]}
