"""The index of all packs against the column expressions, on generated links, words and texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from polyglyph.functions import html as H
from polyglyph.operators import classify as C
from polyglyph.operators import index as I
from polyglyph.sources.languages import Pack, label_map, load_packs

PACKS = load_packs()


def links(draw, n):
    labels, codes = sorted(label_map(PACKS)), sorted(c for p in PACKS for c in p.codes)
    out = []
    for _ in range(n):
        name = draw.choice(labels)
        name = draw.choice([name, name.upper(), name.title(), name[:-1], name + "x", "shop"])
        text = draw.choice(["{}", "Language {}", "language: {}", "LANGUAGE-{}", "language {}", "language :  {}", "View in {}", "view  in\t{}", "in {}", "View {}", "in in {}", "Change  Language", "Sprache ÄNDERN", "newid iaith", "<b>{}</b>", " {}\xa0", "{} {}", "language", "x" * 60]).format(name, name)
        href = draw.choice(["/{}/", "/{}", "https://x/{}?a", "/a/{}/b", "{}", "/{}x/"]).format(draw.choice([*codes, "uk", "qq", "EN"]))
        attributes = draw.choice(['href="{}"', "class='a' HREF='{}' hreflang=\"{}\"", "hreflang='x-default' href=\"{}\"", 'title="{}"']).format(href, draw.choice(["en-GB", "cy_GB", "zz", ""]))
        out.append(f"<a {attributes}>{text}</a>")
    return out


def test_links_equal_the_column_expressions(spark):
    draw = random.Random(3)
    pages = [f'<html lang="{draw.choice(["en", "cy_GB", "x-default", " FR-x ", ""])}"><link rel=x hreflang="{draw.choice(["pl", "DE-at", "zz"])}" href="/p"><body>{"".join(links(draw, 12))}' for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(pages)), "id long, html string")
    want = {r.id: sorted(set(r.s)) for r in df.select("id", C.switch_languages(F.col("html"), PACKS).alias("s")).collect()}
    got = {r.id: r.by_switch for r in C.classify(df, PACKS).collect()}
    assert got == want and sum(map(len, want.values())) > 200


def test_words_equal_the_column_expressions(spark):
    draw = random.Random(4)
    listed = [w for p in PACKS for w in p.words]
    letters = "aeiouäßñçşğıþðłőåøżœabcяюєїґіўъқңһөүәёыэѓќљњћђ日本語のア한국ქართუαβγשלוםسلامپگڤनमहাংதமிழ"
    rows = []
    for i in range(300):
        words = [draw.choice(draw.choice([listed, PACKS[i % len(PACKS)].words or listed])) for _ in range(draw.randint(0, 60))]
        words += ["".join(draw.choice(letters) for _ in range(draw.randint(2, 9))) for _ in range(draw.choice([0, 0, 3, 30]))]
        some = draw.choice(letters)
        words += [some * 5] * draw.choice([0, 0, 9])
        rows.append((i, words))
    df = spark.createDataFrame(rows, "id long, words array<string>")
    plain = lambda s: (sorted(s.by_script), sorted(s.by_words), sorted(s.content), [(x.language, x.n) for x in s.scores])
    want = {r.id: plain(r.s) for r in df.select("id", C.content_languages(F.col("words"), PACKS).alias("s")).collect()}
    got = {r.id: plain(r.s) for r in df.select("id", I.words_say(F.col("words"), PACKS).alias("s")).collect()}
    assert got == want and len({str(w) for w in want.values()}) > 100


def test_visible_words_equal_the_column_expression(spark):
    draw = random.Random(6)
    bits = ["<body>", "<BODY class='x'>", "</body>", "<script>var a = 'one two';</script>", "<STYLE x>css</style>", "<svg>never closed", "<noscript>n</NOSCRIPT>", "<!-- a <body> comment -->", "<!--", "-->", "<p>", "</p\n>", "<", ">", "caf&eacute;", "&#233;", "&#xE9;", "&nope", "Gwasanaeth", "\u0421\u0435\u0440\u0432\u0456\u0441", "x", "\u65e5\u672c", "\x0b", "\x1c", "\u0130stanbul", "</script>", "<script", "<svgx>y</svg>"]
    pages = ["".join(draw.choice([b, b + " "]) for b in draw.choices(bits, k=draw.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    for r in df.select("id", H.visible_words(F.col("html")).alias("w")).collect():
        assert I.visible_words(pages[r.id]) == r.w, pages[r.id]


def test_words_of_texts(spark):
    texts = ["Siop y Pentre, caf\u00e9 d\u2019or 12 xyz bcd \u02bbokina", "\u0130stanbul \u039f\u0394\u039f\u03a3 STRASSE \u00df", "a" * 40 + " ok", "\u65e5\u672c\u8a9e \ud55c\uad6d\uc5b4 x", "", None, "\U00020000\U00020001 one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in df.select("id", H.words_of(F.coalesce("text", F.lit(""))).alias("w")).collect():
        assert I.words_in(texts[r.id] or "") == r.w
    assert I.words_in("one two three", 2) == ["one", "two"]
    scored = C.word_scores(spark.createDataFrame([(1, "yn yr mae gan"), (1, None)], "id long, text string"), PACKS)
    assert ("welsh", 4) in {(r.language, r.n) for r in scored.collect()}


def test_the_number_of_packs_does_not_matter():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(6))
    make = lambda n: I.Index([Pack(f"p{i}", words=tuple(word() for _ in range(60)), labels=(f"label {i}",), order=i) for i in range(n)])
    few, many, words = make(16), make(480), [word() for _ in range(200)]
    attributes, inner = ['href="/x"'] * 50, [f"Label {i}0" for i in range(50)]

    def took(index):
        start = time.perf_counter()
        for _ in range(100):
            index.words_say(words)
            index.switches("en", [], attributes, inner)
        return time.perf_counter() - start

    took(few)
    assert min(took(many) for _ in range(3)) < 2.5 * min(took(few) for _ in range(3))


@pytest.mark.parametrize("label, want", [("Cymraeg", True), ("language: cymraeg", True), ("language-cymraeg", True), ("languagecymraeg", True), ("view in cymraeg", True), ("view cymraeg", True), ("in view cymraeg", False), ("language :- cymraeg", False), ("", False), ("change language", True)])
def test_switchers(label, want):
    assert I.Index(PACKS).switcher(label) is want
