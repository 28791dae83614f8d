"""Queries over pages and documents: words, scripts, switchers, languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.hold import hold
from ..functions.scripts import KEEP, MOST_WORDS, TOKEN, letter_hits, ranges, script_chars
from ..functions.urls import AMBIGUOUS_PATH_CODES, NO_PAGE_SUFFIXES, normalize_url, path_code
from ..operators import classify as C
from ..operators import records as R
from ..sources.languages import code_map, load_packs

PACKS = load_packs()


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(r) + ")" for r in rows) + f") AS {names}"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]::VARCHAR[]"


# --- SQL pieces -----------------------------------------------------------------------------------------------

_HIDDEN_SQL = "(?is)" + "|".join(rf"<{t}[^>]*>.*?(?:</{t}>|\z)" for t in H.HIDDEN_TAGS)


def _words_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), {_q(TOKEN)}), lambda w: length(w) <= 32 AND regexp_matches(w, {_q(KEEP)}))[1:200]"


def _visible_sql(html: str) -> str:
    t = f"regexp_replace(coalesce({html}, ''), {_q(H.BEFORE_BODY)}, '')"
    for pattern in (H.COMMENT, _HIDDEN_SQL, H.TAG, H.ENTITY):
        t = f"regexp_replace({t}, {_q(pattern)}, ' ', 'g')"
    return _words_sql(t)


def _chars_sql(text: str, script: str) -> str:
    own = f"(length({text}) - length(regexp_replace({text}, {_q(f'[{ranges(script)}]')}, '', 'g')))"
    if script != "latin":
        return own
    rest = f"regexp_replace({text}, {_q(f'[{ranges()}]')}, '', 'g')"  # letters outside all blocks count as Latin
    return f"({own} + length({rest}) - length(regexp_replace({rest}, '\\p{{L}}', '', 'g')))"


def _hits_sql(text: str, letters: str) -> str:
    return f"(length({text}) - length(translate({text}, {_q(letters)}, '')))"


_CODES_SQL = _values([(_q(c), _q(n)) for c, n in code_map(PACKS).items()], "codes(code, lang)")
_INDEX_SQL = _values([(_q(w), _q(p.name), _list(p.scripts)) for p in PACKS for w in p.words], "idx(word, lang, scripts)")
_SUBTAG = "split_part(lower(trim(translate({0}, '_', '-'))), '-', 1)"


def _html_lang_sql(html: str) -> str:
    return f"nullif(regexp_extract({html}, {_q(H.HTML_LANG)}, 1), '')"


def _suppress_sql(found: str) -> str:
    """No pack that suppresses others is suppressed itself, so the packs' order does not matter."""
    rules = [p for p in PACKS if p.suppresses]
    assert not {p.name for p in rules} & {n for p in rules for n in p.suppresses}
    gone = " OR ".join(f"list_contains({found}, {_q(p.name)}) AND list_contains({_list(p.suppresses)}, x)" for p in rules)
    return f"list_filter({found}, lambda x: NOT coalesce({gone}, false))"


def _script_langs_sql(text: str) -> str:
    """Exclusive letters and sufficient scripts, suppression, then the share of a Cyrillic vowel; digraphs by replace()."""
    flags = []
    for p in PACKS:
        if p.exclusive:
            total, hits = _chars_sql(text, p.exclusive.script), _hits_sql(text, p.exclusive.letters)
            flags.append(f"CASE WHEN {total} >= 40 AND {hits} >= {p.exclusive.min_hits} AND {hits} >= {total} * {p.exclusive.min_share} THEN {_q(p.name)} END")
        elif p.script_sufficient:
            flags.append(f"CASE WHEN {' OR '.join(f'{_chars_sql(text, s)} >= 40' for s in p.scripts)} THEN {_q(p.name)} END")
    return f"list_filter([{', '.join(flags)}], lambda x: x IS NOT NULL)"


_PAGE_LANGS_SQL = f"""
WITH w AS (SELECT page_id, url, html, {_visible_sql('html')} AS words FROM pages),
 t AS (SELECT *, array_to_string(words, ' ') AS txt FROM w),
 s0 AS (SELECT *, {_script_langs_sql('txt')} AS f0, {_chars_sql('txt', 'cyrillic')} AS cyr FROM t),
 s1 AS (SELECT *, {_suppress_sql('f0')} AS f1 FROM s0),
 s2 AS (SELECT *, CASE WHEN cyr >= 40 AND NOT list_has_any(f1, ['russian', 'ukrainian', 'belarusian']) AND {_hits_sql('txt', 'ъ')} >= cyr * 0.006 THEN list_append(f1, 'bulgarian') ELSE f1 END AS by_script FROM s1),
 sc AS (SELECT page_id, list_filter([{', '.join(f"CASE WHEN {_chars_sql('txt', x)} > 0 THEN {_q(x)} END" for x in sorted({s for p in PACKS for s in p.scripts}))}], lambda x: x IS NOT NULL) AS on_page FROM t),
 e AS (SELECT DISTINCT page_id, unnest(words) AS word FROM t),
 n AS (SELECT e.page_id, idx.lang, count(*) AS n FROM e JOIN {_INDEX_SQL} USING (word) JOIN sc ON sc.page_id = e.page_id
       WHERE len(idx.scripts) = 0 OR len(on_page) = 0 OR list_has_any(idx.scripts, on_page) GROUP BY ALL),
 m AS (SELECT *, max(n) OVER (PARTITION BY page_id) AS top FROM n),
 bw AS (SELECT page_id, list(lang) AS by_words FROM m WHERE n >= 4 AND n >= top * 0.35 GROUP BY page_id),
 d AS (SELECT page_id, c.lang AS declared FROM t LEFT JOIN {_CODES_SQL.replace('codes(', 'c(')} ON c.code = {_SUBTAG.format(_html_lang_sql('html'))}),
 u AS (SELECT s2.page_id, declared, list_concat(by_script, coalesce(by_words, [])) AS content FROM s2 LEFT JOIN bw ON s2.page_id = bw.page_id LEFT JOIN d ON d.page_id = s2.page_id),
 langs AS (SELECT page_id, list_sort(list_distinct(list_concat(CASE WHEN declared IS NULL THEN [] ELSE [declared] END, {_suppress_sql('content')}))) AS languages FROM u)
"""


_FOLD = ("belarusian", "ukrainian", "russian", "english", "japanese", "chinese")

# --- queries --------------------------------------------------------------------------------------------------


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def page_words(spark, sf_dir):
    words = hold(_pages(spark, sf_dir).select("page_id", "html"), w=H.visible_words(F.col("html")))
    return words.select("page_id", F.size("w").alias("n_words"), F.array_join("w", " ").alias("words"))


def page_html_lang(spark, sf_dir):
    lang = H.html_lang(F.col("html"))
    return _pages(spark, sf_dir).select("page_id", lang.alias("html_lang"), C.code_language(lang, PACKS).alias("language"))


def page_path_lang(spark, sf_dir):
    code = path_code(F.col("url"))
    return _pages(spark, sf_dir).select("page_id", code.alias("code"), C.code_language(code, PACKS).alias("language"))


def page_classify(spark, sf_dir):
    found = C.classify(_pages(spark, sf_dir), PACKS, "page_id")
    return found.select("page_id", F.array_join("languages", ",").alias("languages"))


def page_primary(spark, sf_dir):
    return C.primary_language(_pages(spark, sf_dir), PACKS, "page_id")


def combo_counts(spark, sf_dir):
    return R.combination_counts(C.classify(_pages(spark, sf_dir), PACKS, "page_id"), "languages")


def presence_counts(spark, sf_dir):
    return R.presence_counts(C.classify(_pages(spark, sf_dir), PACKS, "page_id"), "languages")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _languages(found):
    return found.select("doc_id", F.array_join(F.array_sort("by_words"), ",").alias("languages"))


def doc_word_scores(spark, sf_dir):
    return C.word_scores(_docs(spark, sf_dir), PACKS, "doc_id", MOST_WORDS)


def doc_word_languages(spark, sf_dir):
    return _languages(C.word_languages(_docs(spark, sf_dir), PACKS, "doc_id", MOST_WORDS))


def doc_whole_word_scores(spark, sf_dir):
    """As doc_word_scores, whose SQL reads 200 words, over all words."""
    return C.word_scores(_docs(spark, sf_dir), PACKS, "doc_id")


def doc_whole_word_languages(spark, sf_dir):
    """As doc_word_languages, whose SQL reads 200 words, over all words."""
    return _languages(C.word_languages(_docs(spark, sf_dir), PACKS, "doc_id"))


def doc_script_totals(spark, sf_dir):
    text = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", *[script_chars(text, s).alias(s) for s in ("latin", "cyrillic", "greek", "han")])


def doc_exclusive_letters(spark, sf_dir):
    text = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", letter_hits(text, "äöüß").alias("german_hits"), letter_hits(text, "ñ¿¡").alias("spanish_hits"), letter_hits(text, "çœ").alias("french_hits"))


def suppression_fold(spark, sf_dir):
    """Every part as a list of found languages."""
    k = F.col("p_partkey")
    found = F.array_compact(F.array(*[F.when(F.shiftright(k, i) % 2 == 1, n) for i, n in enumerate(_FOLD)]))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.suppress(found, PACKS), ",").alias("kept"))


def url_normalize(spark, sf_dir):
    raw = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("  "), F.regexp_replace("url", "^https?://", ""))).when(F.col("page_id") % 7 == 1, F.concat("url", F.lit(".PDF"))).when(F.col("page_id") % 7 == 2, F.lit("mailto:a@b")).otherwise(F.col("url"))
    return _pages(spark, sf_dir).select("page_id", normalize_url(raw).alias("url"))


def url_first_seen(spark, sf_dir):
    host = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    return R.unique_urls(_pages(spark, sf_dir).withColumn("host", host), "host", "page_id")


def url_shard(spark, sf_dir):
    return R.shard(url_first_seen(spark, sf_dir), 1, 3).select("url", "position")


QUERIES = {f.__name__: f for f in (page_classify, page_words, page_html_lang, page_path_lang, page_primary, combo_counts, presence_counts, doc_word_scores, doc_word_languages, doc_whole_word_scores, doc_whole_word_languages, doc_script_totals, doc_exclusive_letters, suppression_fold, url_normalize, url_first_seen, url_shard)}

_DOC_WORDS_SQL = f"""
WITH w AS (SELECT doc_id, {_words_sql("coalesce(text, '')")} AS words FROM documents),
 sc AS (SELECT doc_id, words, array_to_string(words, ' ') AS txt FROM w),
 e AS (SELECT DISTINCT doc_id, unnest(words) AS word FROM w),
 o AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN {_chars_sql('txt', x)} > 0 THEN {_q(x)} END" for x in sorted({s for p in PACKS for s in p.scripts}))}], lambda x: x IS NOT NULL) AS on_page FROM sc),
 n AS (SELECT e.doc_id, idx.lang AS language, count(*)::BIGINT AS n FROM e JOIN {_INDEX_SQL} USING (word) JOIN o ON o.doc_id = e.doc_id
       WHERE len(idx.scripts) = 0 OR len(on_page) = 0 OR list_has_any(idx.scripts, on_page) GROUP BY ALL)
"""
_WHOLE_DOC_WORDS_SQL = _DOC_WORDS_SQL.replace("[1:200]", "")
_PATH_SQL = "regexp_extract(regexp_extract(lower(regexp_replace(url, '^https?://[^/]+/web/\\d+[a-z_]*/', '')), '^(?:https?://)?[^/?#]*([^?#]*)', 1), '^/([a-z]{2,3})(?:/|$)', 1)"
_AMBIGUOUS = "(" + ", ".join(_q(c) for c in AMBIGUOUS_PATH_CODES) + ")"
_SUFFIXES = "(?:" + "|".join(s.replace(".", "\\.") for s in NO_PAGE_SUFFIXES) + ")\\z"

ORACLE_SQL = {
    "page_words": f"WITH w AS (SELECT page_id, {_visible_sql('html')} AS w FROM pages) SELECT page_id, len(w)::INT AS n_words, array_to_string(w, ' ') AS words FROM w",
    "page_html_lang": f"SELECT page_id, {_html_lang_sql('html')} AS html_lang, c.lang AS language FROM pages LEFT JOIN {_CODES_SQL.replace('codes(', 'c(')} ON c.code = {_SUBTAG.format(_html_lang_sql('html'))}",
    "page_path_lang": f"WITH p AS (SELECT page_id, {_PATH_SQL} AS x FROM pages), y AS (SELECT page_id, CASE WHEN x <> '' AND x NOT IN {_AMBIGUOUS} THEN x END AS code FROM p) SELECT page_id, y.code, c.lang AS language FROM y LEFT JOIN {_CODES_SQL.replace('codes(', 'c(')} ON c.code = y.code",
    "page_classify": _PAGE_LANGS_SQL + "SELECT page_id, array_to_string(languages, ',') AS languages FROM langs",
    "combo_counts": _PAGE_LANGS_SQL + "SELECT coalesce(nullif(array_to_string(languages, ','), ''), 'unknown') AS combo, count(*) AS n FROM langs GROUP BY 1",
    "presence_counts": _PAGE_LANGS_SQL + "SELECT language, count(*) AS n FROM (SELECT unnest(CASE WHEN len(languages) = 0 THEN ['unknown'] ELSE languages END) AS language FROM langs) GROUP BY 1",
    "doc_word_scores": _DOC_WORDS_SQL + "SELECT doc_id, language, n FROM n",
    "doc_word_languages": _DOC_WORDS_SQL + ", m AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS top FROM n) SELECT doc_id, coalesce(string_agg(language, ',' ORDER BY language) FILTER (WHERE n >= 4 AND n >= top * 0.35), '') AS languages FROM m GROUP BY doc_id",
    "doc_whole_word_scores": _WHOLE_DOC_WORDS_SQL + "SELECT doc_id, language, n FROM n",
    "doc_whole_word_languages": _WHOLE_DOC_WORDS_SQL + ", m AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS top FROM n) SELECT doc_id, coalesce(string_agg(language, ',' ORDER BY language) FILTER (WHERE n >= 4 AND n >= top * 0.35), '') AS languages FROM m GROUP BY doc_id",
    "doc_script_totals": "SELECT doc_id, " + ", ".join(f"{_chars_sql('lower(coalesce(text, chr(32)))', s)}::INT AS {s}" for s in ("latin", "cyrillic", "greek", "han")) + " FROM documents",
    "doc_exclusive_letters": "SELECT doc_id, " + ", ".join(f"{_hits_sql('lower(coalesce(text, chr(32)))', x)}::INT AS {n}" for n, x in (("german_hits", "äöüß"), ("spanish_hits", "ñ¿¡"), ("french_hits", "çœ"))) + " FROM documents",
    "suppression_fold": "WITH f AS (SELECT p_partkey, " + ", ".join(f"(p_partkey >> {i}) % 2 = 1 AS {n}" for i, n in enumerate(_FOLD)) + " FROM part) SELECT p_partkey, array_to_string(list_filter([CASE WHEN belarusian THEN 'belarusian' END, CASE WHEN ukrainian THEN 'ukrainian' END, CASE WHEN russian AND NOT belarusian AND NOT ukrainian THEN 'russian' END, CASE WHEN english THEN 'english' END, CASE WHEN japanese THEN 'japanese' END, CASE WHEN chinese AND NOT japanese THEN 'chinese' END], lambda x: x IS NOT NULL), ',') AS kept FROM f",
    "url_normalize": f"""WITH r AS (SELECT page_id, trim(CASE page_id % 7 WHEN 0 THEN '  ' || regexp_replace(url, '^https?://', '') WHEN 1 THEN url || '.PDF' WHEN 2 THEN 'mailto:a@b' ELSE url END) AS u FROM pages),
      w AS (SELECT page_id, u, CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE 'http://' || u END AS x FROM r)
      SELECT page_id, CASE WHEN u = '' OR regexp_matches(u, '^(?:javascript:|mailto:|tel:)') OR regexp_extract(x, '^https?://([^/?#]*)', 1) = '' OR regexp_matches(lower(regexp_extract(x, '^https?://[^/?#]*([^?#]*)', 1)), {_q(_SUFFIXES)}) THEN NULL ELSE x END AS url FROM w""",
    "url_first_seen": "SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS url, min(page_id) AS first_row FROM pages WHERE url IS NOT NULL GROUP BY 1",
    "url_shard": "WITH f AS (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS url, min(page_id) AS first_row FROM pages WHERE url IS NOT NULL GROUP BY 1), p AS (SELECT url, row_number() OVER (ORDER BY first_row) - 1 AS position FROM f) SELECT url, position FROM p WHERE position % 3 = 1",
}
