"""Visible words and declared languages of an HTML page. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scripts import MOST_WORDS, TOKEN, keep_word

# What counts as a page's body, comments, hidden text, tags, entities, declared languages and links.
BEFORE_BODY = r"(?is)^.*?<body[^>]*>"
COMMENT = r"(?s)<!--.*?-->"
HIDDEN_TAGS = ("script", "style", "noscript", "svg")
HIDDEN = rf"(?is)<({'|'.join(HIDDEN_TAGS)})[^>]*>.*?(?:</\1>|\z)"
TAG = r"<[^>]+>"
ENTITY = r"(?i)&(?:[a-z]+|#\d+|#x[0-9a-f]+);"
HTML_LANG = r"""(?is)<html[^>]*\slang=["']([^"']+)["']"""
LINK = r"(?is)<link\b[^>]*>"
HREFLANG = r"""(?is)hreflang=["']([^"']+)["']"""
ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a>"
HREF = r"""(?is)href=["']([^"']+)["']"""
LINK_HREF = r"""(?is)[^a-z]href=["'][^"']+["']"""
PATH_CODE = r"(?:^|/)([a-z]{2,3})(?:/|$|\?)"


def visible_words(html: Column, most: int = MOST_WORDS) -> Column:
    """The first `most` kept words of the text after the first <body>; a null page has no words."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), BEFORE_BODY, "")
    for pattern in (COMMENT, HIDDEN, TAG, ENTITY):
        text = F.regexp_replace(text, pattern, " ")
    return words_of(text, most)


def words_of(text: Column, most: int | None = None) -> Column:
    """The kept words of the text; the first `most` if given."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), keep_word)
    return words if most is None else F.slice(words, 1, most)


def primary_subtag(code: Column) -> Column:
    """`en` of ` en_GB`; null for an empty code and for x-default."""
    code = F.lower(F.trim(F.translate(code, "_", "-")))
    return F.when((code != "") & (code != "x-default"), F.split(code, "-")[0])


def html_lang(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, HTML_LANG, 1), F.lit(""))


def link_langs(html: Column) -> Column:
    """Codes of <link> tags that have both hreflang and href, in either order."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(LINK), F.lit(0)), lambda t: t.rlike(HREFLANG) & t.rlike(LINK_HREF))
    return F.transform(tags, lambda t: F.regexp_extract(t, HREFLANG, 1))
