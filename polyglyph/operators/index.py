"""One index of all packs: a word is looked up once, whatever the number of packs, and so are labels and codes of links.

A page or text is read in one Arrow pass, by the patterns of functions.html and dictionaries. operators.classify has the
same rules as column expressions, for use inside a row's lambda functions.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.scripts import KEEP, LONGEST_WORD, MOST_WORDS, TOKEN, script_of
from ..functions.urls import AMBIGUOUS_PATH_CODES
from ..sources.languages import Pack, code_map, label_map

# Least words and share of the strongest language's, least letters of a script, longest label of a link,
# texts of links that lead to a choice of languages, and what may stand before a language's name.
MIN_WORDS, MIN_RATIO, MIN_SCRIPT_CHARS, LONGEST_LABEL = 4, 0.35, 40, 48
SWITCH_PHRASES = ("newid iaith", "change language", "changer de langue", "cambiar idioma", "sprache ändern", "sprache andern")
NAMED_AFTER = ("language ", "view in ", "in ")
_SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")



def _here(pattern: str) -> re.Pattern:
    """A pattern as this language writes code points and the end of a text."""
    pattern = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)
    return re.compile(pattern.replace(r"\z", r"\Z"), re.ASCII)


_TOKEN, _KEEP, _PATH_CODE, _HTML_LANG = (_here(p) for p in (TOKEN, KEEP, H.PATH_CODE, H.HTML_LANG))
_BEFORE_BODY, _COMMENT, _HIDDEN, _TAG, _ENTITY = (_here(p) for p in (H.BEFORE_BODY, H.COMMENT, H.HIDDEN, H.TAG, H.ENTITY))
_LINK, _HREFLANG, _LINK_HREF, _ANCHOR, _HREF = (_here(p) for p in (H.LINK, H.HREFLANG, H.LINK_HREF, H.ANCHOR, H.HREF))
_NAMES, _SCORES = pa.list_(pa.string()), pa.list_(pa.struct([("language", pa.string()), ("n", pa.int64())]))
_WORDS_SAY = pa.struct([("by_script", _NAMES), ("by_words", _NAMES), ("content", _NAMES), ("scores", _SCORES)])
WORDS_SAY = "struct<by_script: array<string>, by_words: array<string>, content: array<string>, scores: array<struct<language: string, n: bigint>>>"
_PAGE_SAYS = pa.struct([("languages", _NAMES), ("by_switch", _NAMES), ("by_words", _NAMES), ("by_script", _NAMES), ("primary", pa.string()), ("words", pa.int32())])
PAGE_SAYS = "struct<languages: array<string>, by_switch: array<string>, by_words: array<string>, by_script: array<string>, primary: string, words: int>"


@lru_cache(maxsize=65536)
def _kept(word: str) -> bool:
    return len(word) <= LONGEST_WORD and _KEEP.search(word) is not None


def words_in(text: str, most: int | None = None) -> list[str]:
    """The kept words of a text, the first `most` if given: as functions.html.words_of()."""
    words = (w for w in _TOKEN.findall(text.lower()) if _kept(w))
    return list(words if most is None else islice(words, most))


def visible_words(html: str, most: int = MOST_WORDS) -> list[str]:
    """As functions.html.visible_words()."""
    text = _BEFORE_BODY.sub("", html)
    for pattern in (_COMMENT, _HIDDEN, _TAG, _ENTITY):
        text = pattern.sub(" ", text)
    return words_in(text, most)


@lru_cache(maxsize=65536)
def _script(letter: str) -> str | None:
    return script_of(letter)


def _letter(c: str) -> str:
    """A letter without its case, one by one: what has no single upper or lower form stays."""
    up = c.upper() if len(c.upper()) == 1 else c
    return up.lower() if len(up.lower()) == 1 else up


def folded(text: str) -> str:
    return text.lower() if text.isascii() else "".join(map(_letter, text))


def label_of(inner: str) -> str:
    """The text of a link: without tags, white space as single spaces."""
    return _SPACES.sub(" ", _TAG.sub(" ", inner)).strip(" ")


def subtag(code: str | None) -> str | None:
    code = (code or "").replace("_", "-").strip(" ").lower()
    return code.split("-")[0] if code not in ("", "x-default") else None


class Index:
    """Packs by word, by code and by label."""

    def __init__(self, packs: list[Pack]):
        self.packs, self.codes, self.labels = packs, code_map(packs), label_map(packs)
        self.folded_labels = {folded(label) for label in self.labels}
        self.phrases = {folded(p) for p in SWITCH_PHRASES}
        self.of_word: dict[str, tuple[int, ...]] = {}
        for i, p in enumerate(packs):
            for w in p.words:
                self.of_word[w] = (*self.of_word.get(w, ()), i)
        #: Packs with a word that has no letter of the pack's scripts, and the scripts that may rule them out.
        self.odd = {i for i, p in enumerate(packs) if p.words and p.scripts and not all(any(script_of(c) in p.scripts for c in w) for w in p.words)}
        self.listed_scripts = {s for p in packs if p.words for s in p.scripts}
        self.exclusive = [p for p in packs if p.exclusive]
        self.scripted = [p for p in packs if p.exclusive or p.script_sufficient]
        self.order = {p.name: p.order for p in packs}
        self.suppressing = [(p.name, set(p.suppresses)) for p in packs if p.suppresses]
        self.digraphs = [(p, re.compile(f"(?<=[{p.sign.leaders}]){p.sign.letter}")) for p in packs if p.sign and p.sign.mode == "digraph"]
        self.shares = [p for p in packs if p.sign and p.sign.mode == "vowel_share"]

    # --- links ---

    def code(self, code: str | None) -> str | None:
        return self.codes.get(subtag(code))

    def switcher(self, label: str) -> bool:
        """Whether a link's text is a language's name, alone or after a word for it, or asks for a choice of languages."""
        if len(label) > LONGEST_LABEL:
            return False
        text, names = folded(label), self.folded_labels
        if text in names or text in self.phrases:
            return True
        if text.startswith("language"):
            rest = text[8:].removeprefix(" ")
            if rest in names or rest[:1] in (":", "-") and rest[1:].removeprefix(" ") in names:
                return True
        rest = text.removeprefix("view ")
        return rest in names or rest.removeprefix("in ") in names

    def link(self, attributes: str, inner: str) -> list[str]:
        """The languages that a link names, if it is a switcher: by its text, its hreflang and its path."""
        label = label_of(inner)
        if not self.switcher(label):
            return []
        low = label.lower()
        name = next((low[len(p) :] for p in NAMED_AFTER if low.startswith(p)), low)
        out = [self.labels.get(name)]
        if lang := _HREFLANG.search(attributes):
            out.append(self.code(lang[1]))
        if (href := _HREF.search(attributes)) and (code := _PATH_CODE.search(href[1].lower())) and code[1] not in AMBIGUOUS_PATH_CODES:
            out.append(self.codes.get(code[1]))
        return [x for x in out if x is not None]

    def switches(self, declared: str | None, links: list[str | None], attributes: list[str], inner: list[str]) -> set[str]:
        found = {self.code(c) for c in (declared, *links)}
        for a, i in zip(attributes, inner):
            found.update(self.link(a, i))
        return found - {None}

    # --- words ---

    def suppressed(self, found: list[str]) -> list[str]:
        """Packs in order; one that is still there removes those it suppresses."""
        left = dict.fromkeys(found)
        for name, gone in self.suppressing:
            if name in left:
                left = {x: None for x in left if x not in gone}
        return list(left)

    def counts(self, text: str) -> tuple[Counter, Counter]:
        """How often each letter, and letters of each script, are in a text."""
        letters, scripts = Counter(text), Counter()
        for c, n in letters.items():
            scripts[_script(c)] += n
        return letters, scripts

    def scores(self, words: list[str], scripts: Counter) -> dict[str, int]:
        """How many distinct words each pack lists, in the packs' order, where any."""
        n: Counter = Counter()
        for w in set(words):
            for i in self.of_word.get(w, ()):
                n[i] += 1
        on_page = {s for s in self.listed_scripts if scripts[s]} if self.odd.intersection(n) else set()
        return {self.packs[i].name: n[i] for i in sorted(n) if i not in self.odd or not on_page or on_page.intersection(self.packs[i].scripts)}

    def marked(self, letters: Counter, scripts: Counter) -> dict[str, int]:
        """Letters that only one language uses within its script, where there are enough of them."""
        out = {}
        for p in self.exclusive:
            x = p.exclusive
            if scripts[x.script] >= MIN_SCRIPT_CHARS:
                hits = sum(letters[c] for c in set(x.letters))
                if hits >= x.min_hits and hits >= scripts[x.script] * x.min_share:
                    out[p.name] = hits
        return out

    def by_script(self, text: str, letters: Counter, scripts: Counter, marked: dict[str, int]) -> list[str]:
        found = [p.name for p in self.scripted if (p.name in marked if p.exclusive else p.script_sufficient and any(scripts[s] >= MIN_SCRIPT_CHARS for s in p.scripts))]
        found = self.suppressed(found)
        total = scripts["cyrillic"]
        if total < MIN_SCRIPT_CHARS:
            return found
        after = [(p, len(pattern.findall(text))) for p, pattern in self.digraphs]
        found += [p.name for p, n in after if n >= p.sign.min_hits and p.name not in found]
        for p in self.shares:
            gone = sum(n for d, n in after if d.sign.letter == p.sign.letter and n >= d.sign.min_hits)
            if p.name not in found and not set(p.sign.blocked_by).intersection(found) and letters[p.sign.letter] - gone >= total * p.sign.min_share:
                found.append(p.name)
        return found

    def words_say(self, words: list[str]) -> dict:
        """by_script, by_words, content and scores of a page's words, and marked letters."""
        text = " ".join(words)
        letters, scripts = self.counts(text)
        scores, marked = self.scores(words, scripts), self.marked(letters, scripts)
        by_script = self.by_script(text, letters, scripts, marked)
        top = max(scores.values(), default=0)
        by_words = [k for k, n in scores.items() if n >= MIN_WORDS and n >= top * MIN_RATIO]
        return {"by_script": by_script, "by_words": by_words, "content": self.suppressed(by_script + by_words), "scores": scores, "marked": marked}

    # --- pages ---

    def primary(self, available: list[str], scores: dict[str, int], marked: dict[str, int], path: str | None, declared: str | None) -> str | None:
        """The one available language; else the path's, then the declared one, if available and scored; else the best score."""
        if len(available) < 2:
            return available[0] if available else None
        names = [*scores, *(k for k in marked if k not in scores)]
        rank = lambda k: (scores.get(k, 0) + marked.get(k, 0), k in available, scores.get(k, 0) > 0, -self.order[k], k)
        trusted = [c for c in (path, declared) if c in available and c in names]
        best = max(names, key=rank, default=None)
        return next(c for c in (*trusted, best, declared, path, available[0]) if c is not None)

    def page_says(self, html: str, path: str | None) -> dict:
        """PAGE_SAYS of a page and the language code of its path."""
        found = _HTML_LANG.search(html)
        declared, words = found and found[1], visible_words(html)
        links = [_HREFLANG.search(t)[1] for t in _LINK.findall(html) if _HREFLANG.search(t) and _LINK_HREF.search(t)]
        anchors = _ANCHOR.findall(html)
        said, switch = self.words_say(words), self.switches(declared, links, [a for a, _ in anchors], [i for _, i in anchors])
        languages = sorted(switch.union(said["content"]))
        primary = self.primary(languages, said["scores"], said["marked"], self.code(path), self.code(declared))
        return {"languages": languages, "by_switch": sorted(switch), "by_words": sorted(said["by_words"]), "by_script": sorted(said["by_script"]), "primary": primary, "words": len(words)}


def _said(rows) -> pa.Array:
    return pa.array([{**{k: r[k] for k in ("by_script", "by_words", "content")}, "scores": [{"language": k, "n": n} for k, n in r["scores"].items()]} for r in rows], _WORDS_SAY)


def words_say(words: Column, packs: list[Pack]) -> Column:
    """WORDS_SAY of a list of words; lists are not sorted. A null list is empty."""
    index = Index(packs)

    @F.arrow_udf(WORDS_SAY)
    def say(words: pa.Array) -> pa.Array:
        return _said(index.words_say(w.as_py() or []) for w in words)

    return say.asNondeterministic()(words)  # evaluated once, wherever its fields are used


def text_says(text: Column, packs: list[Pack], most: int | None = None) -> Column:
    """WORDS_SAY of a text's words, the first `most` if given. A null text is empty."""
    index = Index(packs)

    @F.arrow_udf(WORDS_SAY)
    def say(texts: pa.Array) -> pa.Array:
        return _said(index.words_say(words_in(t.as_py() or "", most)) for t in texts)

    return say.asNondeterministic()(text)


def page_says(html: Column, path: Column, packs: list[Pack]) -> Column:
    """PAGE_SAYS of a page's html (null: empty) and the language code of its path; lists are sorted."""
    index = Index(packs)

    @F.arrow_udf(PAGE_SAYS)
    def say(html: pa.Array, path: pa.Array) -> pa.Array:
        return pa.array([index.page_says(h.as_py() or "", p.as_py()) for h, p in zip(html, path)], _PAGE_SAYS)

    return say.asNondeterministic()(html, path)
