"""The languages of a page: language switchers, distinctive words and writing systems, united.

A page is a row with an id and its html or words; packs are an argument. Everything is told from the row itself: no
shuffle, no join, and rows that share an id, or have none, have answers of their own. Whole tables are told by one index
of all packs (operators.index); the column expressions here say the same where a page's prefixes are tried in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.hold import hold, let
from ..functions.scripts import letter_class, letter_hits, ranges, script_chars, script_of
from ..functions.urls import AMBIGUOUS_PATH_CODES, path_code
from ..sources.languages import Pack, code_map, label_map
from .index import page_says, text_says, words_say

MIN_WORDS, MIN_RATIO, MIN_SCRIPT_CHARS = 4, 0.35, 40
LONGEST_LABEL = 48
# Texts of links that lead to a choice of languages.
SWITCH_PHRASES = ("newid\\s+iaith", "change\\s+language", "changer\\s+de\\s+langue", "cambiar\\s+idioma", "sprache\\s+ändern", "sprache\\s+andern")


#: Between the members of a list or map that is made of one literal; the optimizer folds it once, whatever its length.
_NEXT, _IS = "\x1f", "\x1e"


def _map(values: dict[str, str]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.str_to_map(F.lit(_NEXT.join(f"{k}{_IS}{v}" for k, v in values.items())), F.lit(_NEXT), F.lit(_IS))


def _strings(values) -> Column:
    values = list(values)
    return F.split(F.lit(_NEXT.join(values)), _NEXT) if values else F.array().cast("array<string>")


def _found(*flags: tuple[str, Column]) -> Column:
    """The names whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags])) if flags else _strings(())


def code_language(code: Column, packs: list[Pack]) -> Column:
    return F.try_element_at(_map(code_map(packs)), H.primary_subtag(code))


def switch_languages(html: Column, packs: list[Pack]) -> Column:
    """Languages that <html lang>, <link hreflang> and anchors labelled as switchers name; unsorted, repeats left in."""
    labels, codes = label_map(packs), _map(code_map(packs))
    alternatives = "|".join("\\Q" + w + "\\E" for w in sorted(labels, key=lambda w: (-len(w), w)))
    gate = (
        rf"(?isU)^(?:(?:{alternatives})|language\s*[:\-]?\s*(?:{alternatives})|(?:view\s+)?(?:in\s+)?(?:{alternatives})"
        rf"|{'|'.join(SWITCH_PHRASES)})$"
    )
    code = lambda c: F.try_element_at(codes, H.primary_subtag(c))
    anchors = F.regexp_extract_all(html, F.lit(H.ANCHOR), F.lit(0))
    label = lambda a: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(a, H.ANCHOR, 2), H.TAG, " "), r"(?U)\s+", " "))
    switchers = F.filter(anchors, lambda a: (F.length(label(a)) <= LONGEST_LABEL) & label(a).rlike(gate))
    attrs = lambda a: F.regexp_extract(a, H.ANCHOR, 1)
    named = F.transform(switchers, lambda a: F.try_element_at(_map(labels), F.regexp_replace(F.lower(label(a)), r"^(?:language|view in|in) ", "")))
    by_attr = F.transform(switchers, lambda a: code(F.nullif(F.regexp_extract(attrs(a), H.HREFLANG, 1), F.lit(""))))

    def by_path(a: Column) -> Column:
        c = F.regexp_extract(F.lower(F.regexp_extract(attrs(a), H.HREF, 1)), H.PATH_CODE, 1)
        return F.when((c != "") & ~c.isin(*AMBIGUOUS_PATH_CODES), F.try_element_at(codes, c))

    return F.array_compact(F.concat(F.array(code(H.html_lang(html))), F.transform(H.link_langs(html), code), named, by_attr, F.transform(switchers, by_path)))


def suppress(found: Column, packs: list[Pack]) -> Column:
    """Packs in order; one that is still there removes those it suppresses."""
    rules = [F.struct(F.lit(p.name).alias("name"), _strings(p.suppresses).alias("gone")) for p in packs if p.suppresses]
    if not rules:
        return found
    return F.aggregate(F.array(*rules), found, lambda left, rule: F.when(F.array_contains(left, rule["name"]), F.array_except(left, rule["gone"])).otherwise(left))


def _adds(p: Pack, enough: Column):
    """found -> found with the pack's language, if `enough` holds and nothing found blocks it."""

    def use(found: Column) -> Column:
        free = ~F.arrays_overlap(found, _strings(p.sign.blocked_by)) if p.sign.blocked_by else F.lit(True)
        return F.when(free & enough, F.array_union(found, _strings([p.name]))).otherwise(found)

    return use


def script_languages(text: Column, packs: list[Pack]) -> Column:
    """Languages that the letters of text (words, lower case, with spaces between) show.

    Suppression is applied before the Cyrillic signs: letters after leaders first, then the share of a vowel without
    those that stood after leaders. A language found by a share blocks those of the packs after it.
    """
    used = sorted({"cyrillic"} | {p.exclusive.script for p in packs if p.exclusive} | {s for p in packs if p.script_sufficient for s in p.scripts})

    def from_counts(chars: Column) -> Column:
        flags = []
        for p in packs:
            if p.exclusive:
                total, hits = chars[p.exclusive.script], letter_hits(text, p.exclusive.letters)
                flags.append((p.name, (total >= MIN_SCRIPT_CHARS) & (hits >= p.exclusive.min_hits) & (hits >= total * p.exclusive.min_share)))
            elif p.script_sufficient:
                enough = F.lit(False)
                for s in p.scripts:
                    enough = enough | (chars[s] >= MIN_SCRIPT_CHARS)
                flags.append((p.name, enough))
        return let(suppress(_found(*flags), packs), lambda found: F.when(chars["cyrillic"] >= MIN_SCRIPT_CHARS, signed(found, chars["cyrillic"])).otherwise(found))

    def signed(found: Column, total: Column) -> Column:
        after = [(p, F.regexp_count(text, F.lit(f"(?<=[{p.sign.leaders}]){p.sign.letter}"))) for p in packs if p.sign and p.sign.mode == "digraph"]
        found = F.array_union(found, _found(*[(p.name, n >= p.sign.min_hits) for p, n in after]))
        for p in packs:
            if p.sign and p.sign.mode == "vowel_share":
                gone = sum([F.when(n >= d.sign.min_hits, n).otherwise(0) for d, n in after if d.sign.letter == p.sign.letter], F.lit(0))
                enough = letter_hits(text, p.sign.letter) - gone >= total * p.sign.min_share

                found = let(found, _adds(p, enough))
        return found

    # most pages have letters of Latin and Cyrillic only: one look tells whether the other scripts are to be counted
    rare = [s for s in used if s not in ("latin", "cyrillic")]
    some = text.rlike(f"[{ranges(*rare)}]") if rare else F.lit(False)
    count = lambda s, there: F.when(there, script_chars(text, s)).otherwise(0) if s in rare else script_chars(text, s)
    return let(some, lambda there: let(F.struct(*[count(s, there).alias(s) for s in used]), from_counts))


def _own_letters(p: Pack) -> bool:
    """Whether each of the pack's words has a letter of the pack's scripts, so that a page with the word has the script."""
    return all(any(script_of(c) in p.scripts for c in w) for w in p.words)


def scores_of(words: Column, text: Column, packs: list[Pack]) -> Column:
    """array<struct<language, n>>, in the packs' order: how many distinct words of the page a pack lists, where any.

    A pack in other scripts than the page's does not score. The page's scripts are looked for only if some pack lists
    words without letters of its scripts.
    """
    listed = [p for p in packs if p.words]
    if not listed:
        return F.array().cast("array<struct<language:string,n:bigint>>")
    odd = {p.name for p in listed if p.scripts and not _own_letters(p)}
    index = F.array(*[F.struct(F.lit(p.name).alias("language"), _strings(p.words).alias("words"), _strings(p.scripts if p.name in odd else ()).alias("scripts")) for p in listed])
    on_page = _found(*[(s, text.rlike(letter_class(s))) for s in sorted({s for p in listed for s in p.scripts}) if odd])
    # the second list of an intersection is the one that is hashed: the shorter
    known = F.array_intersect(_strings(sorted({w for p in listed for w in p.words})), words)

    def scored(x: Column) -> Column:
        fits = lambda p: (F.size(p["scripts"]) == 0) | (F.size(x["on"]) == 0) | F.arrays_overlap(p["scripts"], x["on"])
        each = F.transform(index, lambda p: F.struct(p["language"].alias("language"), F.when(fits(p), F.size(F.array_intersect(p["words"], x["known"]))).otherwise(0).cast("long").alias("n")))
        return F.filter(each, lambda s: s["n"] > 0)

    return let(F.struct(known.alias("known"), on_page.alias("on")), scored)


def languages_of_scores(scores: Column) -> Column:
    """Languages with enough words and enough of the strongest language's."""
    top = F.array_max(F.transform(scores, lambda s: s["n"]))
    return F.transform(F.filter(scores, lambda s: (s["n"] >= MIN_WORDS) & (s["n"] >= top * MIN_RATIO)), lambda s: s["language"])


def _say(rows: DataFrame, packs: list[Pack], most: int | None) -> Column:
    """WORDS_SAY of rows with `words`, else with `text`."""
    return words_say(F.col("words"), packs) if "words" in rows.columns else text_says(F.col("text"), packs, most)


def word_scores(rows: DataFrame, packs: list[Pack], key: str = "id", most: int | None = None) -> DataFrame:
    """rows (key, words or text) -> (key, language, n): the distinct words of a row that a pack lists, for each row by itself.

    Of a text the first `most` words if given.
    """
    return rows.select(key, _say(rows, packs, most).alias("s")).select(key, F.explode("s.scores").alias("s")).select(key, "s.language", "s.n")


def word_languages(rows: DataFrame, packs: list[Pack], key: str = "id", most: int | None = None) -> DataFrame:
    """rows as of word_scores() -> (key, by_words), of rows with any score: see languages_of_scores()."""
    said = rows.select(key, _say(rows, packs, most).alias("s"))
    return said.where(F.size("s.scores") > 0).select(key, "s.by_words")


def content_languages(words: Column, packs: list[Pack]) -> Column:
    """struct<by_script, by_words, content, scores, text> of a page's words; content: both, suppressed. All lists unsorted."""

    def of_text(text: Column) -> Column:
        def of_scores(scores: Column) -> Column:
            found = F.struct(script_languages(text, packs).alias("by_script"), languages_of_scores(scores).alias("by_words"))
            return let(found, lambda x: F.struct(x["by_script"].alias("by_script"), x["by_words"].alias("by_words"), suppress(F.array_union(x["by_script"], x["by_words"]), packs).alias("content"), scores.alias("scores"), text.alias("text")))

        return let(scores_of(words, text, packs), of_scores)

    return let(F.array_join(words, " "), of_text)


def classify_words(words: Column, packs: list[Pack]) -> Column:
    """The sorted languages of a list of words, without switchers."""
    return _tidy(words_say(words, packs)["content"])


def _tidy(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def classify(pages: DataFrame, packs: list[Pack], key: str = "id", html: str = "html") -> DataFrame:
    """(key, languages, by_switch, by_words, by_script): sorted lists of each row; nothing found is the empty list."""
    said = pages.select(F.col(key), page_says(F.col(html), F.lit(None).cast("string"), packs).alias("s"))
    return said.select(key, "s.languages", "s.by_switch", "s.by_words", "s.by_script")


def classify_snapshots(pages: DataFrame, packs: list[Pack], html: str = "html", url: str = "url") -> DataFrame:
    """pages with primary, available (sorted) and words (how many were read): the label of each row's landing page.

    primary is the one language of the text. One available language is it; else the path's, then the declared one, if
    available and scored; else the best score, available ones first on ties, then pack order, languages scored by
    letters alone last. A null html has no label; columns of these names are replaced, others pass.
    """
    others = [c for c in pages.columns if c not in ("primary", "available", "words")]
    said = pages.select(*others, page_says(F.col(html), path_code(F.col(url)), packs).alias("_s"))
    return said.select(*others, F.col("_s.primary").alias("primary"), F.col("_s.languages").alias("available"), F.col("_s.words").alias("words"))


def primary_language(pages: DataFrame, packs: list[Pack], key: str = "id", html: str = "html", url: str = "url") -> DataFrame:
    """(key, primary) of each row: see classify_snapshots()."""
    return classify_snapshots(pages.select(key, html, url), packs, html, url).select(key, "primary")


#: Words that a page must have for its label to count in a history.
MIN_WORDS_FOR_LABEL = 25


def usable(words: Column, available: Column) -> Column:
    """Whether a label counts: enough words were read and something was found."""
    return (words >= MIN_WORDS_FOR_LABEL) & (F.size(available) > 0)


def label_state(primary: Column, available: Column, track: str = "primary") -> Column:
    """What must stay the same within an interval: the primary language, or with track `available` the list too."""
    if track not in ("primary", "available"):
        raise ValueError(f"track {track}")
    return F.struct(primary.alias("primary")) if track == "primary" else F.struct(primary.alias("primary"), available.alias("available"))


def early_languages(pages: DataFrame, packs: list[Pack], key: str = "id", html: str = "html", *, step: int = 16384, most: int = 192_000) -> DataFrame:
    """(key, n_chars, languages): the shortest prefix, in steps, that decides a page and what it says; no row if none does.

    Two languages in switchers decide at once; else a body with all the words that are read and any language. A page's
    prefixes are tried in turn within its row and no further than the first that decides.
    """
    text = F.substring(F.coalesce(F.col(html), F.lit("")), 1, most)
    read = pages.select(F.col(key), text.alias("_text"))
    cuts = F.sequence(F.lit(1), F.greatest(F.ceil(F.length("_text") / step).cast("int"), F.lit(1)))

    def said(prefix: Column) -> Column:
        def by_words(words: Column, switch: Column) -> Column:
            full = prefix.rlike("(?i)<body") & (F.size(words) == H.MOST_WORDS)
            return F.when(full, let(_tidy(F.array_union(switch, content_languages(words, packs)["content"])), lambda found: F.when(F.size(found) > 0, found)))

        return let(_tidy(switch_languages(prefix, packs)), lambda switch: F.when(F.size(switch) >= 2, switch).otherwise(let(H.visible_words(prefix), lambda words: by_words(words, switch))))

    def attempt(n: Column) -> Column:
        prefix = F.substring(F.col("_text"), F.lit(1), n * step)
        return let(prefix, lambda p: let(said(p), lambda found: F.when(found.isNotNull(), F.struct(F.length(p).alias("n_chars"), found.alias("languages")))))

    none = F.lit(None).cast("struct<n_chars:int,languages:array<string>>")
    tried = F.aggregate(cuts, none, lambda done, n: F.when(done.isNotNull(), done).otherwise(attempt(n)))
    return hold(read.select(key, "_text"), _best=tried).where("_best is not null").select(key, "_best.*")
