"""The language of a place's name in regions with two languages, from its letters, words and name tags."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scripts import letter_hits

# Letters that only one language of a pair uses.
UK_MARKS, RU_MARKS = "їєґ", "ыэё"


def ukrainian_or_russian(name: Column) -> Column:
    """By marks; an і counts two for Ukrainian; a tie or no mark: null."""
    text = F.lower(F.coalesce(name, F.lit("")))
    uk = letter_hits(text, UK_MARKS) + F.when(F.contains(text, F.lit("і")), 2).otherwise(0)
    ru = letter_hits(text, RU_MARKS)
    return F.when(uk > ru, "ukrainian").when(ru > uk, "russian")


def marked_or_plain(marks: str, words: list[str], marked: str, plain: str):
    """A classifier of Latin names: any mark or listed word says `marked`, any letter a-z else `plain`."""

    def of(name: Column) -> Column:
        text = F.lower(F.trim(F.coalesce(name, F.lit(""))))
        hit = (letter_hits(text, marks) > 0) if marks else F.lit(False)
        if words:
            tokens = F.regexp_extract_all(text, F.lit(r"[\p{L}']+"), F.lit(0))
            hit = hit | F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
        return F.when(hit, marked).when(text.rlike("[a-z]"), plain)

    return of


def by_tags(name: Column, first_tag: Column, second_tag: Column, first: str, second: str, classify) -> tuple[Column, Column]:
    """(primary, available): by the name's letters, else by the tag the name equals, the first tag before the second."""
    a, b, n = (F.trim(F.coalesce(c, F.lit(""))) for c in (first_tag, second_tag, name))
    by_name = classify(n)
    same = lambda t: (n != "") & (t != "") & (F.lower(n) == F.lower(t))
    primary = F.coalesce(by_name, F.when(same(a), first).when(same(b), second))
    tags = F.array(F.when(a != "", F.lit(first)), F.when(b != "", F.lit(second)), by_name)
    return primary, F.array_sort(F.array_distinct(F.array_compact(tags)))


# Letters and words of names that show the first language of a region.
KK_MARKS, KK_LATIN_MARKS = "әғқңөұүһ", "äğñöüşı"
WELSH_MARKS, FRENCH_MARKS, ESTONIAN_MARKS, DANISH_MARKS = "ŵŷẁẃẅỳýÿ", "éèêëàâùûçœæ", "õäöü", "æøå"
WELSH_WORDS = (
    "siop", "ysgol", "caffi", "tafarn", "capel", "eglwys", "swyddfa", "llyfrgell", "meddygfa", "fferyllfa", "cymru", "cymraeg", "gymraeg", "ganolfan", "canolfan",
    "gwesty", "bwyd", "bara", "gofal", "cartref", "deintydd", "optegydd", "marchnad", "cwmni", "cyngor", "llywodraeth", "menter", "croeso", "cymdeithas",
)
FRENCH_WORDS = (
    "depanneur", "dépanneur", "epicerie", "épicerie", "boulangerie", "patisserie", "pâtisserie", "fromagerie", "coiffure", "pharmacie", "librairie",
    "quincaillerie", "ecole", "école", "hopital", "hôpital", "caisse", "municipale", "municipalite", "municipalité", "brasserie", "auberge",
)
GREENLANDIC_WORDS = (
    "kalaallit", "kalaallisut", "nunaat", "kommunia", "pisiniarfik", "atuarfik", "allaffeqarfik", "neqeroorut", "illorsuaq", "nunatsinni", "qeqqata",
    "sermersooq", "kujalleq", "avannaata", "qeqertalik",
)
ESTONIAN_WORDS = ("eesti", "kohvik", "raamatukogu", "vallavalitsus", "linnavalitsus", "apteek", "pagariäri", "kaubamaja", "teenindus", "kool", "haigla")
CYRILLIC = "[\\x{400}-\\x{4FF}]"

french_or_english = marked_or_plain(FRENCH_MARKS, list(FRENCH_WORDS), "french", "english")


def welsh_or_english(name: Column) -> Column:
    """Any Welsh mark or word: Welsh; any other letter, accented or not: English."""
    accented = F.lower(F.coalesce(name, F.lit(""))).rlike("[a-zàáâäéèêëîïóôöúùûü]")
    return F.coalesce(marked_or_plain(WELSH_MARKS, list(WELSH_WORDS), "welsh", "english")(name), F.when(accented, "english"))


def greenlandic_or_danish(name: Column) -> Column:
    """A Greenlandic word first, then a q without Danish letters; other Latin names are Danish."""
    text = F.lower(F.coalesce(name, F.lit("")))
    danish = letter_hits(text, DANISH_MARKS) > 0
    by_word = marked_or_plain("", list(GREENLANDIC_WORDS), "greenlandic", "other")(name)
    return F.when(by_word == "greenlandic", "greenlandic").when(F.contains(text, F.lit("q")) & ~danish, "greenlandic").when(danish | text.rlike("[a-z]"), "danish")


def kazakh_or_russian(name: Column) -> Column:
    """By marks of either script, `qazaq` counts three; Cyrillic without any Kazakh mark is Russian."""
    text = F.lower(F.coalesce(name, F.lit("")))
    kk = letter_hits(text, KK_MARKS + KK_LATIN_MARKS) + F.when(F.contains(text, F.lit("qazaq")), 3).otherwise(0)
    ru = letter_hits(text, RU_MARKS)
    return F.when(kk > ru, "kazakh").when(ru > kk, "russian").when(text.rlike(CYRILLIC) & (kk == 0), "russian")


def estonian_or_russian(name: Column) -> Column:
    latin = marked_or_plain(ESTONIAN_MARKS, list(ESTONIAN_WORDS), "estonian", "estonian")(name)
    return F.when(F.coalesce(name, F.lit("")).rlike(CYRILLIC), "russian").otherwise(latin)


@dataclass(frozen=True)
class Region:
    """Two languages with the name tags that mark them, a classifier of names, and the language whose gains are counted."""

    first: str
    first_tag: str
    second: str
    second_tag: str
    classify: Callable[[Column], Column]

    def languages(self, tags: Column) -> tuple[Column, Column]:
        """(primary, available) of a map of tags."""
        t = lambda k: F.try_element_at(tags, F.lit(k))
        return by_tags(t("name"), t(self.first_tag), t(self.second_tag), self.first, self.second, self.classify)


REGIONS = {
    "ukraine": Region("ukrainian", "name:uk", "russian", "name:ru", ukrainian_or_russian),
    "wales": Region("welsh", "name:cy", "english", "name:en", welsh_or_english),
    "greenland": Region("greenlandic", "name:kl", "danish", "name:da", greenlandic_or_danish),
    "quebec": Region("french", "name:fr", "english", "name:en", french_or_english),
    "kazakhstan": Region("kazakh", "name:kk", "russian", "name:ru", kazakh_or_russian),
    "estonia": Region("estonian", "name:et", "russian", "name:ru", estonian_or_russian),
}


def site_languages(primary: Column, available: Column) -> Column:
    """The primary language, then the others; null where the name decides none."""
    return F.when(primary.isNotNull(), F.array_union(F.array(primary), available))
