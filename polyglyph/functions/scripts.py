"""Writing systems: Unicode ranges, token patterns and character counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges of code points that count as a script's letters, in table order.
BLOCKS = (
    ("latin", 65, 90), ("latin", 97, 122), ("latin", 192, 214), ("latin", 216, 246), ("latin", 248, 591), ("latin", 592, 687),
    ("latin", 7680, 7935), ("latin", 42784, 43007), ("greek", 880, 1023), ("greek", 7936, 8191), ("cyrillic", 1024, 1327),
    ("armenian", 1328, 1423), ("hebrew", 1424, 1535), ("arabic", 1536, 1791), ("arabic", 1872, 1919), ("arabic", 2208, 2303),
    ("syriac", 1792, 1871), ("thaana", 1920, 1983), ("nko", 1984, 2047), ("devanagari", 2304, 2431), ("bengali", 2432, 2559),
    ("gurmukhi", 2560, 2687), ("gujarati", 2688, 2815), ("oriya", 2816, 2943), ("tamil", 2944, 3071), ("telugu", 3072, 3199),
    ("kannada", 3200, 3327), ("malayalam", 3328, 3455), ("sinhala", 3456, 3583), ("thai", 3584, 3711), ("lao", 3712, 3839),
    ("tibetan", 3840, 4095), ("myanmar", 4096, 4255), ("georgian", 4256, 4351), ("hangul", 4352, 4607), ("ethiopic", 4608, 4991),
    ("cherokee", 5024, 5119), ("syllabics", 5120, 5759), ("khmer", 6016, 6143), ("mongolian", 6144, 6319), ("hiragana", 12352, 12447),
    ("katakana", 12448, 12543), ("meitei", 43744, 43775), ("meitei", 43968, 44031), ("hangul", 44032, 55215), ("han", 19968, 40959),
    ("tifinagh", 11568, 11647),
)
# Characters of words beside the scripts' letters, and the letters that count as vowels.
WORD_EXTRAS = "'ꞌʻʼ"
VOWELS = "aeiouwyâêîôûŵŷäëïöüáéíóúẃỳàèùåæøœõāēīūůěėįųąęőűýò"
LONGEST_WORD, MOST_WORDS = 32, 200


def ranges(*scripts: str) -> str:
    """The inside of a character class of the scripts' ranges, for Java and RE2 alike; of all scripts without names.

    Ranges that touch are one: Java tests the ranges of a class one by one.
    """
    joined: list[list[int]] = []
    for a, b in sorted((a, b) for s, a, b in BLOCKS if not scripts or s in scripts):
        if joined and a <= joined[-1][1] + 1:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in joined)


ALL_SCRIPTS = tuple(dict.fromkeys(s for s, _, _ in BLOCKS))
TOKEN = f"[{ranges()}{WORD_EXTRAS}]{{2,}}"
KEEP = f"[{VOWELS}]|[{ranges(*[s for s in ALL_SCRIPTS if s != 'latin'])}]"


def keep_word(w: Column) -> Column:
    """Not too long, and either in another script than Latin or with a vowel."""
    return (F.length(w) <= LONGEST_WORD) & w.rlike(KEEP)


def script_of(letter: str) -> str | None:
    """The script of one letter; a letter outside all blocks counts as Latin, anything else has none."""
    code = ord(letter)
    return next((s for s, a, b in BLOCKS if a <= code <= b), "latin" if letter.isalpha() else None)


def letter_class(script: str) -> str:
    """A character class of the script's letters, for Java. A letter outside all blocks counts as Latin."""
    return f"[{ranges(script)}[\\p{{L}}&&[^{ranges()}]]]" if script == "latin" else f"[{ranges(script)}]"


def script_chars(text: Column, script: str) -> Column:
    """How many characters of text are in the script."""
    return F.length(text) - F.length(F.regexp_replace(text, letter_class(script), ""))


def letter_hits(text: Column, letters: str) -> Column:
    """How many characters of text are among the letters."""
    return F.length(text) - F.length(F.translate(text, letters, ""))
