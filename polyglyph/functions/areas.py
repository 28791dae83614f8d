"""Keys, codes and levels of administrative areas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def plain_key(name: Column) -> Column:
    """Lower case, without anything but a-z and 0-9; accented letters are dropped."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


@F.pandas_udf(StringType())
def _decomposed(name: pd.Series) -> pd.Series:
    return name.str.normalize("NFKD")


def folded_key(name: Column) -> Column:
    """plain_key with accented letters as their base letters. Spark has no Unicode normalisation, so Arrow does it."""
    return plain_key(_decomposed(name))


def in_box(lat: Column, lon: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    """Inside, borders included; without coordinates or without a box: true."""
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(True))


def iso_candidates(code: Column) -> Column:
    """Codes that a shape's code may stand for, the likeliest first: as it is, with dots as dashes, its country cut to two letters."""
    code = F.coalesce(code, F.lit(""))
    cut = lambda c: F.regexp_replace(F.upper(c), r"^([A-Z]{2})[A-Z]-([^-]*).*$", "$1-$2")
    dashed = F.translate(code, ".", "-")
    forms = F.transform(F.array(code, cut(code), dashed, cut(dashed)), lambda c: iso_code(c))
    return F.array_distinct(F.filter(forms, lambda c: c != ""))


def iso_code(code: Column) -> Column:
    """An ISO 3166-2 code in its usual form, else the empty string."""
    return F.regexp_extract(F.upper(F.translate(code, "_", "-")), r"^[A-Z]{2}-[A-Z0-9]{1,3}$", 0)


def stable_id(name: Column) -> Column:
    return (F.conv(F.substring(F.sha1(name.cast("binary")), 1, 8), 16, 10).cast("long") % 900000000) + 100000000


def fix_mojibake(name: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; anything else is left as it is."""
    suspect = name.rlike("[ÃÂ]") & name.rlike(r"^[\x{00}-\x{FF}]*\z")
    again = F.decode(F.encode(F.when(suspect, name), "ISO-8859-1"), "UTF-8")
    return F.when(suspect & ~F.contains(again, F.lit("�")), again).otherwise(name)


def area_kind(level: Column) -> Column:
    n = level.try_cast("int")
    return F.when(n <= 2, "country").when(n <= 4, "subdivision_1").otherwise("subdivision_2")


def child_levels(parent: Column) -> Column:
    """Levels at which to look for children, the preferred first: 3 to 10 and below the parent."""
    best = F.when(parent <= 3, 4).when(parent <= 5, 6).otherwise(8)
    tries = F.array(best, best + 2, best - 1, best + 1)
    return F.filter(tries, lambda x: (x >= 3) & (x <= 10) & (x > parent))


def name_rank(key: Column, query: str) -> Column:
    """0 equal, 1 prefix, 2 suffix of 4 letters at least, 3 part of 5 at least; null without a match."""
    out = F.when(key == query, 0).when(F.startswith(key, F.lit(query)), 1)
    out = out.when(F.lit(len(query) >= 4) & F.endswith(key, F.lit(query)), 2)
    return out.when(F.lit(len(query) >= 5) & F.contains(key, F.lit(query)), 3)
