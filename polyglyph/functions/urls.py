"""URL normalisation and language codes in paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path endings that are no pages, and path codes that are also something else.
NO_PAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".pdf", ".mp4", ".mp3", ".zip", ".css", ".js", ".xml", ".json", ".csv", ".doc", ".docx", ".xls", ".xlsx")
NO_URL_PREFIXES = ("javascript:", "mailto:", "tel:")
AMBIGUOUS_PATH_CODES = ("uk", "be", "el", "ro", "sk", "mo", "no", "is", "my", "gn", "om", "af", "sn", "tn", "st", "ee", "ki", "eu", "se", "bi", "ch", "as", "or", "si", "sd", "ky", "tk")
ARCHIVE_PREFIX = r"^https?://[^/]+/web/\d+[a-z_]*/"


def normalize_url(url: Column) -> Column:
    """The trimmed URL with a scheme; null for what names no page. Prefixes are told by case, endings are not."""
    url = F.regexp_replace(url, r"^\s+|\s+\z", "")
    whole = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("http://"), url))
    host = F.regexp_extract(whole, r"^https?://([^/?#]*)", 1)
    path = F.lower(F.regexp_extract(whole, r"^https?://[^/?#]*([^?#]*)", 1))
    bad = (url == "") | url.rlike("^(?:" + "|".join(NO_URL_PREFIXES) + ")") | (host == "") | path.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in NO_PAGE_SUFFIXES) + r")\z")
    return F.when(~bad, whole)


def path_code(url: Column) -> Column:
    """The first path segment of a landing URL if it is an unambiguous language code, lower case."""
    path = F.lower(F.regexp_extract(F.regexp_replace(url, ARCHIVE_PREFIX, ""), r"^(?:https?://)?[^/?#]*([^?#]*)", 1))
    code = F.regexp_extract(path, r"^/([a-z]{2,3})(?:/|$)", 1)
    return F.when((code != "") & ~code.isin(*AMBIGUOUS_PATH_CODES), code)
