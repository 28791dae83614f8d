"""Sites as records: unique URLs, label merging, upserts and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Labels of an older data format.
LEGACY = {"english": ["english"], "welsh": ["welsh"], "english+welsh": ["english", "welsh"], "fetch_failed": [], "too_little_text": [], "unknown": []}
UNLABELLED = ("", "unknown", "fetch_failed", "too_little_text")


def _none() -> Column:
    return F.array().cast("array<string>")


def _legacy(name: Column, known: list[str]) -> Column:
    """The names that an older label stands for; null where it is none, or the name of a language now."""
    pairs = [(k, v) for k, v in LEGACY.items() if k not in known]
    table = F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.array(*[F.lit(w) for w in v]).cast("array<string>"))])
    return F.try_element_at(table, name)


def normalize_languages(values: Column, known: list[str]) -> Column:
    """A list of names, distinct and sorted; labels of the older format are what they stand for, other names go."""
    one = lambda v: F.coalesce(_legacy(v, known), F.when(v.isin(*known), F.array(v)), _none())
    low = F.transform(F.filter(F.coalesce(values, _none()), lambda v: v.isNotNull()), lambda v: F.lower(F.trim(v)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(low, one))))


def migrate_languages(sites: DataFrame, known: list[str], languages: str = "language") -> DataFrame:
    """sites with a tidy list of languages and `changed`, whether it was something else before."""
    old = F.col(languages)
    tidy = normalize_languages(old, known)
    return sites.select(*[tidy.alias(c) if c == languages else F.col(c) for c in sites.columns], (~old.eqNullSafe(tidy)).alias("changed"))


def good_label(values: Column, known: list[str]) -> Column:
    """Whether a list names any language."""
    return F.size(normalize_languages(values, known)) > 0


def merge_label(new: Column, previous: Column) -> Column:
    """The new list unless it is empty; else the previous one, or the empty list."""
    return F.when(F.size(new) > 0, new).otherwise(F.coalesce(previous, F.array().cast("array<string>")))


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key by an explicit order; rank limits are pushed below the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def unique_urls(sites: DataFrame, url: str, row: str) -> DataFrame:
    """(url, first_row) in first-seen order, by partial aggregation: no list of a URL's rows is ever gathered."""
    return sites.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("url")).agg(F.min(row).alias("first_row"))


#: Rows of a range of shard(), and its most ranges.
RANGE_ROWS, MOST_RANGES = 100_000, 1000


def shard(urls: DataFrame, k: int, n: int, order: str = "first_row") -> DataFrame:
    """Every n-th URL from the k-th, by the position in first-seen order (`order`: distinct numbers).

    Rows are dealt to ranges of `order`; positions come from the ranges' sizes and the places within them. A range is
    told from the value alone, so it does not matter how often or where it is computed, and no task orders all rows.
    """
    if not 0 <= k < n:
        raise ValueError(f"shard {k}/{n}")
    ranges = min(MOST_RANGES, urls.count() // RANGE_ROWS + 1)
    cuts = sorted(set(urls.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    bounds = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")
    dealt = urls.withColumn("_part", F.aggregate(bounds, F.lit(0), lambda at, c: at + (c < F.col(order)).cast("int")))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    local = dealt.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(order)))
    position = F.col("_before") + F.col("_at") - 1
    return local.join(F.broadcast(before), "_part").withColumn("position", position.cast("long")).where(F.col("position") % n == k).drop("_part", "_at", "_before")


def _says(df: DataFrame, column: str) -> Column:
    """Whether a value says something: not null, empty, zero or false."""
    kind, c = df.schema[column].dataType.simpleString(), F.col(column)
    if kind.startswith(("array", "map")):
        return c.isNotNull() & (F.size(c) > 0)
    if kind == "string":
        return c.isNotNull() & (c != "")
    if kind == "boolean" or kind.startswith("struct"):
        return F.coalesce(c, F.lit(False)) if kind == "boolean" else c.isNotNull()
    return c.isNotNull() & (c != F.lit(0).cast(kind)) if kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")) else c.isNotNull()


def _one_row(df: DataFrame, key: list[str], sticky: list[str], order: str | None, name: str) -> DataFrame:
    """One row a key: the last by `order`, with the first sticky values that say something."""
    rest = [c for c in df.columns if c not in (*key, order)]
    at = F.col(order) if order and order in df.columns else F.struct(*rest)
    firsts = [F.min(F.when(_says(df, c), F.struct(at.alias("at"), F.col(c).alias("v")))).alias(f"{name}{c}") for c in sticky if c in rest]
    last = F.max_by(F.struct(*rest), at).alias("_last")
    done = df.groupBy(*key).agg(last, *firsts)
    said = [F.col(f"{name}{c}.v").alias(f"{name}said_{c}") for c in sticky if c in rest]
    return done.select(*key, F.lit(True).alias(name), *said, *[F.col(f"_last.{c}").alias(f"{name}{c}") for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: list[str], sticky: list[str], order: str | None = None) -> DataFrame:
    """Rows of new over rows of old by key; a sticky column keeps its old value where that says something.

    Nulls, empty lists and texts, zeros and false say nothing. Of rows of one side that share a key the last by `order`
    (a column of that side that is not kept, or the greatest row where there is none) counts, with the first of their
    sticky values that says something.
    """
    rest = [c for c in old.columns if c not in (*key, order)]
    o, n = _one_row(old, key, sticky, order, "_o_"), _one_row(new, key, sticky, order, "_n_")

    def pick(c: str) -> Column:
        own = F.when(F.col("_n_"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))
        return F.coalesce(F.col(f"_o_said_{c}"), F.col(f"_n_said_{c}"), own) if c in sticky else own

    return o.join(n, key, "full_outer").select(*key, *[pick(c).alias(c) for c in rest])


def combination_counts(df: DataFrame, languages: str) -> DataFrame:
    """(combo, n): how many rows have each list; `unknown` for none."""
    return df.groupBy(F.coalesce(F.nullif(F.array_join(languages, ","), F.lit("")), F.lit("unknown")).alias("combo")).agg(F.count(F.lit(1)).alias("n"))


def presence_counts(df: DataFrame, languages: str) -> DataFrame:
    """(language, n): how many rows have each language in their list."""
    some = F.when(F.size(languages) > 0, F.col(languages)).otherwise(F.array(F.lit("unknown")))
    return df.select(F.explode(some).alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def most_common(counts: DataFrame, key: str, most: int, n: str = "n") -> DataFrame:
    """The `most` greatest counts (key, n) with their place, the least key first of equals: a report, so it is cut."""
    top = counts.orderBy(F.desc(n), key).limit(most)
    return top.select(key, n, F.row_number().over(W.orderBy(F.desc(n), key)).alias("place"))  # `most` rows


def unlabelled(languages: Column) -> Column:
    """Whether a list says nothing: null, empty, or only labels of failures."""
    said = F.filter(languages, lambda v: ~F.lower(F.trim(v)).isin(*UNLABELLED))
    return F.coalesce(F.size(said) <= 0, F.lit(True))


def previous_labels(sites: DataFrame, url: str, languages: str, row: str) -> DataFrame:
    """(url, languages): of each URL the first list, by row, that is not empty."""
    some = sites.where(F.col(url).isNotNull() & (F.size(languages) > 0))
    return some.groupBy(F.col(url).alias("url")).agg(F.min_by(languages, row).alias("languages"))


def annotate(sites: DataFrame, labels: DataFrame, url: str, languages: str) -> DataFrame:
    """sites with the languages that labels (url, languages) have for their URL, laid over their own by merge_label.

    Of several labels of a URL the least that names a language counts, so that no site is doubled.
    """
    named = F.when(F.size("languages") > 0, F.col("languages"))
    found = labels.groupBy(F.col("url").alias("_url")).agg(F.min(named).alias("_languages"))
    joined = sites.join(found, F.col(url) == F.col("_url"), "left")
    merged = merge_label(F.coalesce("_languages", F.array().cast("array<string>")), F.col(languages) if languages in sites.columns else F.lit(None).cast("array<string>"))
    return joined.withColumn(languages, merged).drop("_url", "_languages")


def site_sample(sites: DataFrame, most: int, key: list[str], order: str) -> DataFrame:
    """The first `most` sites by an explicit order, each key once: a sampling operator for quick looks at a region."""
    return first_per_key(sites, key, [order]).orderBy(order).limit(most)
