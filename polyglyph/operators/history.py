"""Language histories: runs of equal states, transitions, modal values and nearest snapshots."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.urls import normalize_url
from .classify import label_state


def month_index(text: Column) -> Column:
    """year * 12 + month - 1 of yyyy-mm, yyyymm or a longer stamp of either form."""
    digits = F.regexp_replace(text, "-", "")
    return (F.substring(digits, 1, 4).cast("int") * 12 + F.substring(digits, 5, 2).cast("int") - 1).cast("int")


def month_text(index: Column) -> Column:
    return F.concat(F.lpad(F.floor(index / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((index % 12 + 1).cast("string"), 2, "0"))


def month_stamp(index: Column) -> Column:
    """The 14-digit stamp of the middle of the month."""
    return F.concat(F.regexp_replace(month_text(index), "-", ""), F.lit("15000000"))


#: Rows of a key from which on its rows are dealt to ranges of time, and the most ranges.
HOT_ROWS, MOST_RANGES = 1_000_000, 500
#: Values that are sampled for each range.
SAMPLED = 200


def _ranges(df: DataFrame, key: list[str], at: str, hot_rows: int) -> Column | None:
    """The range of `at` (of any type that has an order) that a row is in, of about hot_rows rows of the large keys; None without such keys.

    Ranges are cut at values of a sample, by the order of the column's own type; a null is in the first.
    """
    large = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    most, total = large.agg(F.max("_n"), F.sum("_n")).first()
    if most is None:
        return None
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    theirs = df.join(large.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]), same, "left_semi")
    n = min(MOST_RANGES, most // hot_rows + 1)
    share = min(1.0, n * SAMPLED / total)
    values = sorted(r[0] for r in theirs.where(F.col(at).isNotNull()).select(at).sample(share, 7).collect())  # about n * SAMPLED
    cuts = sorted({values[len(values) * i // n] for i in range(1, n)}) if values else []
    bounds = F.array(*[F.lit(c) for c in cuts]).cast(f"array<{df.schema[at].dataType.simpleString()}>")
    return F.aggregate(bounds, F.lit(0), lambda k, c: k + F.coalesce(c < F.col(at), F.lit(False)).cast("int"))


def runs(df: DataFrame, key: list[str], order: list[str], state: list[str], *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with run: the number of the run of equal states (null-safe) that the row is in, from 1.

    Where a key has more than hot_rows rows, rows are dealt to ranges of the first order column; runs are numbered
    within a key's ranges and carried over them by their first and last states, so that no task orders a large key.
    """
    now = F.struct(*state)
    block = _ranges(df, key, order[0], hot_rows)
    if block is None:
        by = W.partitionBy(*key).orderBy(*order)
        new = F.when(F.row_number().over(by) == 1, 1).otherwise(F.when(F.lag(now).over(by).eqNullSafe(now), 0).otherwise(1))
        return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_new")
    dealt = df.withColumn("_block", block)
    by = W.partitionBy(*key, "_block").orderBy(*order)
    changed = F.when((F.row_number().over(by) > 1) & ~F.lag(now).over(by).eqNullSafe(now), 1).otherwise(0)
    local = dealt.withColumn("_new", changed).withColumn("_in", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    place = F.struct(*order)
    parts = local.groupBy(*key, "_block").agg(F.max("_in").alias("_changes"), F.min_by(now, place).alias("_first"), F.max_by(now, place).alias("_last"))
    over = W.partitionBy(*key).orderBy("_block")
    starts = F.when((F.row_number().over(over) > 1) & F.lag("_last").over(over).eqNullSafe(F.col("_first")), 0).otherwise(1)
    parts = parts.withColumn("_starts", starts)
    before = F.sum("_starts").over(over.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum("_changes").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carried = parts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col("_block").alias("_kb"), before.alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)] + [F.col("_block") == F.col("_kb")]
    return local.join(carried, same).select(*df.columns, (F.col("_before") + F.col("_in")).cast("int").alias("run"))


def intervals(df: DataFrame, key: list[str], order: list[str], state: str, at: str, *, available: str | None = None, path: str | None = None, primary: str | None = None) -> DataFrame:
    """One row per run: key, run, from, to, primary, observations; with the union of `available` and the modal `path`.

    A run is of equal `state`; primary is the column of that name if one is given (a part of the state), else the state.

    Rows without anything available are left out before runs are formed, so a state goes on across them. Of equally
    frequent paths the one seen first in the run wins.
    """
    if available:
        df = df.where(F.size(available) > 0)
    with_runs = runs(df, key, order, [state])
    aggs = [F.min(at).alias("from"), F.max(at).alias("to"), F.first(primary or state).alias("primary"), F.count(F.lit(1)).alias("observations")]
    if available:
        aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(available)))).alias("available"))
    out = with_runs.groupBy(*key, "run").agg(*aggs)
    if path:
        out = out.join(modal(with_runs, [*key, "run"], path, order).withColumnRenamed(path, "landing_path"), [*key, "run"], "left")
    return out


def landing_path(url: Column) -> Column:
    """The path of a URL without parameters; `/` for none."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.coalesce(F.nullif(F.regexp_replace(path, ";[^/]*$", ""), F.lit("")), F.lit("/"))


def label_histories(observations: DataFrame, track: str = "primary", key: str = "url") -> DataFrame:
    """The intervals of each key over its observations (snapshot, date, final_url, primary, available), in whatever order they came.

    A state is the primary language, or with track `available` that and the list; primary stays the language in both.
    """
    state = label_state(F.col("primary"), F.col("available"), track)
    df = observations.withColumn("_state", state).withColumn("_path", landing_path(F.col("final_url")))
    return intervals(df, [key], ["snapshot"], "_state", "date", available="available", path="_path", primary="primary")


def listed(spans: DataFrame, key: str = "url") -> DataFrame:
    """(key, lang_history): each key's intervals in order. A history is as long as its changes, so the list is short."""
    fields = [c for c in ("from", "to", "primary", "observations", "available", "landing_path") if c in spans.columns]
    rows = F.transform(F.array_sort(F.collect_list(F.struct("run", *fields))), lambda r: F.struct(*[r[c].alias(c) for c in fields]))
    return spans.where(F.col(key).isNotNull()).groupBy(key).agg(rows.alias("lang_history"))


def with_histories(records: DataFrame, spans: DataFrame, url: str, key: str = "url") -> DataFrame:
    """records with lang_history, the list of their URL's intervals; null for a URL without any. spans: intervals() by `key`."""
    histories = listed(spans, key).withColumnRenamed(key, "_url")
    return records.drop("lang_history").join(histories, F.col(url) == F.col("_url"), "left").drop("_url")


def annotate_histories(records: DataFrame, observations: DataFrame, website: str = "website", track: str = "primary") -> DataFrame:
    """records with lang_history and history_state, from their websites and an observation log.

    A website is normalised and looked up among the observations' URLs. history_state is no_history without observations,
    no_usable_label if none of them names a language, else with_history; only then is an older lang_history replaced.
    """
    kept = F.col("lang_history") if "lang_history" in records.columns else None
    seen = observations.where(F.col("url").isNotNull()).groupBy(F.col("url").alias("_url")).agg(F.lit(True).alias("_seen"))
    new = listed(label_histories(observations, track)).select(F.col("url").alias("_key"), F.col("lang_history").alias("_new"))
    rows = records.withColumn("_site", normalize_url(F.col(website))).join(seen, F.col("_site") == F.col("_url"), "left").join(new, F.col("_site") == F.col("_key"), "left")
    said = F.when(F.col("_seen").isNull(), "no_history").when(F.col("_new").isNull(), "no_usable_label").otherwise("with_history")
    history = F.col("_new") if kept is None else F.coalesce("_new", kept)
    others = [c for c in records.columns if c not in ("lang_history", "history_state")]
    return rows.select(*others, history.alias("lang_history"), said.alias("history_state"))


def history_counts(records: DataFrame) -> DataFrame:
    """(state, n): records by history_state; of those with a history, the ones of several intervals, on one landing path or not, and `first -> last`."""
    h = F.col("lang_history")
    several = (F.col("history_state") == "with_history") & (F.size(h) > 1)
    paths = F.size(F.array_distinct(F.transform(h, lambda r: r["landing_path"]))) == 1
    first, last = h[0]["primary"], F.element_at(h, -1)["primary"]
    turn = F.when(several & ~first.eqNullSafe(last), F.concat(F.coalesce(first, F.lit("None")), F.lit(" -> "), F.coalesce(last, F.lit("None"))))
    said = F.array_compact(F.array(F.col("history_state"), F.when(several, "changed"), F.when(several & paths, "changed_same_landing_path"), F.when(several & ~paths, "changed_with_landing_path_move"), turn))
    return records.select(F.explode(said).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def modal(df: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """(key, value): the most frequent value, the first seen of equals. Counted by value first, so groups stay small."""
    counted = df.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first"))
    best = counted.groupBy(*key).agg(F.max("_n").alias("_top"))
    tops = counted.join(best, key).where(F.col("_n") == F.col("_top"))
    return tops.groupBy(*key).agg(F.min_by(value, "_first").alias(value))


def transitions(spans: DataFrame, key: list[str]) -> DataFrame:
    """(from_state, to_state, n): histories by the states of their first and last interval, where they differ."""
    ends = spans.groupBy(*key).agg(F.min_by("primary", "run").alias("from_state"), F.max_by("primary", "run").alias("to_state"), F.max("run").alias("runs"))
    return ends.where("runs > 1 and from_state <> to_state").groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def nearest(wanted: DataFrame, snapshots: DataFrame, key: str, month: str, *, drift: int = 9) -> DataFrame:
    """Each (key, month) of wanted with the nearest snapshot's month within the drift; the earlier of equals.

    The range condition becomes an equi-join: a snapshot is offered to the blocks of months its drift reaches. Rows that
    come of an explode are many more than the planner takes them for, so the join is told not to broadcast them.
    """
    width = 2 * drift + 1
    w = wanted.withColumn("_block", F.floor(F.col(month) / width))
    reach = F.explode(F.sequence(F.floor((F.col("seen") - drift) / width), F.floor((F.col("seen") + drift) / width)))
    s = snapshots.select(key, F.col(month).alias("seen")).distinct().withColumn("_block", reach)
    near = w.join(s.hint("merge"), [key, "_block"]).withColumn("_d", F.abs(F.col("seen") - F.col(month))).where(F.col("_d") <= drift)
    return near.groupBy(key, month).agg(F.min_by("seen", F.struct("_d", "seen")).alias("seen"))


def timeline(spans: DataFrame, key: list[str], first: int, last: int) -> DataFrame:
    """(key, month, primary): the state of each history in each month of [first, last] that an interval covers."""
    months = F.sequence(F.greatest(month_index(F.col("from")), F.lit(first)), F.least(month_index(F.col("to")), F.lit(last)))
    inside = spans.where((month_index(F.col("from")) <= last) & (month_index(F.col("to")) >= first))
    return inside.select(*key, "primary", F.explode(months).alias("month"))


def name_intervals(df: DataFrame, key: list[str], order: list[str], at: str) -> DataFrame:
    """Runs of equal (primary, available): key, run, from, to, primary, available, observations.

    Rows that have neither are left out before runs are formed.
    """
    with_runs = runs(df.where(F.col("primary").isNotNull() | (F.size("available") > 0)), key, order, ["primary", "available"])
    return with_runs.groupBy(*key, "run").agg(
        F.min(at).alias("from"), F.max(at).alias("to"), F.first("primary").alias("primary"), F.first("available").alias("available"), F.count(F.lit(1)).alias("observations")
    )


def with_current_names(snapshots: DataFrame, current: DataFrame, key: list[str], today: str, classify) -> DataFrame:
    """snapshots (key, date, name, primary, available) with a row of today for each key of current (key, name) that has any.

    An unchanged name keeps what its last snapshot said, so that name tags are not lost; a changed one is classified
    alone, and left out if that decides nothing.
    """
    last = snapshots.groupBy(*key).agg(F.max_by(F.struct("name", "primary", "available"), "date").alias("_last"))
    said = classify(F.col("name"))
    alone = F.struct(F.col("name"), said.alias("primary"), F.array_compact(F.array(said)).alias("available"))
    same = F.coalesce("name", F.lit("")) == F.coalesce("_last.name", F.lit(""))
    now = current.select(*key, "name").join(last, key).select(*key, F.when(same, F.col("_last")).when(said.isNotNull(), alone).alias("_now")).where("_now is not null")
    return snapshots.select(*key, "date", "name", "primary", "available").unionByName(now.select(*key, F.lit(today).alias("date"), "_now.*"))


def tracked(spans: DataFrame, key: list[str], language: str) -> DataFrame:
    """(change, n): histories of several intervals that gained or lost a language between the first and the last."""
    has = F.array_contains("available", language) | F.col("primary").eqNullSafe(language)
    ends = spans.groupBy(*key).agg(F.min_by(has, "run").alias("before"), F.max_by(has, "run").alias("after"), F.max("run").alias("runs")).where("runs > 1")
    change = F.when(~F.col("before") & F.col("after"), "gained").when(F.col("before") & ~F.col("after"), "lost")
    return ends.select(change.alias("change")).where("change is not null").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def moved(spans: DataFrame, key: list[str]) -> DataFrame:
    """(key, moved): whether a history of several intervals landed on more than one path."""
    each = spans.groupBy(*key).agg(F.max("run").alias("runs"), F.min("landing_path").alias("a"), F.max("landing_path").alias("b"), F.count_if(F.col("landing_path").isNull()).alias("none"))
    return each.where("runs > 1").select(*key, ((F.col("a") != F.col("b")) | ((F.col("none") > 0) & F.col("b").isNotNull())).alias("moved"))


class _Nearest:
    """The snapshot nearest each month, of a history's snapshots (seen, snapshot, state) by month; looked up as it is asked for."""

    def __init__(self, seen: list[int], at: list[tuple[str, str | None]], drift: int):
        self.seen, self.at, self.drift = seen, at, drift

    def get(self, month: int) -> tuple[str | None, str | None]:
        i = bisect_left(self.seen, month)
        near = [(abs(self.seen[j] - month), j) for j in (i - 1, i) if 0 <= j < len(self.seen)]
        d, j = min(near, default=(self.drift + 1, 0))
        return self.at[j] if d <= self.drift else (None, None)


def _visited(months: _Nearest, first: int, last: int, coarse: int, deepest: int = 8) -> set[str]:
    """Snapshots that a change-point search looks at.

    A coarse grid first. Only spans with different states at their ends are halved, down to single months; a midpoint
    without a usable snapshot lets both halves be tried for the first three levels.
    """
    seen: set[str] = set()

    def state(m: int) -> str | None:
        at, s = months.get(m)
        if at is not None:
            seen.add(at)
        return s

    grid = [*range(first, last, coarse), last]
    states = [state(m) for m in grid]
    open_spans = [(a, b, s, t, 0) for a, b, s, t in zip(grid, grid[1:], states, states[1:]) if s is not None and t is not None and s != t]
    while open_spans:
        a, b, s, t, depth = open_spans.pop()
        if b - a <= 1 or depth > deepest or months.get(a)[0] == months.get(b)[0] is not None:
            continue
        mid = (a + b) // 2
        m = state(mid)
        if m is None:
            halves = [(a, mid, s, t), (mid, b, s, t)] if depth < 3 else []
        else:
            halves = [h for h in ((a, mid, s, m), (mid, b, m, t)) if h[2] != h[3]]
        open_spans += [(*h, depth + 1) for h in halves]
    return seen if any(x is not None for x in states) else set()


def search_changes(snapshots: DataFrame, key: str, first: int, last: int, *, coarse: int = 84, drift: int = 9) -> DataFrame:
    """(key, snapshot): the snapshots that a change-point search of each history looks at; none without a usable grid point.

    snapshots: key, snapshot (stamp), state (null where unusable). A history is cut down to the first snapshot of each
    month before it is searched, so that a group has no more rows than there are months; which of them is nearest a month
    is looked up where the search asks, so no snapshot is handed to all the months it may be nearest to.
    """
    if first > last or coarse < 1:
        raise ValueError("the months must be in order and the step positive")
    stamped = snapshots.where(F.col("snapshot").isNotNull()).groupBy(key, "snapshot").agg(F.max("state").alias("state"))
    stamped = stamped.withColumn("seen", month_index(F.col("snapshot"))).groupBy(key, "seen").agg(F.min(F.struct("snapshot", "state")).alias("at"))
    inside = stamped.where((F.col("seen") + drift >= first) & (F.col("seen") - drift <= last))
    flat = inside.where(F.col(key).isNotNull()).select(key, "seen", "at.snapshot", "at.state")
    schema = flat.select(key, "snapshot").schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        held, seen, at, keys, out = None, [], [], [], []

        def found() -> None:
            new = sorted(_visited(_Nearest(seen, at, drift), first, last, coarse))
            keys.extend([held] * len(new))
            out.extend(new)

        for batch in batches:
            for k, m, s, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if seen and k != held:
                    found()
                    seen, at = [], []
                held = k
                seen.append(m)
                at.append((s, t))
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow.field(0).type), pa.array(out, arrow.field(1).type)], schema=arrow)
            keys, out = [], []
        if seen:
            found()
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow.field(0).type), pa.array(out, arrow.field(1).type)], schema=arrow)

    # a history's months lie one after the other in one partition, many histories to a batch
    return flat.repartition(key).sortWithinPartitions(key, "seen").mapInArrow(run, schema)
