"""The store that is merged into, and histories that are kept while observations stream in."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from polyglyph.operators import history as Hi
from polyglyph.operators import records as R
from polyglyph.sources.store import Conflict, Store
from polyglyph.streaming import intervals as I

ROW = "k int, name string, language array<string>"


def upsert(old, new):
    return R.upsert(old, new, ["k"], ["language"])


def rows_of(store):
    return sorted((r.k, r.name, r.language) for r in store.read().collect())


def test_store_merges_only_what_is_touched(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ["k"], 8)
    assert store.read() is None and store.merge(spark.createDataFrame([], ROW), upsert) == 0
    first = [(k, f"n{k}", ["x"] if k % 2 else []) for k in range(40)]
    assert store.merge(spark.createDataFrame(first + first[:3], ROW), upsert) == 1 and rows_of(store) == first
    before = store.manifest()["folders"]
    assert store.merge(spark.createDataFrame([(3, "new", ["y"]), (4, "new", ["y"])], ROW), upsert) == 2
    after = store.manifest()["folders"]
    assert 1 <= sum(before[b] != after[b] for b in after) <= 2  # two keys touch two buckets at most
    want = sorted([r for r in first if r[0] not in (3, 4)] + [(3, "new", ["x"]), (4, "new", ["y"])])
    assert rows_of(store) == want
    assert store.rebucket(3) == 3 and rows_of(store) == want and set(store.manifest()["folders"]) <= {"0", "1", "2"}
    store.vacuum()
    assert rows_of(store) == want and len(os.listdir(tmp_path / "s/data")) == 1


def test_interrupted_merges_leave_a_whole_version(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), ["k"], 4)
    store.merge(spark.createDataFrame([(1, "a", []), (2, "b", [])], ROW), upsert)
    commit = Store._commit

    def stopped(self, manifest):
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(Store, "_commit", stopped)
    for _ in range(2):
        with pytest.raises(RuntimeError, match="gone"):
            store.merge(spark.createDataFrame([(1, "c", []), (5, "d", [])], ROW), upsert)
    assert rows_of(Store(spark, str(tmp_path / "s"), ["k"])) == [(1, "a", []), (2, "b", [])]
    monkeypatch.setattr(Store, "_commit", commit)

    def raced(old, new):  # another run commits while this one merges
        Store(spark, str(tmp_path / "s"), ["k"]).merge(spark.createDataFrame([(7, "other", [])], ROW), upsert)
        return upsert(old, new)

    with pytest.raises(Conflict):
        store.merge(spark.createDataFrame([(1, "late", [])], ROW), raced)
    assert rows_of(store) == [(1, "a", []), (2, "b", []), (7, "other", [])]
    assert store.merge(spark.createDataFrame([(1, "late", [])], ROW), upsert) == 3 and rows_of(store)[0] == (1, "late", [])


def observed(draw, n):
    """An observation log with repeats, rows that say nothing and rows of one URL that stay the same over months."""
    out = []
    for i in range(n):
        url = draw.choice(["http://a", "http://a", "http://b", "http://c"])
        year, month, day = 2019 + draw.randint(0, 1), draw.randint(1, 12), draw.randint(1, 3)
        primary = "de" if url == "http://c" else draw.choice(["uk", "uk", "ru", None])
        available = draw.choice([[primary, "en"], [primary]]) if primary else draw.choice([[], ["en"]])
        out.append({"url": url, "snapshot": f"{year}{month:02}{day:02}000000", "date": f"{year}-{month:02}-{day:02}", "final_url": url + draw.choice(["", "/", "/x?y", "/z"]), "primary": primary, "available": available, "words": draw.choice([None, 30, 40])})
    return out


def said(rows):
    return sorted((r.url, r.run, r["from"], r["to"], r.primary, r.observations, tuple(r.available), r.landing_path) for r in rows)


@pytest.mark.parametrize("track, seed", [("primary", 1), ("available", 2)])
def test_any_order_of_arrival_equals_the_batch(spark, tmp_path, track, seed):
    draw = random.Random(seed)
    log = observed(draw, 300)
    log += log[:40]
    draw.shuffle(log)
    (tmp_path / "log").mkdir()
    run = lambda: I.keep_histories(spark, str(tmp_path / "log"), str(tmp_path / "t"), str(tmp_path / "c"), track).awaitTermination()
    for part in range(3):
        rows = log[part::3] + [{"url": "http://a", "complete": True}]
        (tmp_path / f"log/{part}.json").write_text("\n".join(map(json.dumps, rows)))
        run()
    version = I.months_store(spark, str(tmp_path / "t")).manifest()["version"]
    (tmp_path / "log/again.json").write_text("\n".join(map(json.dumps, log)))  # the whole log once more
    run()
    store = I.months_store(spark, str(tmp_path / "t"))
    assert store.manifest()["version"] == version
    best = {}
    for o in log:
        rank = lambda x: (-1 if x["words"] is None else x["words"], x["final_url"], x["primary"] or "", x["available"])
        k = (o["url"], o["snapshot"])
        if k not in best or rank(o) > rank(best[k]):
            best[k] = o
    seen = spark.createDataFrame([tuple(o[c] for c in ("url", "snapshot", "date", "final_url", "primary", "available")) for o in best.values()], "url string, snapshot string, date string, final_url string, primary string, available array<string>")
    want = said(Hi.label_histories(seen, track).collect())
    assert said(I.histories_of_months(store.read()).collect()) == want and len(want) > 20
    assert said(I.histories_of_months(store.read(), hot_rows=5).collect()) == want
    months = store.read().where("url = 'http://c'")
    assert months.count() > 12 and len([w for w in want if w[0] == "http://c" and track == "primary"]) in (0, 1)


def test_the_state_is_asked_for_months_not_for_observations(spark, tmp_path):
    (tmp_path / "log").mkdir()
    row = lambda u, d, i: {"url": u, "snapshot": f"201901{d:02}{i:06}", "date": f"2019-01-{d:02}", "final_url": u, "primary": "uk", "available": ["uk"], "words": 30}
    for part, days in enumerate(((1, 3), (2, 3))):  # the third comes twice
        (tmp_path / f"log/{part}.json").write_text("\n".join(json.dumps(row(u, d, i)) for u in ("http://a", "http://b") for d in days for i in range(20)))
        stream = I.keep_histories(spark, str(tmp_path / "log"), str(tmp_path / "t"), str(tmp_path / "c"))
        stream.awaitTermination()
        state = [s for p in stream.recentProgress for s in p["stateOperators"]]
        assert max(s["numRowsTotal"] for s in state) == 2 and sum(s["numRowsUpdated"] for s in state) == 2
    assert said(I.histories_of_months(I.months_store(spark, str(tmp_path / "t")).read()).collect()) == [(u, 1, "2019-01-01", "2019-01-03", "uk", 60, ("uk",), "/") for u in ("http://a", "http://b")]


def test_only_runs_that_go_on_are_joined(spark):
    run = lambda first, state, n, *paths: (first, first, first, state, [state], n, [state], list(paths))
    months = [
        ("a", "201901", 3, [run("20190101", "uk", 1, ("/", 1)), run("20190102", "ru", 1, ("/x", 1)), run("20190103", "uk", 1, ("/y", 1))]),
        ("a", "201902", 1, []),  # nothing that counts
        ("a", "201903", 2, [run("20190301", "uk", 2, ("/z", 2))]),
        ("a", "201904", 2, [run("20190401", "uk", 1, ("/y", 1)), run("20190402", "ru", 1, ("/", 1))]),
        ("a", "201905", 1, [run("20190501", "de", 1, ("/", 1))]),
        ("b", "201901", 1, [run("20190101", "de", 1, ("/", 1))]),
    ]
    got = [r[:6] + r[7:] for r in said(I.histories_of_months(spark.createDataFrame(months, I.MONTHS)).collect())]
    assert got == [
        ("a", 1, "20190101", "20190101", "uk", 1, "/"), ("a", 2, "20190102", "20190102", "ru", 1, "/x"), ("a", 3, "20190103", "20190401", "uk", 4, "/y"),
        ("a", 4, "20190402", "20190402", "ru", 1, "/"), ("a", 5, "20190501", "20190501", "de", 1, "/"), ("b", 1, "20190101", "20190101", "de", 1, "/"),
    ]


def test_month_runs_split_and_join():
    one = lambda p, d: [f"2019-01-{d:02}", p, [p], "u", 1, "/"]
    runs = lambda seen: [(r["primary"], r["from"], r["to"], r["observations"]) for r in I.month_runs(seen, "primary")]
    seen = {"1": one("uk", 1), "5": one("uk", 5)}
    assert runs(seen) == [("uk", "2019-01-01", "2019-01-05", 2)]
    seen["3"] = one("ru", 3)
    assert runs(seen) == [("uk", "2019-01-01", "2019-01-01", 1), ("ru", "2019-01-03", "2019-01-03", 1), ("uk", "2019-01-05", "2019-01-05", 1)]
    seen["3"] = one("uk", 3)
    assert runs(seen) == [("uk", "2019-01-01", "2019-01-05", 3)]


def test_the_log_looks_only_at_the_months_that_come(spark, tmp_path):
    from polyglyph.streaming import observations as O

    (tmp_path / "log").mkdir()
    run = lambda: O.ingest(spark, str(tmp_path / "log"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    row = lambda u, s, w: {"url": u, "snapshot": s, "date": s[:4], "final_url": u, "primary": "uk", "available": ["uk"], "words": w}
    (tmp_path / "log/1.json").write_text("\n".join(map(json.dumps, [row("a", "20190101", 30), row("a", "20190101", 50), row("b", "20190301", 30), {"url": "a", "complete": True, "status": "ok"}])))
    run()
    (tmp_path / "log/2.json").write_text("\n".join(map(json.dumps, [row("a", "20190101", 90), row("a", "20190102", 30), row("c", "20200101", 30)])))
    run()
    kept = O.stored(spark, str(tmp_path / "t/observations"))
    assert sorted((r.url, r.snapshot, r.words, r.month, r.batch) for r in kept.collect()) == [("a", "20190101", 50, "m201901", 0), ("a", "20190102", 30, "m201901", 1), ("b", "20190301", 30, "m201903", 0), ("c", "20200101", 30, "m202001", 1)]
    pruned = kept.where(F.col("month").isin("m202001"))
    assert "PartitionFilters: [" in pruned._jdf.queryExecution().executedPlan().toString() and len(pruned.inputFiles()) >= 1
    assert [r.url for r in O.stored(spark, str(tmp_path / "t/markers")).collect()] == ["a"]
