"""Page directory, indexes over files, and verification of content on small tables."""

import os
import time
from collections import Counter
from datetime import datetime, timedelta
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import session
from flowlens.operators import paging, verify
from flowlens.plans import fixtures as fx
from flowlens.session import scratch_dir, tasks_for
from flowlens.sources import directory, indexes, tables

START = datetime(2024, 1, 31, 22, 59, 58)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def table(spark):
    """A hot second, sparse days over a month's end, rows without a time, and a name in few places."""
    times = [START] * 120 + [START + timedelta(hours=7 * i, seconds=i % 5) for i in range(90)] + [None] * 30
    data = [(t, f"user{i % 9}", f"10.0.{i % 7}.{i}", i) for i, t in enumerate(times)] + [(START + timedelta(days=9), "Änne Ödegård", "10.9.9.9", 999)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, name string, ip string, n int")
    root = scratch_dir(spark, "test-stored")
    tables.write_clustered(df, f"{root}/t", ["ts", "ip"], "ts", partitions=12)
    return root, spark.read.parquet(f"{root}/t"), df


def test_every_page(table):
    root, stored, df = table
    directory.add(stored.where("n % 2 = 0"), f"{root}/d", "ts", 0)
    for _ in range(2):  # the second load runs twice
        directory.add(stored.where("n % 2 = 1"), f"{root}/d", "ts", 1)
    whole = df.orderBy(F.desc_nulls_last("ts"), "name", "ip", "n").collect()
    for size in (7, 50):
        for number in [*range(1, len(whole) // size + 3)]:
            found = directory.page(stored, f"{root}/d", number, size, "ts").collect()
            assert [tuple(r) for r in found] == [tuple(r) for r in whole[(number - 1) * size : number * size]]
    assert directory.find(stored.sparkSession, f"{root}/none", 1) is None


def test_a_page_reads_its_months(table):
    root, stored, _ = table
    directory.add(stored, f"{root}/p", "ts")
    page = directory.page(stored, f"{root}/p", 1, 5, "ts")
    plan = page._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "ym#" in plan.split("PartitionFilters: [")[1][:120]
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_deep_in_one_second_is_found_by_ranges(table, monkeypatch):
    root, stored, df = table
    directory.add(stored, f"{root}/deep", "ts")
    want = directory.page(stored, f"{root}/deep", 9, 20, "ts").collect()
    monkeypatch.setattr(paging, "SORTED", 10)
    assert directory.page(stored, f"{root}/deep", 9, 20, "ts").collect() == want and len(want) == 20


@pytest.mark.parametrize("needle", ["user3", "SER", "ÄNNE", "ödeg", "10.9", "9.9", "nowhere", "us", "", "10.0.3.3"])
def test_search_equals_a_full_scan(table, needle):
    root, stored, df = table
    index = indexes.gram_index(stored, ["name", "ip"], "ts").cache()
    found = indexes.search(stored, f"{root}/t", index, needle, ["name", "ip"], "ts").drop("ym")
    want = df.where(F.contains(F.lower("name"), F.lit(needle.lower())) | F.contains(F.lower("ip"), F.lit(needle.lower())))
    assert rows(found) == rows(want)
    files, _ = indexes.files_like(stored, index, needle, "ts")
    if needle in ("ÄNNE", "ödeg"):
        assert len(files) == 1
    if needle == "nowhere":
        assert files == []
    if len(needle) < indexes.GRAM:
        assert len(files) == len(stored.inputFiles())


@pytest.mark.parametrize("values", [indexes.VALUES, 2])
def test_look_up_equals_a_full_scan(table, values, monkeypatch):
    """With lists of values and with bitmaps."""
    monkeypatch.setattr(indexes, "VALUES", values)
    root, stored, df = table
    index = indexes.value_index(stored, ["name", "n"]).cache()
    for equal in ({"name": "user4"}, {"name": "Änne Ödegård"}, {"n": 17}, {"name": "user1", "n": 10}, {"name": "user1", "n": 11}, {"name": "zz"}):
        found = indexes.look_up(stored, f"{root}/t", index, equal).drop("ym")
        want = df
        for c, v in equal.items():
            want = want.where(F.col(c) == F.lit(v))
        assert rows(found) == rows(want)
        assert len(indexes.files_with(stored, index, equal)) < len(stored.inputFiles()) or equal == {"name": "user4"}


def test_files_that_an_index_does_not_know_are_read(spark, table):
    _, _, df = table
    root = scratch_dir(spark, "test-lag")
    tables.append(df.where("n < 100"), f"{root}/t", "ts")
    first = spark.read.parquet(f"{root}/t")
    values, grams = indexes.value_index(first, ["name"]).cache(), indexes.gram_index(first, ["name"], "ts").cache()
    values.count(), grams.count()
    tables.append(df.where("n >= 100"), f"{root}/t", "ts")
    whole = spark.read.parquet(f"{root}/t")
    want = rows(df.where("name = 'user5'"))
    assert rows(indexes.look_up(whole, f"{root}/t", values, {"name": "user5"}).drop("ym")) == want
    assert rows(indexes.search(whole, f"{root}/t", grams, "USER5", ["name"], "ts").drop("ym")) == want


def test_differences_are_named(spark):
    """Loss, a swap that keeps all counts, copies more and less, a file that is gone, and nulls as values."""
    parsed = [("a", 1, "x"), ("a", 2, None), ("a", 2, None), ("b", 1, "x"), ("b", 2, "y"), ("c", None, None), (None, 5, "q")] + [("d", i, "z") for i in range(400)]
    stored = [("a", 1, "x"), ("a", 2, None), ("b", 1, "x"), ("b", 3, "y"), (None, 5, "q"), (None, 5, "q")] + [("d", i, "z") for i in range(400)]
    a, b = (spark.createDataFrame(x, "file string, n int, t string").repartition(4) for x in (parsed, stored))
    found = {(r["file"], r["n"], r["t"]): (r["finding"], r["parsed_copies"], r["stored_copies"]) for r in verify.differences(a, b, "file", ["n", "t"]).collect()}
    assert found == {
        ("a", 2, None): ("copies lost", 2, 1), ("b", 2, "y"): ("lost", 1, 0), ("b", 3, "y"): ("foreign", 0, 1),
        ("c", None, None): ("lost", 1, 0), (None, 5, "q"): ("repeated", 1, 2),
    }
    counts = Counter(f for f, *_ in parsed), Counter(f for f, *_ in stored)
    assert counts[0]["b"] == counts[1]["b"], "equal counts do not pass a swap"
    files = {r["file"] for r in verify.unequal(a, b, ["file"], ["n", "t"]).collect()}
    assert files == {"a", "b", "c", None}
    assert verify.differences(a, a, "file", ["n", "t"]).count() == 0


def test_files_that_differ_go_to_the_rows(spark, sf_dir):
    """Rows are shuffled to be counted, not to be picked by file and bucket; the query joins the given tables once."""
    from flowlens.plans.stored import verify_content

    found = verify_content(spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    picked = [line for line in plan if "Join LeftSemi" in line]
    assert picked and all("strategy=broadcast" in line for line in picked)
    assert found.inputFiles() and not any("lineitem" in path for path in found.inputFiles())


def test_distinct_counts_merge(spark):
    """Any window and grouping of several batches, one of which ran twice, with many values, nulls and a hot value."""
    from flowlens.operators import distinct
    from flowlens.operators.filters import TimeWindow

    path, at = f"{scratch_dir(spark, 'test-distinct')}/d", datetime(2024, 1, 30)
    data = [(at + timedelta(hours=i % 60), f"k{i % 3}", None if i % 50 == 0 else "hot" if i % 3 == 0 else f"v{(i * 7919) % 70_000}") for i in range(120_000)]
    rows = spark.createDataFrame(data, "ts timestamp_ntz, k string, v string").repartition(6)
    keys = {"hour": F.date_trunc("HOUR", "ts").cast("timestamp_ntz"), "k": F.col("k")}
    for batch, when in ((0, "hour(ts) < 5"), (1, "hour(ts) BETWEEN 5 AND 14"), (1, "hour(ts) BETWEEN 5 AND 14"), (2, "hour(ts) > 14")):
        distinct.add(rows.where(when), path, keys, "hour", "v", batch)
    schema = "hour timestamp_ntz, k string"
    every = distinct.stored(spark, path, schema, "hour")
    assert distinct.count(every).first()[0] == len({v for *_, v in data if v is not None})
    window = TimeWindow(datetime(2024, 1, 31, 3), datetime(2024, 2, 1, 2))
    inside = distinct.stored(spark, path, schema, "hour", window)
    assert "PartitionFilters: [isnotnull(ym" in inside._jdf.queryExecution().toString()
    found = {r["k"]: r["distinct_values"] for r in distinct.count(inside, ["k"]).collect()}
    want = {}
    for ts, k, v in data:
        if window.since <= ts.replace(minute=0) <= window.until and v is not None:
            want.setdefault(k, set()).add(v)
    assert found == {k: len(v) for k, v in want.items()}
    known = distinct._known(spark, path)
    assert known.count() == known.select("value").distinct().count() == known.select("bucket", "n").distinct().count()
    assert distinct.count(distinct.stored(spark, f"{path}-none", schema, "hour")).first()[0] == 0


def test_a_month_of_the_directory_is_few_files(spark):
    """Not one file for each task and month."""
    at = datetime(2024, 1, 1)
    data = [(at + timedelta(days=31 * (i % 6), seconds=i),) for i in range(6000)]
    root = scratch_dir(spark, "test-directory")
    directory.add(spark.createDataFrame(data, "ts timestamp_ntz").repartition(8), f"{root}/d", "ts")
    counts = spark.read.parquet(f"{root}/d/seconds/batch=0")
    months = counts.select("ym").distinct().count()
    assert len(counts.inputFiles()) <= 2 * months and counts.agg(F.sum("n")).first()[0] == 6000


def test_tasks_of_a_clustered_table_grow_with_its_rows(spark, monkeypatch):
    """However many rows, a task sorts no more than about so many; all rows are there."""
    monkeypatch.setattr(tables, "SORTED_ROWS", 20)
    df = spark.range(4000).select((F.lit(START) + F.make_interval(secs="id")).cast("timestamp_ntz").alias("ts"), F.col("id").alias("n"))
    path = f"{scratch_dir(spark, 'test-tasks')}/t"
    tables.write_clustered(df, path, ["ts"], "ts")
    stored = spark.read.parquet(path)
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 200 and rows(stored.drop("ym")) == rows(df)


def test_shuffles_have_tasks_for_their_rows(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with tasks_for(spark, 10_000, each=10):
        assert spark.conf.get(key) == "1000"
    with tasks_for(spark, 0):
        assert spark.conf.get(key) == before
    assert spark.conf.get(key) == before


def _shuffle_files(spark):
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    found = (os.path.join(d, f) for one in top for d, _, names in os.walk(one) for f in names if f.startswith("shuffle_"))
    return set(found)


def test_a_large_table_is_clustered_in_rounds(spark, monkeypatch):
    """Frames, rounds within hot seconds and over years, rows without a time; no shuffle stays on disk behind them."""
    monkeypatch.setattr(session, "ROUND_ROWS", 40)
    times = [START] * 60 + [START + timedelta(days=5 * i, seconds=i) for i in range(150)] + [None] * 20
    data = [(t, f"10.0.{i % 7}.{i}", i) for i, t in enumerate(times)] * 2
    frames = [spark.createDataFrame(data[i::3], "ts timestamp_ntz, ip string, n int") for i in range(3)]
    path, before = f"{scratch_dir(spark, 'test-rounds')}/t", _shuffle_files(spark)
    tables.write_clustered(frames, path, ["ts", "ip"], "ts")
    found = spark.read.parquet(path)
    assert found.columns == ["ts", "ip", "n", "ym"]
    assert Counter((r["ts"], r["ip"], r["n"]) for r in found.collect()) == Counter(data)
    assert all(r["ym"] == (r["ts"] and r["ts"].year * 100 + r["ts"].month) for r in found.collect())
    for file in found.inputFiles():
        rows = [(r["ts"], r["ip"]) for r in spark.read.parquet(file).collect() if r["ts"]]
        assert rows == sorted(rows)
    until = time.time() + 20
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    tables.write_clustered([f.where("false") for f in frames], path, ["ts", "ip"], "ts")
    assert not os.path.exists(path) or spark.read.schema(found.schema).parquet(path).count() == 0


def test_rounds_hold_all_flows(spark, sf_dir, monkeypatch):
    want = rows(fx.flows(spark, sf_dir))
    assert len(fx.flow_rounds(spark, sf_dir)) == 1
    monkeypatch.setattr(session, "ROUND_ROWS", 1500)
    parts = fx.flow_rounds(spark, sf_dir)
    assert len(parts) > 3 and max(p.count() for p in parts) < 3000
    assert rows(reduce(DataFrame.unionAll, parts)) == want
