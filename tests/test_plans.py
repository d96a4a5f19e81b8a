"""What the physical plans must and must not hold."""

import os
import re
from datetime import datetime

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators import grouping, paging, summary, unify
from flowlens.operators.filters import FilterSpec, TimeWindow
from flowlens.plans import catalogue, parsing
from flowlens.plans import fixtures as fx
from flowlens.plans.catalogue import QUERIES
from flowlens.session import scratch_dir
from flowlens.sources import tables


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


BATCH = sorted(n for n in QUERIES if not n.startswith(("stream_", "sink_", "layout_", "src_", "retention")))


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_joins_no_python_no_single_task_windows(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert word not in text
    # all rows in one partition only for totals of partial aggregates and for pages
    if "Exchange SinglePartition" in text:
        assert re.search(r"HashAggregate|TakeOrdered|GlobalLimit", text)


def test_rendered_lines_land_packed_by_the_tasks_that_render_them(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(parsing, "_LANDED", {})
    shuffled = []
    monkeypatch.setattr(DataFrame, "repartition", lambda df, *to: shuffled.append(df.columns) or df)
    for kind, rendered in (("kv", fx.kv_lines), ("url", fx.url_lines)):
        lines = parsing.landed(spark, sf_dir, kind)
        files = [f.removeprefix("file://") for f in lines.inputFiles()]
        text = lines.agg(F.sum(F.octet_length("line"))).first()[0]
        assert sum(os.path.getsize(f) for f in files) < text / 3
        assert sorted(lines.collect()) == sorted(rendered(spark, sf_dir).collect())
    assert not any("line" in columns for columns in shuffled)


def test_top_lists_take_ordered(spark, sf_dir):
    text = plan(summary.top_flows(fx.flows(spark, sf_dir)))
    assert "TakeOrderedAndProject" in text and text.count("partial_sum") > 0


def test_time_window_reaches_the_scan(spark, sf_dir):
    window = TimeWindow(datetime(2001, 7, 1), datetime(2001, 8, 1))
    df = FilterSpec(window=window, include_threats=True).apply(
        fx.flows(spark, sf_dir, window.since, window.until), "ts"
    )
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(l_shipdate", plan(df))


def test_month_partitions_are_pruned(spark, sf_dir):
    path = f"{scratch_dir(spark, 'test-months')}/flows"
    tables.append(fx.flows(spark, sf_dir), path, "ts")
    window = TimeWindow(datetime(1999, 3, 1), datetime(1999, 4, 30))
    text = plan(spark.read.parquet(path).where(window.predicate("ts", ym="ym")).select("src_ip"))
    assert re.search(r"PartitionFilters: \[[^\]]*ym", text)
    assert "ReadSchema: struct<ts:timestamp_ntz,src_ip:string>" in text


def test_source_selector_drops_branches(spark, sf_dir):
    df = FilterSpec(log_source="flows_pan").apply(unify.union_sources(fx.source_tables(spark, sf_dir)))
    assert "Union" not in plan(df)
    assert plan(df).count("lineitem.parquet") == 1


def test_columns_are_pruned(spark, sf_dir):
    text = plan(summary.top_values(fx.flows(spark, sf_dir), "src_user"))
    lineitem = next(s for s in re.findall(r"ReadSchema: struct<[^\n]*", text) if "l_orderkey" in s)
    assert "l_shipdate" not in lineitem and "l_returnflag" not in lineitem


def test_subnet_rollup_shuffles_twice(spark, sf_dir):
    """Once by flow and once, already aggregated, by network."""
    rows = spark.read.parquet(_stored_flows(spark, sf_dir))
    text = plan(grouping.subnet_rollup(grouping.flow_groups(rows, "ts")), "simple")
    assert text.count("Exchange hashpartitioning") == 2


def test_page_has_no_growing_offset(spark, sf_dir):
    """A page is sorted from few rows or a filter on rows that lie in order: no task keeps more for a deeper one."""
    rows = spark.read.parquet(_stored_flows(spark, sf_dir))
    for number in (3, 90, 115):
        found = paging.newest_page(rows, number, ts="ts")
        limits = [int(n) for n in re.findall(r"limit=(\d+)", plan(found, "simple"))]
        assert limits and max(limits) < 50 * 3 < paging.SORTED, "rows to skip are those of the page's first second"
    text = plan(paging.clamped_page(rows, [F.asc("ts"), F.asc("src_ip")], 10**9).rows)
    assert "TakeOrderedAndProject" not in text and "Limit" not in text


def test_lines_are_parsed_once(spark, sf_dir):
    """Acceptance, and both times of a traffic line, come from one scan of the lines."""
    text = plan(catalogue.QUERIES["split_valid_invalid"](spark, sf_dir), "simple")
    assert text.count("FileScan text") == 1
    text = plan(catalogue.QUERIES["resolve_event_time"](spark, sf_dir), "simple")
    assert text.count("FileScan text") == 3, "key-value, traffic and web-access lines, once each"


def test_parsers_compile(spark, sf_dir):
    """No stage of a parser falls back from generated code."""
    names = [n for n in catalogue.QUERIES if n.startswith("parse_")]
    assert len(names) >= 9
    for name in names:
        catalogue.QUERIES[name](spark, sf_dir)  # lands the lines
        spark.conf.set("spark.sql.codegen.fallback", "false")
        try:
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        finally:
            spark.conf.unset("spark.sql.codegen.fallback")


_stored = {}


def _stored_flows(spark, sf_dir):
    if "path" not in _stored:
        _stored["path"] = f"{scratch_dir(spark, 'test-flows')}/flows"
        tables.write_clustered(fx.flows(spark, sf_dir), _stored["path"], ["ts", "src_ip", "dst_ip"], "ts")
    return _stored["path"]


def test_clustered_files_hold_narrow_ranges(spark, sf_dir):
    """Files of one month do not overlap in time, though rows of a hot month spread over files."""
    path = f"{scratch_dir(spark, 'test-ranges')}/flows"
    rows = fx.flows(spark, sf_dir).withColumn("ts", F.when(F.col("action") == "deny", F.lit("1999-01-01").cast("timestamp_ntz")).otherwise(F.col("ts")))
    tables.write_clustered(rows, path, ["ts", "src_ip", "dst_ip"], "ts", partitions=8)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f"), "ym").agg(
        F.min("ts").alias("low"), F.max("ts").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    hot = [f for f in files if f["low"] <= datetime(1999, 1, 1) <= f["high"]]
    assert len(hot) >= 2, "a third of the rows share one second and yet spread"
    by_time = sorted(files, key=lambda f: (f["low"], f["high"]))
    assert all(a["high"] <= b["low"] for a, b in zip(by_time, by_time[1:]))
    assert sum(f["n"] for f in files) == rows.count()


def test_hot_month_is_written_by_many_tasks(spark, sf_dir):
    """With small task sizes, the month that holds a third of the rows spreads; none is lost."""
    rows = fx.flows(spark, sf_dir).repartition(8, "src_port", "ts").withColumn(
        "ts", F.when(F.col("action") == "deny", F.lit("1999-01-01").cast("timestamp_ntz")).otherwise(F.col("ts")))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "16k")
    try:
        path = f"{scratch_dir(spark, 'test-hot')}/flows"
        tables.append(rows, path, "ts")
    finally:
        spark.conf.unset(key)
    files = spark.read.parquet(path).groupBy("ym", F.input_file_name().alias("f")).count().collect()
    assert len([f for f in files if f["ym"] == 199901]) > 1
    assert sum(f["count"] for f in files) == rows.count()


def test_expire_drops_rewrites_and_keeps_months(spark):
    """Old months go, the month of the limit loses its old rows, others keep their files; repeats change nothing."""
    days = [datetime(2024, m, d) for m in (1, 2, 3, 4, 5) for d in (2, 20)]
    rows = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "ts timestamp, n int")
    name = tables.scratch_table(spark, "kept")
    tables.create_table(rows, name, "ts")

    def files():
        return {(r["ym"], r["f"]) for r in spark.table(name).select("ym", F.col("_metadata.file_path").alias("f")).collect()}

    before = files()
    assert tables.expire(spark, name, datetime(2024, 3, 10), "ts", 0) == {202401: "dropped", 202402: "dropped", 202403: "rewritten"}
    assert sorted(r["n"] for r in spark.table(name).collect()) == [5, 6, 7, 8, 9]
    assert {f for f in files() if f[0] > 202403} == {f for f in before if f[0] > 202403}
    assert tables.table_months(spark, name) == [202403, 202404, 202405]
    assert tables.expire(spark, name, datetime(2024, 3, 10), "ts", 0) == {}
    assert tables.expire(spark, name, datetime(2024, 4, 1), "ts", 0) == {202403: "dropped"}
    assert tables.expire(spark, name, datetime(2024, 4, 25), "ts", 0) == {202404: "dropped"}
    assert sorted(r["n"] for r in spark.table(name).collect()) == [8, 9]
