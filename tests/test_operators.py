"""Parsers on hand-written lines, filters, paging, exports, monitoring."""

import glob
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowlens.operators import filters, grouping, monitor, paging, parse_kv, rollups, unify, validate
from flowlens.operators import parse_positional as positional
from flowlens.plans import fixtures as fx
from flowlens.session import scratch_dir
from flowlens.sources import registry, syslog, tables

AS_OF = datetime(2025, 6, 20, 12, 0, 0)


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


def test_kv_line(spark):
    plain = "date=2024-06-16 time=14:30:15 devname=FGT60F srcip=192.168.1.100 dstip=8.8.8.8 srcport=54321 dstport=53 action=accept"
    row = parse_kv.parse_kv_typed(lines(spark, plain), AS_OF).first()
    assert row["timestamp"] == datetime(2024, 6, 16, 14, 30, 15)
    assert (row["devname"], row["srcip"], row["dstip"]) == ("FGT60F", "192.168.1.100", "8.8.8.8")
    assert (row["srcport"], row["dstport"], row["action"]) == (54321, 53, "accept")
    assert (row["raw_message"], row["policyname"], row["sessionid"]) == (plain, "", 0)


def test_kv_bad_values(spark):
    bad = "time=1:2:3 srcip=10.11.40. dstip=2001:db8::1 eventtime=99999999999999999999 srcport=-4 dstport=abc proto=300"
    row = parse_kv.parse_kv_typed(lines(spark, bad), AS_OF).first()
    assert row["timestamp"] == AS_OF
    assert (row["srcip"], row["srcip_raw"]) == ("0.0.0.0", "10.11.40.")
    assert (row["dstip"], row["dstip_raw"]) == ("0.0.0.0", "2001:db8::1")
    assert (int(row["eventtime"]), row["srcport"], row["dstport"], row["proto"]) == (2**64 - 1, 0, 0, 255)


def test_kv_keys_are_looked_up_without_a_map(spark):
    """The last of equal keys counts; a line without pairs or none at all gives defaults. No map of all pairs is built."""
    typed = parse_kv.parse_kv_typed(lines(spark, "action=first srcip=1.2.3.4 action=\"last one\" user=a user=", "none", None), AS_OF)
    assert [(r["action"], r["srcip"], r["username"], r["srcip_raw"]) for r in typed.collect()] == [
        ("last one", "1.2.3.4", "a", "1.2.3.4"), ("", "0.0.0.0", "", None), ("", "0.0.0.0", "", None)]
    assert "map_from" not in typed._jdf.queryExecution().optimizedPlan().toString()


def test_kv_window(spark):
    out = parse_kv.parse_kv_window(lines(
        spark, "x=1 date=2024-01-01 a=2 rcvdpkt=3 y=2", "a=1 b=2", "rcvdpkt=1 date=2 z=3")).collect()
    assert [r["kv"] for r in out] == [
        {"date": "2024-01-01", "a": "2", "rcvdpkt": "3"}, {"a": "1", "b": "2"}, {}]


def test_good_and_bad_rows_are_all_rows(spark, sf_dir):
    typed = parse_kv.parse_kv_typed(fx.kv_lines(spark, sf_dir), AS_OF)
    good, bad = validate.split_valid_invalid(typed)
    assert good.count() + bad.count() == typed.count()
    assert bad.count() > 0


def traffic_line(head="Jun  8 13:33:23 host", **fields):
    values = {1: "2025/06/08 13:33:20", 3: "TRAFFIC", 7: "10.0.0.1", 8: "8.8.8.8"} | {int(k[1:]): v for k, v in fields.items()}
    return f"{head} 1," + ",".join(str(values.get(i, "")) for i in range(1, 85))


def test_traffic_line(spark):
    df = lines(
        spark,
        traffic_line(f33=5, f34=6, f44=7, f58="old", f63="new", f29="gre", f52="dev"),
        traffic_line(f33=5, f44="", f58="old", f29="what"),
        traffic_line(f3="SYSTEM"),
        "May 1 10:00:00 host",
        "May 1 10:00:00 host 1,2,3",
    )
    first, second = positional.parse_traffic(df, AS_OF).collect()
    assert (first["packets_sent"], first["packets_received"], first["tunnel_type"]) == (7, 6, "new")
    assert (second["packets_sent"], second["tunnel_type"], second["protocol"]) == (5, "old", 0)
    assert (first["protocol"], first["device_name"], second["device_name"]) == (47, "dev", "host")
    assert first["timestamp"] == datetime(2025, 6, 8, 13, 33, 23)
    outcomes = [r["outcome"] for r in positional.with_traffic_fields(df).select("outcome").collect()]
    assert outcomes == ["parsed", "parsed", "skipped", "error", "error"]
    stats = validate.ingest_stats(positional.with_traffic_fields(df)).first()
    assert (stats["total_lines"], stats["parsed"], stats["skipped"], stats["errors"], stats["success_pct"]) == (5, 2, 1, 2, 50.0)


def url_line(url, **fields):
    values = {3: "Threat", 4: "URL", 6: "2025/06/18 13:45:20", 31: url} | {int(k[1:]): v for k, v in fields.items()}
    return "Jun 18 13:45:21 fw.example 1," + ",".join(str(values.get(i, "")) for i in range(1, 108))


def test_url_line(spark):
    df = lines(
        spark,
        url_line('"example.com/a,b"', f12="CORP\\u1", f45='"Agent (a, b)"', f62="get", f29="tcp", f32='ab"cd', f105="2025-06-18T13:45:20.5+03:00"),
        url_line("host:bad/x", f12="u2@corp", f58="dev", f6="", f82="Vendor"),
        url_line("http://x/", f4="spyware"),
    )
    first, second = positional.parse_url(df, AS_OF, wide=True).collect()
    assert (first["url"], first["url_domain"], first["url_path"]) == ("example.com/a,b", "example.com", "/a,b")
    assert (first["source_user"], first["source_user_domain"], first["threat_id"]) == ("u1", "CORP", 'ab"cd')
    assert (first["user_agent"], first["http_method"], first["ip_protocol"], first["protocol"]) == ("Agent (a, b)", "GET", 6, "tcp")
    assert first["timestamp"] == datetime(2025, 6, 18, 13, 45, 20)
    assert first["receive_time"] == datetime(2025, 6, 18, 13, 45, 21)
    assert first["high_resolution_timestamp"] == datetime(2025, 6, 18, 13, 45, 20, 500000)
    assert (second["url"], second["source_user"], second["device_name"], second["source_device_vendor"]) == ("", "u2", "dev", "Vendor")
    assert second["timestamp"] == datetime(2025, 6, 18, 13, 45, 21)


@pytest.mark.parametrize("grammar, ports", [
    ("80", {80}), ("1000-2000", {1000, 2000}), ("80, 443", {80, 443}), ("x-y", None), ("1-2-3", None), ("abc", None), (",", None),
])
def test_ports(spark, grammar, ports):
    everything = {80, 443, 1000, 2000, 2001}
    df = spark.createDataFrame([(p,) for p in everything], "dst_port int")
    kept = filters.FilterSpec(dst_port=grammar).apply(df)
    assert {r[0] for r in kept.collect()} == (everything if ports is None else ports)


def test_windows():
    hour = filters.preset_window("last_hour", AS_OF)
    assert filters.preset_window("nonsense", AS_OF) == hour
    assert filters.preset_window("Last_6_Hours", AS_OF) == filters.preset_window("6h", AS_OF)
    assert filters.custom_window("bad", "bad", AS_OF) == filters.TimeWindow(hour.since, None)
    assert filters.custom_window("2025-01-01T00:00", "bad", AS_OF, open_end=False) == hour
    both = filters.custom_window("2025-01-01T00:00", "2025-01-02T00:00", AS_OF, open_end=False)
    assert both == filters.TimeWindow(datetime(2025, 1, 1), datetime(2025, 1, 2))


def test_sources(spark, sf_dir):
    everything = unify.union_sources(fx.source_tables(spark, sf_dir))
    sources = lambda spec: {r[0] for r in spec.apply(everything).select("log_source").distinct().collect()}
    assert sources(filters.FilterSpec()) == {"flows_kv", "flows_pan"}
    assert sources(filters.FilterSpec(include_threats=True)) == {"flows_kv", "flows_pan", "threats"}
    assert sources(filters.FilterSpec(log_source="threats")) == {"threats"}
    empty = unify.union_available(spark, {"flows_kv": "no_such_table"})
    assert empty.columns == everything.columns and empty.count() == 0


@pytest.mark.parametrize("number", [1, 7, 60, 85, 119, 120, 121, 500])
def test_pages_at_any_depth(spark, sf_dir, number):
    """Pages agree with sorting everything; half of the rows share one second, a third has no time."""
    rows = fx.flows(spark, sf_dir).select(
        F.when(F.col("action") == "close", F.lit(datetime(1999, 1, 1)))
        .when(F.col("src_port") % 3 != 0, F.col("ts").cast("timestamp")).alias("ts"),
        "src_ip", "src_port", "dst_ip", "bytes_sent",
    )
    everything = sorted(
        (tuple(r) for r in rows.collect()), key=lambda r: (r[0] is None, -r[0].timestamp() if r[0] else 0, *r[1:])
    )
    assert any(r[0] is None for r in everything)
    found = paging.newest_page(rows, number, 50, ts="ts")
    assert [tuple(r) for r in found.collect()] == everything[(number - 1) * 50: number * 50]


def test_page_clamp(spark):
    df = spark.range(101)
    for asked, got in ((1, 1), (3, 3), (99, 3), (-5, 1)):
        found = paging.clamped_page(df, [F.asc("id")], asked)
        assert (found.number, found.total_pages, found.total_rows) == (got, 3, 101)
    assert paging.clamped_page(spark.range(0), [F.asc("id")], 4).total_pages == 1


def test_subnet_details_are_bounded_and_sorted(spark, sf_dir):
    nested = grouping.subnet_details(grouping.flow_groups(fx.flows(spark, sf_dir), "ts"))
    for row in nested.collect():
        counts = [d["event_count"] for d in row["details"]]
        assert counts == sorted(counts, reverse=True) and len(counts) <= 256
        assert sum(counts) == row["event_count"]


def test_merge_law(spark, sf_dir):
    """Rollups of parts, merged in any grouping, are the rollup of the whole."""
    rows = fx.urls(spark, sf_dir)
    for rollup in (rollups.url_hourly("ts"), rollups.user_daily("ts"), rollups.blocked_hourly("ts")):
        parts = [rollup.partial(rows.where(F.col("session_id") % 3 == i)) for i in range(3)]
        two = rollup.merge(parts[0].unionByName(parts[1]))
        merged = rollup.finish(rollup.merge(two.unionByName(parts[2])))
        exact = rollup.exact(rows).select(*merged.columns)
        key = lambda r: repr(tuple(r))
        assert sorted(map(key, merged.collect())) == sorted(map(key, exact.collect()))


def test_csv_text(spark):
    path = f"{scratch_dir(spark, 'test')}/csv"
    tables.export_csv(spark.createDataFrame([("a,b", 'say "hi"', None, 5)], "A string, b string, c string, d int").coalesce(1), path)
    text = open(glob.glob(f"{path}/part-*.csv")[0]).read() if not path.startswith("file:") else open(glob.glob(f"{path[5:]}/part-*.csv")[0]).read()
    assert text == '"A","b","c","d"\n"a,b","say ""hi""","","5"\n'


def test_registry_document(spark, tmp_path):
    (tmp_path / "registry.json").write_text("""{
      "file_info": {"/var/log/a.log": {"filepath": "/var/log/a.log", "size": 10, "last_processed_position": 4,
                    "rotated_files": ["x", "y"], "last_modified": 86400.0, "clickhouse_verified": true}},
      "processed_records": [{"original_file": "/var/log/a.log", "rotated_file": "x", "safe_to_delete": false,
                             "clickhouse_verification_time": 0}],
      "last_updated": 1.5}""")
    read = registry.read_registry(spark, str(tmp_path / "registry.json"))
    progress = registry.file_progress(read).first()
    assert (progress["path"], progress["size"], progress["position"], progress["rotated_files"]) == ("/var/log/a.log", 10, 4, 2)
    assert progress["modified"] == datetime(1970, 1, 2) and progress["processed_at"] is None
    record = registry.processed_records(read).first()
    assert record["verified_at"] is None and record["safe_to_delete"] is False


def test_inventory(spark, tmp_path):
    for name, size in (("a.log", 5), ("a.log.20250101_0101.gz", 2), ("a.log.20250102_0101", 3), ("b.log.1.gz", 1), ("c.txt", 9)):
        (tmp_path / name).write_bytes(b"x" * size)
    found = registry.file_inventory(registry.list_files(spark, str(tmp_path)))
    rows = {r["base"]: (r["file_exists"], r["size"], r["rotated_files"], r["total_size"]) for r in found.collect()}
    assert rows == {"a.log": (True, 5, 2, 10), "b.log": (False, 0, 1, 1)}


def test_new_files_only(spark, tmp_path):
    import os

    for name, when in (("old.log", 1_000_000_000), ("new.log", 2_000_000_000)):
        (tmp_path / name).write_text(name + "\n")
        os.utime(tmp_path / name, (when, when))
    assert {r["line"] for r in syslog.read_syslog(spark, str(tmp_path)).collect()} == {"old.log", "new.log"}
    late = syslog.read_syslog(spark, str(tmp_path), since=datetime(2020, 1, 1))
    assert [r["line"] for r in late.collect()] == ["new.log"]


def test_cleanup_ages(spark):
    rows = [("a", True, datetime(2025, 6, 19)), ("b", True, datetime(2025, 6, 1)), ("c", True, datetime(2025, 5, 1)),
            ("d", False, datetime(2025, 5, 1)), ("e", True, None)]
    df = spark.createDataFrame(rows, "f string, safe_to_delete boolean, verified_at timestamp")
    assert {r["f"]: r["cleanup"] for r in monitor.cleanup_plan(df, AS_OF).collect()} == {
        "a": "keep", "b": "archive", "c": "purge", "d": "keep", "e": "keep"}


def test_levels(spark):
    gib, mib = 1024**3, 1024**2
    sizes = [("a", True, int(1.8 * gib)), ("b", True, int(1.5 * gib)), ("c", True, int(1.5 * gib) - 1), ("d", False, 5 * gib)]
    files = spark.createDataFrame(sizes, "path string, file_exists boolean, size bigint")
    assert [r["alert_level"] for r in monitor.file_alerts(files).orderBy("path").collect()] == ["critical", "warning", "ok", "info"]
    progress = spark.createDataFrame(
        [("a", int(1.8 * gib) - 500 * mib, 1), ("b", int(1.5 * gib) - 100 * mib, 2), ("c", 9 * gib, 3)],
        "path string, position bigint, total_lines bigint")
    lag = monitor.ingest_lag(files, progress).orderBy("path").collect()
    assert [(r["alert_level"], r["lag_bytes"]) for r in lag] == [
        ("critical", 500 * mib), ("warning", 100 * mib), ("ok", 0), ("info", 0)]
    worst = monitor.overall_severity(monitor.file_alerts(files), monitor.ingest_lag(files, progress)).first()[0]
    assert worst == "critical"
