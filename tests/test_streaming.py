"""Streams end as the batch job would; a batch that runs again changes nothing."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from flowlens.operators import parse_kv, rollups, validate
from flowlens.operators import parse_positional as positional
from flowlens.operators.filters import TimeWindow
from flowlens.plans import fixtures as fx
from flowlens.plans import streams
from flowlens.plans.monitoring import land_lines
from flowlens.session import file_sizes, scratch_dir
from flowlens.sources import syslog
from flowlens.streaming import ingest
from flowlens.streaming import rollups as stream_rollups

ONCE = {"availableNow": True}


def rows(df):
    return sorted(map(repr, df.collect()))


def test_landed_lines_make_several_batches(spark, sf_dir):
    """What the stream queries land is more than they take in a batch, and each batch has a folder."""
    root, lines = scratch_dir(spark, "test-batches"), fx.kv_lines(spark, sf_dir)
    stream = syslog.stream_syslog(spark, land_lines(spark, lines, "test-spread"), max_files=3).select("line")
    ingest.ingest_kv(stream, root, f"{root}/checkpoint", fx.AS_OF, ONCE).awaitTermination()
    found = ingest.stored(spark, root, "accepted", ingest.kv_schema(spark, "accepted", fx.AS_OF))
    assert found.select("batch_id").distinct().count() == 3


def test_quarantine_holds_the_rest(spark, sf_dir):
    root = scratch_dir(spark, "test-ingest")
    lines = fx.kv_lines(spark, sf_dir)
    landing = land_lines(spark, lines, "test-landing")
    stream = syslog.stream_syslog(spark, landing).select("line")
    ingest.ingest_kv(stream, root, f"{root}/checkpoint", fx.AS_OF, ONCE).awaitTermination()
    good, bad = validate.split_valid_invalid(parse_kv.parse_kv_typed(lines, fx.AS_OF))
    for branch, want in (("accepted", good), ("quarantine", bad)):
        found = ingest.stored(spark, root, branch, ingest.kv_schema(spark, branch, fx.AS_OF))
        assert rows(found.drop("batch_id", "ym")) == rows(want)


def _positional(spark, lines, name):
    root = scratch_dir(spark, name)
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(f"{root}/in")
    stream = syslog.stream_syslog(spark, f"{root}/in").select("line")
    ingest.ingest_positional(stream, root, f"{root}/checkpoint", fx.AS_OF, ONCE).awaitTermination()
    return {
        b: ingest.stored(spark, root, b, ingest.positional_schema(spark, b, fx.AS_OF))
        for b in ingest.positional_branches(fx.AS_OF)
    }


def test_batch_without_an_accepted_row(spark):
    """Each line is in one place, and a branch that never had a row reads as empty."""
    bad = "Jun 8 13:33:23 fw " + ",".join(["1", "2025/06/08 13:33:23", "s", "TRAFFIC", "end", "x", "r", "bad", "also bad"] + ["0"] * 60)
    other = "Jun 8 13:33:23 fw 1,2,3,SYSTEM,general,x"
    found = _positional(spark, [bad, other, "broken", ""], "test-rejects")
    counts = {b: df.count() for b, df in found.items()}
    assert counts == {"traffic": 0, "traffic_quarantine": 1, "urls": 0, "unreadable": 3}
    assert sorted(r["outcome"] for r in found["unreadable"].collect()) == ["error", "error", "skipped"]


def test_nothing_stored_yet(spark):
    schema = ingest.positional_schema(spark, "traffic", fx.AS_OF)
    assert ingest.stored(spark, scratch_dir(spark, "test-none"), "traffic", schema).count() == 0


def test_metrics_of_more_than_a_hundred_batches(spark, sf_dir):
    from flowlens.operators import parse_positional as positional

    root = scratch_dir(spark, "test-many")
    line = fx.traffic_lines(spark, sf_dir).first()["line"]
    spark.range(0, 105, 1, 105).select(F.lit(line).alias("value")).write.text(f"{root}/in")
    stream = syslog.stream_syslog(spark, f"{root}/in", max_files=1).select("line")
    judged = positional.with_traffic_fields(stream).select("outcome")
    ingest.ingest_counted(judged, root, f"{root}/checkpoint", None, ONCE).awaitTermination()
    found = ingest.metrics(spark, root)
    assert found.count() == 105 and found.agg(F.sum("total_lines")).first()[0] == 105


def _landed_urls(spark, rows, root):
    rows.withColumn("ts", F.col("ts").cast("timestamp")).repartition(3, "session_id").write.mode("append").parquet(f"{root}/in")
    return spark.read.parquet(f"{root}/in").schema


def _run(spark, store, root, checkpoint):
    stream = spark.readStream.schema(store.rows).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    stream_rollups.store_partials(stream, store, f"{root}/{checkpoint}", ONCE).awaitTermination()


def test_repeated_batch_is_stored_once(spark, sf_dir):
    """Without its checkpoint a run writes the same batch numbers again, as after a failure."""
    root = scratch_dir(spark, "test-again")
    store = stream_rollups.Store(f"{root}/r", rollups.url_hourly("ts"), "hour", _landed_urls(spark, fx.urls(spark, sf_dir), root))
    for run in ("first", "second"):
        _run(spark, store, root, run)
    total = stream_rollups.read_rollup(spark, store).agg(F.sum("requests")).first()[0]
    assert total == fx.urls(spark, sf_dir).count()


def test_rollup_from_stream_has_sketched_counts(spark, sf_dir):
    root, urls = scratch_dir(spark, "test-sketch"), fx.urls(spark, sf_dir)
    store = stream_rollups.Store(f"{root}/r", rollups.user_daily("ts"), "date", _landed_urls(spark, urls, root))
    _run(spark, store, root, "c")
    found = stream_rollups.read_rollup(spark, store)
    exact = store.rollup.exact(urls.withColumn("ts", F.col("ts").cast("timestamp")))
    assert rows(found) == rows(exact.select(*found.columns))


def test_rollup_by_month(spark, sf_dir):
    """Only touched months are rewritten, an interrupted compaction and a repeated batch change nothing, a window
    lists its months, and expired months go."""
    root = scratch_dir(spark, "test-months")
    urls = fx.urls(spark, sf_dir).withColumn("ts", F.col("ts") + F.make_ym_interval(months=(F.col("session_id") % 4).cast("int")))
    late = urls.where("session_id % 4 = 1 AND http_method = 'POST'")
    store = stream_rollups.Store(f"{root}/r", rollups.url_hourly("ts"), "hour", _landed_urls(spark, urls.exceptAll(late), root))
    assert stream_rollups.read_rollup(spark, store).count() == 0 and stream_rollups.compact(spark, store) == []
    _run(spark, store, root, "c")
    assert stream_rollups.compact(spark, store) == [202401, 202402, 202403, 202404]
    first = stream_rollups.listing(spark, store.path)
    assert first.pending == first.replaced == []

    _landed_urls(spark, late, root)
    _run(spark, store, root, "c")
    pending = {m for _, m in stream_rollups.listing(spark, store.path).pending}
    assert pending == {202402}
    whole = rows(stream_rollups.read_rollup(spark, store))
    # A compaction that wrote its month but did not remove what it replaces.
    removed, stream_rollups.remove = stream_rollups.remove, lambda *_: None
    try:
        assert stream_rollups.compact(spark, store) == [202402]
    finally:
        stream_rollups.remove = removed
    left = stream_rollups.listing(spark, store.path)
    assert left.replaced and left.pending == []
    assert rows(stream_rollups.read_rollup(spark, store)) == whole
    assert stream_rollups.compact(spark, store) == []
    after = stream_rollups.listing(spark, store.path)
    assert after.replaced == [] and {m for m in after.merged if after.merged[m] != first.merged[m]} == {202402}
    assert rows(stream_rollups.read_rollup(spark, store)) == whole
    exact = store.rollup.exact(urls.withColumn("ts", F.col("ts").cast("timestamp")))
    assert rows(stream_rollups.read_rollup(spark, store).drop("unique_users", "unique_domains", "avg_response_time")) == rows(
        exact.drop("unique_users", "unique_domains", "avg_response_time"))

    window = TimeWindow(datetime(2024, 2, 3), datetime(2024, 2, 20))
    files = stream_rollups.states(spark, store, window).inputFiles()
    assert files and all("ym=202402" in f for f in files)
    assert stream_rollups.expire(spark, store, datetime(2024, 6, 15)) == [202401, 202402]
    assert sorted(stream_rollups.listing(spark, store.path).merged) == [202403, 202404]


def test_batch_observation(spark, sf_dir):
    from flowlens.operators import parse_positional as positional

    lines = positional.with_traffic_fields(fx.traffic_lines(spark, sf_dir))
    counted, observation = ingest.observe_batch(lines, "load")
    counted.write.format("noop").mode("overwrite").save()
    assert observation.get["total_lines"] == lines.count()


def test_replays_add_no_row(spark):
    """A file that is sent again, at once or after the delay; a line of another time with the same text is another line."""
    root = scratch_dir(spark, "test-replay")
    at = datetime(2024, 3, 1)
    parts = [[(at + timedelta(minutes=i), f"line {i % 5}") for i in range(n, n + 50)] for n in (0, 50, 100, 400)]
    parts += [parts[3], parts[0], [(None, "no time"), parts[3][0], (at + timedelta(minutes=460), "line 0")]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, "ts timestamp, line string").write.parquet(f"{root}/in/{n}")
        stream = spark.readStream.schema("ts timestamp, line string").option("recursiveFileLookup", "true").parquet(f"{root}/in")
        once = ingest.without_replays(stream, "ts", "line", "60 minutes")
        out = once.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/c")
        run = out.trigger(**ONCE).start()
        run.awaitTermination()
    want = {row for part in parts[:4] for row in part} | {parts[6][2]}
    found = [(r["ts"], r["line"]) for r in spark.read.parquet(f"{root}/out").collect()]
    assert sorted(found) == sorted(want)
    assert run.lastProgress.stateOperators[0].numRowsTotal <= 51


def test_sessions(spark):
    from flowlens.streaming import activity

    root, at = scratch_dir(spark, "test-sessions"), datetime(2024, 3, 1)
    times = {"a": [0, 299, 600, 898, 2000], "b": [10], "c": [90_000]}
    data = [(d, at + timedelta(seconds=s)) for d, all_ in times.items() for s in all_]
    spark.createDataFrame(data, "device string, ts timestamp").write.parquet(f"{root}/in")
    stream = spark.readStream.schema("device string, ts timestamp").parquet(f"{root}/in")
    out = activity.sessions(stream, "ts", "device").writeStream.format("parquet").option("path", f"{root}/out")
    out.option("checkpointLocation", f"{root}/c").trigger(**ONCE).start().awaitTermination()
    found = {(r["device"], (r["first_seen"] - at).seconds, (r["last_seen"] - at).seconds, r["events"]) for r in spark.read.parquet(f"{root}/out").collect()}
    assert found == {("a", 0, 299, 2), ("a", 600, 898, 2), ("a", 2000, 2000, 1), ("b", 10, 10, 1)}


def test_traffic_lines_are_parsed_once(spark):
    """Both traffic branches read the typed rows that the batch holds."""
    lines = ingest.with_traffic(ingest.routed(spark.createDataFrame([], "line string")), fx.AS_OF)
    for branch in ("traffic", "traffic_quarantine"):
        plan = ingest.positional_branches(fx.AS_OF)[branch](lines.persist())._jdf.queryExecution().optimizedPlan().toString()
        assert plan.split("InMemoryRelation")[0].count("regexp") == plan.split("InMemoryRelation")[0].count("split(") == 0


def test_a_batch_holds_lines_and_no_typed_rows(spark, monkeypatch):
    """What is persisted is the routed lines; addresses judged before the parse are judged as after it."""
    at = "Jun 8 13:33:23 fw 1,2025/06/08 13:33:23,s,TRAFFIC,end,x,r"
    pairs = ["10.0.0.1,10.0.0.2", " 10.0.0.1 ,10.0.0.2", ",10.0.0.2", "10.0.0.1", "10.0.0.1,", "10.0.0.1,::1", "bad,10.0.0.2"]
    lines = spark.createDataFrame([(f"{at},{p}{rest}",) for p in pairs for rest in ("", ",0" * 60)], "line string")
    held = []
    stage = ingest.routed
    monkeypatch.setattr(ingest, "routed", lambda rows: held.append(stage(rows)) or held[-1])
    root = scratch_dir(spark, "test-held")
    lines.select("line").write.text(f"{root}/in")
    ingest.ingest_positional(syslog.stream_syslog(spark, f"{root}/in").select("line"), root, f"{root}/c", fx.AS_OF, ONCE).awaitTermination()
    assert [h.columns for h in held] == [["line", "route", "accepted"]]
    typed = validate.with_accepted(positional.parse_traffic(lines, fx.AS_OF), "src_ip_raw", "dst_ip_raw")
    for branch, good in (("traffic", True), ("traffic_quarantine", False)):
        schema = ingest.positional_schema(spark, branch, fx.AS_OF)
        found = ingest.stored(spark, root, branch, schema).drop("batch_id", "ym")
        assert rows(found) == rows(typed.where(F.col("accepted") == good).drop("accepted").select(*found.columns))


def test_large_feeds_are_landed_in_more_files(spark):
    path = land_lines(spark, spark.range(100).select(F.col("id").cast("string").alias("line")), "test-files", maxRecordsPerFile=5)
    assert len(spark.read.text(path).inputFiles()) >= 20 and spark.read.text(path).count() == 100


def test_a_feed_is_landed_packed_and_not_shuffled(spark, monkeypatch):
    """Tasks write their own lines; a feed of few files is dealt anew, and no line is lost either way."""
    lines = spark.range(0, 4000, 1, 16).select(F.when(F.col("id") % 9 != 0, F.concat(F.lit("same text " * 20), F.col("id") % 500)).alias("line"))
    want = sorted(r["line"] or "" for r in lines.collect())
    monkeypatch.setattr(streams, "FEED_LINES", 100)
    for parts, files in ((16, 48), (1, 40)):
        path = streams.land_feed(spark, lines.coalesce(parts), f"{scratch_dir(spark, 'test-feed')}/{parts}")
        sizes = file_sizes(spark, f"{path}/part-*.gz")
        assert len(sizes) >= files and sum(sizes) < sum(map(len, want)) / 4
        assert sorted(r["value"] for r in spark.read.text(path).collect()) == want
    monkeypatch.setattr(streams, "FEED_LINES", 100_000)
    path = streams.land_feed(spark, lines.coalesce(1), f"{scratch_dir(spark, 'test-feed')}/few")
    assert len(file_sizes(spark, f"{path}/part-*")) == 8
    assert [streams.batch_files(spark, path, n) for n in (1, 4, 6, None)] == [1, 4, 6, None]


def test_a_batch_does_not_grow_with_the_feed(spark, sf_dir, monkeypatch):
    """Of a large feed no batch has more than its bytes, in stream_resume either."""
    path = streams.land_feed(spark, fx.kv_lines(spark, sf_dir), f"{scratch_dir(spark, 'test-bytes')}/lines")
    sizes = file_sizes(spark, f"{path}/part-*")
    monkeypatch.setattr(streams, "BATCH_BYTES", 3 * max(sizes))
    assert 3 <= streams.batch_files(spark, path) < len(sizes) and streams.batch_files(spark, path, 6) <= 4
    monkeypatch.setattr(streams, "BATCH_BYTES", 1)
    assert streams.batch_files(spark, path) == streams.batch_files(spark, path, 6) == 1
    taken = []
    made = syslog.stream_syslog
    monkeypatch.setattr(syslog, "stream_syslog", lambda spark, path, max_files=None: taken.append(max_files) or made(spark, path, max_files))
    assert streams.stream_resume(spark, sf_dir).count() > 0 and taken == [1, 1]


def test_batches_are_compacted_in_rounds(spark, monkeypatch):
    """Months with and without a date, one larger than a round, and rows without months: all rows, as often as they were there."""
    root = scratch_dir(spark, "test-compact")
    data = [(i % 7, 202401 + i % 3 if i % 11 else None) for i in range(300)] + [(i, 202402) for i in range(400)]
    for batch in range(5):
        rows_ = spark.createDataFrame(data[batch::5], "n int, ym int")
        rows_.write.partitionBy("ym").parquet(f"{root}/a/batch_id={batch}")
        rows_.drop("ym").write.parquet(f"{root}/b/batch_id={batch}")
    monkeypatch.setattr(ingest, "COMPACTED_ROWS", 150)
    for branch, names in (("a", ["n", "ym"]), ("b", ["n"])):
        schema = rows_.select(*names).schema
        stored = ingest.stored(spark, root, branch, schema)
        assert len(ingest._rounds(stored, names[1:])) > 3
        for _ in range(2):
            ingest.compact_batches(spark, root, branch, schema, f"{root}/{branch}-compacted")
        after = spark.read.schema(schema).parquet(f"{root}/{branch}-compacted")
        assert rows(after) == rows(stored.drop("batch_id")) and after.count() == 700
        assert len(after.inputFiles()) < len(stored.inputFiles()) or branch == "b"
