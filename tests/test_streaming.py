from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from agoralens.operators import monitoring as O
from agoralens.plans.preprocess import preprocess
from agoralens.session import shared_dir
from agoralens.sources.files import names
from agoralens.streaming import keyed, streams

EVENTS = "prediction_id bigint, ts timestamp, model_version string, sentiment string, confidence double"


@pytest.fixture
def folder(spark):
    """Writes frames as separate files, which become separate batches."""

    def write(frames):
        path = shared_dir(spark, "input")
        for df in frames:
            df.coalesce(1).write.mode("append").parquet(path)
        return path

    return write


def as_stream(spark, path, schema):
    return streams.read_stream(spark, path, schema, maxFilesPerTrigger="1")


def test_features_on_a_stream_equal_the_batch(spark, make_comments, folder):
    parts = [make_comments([{"comment_id": f"{k}{i}", "text": f"amazing words number {i} today"} for i in range(5)]) for k in "ab"]
    path = folder(parts)
    batch = preprocess(parts[0].unionByName(parts[1]))
    stream = streams.run_to_table(streams.comment_features(as_stream(spark, path, parts[0].schema)), "features")
    assert sorted(map(str, stream.collect())) == sorted(map(str, batch.collect()))


def test_days_close_with_the_watermark(spark, folder):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=3 * i), ["positive", "negative", "neutral"][i % 3]) for i in range(20)]
    parts = [spark.createDataFrame(rows[i : i + 5], "created_utc timestamp, sentiment string") for i in range(0, 20, 5)]
    stream = as_stream(spark, folder(parts), parts[0].schema)
    days = streams.run_to_table(streams.daily_label_counts(stream, "1 hour"), "days")
    got = {str(r.day): r.negative + r.neutral + r.positive for r in days.collect()}
    assert got == {"2024-01-01": 8, "2024-01-02": 8}


def test_copies_arrive_once(spark, make_comments, folder):
    rows = [{"comment_id": f"c{i % 4}"} for i in range(10)]
    parts = [make_comments(rows[:5]), make_comments(rows[5:])]
    stream = as_stream(spark, folder(parts), parts[0].schema)
    got = streams.run_to_table(streams.distinct_comments(stream), "distinct")
    assert sorted(r.comment_id for r in got.collect()) == ["c0", "c1", "c2", "c3"]


def test_last_events_per_key_over_many_batches(spark, folder):
    start = datetime(2024, 1, 1)
    # Most events belong to one version and some arrive late.
    rows = [
        (i, start + timedelta(seconds=(i * 37) % 400), "v0" if i % 10 else "v1", "positive", i / 400) for i in range(400)
    ]
    parts = [spark.createDataFrame(rows[i : i + 100], EVENTS) for i in range(0, 400, 100)]
    stream = as_stream(spark, folder(parts), parts[0].schema)
    base = shared_dir(spark, "last")
    query = keyed.last_n_per_key(stream, 25, ["model_version"], f"{base}/rows", f"{base}/state")
    query.awaitTermination()
    kept = keyed.kept_events(spark, f"{base}/rows", parts[0].schema, 25, ["model_version"])
    batch = O.latest(spark.createDataFrame(rows, EVENTS), 25, ["model_version"]).drop("rank")
    assert sorted(map(str, kept.collect())) == sorted(map(str, batch.select(kept.columns).collect()))
    drift = O.drift(kept, 25, ["model_version"]).select("model_version", F.round("average_confidence", 9)).collect()
    want = O.drift(spark.createDataFrame(rows, EVENTS), 25, ["model_version"]).select("model_version", F.round("average_confidence", 9)).collect()
    assert sorted(drift) == sorted(want)


def test_running_counts_and_histograms(spark, folder):
    rows = [(i, datetime(2024, 1, 1), f"v{i % 2}", "positive", i / 10) for i in range(10)]
    parts = [spark.createDataFrame(rows[:4], EVENTS), spark.createDataFrame(rows[4:], EVENTS)]
    path = folder(parts)
    base = shared_dir(spark, "running")
    counts = streams.running_counter(as_stream(spark, path, parts[0].schema), ["model_version"])
    streams.to_snapshots(counts, f"{base}/counts", f"{base}/state-1").awaitTermination()
    assert {r.model_version: r.value for r in streams.newest_snapshot(spark, f"{base}/counts").collect()} == {"v0": 5, "v1": 5}
    histogram = streams.running_histogram(as_stream(spark, path, parts[0].schema), ["model_version"], "confidence", [0.5])
    streams.to_snapshots(histogram, f"{base}/hist", f"{base}/state-2").awaitTermination()
    got = {(r.model_version, r.le): r.bucket_count for r in streams.newest_snapshot(spark, f"{base}/hist").collect()}
    assert got == {("v0", "0.5"): 3, ("v0", "+Inf"): 5, ("v1", "0.5"): 3, ("v1", "+Inf"): 5}


def test_running_days_include_the_open_one(spark, folder):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=3 * i), ["positive", "negative", "neutral"][i % 3]) for i in range(20)]
    parts = [spark.createDataFrame(rows[i::4], "created_utc timestamp, sentiment string") for i in range(4)]
    base = shared_dir(spark, "days")
    stream = streams.running_daily_counts(as_stream(spark, folder(parts), parts[0].schema))
    streams.to_snapshots(stream, f"{base}/rows", f"{base}/state").awaitTermination()
    got = {str(r.day): r.negative + r.neutral + r.positive for r in streams.newest_snapshot(spark, f"{base}/rows").collect()}
    assert got == {"2024-01-01": 8, "2024-01-02": 8, "2024-01-03": 4}
    assert [n for n in names(spark, f"{base}/rows") if n.startswith("batch=")] == ["batch=2", "batch=3"]
    with pytest.raises(Exception, match="checkpoint is lost"):
        streams.to_snapshots(stream, f"{base}/rows", f"{base}/other").awaitTermination()


def test_no_input_is_an_empty_table(spark):
    assert streams.newest_snapshot(spark, shared_dir(spark, "none"), spark.range(1).schema).count() == 0
    with pytest.raises(FileNotFoundError):
        streams.newest_snapshot(spark, shared_dir(spark, "none"))


def as_rows(df):
    return sorted(map(str, df.collect()))


def test_state_after_a_restart_equals_the_batch(spark, folder):
    """Batches that arrive one by one, with the stream stopped in between; nulls and ties keep their places."""
    start = datetime(2024, 1, 1, microsecond=123456)
    rows = [(i, start + timedelta(seconds=i % 50), f"v{i % 3 and 1}", "neutral", i / 7) for i in range(300)]
    rows += [(None, None, None, None, None), (5, start, None, "positive", float("nan")), (7, None, "v0", "x\n", 0.5)]
    schema, base = spark.createDataFrame([], EVENTS).schema, shared_dir(spark, "restart")
    path = folder([])
    for k in range(4):
        spark.createDataFrame(rows[k::4], EVENTS).coalesce(1).write.mode("append").parquet(path)
        keyed.last_n_per_key(as_stream(spark, path, schema), 20, ["model_version"], f"{base}/rows", f"{base}/state", salts=3).awaitTermination()
        seen = [r for j in range(k + 1) for r in rows[j::4]]
        batch = O.latest(spark.createDataFrame(seen, EVENTS), 20, ["model_version"]).select(*schema.names)
        assert as_rows(keyed.kept_events(spark, f"{base}/rows", schema, 20, ["model_version"])) == as_rows(batch)


def test_a_batch_writes_only_what_it_changes(spark, folder):
    start = datetime(2024, 1, 1)
    first = [(i, start + timedelta(seconds=i), f"v{i % 100}", "neutral", 0.5) for i in range(2000)]
    later = [[(5000 + 10 * k + i, start + timedelta(days=1, seconds=i), "v7", "positive", 0.1) for i in range(3)] for k in range(6)]
    parts = [spark.createDataFrame(p, EVENTS) for p in [first, *later]]
    path, base = folder(parts), shared_dir(spark, "changes")
    stream = as_stream(spark, path, parts[0].schema)
    keyed.last_n_per_key(stream, 10, ["model_version"], f"{base}/rows", f"{base}/state", salts=1).awaitTermination()
    written = {f: spark.read.parquet(f"{base}/rows/{f}") for f in names(spark, f"{base}/rows")}
    sizes = [written[f"batch={k}"].count() for k in range(7)]
    assert sorted(sizes) == [10] * 6 + [1000] and not any(f.startswith("base") for f in written)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    expected = O.latest(every, 10, ["model_version"]).select(*every.columns)
    assert as_rows(keyed.kept_events(spark, f"{base}/rows", every.schema, 10, ["model_version"])) == as_rows(expected)


def test_batches_are_merged_as_they_outgrow_the_base(spark, folder):
    parts = [spark.createDataFrame([(i, datetime(2024, 1, 1), f"v{i % 4}", "positive", 0.5) for i in range(9)], EVENTS) for _ in range(9)]
    path, base = folder(parts), shared_dir(spark, "merged")
    counts = streams.running_counter(as_stream(spark, path, parts[0].schema), ["model_version"])
    keyed.to_keyed_table(counts, f"{base}/rows", f"{base}/state", ["model_version"]).awaitTermination()
    assert {r.model_version: r.value for r in keyed.newest_rows(spark, f"{base}/rows", ["model_version"], counts.schema).collect()} == {
        "v0": 27, "v1": 18, "v2": 18, "v3": 18}
    held = names(spark, f"{base}/rows")
    assert sum(f.startswith("base=") for f in held) == 2 and len(held) < 7
    with pytest.raises(Exception, match="checkpoint is lost"):
        keyed.to_keyed_table(counts, f"{base}/rows", f"{base}/other", ["model_version"]).awaitTermination()
    assert keyed.newest_rows(spark, f"{base}/none", ["model_version"], counts.schema).count() == 0


def test_idle_keys_time_out(spark, folder):
    start = datetime(2024, 1, 1)
    days = [[(0, start, "old", "x", 0.1)], [(1, start + timedelta(days=1), "new", "x", 0.2)]]
    days += [[(k, start + timedelta(days=10 * k), "new", "x", 0.3)] for k in (2, 3, 4)]
    parts = [spark.createDataFrame(d, EVENTS) for d in days]
    base = shared_dir(spark, "idle")
    for part in parts:  # one after the other, as the watermark moves between batches
        part.coalesce(1).write.mode("append").parquet(f"{base}/input")
        stream = as_stream(spark, f"{base}/input", parts[0].schema).withWatermark("ts", "1 hour")
        keyed.last_n_per_key(stream, 5, ["model_version"], f"{base}/rows", f"{base}/state", idle="7 days").awaitTermination()
    kept = keyed.kept_events(spark, f"{base}/rows", parts[0].schema, 5, ["model_version"]).collect()
    assert {r.model_version for r in kept} == {"new"} and max(r.prediction_id for r in kept) == 4
