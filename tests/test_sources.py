import json
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from agoralens.session import shared_dir
from agoralens.sources import tables
from agoralens.sources.schema import COMMENTS
from agoralens.streaming import streams


def test_csv_keeps_line_breaks_quotes_and_types(spark):
    texts = ['line\nbreak, "quoted"', "plain", 'back\\slash "', "", "ünï 😀"]
    rows = [
        (f"c{i}", t, "python", i, "neutral", datetime(2024, 1, 1, 5), None, "title", "p", True, "link", 0, len(t), 1)
        for i, t in enumerate(texts)
    ]
    path = tables.write_csv(spark.createDataFrame(rows, COMMENTS), shared_dir(spark, "csv"))
    back = tables.read_comments_csv(spark, path).orderBy("comment_id").collect()
    assert [r.text or "" for r in back] == texts
    assert (back[0].score, back[0].created_utc, back[0].is_submitter) == (0, datetime(2024, 1, 1, 5), True)


def test_snapshots(spark):
    root = shared_dir(spark, "snapshots")
    df = spark.createDataFrame([("a", 1)], "comment_id string, n int")
    for i, run in enumerate(["20240101_000000", "20240103_000000", "20240102_235959"]):
        tables.write_snapshot(df.withColumn("n", F.lit(i)), root, "comments", run)
    assert tables.read_newest(spark, root, "comments").collect() == [("a", 1)]
    assert tables.write_snapshot(df.filter("n > 5"), root, "comments") is None
    with pytest.raises(Exception, match="already exists"):
        tables.write_snapshot(df, root, "comments", "20240101_000000")
    with pytest.raises(ValueError):
        tables.write_snapshot(df, root, "comments", "yesterday")
    named = tables.write_snapshot(df, root, "other")
    assert "run_ts=20" in named


def test_batches_accumulate(spark):
    a = spark.createDataFrame([("a", 1)], "comment_id string, score int")
    b = spark.createDataFrame([("b", "hot")], "comment_id string, category string")
    both = tables.accumulate([a, b])
    path = shared_dir(spark, "batches")
    tables.append_batch(both.filter("score is null"), path)
    tables.append_batch(both.filter("score is not null"), path)
    got = sorted(map(tuple, spark.read.schema(both.schema).parquet(path).collect()))
    assert got == [("a", 1, None), ("b", None, "hot")]


def test_threads_flatten(spark):
    post = {
        "id": "p1", "title": "T", "subreddit": "python", "over_18": False, "listing": "hot",
        "comments": [
            {"id": "c1", "body": "x", "score": 3, "created_utc": 1704067200.0, "is_submitter": True, "permalink": "/r/python/1"},
            {"id": "c2", "body": "y", "score": -1, "created_utc": 1704067201.5, "permalink": "/2", "controversiality": 1},
        ],
    }
    raw = spark.createDataFrame([(json.dumps(post),), (json.dumps({**post, "comments": []}),), ("not json",)], "value string")
    a, b = tables.flatten_threads(raw).orderBy("comment_id").collect()
    assert (a.created_utc, a.permalink, a.controversiality) == (datetime(2024, 1, 1), "https://reddit.com/r/python/1", 0)
    assert b.created_utc.microsecond == 500000 and b.controversiality == 1 and b.post_title == "T"


def test_working_folder_must_be_shared_on_a_cluster(monkeypatch):
    class Session:
        class sparkContext:
            applicationId = "app-1"

        class conf:
            settings = {"spark.master": "yarn"}

            @classmethod
            def get(cls, key, default=None):
                return cls.settings.get(key, default)

    with pytest.raises(RuntimeError):
        shared_dir(Session, "x")
    Session.conf.settings["spark.checkpoint.dir"] = "hdfs://shared/dir/"
    assert shared_dir(Session, "x").startswith("hdfs://shared/dir/agoralens-app-1/x-")


def test_local_session_without_a_shared_folder_gets_its_own():
    class Session:
        class sparkContext:
            applicationId = "app-1"

        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "local[2]"}.get(key, default)

    first, second = shared_dir(Session, "x"), shared_dir(Session, "x")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_a_damaged_old_snapshot_does_not_matter(spark):
    root = shared_dir(spark, "damaged")
    for run in ("20240101_000000", "20240102_000000"):
        tables.write_snapshot(spark.range(3), root, "numbers", run)
    old = f"{root}/numbers/run_ts=20240101_000000"
    for name in os.listdir(old):
        if name.endswith(".parquet"):
            with open(f"{old}/{name}", "wb") as file:
                file.write(b"no parquet")
    os.makedirs(f"{root}/numbers/run_ts=20240103_000000")  # begun and not ended
    assert sorted(r.id for r in tables.read_newest(spark, root, "numbers").collect()) == [0, 1, 2]
    with pytest.raises(FileNotFoundError):
        tables.read_newest(spark, root, "others")


def test_large_csv_is_read_by_many_tasks(spark):
    """Records that span lines and splits, whatever the size of the splits; the same as one task reads."""
    rng = random.Random(4)
    bits = ["a", '"', ",", "\n", "\n\n", "\r\n", "ü", "😀", '""', " ", "x" * 30, "\\"]
    rows = [(f"c{i}", "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 40, 400]))), i) for i in range(300)]
    df = spark.createDataFrame([(i, t or None, n) for i, t, n in rows], "comment_id string, text string, score long").coalesce(1)
    path = tables.write_csv(df, shared_dir(spark, "csv"))
    whole = spark.read.schema(df.schema).options(header=True, multiLine=True, escape='"').csv(path)
    expected = sorted(map(str, whole.collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97", "1000", "40000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            back = tables.read_comments_csv(spark, path, df.schema)
            assert sorted(map(str, back.collect())) == expected and len(expected) == len(rows)
            lines = spark.read.text(path)
            assert lines.rdd.getNumPartitions() > 20 or size == "40000"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    with pytest.raises(ValueError, match="without a type"):
        tables.read_comments_csv(spark, path, df.select("text").schema)


def test_batches_are_committed_once(spark):
    root = shared_dir(spark, "committed")
    schema = "comment_id string, score int"
    assert tables.read_batches(spark, root, spark.createDataFrame([], schema).schema).count() == 0
    one, two = (spark.createDataFrame(r, schema) for r in ([("a", 1), ("b", 2)], [("c", 3)]))
    spark.createDataFrame([("a", 1)], schema).write.parquet(f"{root}/batch=one")  # a job that died before it committed
    assert tables.read_batches(spark, root, one.schema).count() == 0
    assert tables.commit_batch(one, root, "one") and tables.commit_batch(two, root, "two")
    assert not tables.commit_batch(one, root, "one") and tables.committed_batches(spark, root) == ["one", "two"]
    two.write.mode("overwrite").parquet(f"{root}/batch=three")
    assert sorted(map(tuple, tables.read_batches(spark, root, one.schema).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(ValueError, match="a batch is named"):
        tables.commit_batch(two, root, "../x")


def test_bad_posts_are_told(spark):
    good = {"id": "p1", "comments": [{"id": "c1", "body": "x", "score": 3}]}
    rows = {
        json.dumps(good): None, "not json": "bad_json", None: "bad_json", '{"id": "p"': "bad_json", "": "bad_json",
        json.dumps({**good, "comments": []}): "no_comments", json.dumps({"id": "p1"}): "no_comments",
        json.dumps({**good, "id": None}): "no_post_id", json.dumps({**good, "comments": [{"body": "x"}]}): "no_comment_id",
        json.dumps({**good, "comments": [{"id": "c", "score": "many"}]}): "bad_json",
    }
    raw = spark.createDataFrame([(k,) for k in rows], "value string")
    assert {r["raw"]: r.reason for r in tables.rejected_threads(raw).collect()} == {k: v for k, v in rows.items() if v}
    assert [r.comment_id for r in tables.flatten_threads(raw).collect()] == ["c1"]
    path = shared_dir(spark, "posts")
    raw.write.parquet(path)
    stream = streams.read_stream(spark, path, raw.schema)
    assert streams.run_to_table(tables.rejected_threads(stream), "rejected").count() == len(rows) - 1
