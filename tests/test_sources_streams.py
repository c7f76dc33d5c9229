"""Sources, sinks and streaming jobs."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auralake.sources import captures, jsonl, transcripts
from auralake.streaming import jobs


def test_transcript_files(spark, tmp_path):
    (tmp_path / "episode_7.jsonl").write_text('{"type":"metadata","source":"rss"}\n{"type":"segment","index":0,"start":0,"end":1.5,"text":"a"}\n{"type":"summary","text":"ignored"}\n')
    (tmp_path / "episode_8.jsonl").write_text('{"type":"metadata","source":"asr"}\n{"type":"summary","text":"only"}\n')
    got = sorted(tuple(r) for r in jsonl.read_transcripts(spark, str(tmp_path)).collect())
    assert got == [(7, "rss", 0, 0.0, 1.5, "a"), (8, "asr", 0, None, None, "only")]
    (tmp_path / "episode_9.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        jsonl.read_transcripts(spark, str(tmp_path)).collect()


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "b int, a string")
    n, h = jsonl.write_jsonl(df, str(tmp_path / "out"))
    assert n == 2 and jsonl.write_jsonl(df.repartition(3), str(tmp_path / "out2"))[1] == h
    assert jsonl.read_jsonl(spark, str(tmp_path / "out"), "a string, b int").count() == 2


def test_corpus(spark, tmp_path):
    rows = [(i, k, f"text  {i} {k}") for i in range(70) for k in range(2)] + [(1, 0, "text  1 0"), (1, 5, None), (1, 6, " ")]
    path = str(tmp_path / "c")
    m = jsonl.build_corpus(spark.createDataFrame(rows, "episode_id long, seg_index int, text string"), path)
    assert m == {"rows": 140, "episodes": 70, "shards": 64}
    c = jsonl.open_corpus(spark, path)
    assert {r.text for r in jsonl.episode_rows(c, 65).collect()} == {"text 65 0", "text 65 1"}
    with pytest.raises(Exception):
        jsonl.build_corpus(spark.createDataFrame(rows, "episode_id long, seg_index int, text string"), path)
    import shutil

    shutil.rmtree(tmp_path / "c" / "manifest")
    with pytest.raises(Exception):
        jsonl.open_corpus(spark, path)


def test_bodies(spark):
    bodies = {
        "srt": "1\n00:00:01,000 --> 00:00:02,500\n<i>Hi</i>\nthere\n\n2\n00:01:00,000 --> 00:01:02,000\nBye\n", "vtt": "WEBVTT\r\n\r\n01:02.000 --> 01:03.000\r\nx\r\n",
        "json": '{"segments":[{"startTime":1,"endTime":2,"body":"a"},{"start":3,"text":"b"},{"start":4}]}', "stamped": "0:05\nhello\nyou\n0:10\nbye", "html": "<p>a <b>b</b></p><script>x()</script>&amp; c", "plain": " just  text ",
        "empty": "", "null": None, "broken": "[{",
    }
    df = spark.createDataFrame(list(bodies.items()), "k string, body string")
    got = {}
    for r in transcripts.parse_transcripts(df, "k", "body").orderBy("k", "seg_index").collect():
        got.setdefault(r.k, []).append((r.start_s, r.end_s, r.text))
    assert got == {
        "srt": [(1.0, 2.5, "Hi there"), (60.0, 62.0, "Bye")], "vtt": [(62.0, 63.0, "x")], "json": [(1.0, 2.0, "a"), (3.0, None, "b")], "stamped": [(5.0, 10.0, "hello you"), (10.0, None, "bye")],
        "html": [(None, None, "a b & c")], "plain": [(None, None, "just text")],
    }


def test_listings_feeds_and_pages(spark):
    rows = [(1, "[]"), (2, ""), (3, '[["timestamp","original"],["2020","u"]]'), (4, "oops"), (5, '[["timestamp","original"],["2020"]]')]
    got = {r.k: (r.trusted, r.at) for r in captures.parse_listing(spark.createDataFrame(rows, "k int, b string"), "k", "b").collect()}
    assert got == {1: (True, None), 2: (False, None), 3: (True, "2020"), 4: (False, None), 5: (False, None)}
    feed = '<rss><item><title>T</title><link>L</link><itunes:duration>1:05</itunes:duration><enclosure url="x.mp3?a=1&amp;b=2" type="audio/mpeg"/><enclosure url="y.mp3" type="audio/mpeg"/></item><item><title>no audio</title></item></rss>'
    f = captures.parse_feed(spark.createDataFrame([(1, feed)], "k int, b string"), "k", "b").collect()
    assert [(r.guid, r.title, r.duration_seconds, r.audio_url) for r in f] == [("L", "T", 65, "x.mp3?a=1&b=2")]
    page = "<table><tr><td>1</td><td><a href='/s/1'>One</a></td></tr><tr><td>1</td><td><a href='/s/2'>Again</a></td></tr><tr><td>2</td><td><a href='/s/3'>Two <b>x</b></a></td></tr></table>"
    p = spark.createDataFrame([(1, page), (2, "nothing")], "k int, b string")
    parsed = captures.parse_ranked_html(p, ["k"], "b")
    assert sorted((r.rank, r.name, r.entity_url) for r in parsed.collect()) == [(1, "One", "/s/1"), (2, "Two x", "/s/3")]
    assert {r.k: r.failed for r in captures.parsed_and_failed(p, parsed, "k").collect()} == {1: False, 2: True}
    js = spark.createDataFrame([("us", json.dumps([{"showUri": "spotify:show:1", "showName": "A"}, {"episodeUri": "e", "episodeName": "B", "showName": "A"}]))], "r string, b string")
    assert sorted((r.rank, r.unit, r.name) for r in captures.parse_ranked_json(js, ["r"], "b").collect()) == [(1, "show", "A"), (2, "episode", "B")]
    slug = spark.range(1).select(captures.chart_slug(F.lit("itunes/us-arts-podcasts?page=2")).alias("s")).first().s
    assert tuple(slug) == ("us", "arts", 2)
    assert spark.range(1).select(captures.salvage_items(F.lit('x shelf:[{"a":1},{"b":2},{"c'), "shelf:").alias("s")).first().s == ['{"a":1}', '{"b":2}']


def _stream(spark, tmp_path, rows, schema):
    src = tmp_path / "src"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(src / f"p{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src / "p*"))


def test_late_usage_is_counted_in_its_bucket(spark, tmp_path):
    t = datetime(2024, 1, 1, 0, 0, 5)
    schema = "ts timestamp, event_type string, value double"
    s = _stream(spark, tmp_path, [[(t, "a", 1.0)], [(t + timedelta(minutes=30), "a", 2.0), (t + timedelta(seconds=10), "a", 3.0)]], schema)
    q = jobs.usage_buckets(s).writeStream.outputMode("complete").format("memory").queryName("usage").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.total) for r in spark.table("usage").collect()) == [(1, 2.0), (2, 4.0)]


def test_snapshots_and_label_store(spark, tmp_path):
    w = jobs.replace_snapshots(str(tmp_path / "snap"))
    w(spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 1)], "captured_on string, v int"), 0)
    w(spark.createDataFrame([("2024-01-02", 2)], "captured_on string, v int"), 1)
    assert sorted((str(r.captured_on), r.v) for r in spark.read.parquet(str(tmp_path / "snap")).collect()) == [("2024-01-01", 1), ("2024-01-02", 2)]
    store = jobs.label_store(str(tmp_path / "labels"), ["k"])
    a = spark.createDataFrame([("x", False, 1, "e"), ("y", True, 1, "r")], "k string, ok boolean, at int, body string")
    for _ in range(2):
        store(a, 0)
    store(spark.createDataFrame([("x", True, 2, "r2"), ("x", False, 3, "e2")], a.schema), 1)
    v = {r.k: (r.body, r.n_attempts) for r in jobs.label_view(jobs.read_store(spark, str(tmp_path / "labels")), ["k"]).collect()}
    assert v == {"x": ("r2", 3), "y": ("r", 1)}


def test_leases(spark, tmp_path):
    t = datetime(2024, 1, 1)
    schema = "scope string, lease_id string, action string, ts timestamp"
    s = _stream(spark, tmp_path, [[("s", "a", "take", t), ("s", "b", "take", t + timedelta(seconds=1)), ("s", "c", "take", t + timedelta(seconds=2)), ("s", "a", "release", t + timedelta(seconds=3)), ("s", "d", "take", t + timedelta(seconds=4)), ("s", "e", "take", t + timedelta(seconds=90))]], schema)
    q = jobs.grant_leases(s, limit=2, ttl_seconds=60).writeStream.outputMode("append").format("memory").queryName("leases").start()
    q.processAllAvailable()
    q.stop()
    assert {r.lease_id: r.granted for r in spark.table("leases").collect()} == {"a": True, "b": True, "c": False, "d": True, "e": True}
