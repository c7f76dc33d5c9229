"""Problem 6: cases that only the neighbours decide."""

import json

from auralake.llm import linkage

POD = "id long, title string, publisher string, categories string, episode_count int, latest_episode_date string, rss_url string"


def run(spark, shows, records, **k):
    p = spark.createDataFrame([(i, t, who, None, n, None, f"a.example/{i}") for i, t, who, n in shows], POD)
    r = spark.createDataFrame([(i, json.dumps({"collectionName": t, "artistName": who, "trackCount": n, "feedUrl": f})) for i, t, who, n, f in records], "result_id long, record string")
    return {(x.podcast_id, x.result_id) for x in linkage.match_shows(p, r, **k).collect()}


NAMES = ["Copper Pier Stress", "Sturdy Glacier Whales", "Pastel Pasture Protein", "Lunar Steeple Fevers"]


def test_publishers_under_two_names(spark):
    shows = [(k, t, "Nokirup Mountain", 50 + k) for k, t in enumerate(NAMES)] + [(9, "Hasty Railway Zinc", "Bukelath", 70), (10, NAMES[0], "Zerajon", 51)]
    records = [(k, t, "NKM Verlag", 51 + k, f"f/{k}") for k, t in enumerate(NAMES)] + [(9, "Hasty Railway Zinc", "Orchard", 70, "f/9")]
    want = {(k, k) for k in range(4)}
    assert run(spark, shows, records) == want  # four shows make the names one publisher; one show doesn't
    assert run(spark, shows, records, alpha=0.0) == set()


def test_a_missing_publisher(spark):
    shows = [(1, NAMES[0], "Nokirup Mountain", 50), (2, NAMES[0], "Bukelath", 400), (3, NAMES[1], "Ann Lee", 10)]
    records = [
        (1, NAMES[0], "Bukelath", None, "f/x"), (2, NAMES[0], None, None, "f/x"), (3, NAMES[0], None, 300, "f/x"),  # of one feed, so by one publisher
        (4, NAMES[1], "Orchard", None, "f/y"), (5, NAMES[1], None, None, "f/y"), (6, NAMES[1], None, None, "f/z"),
    ]
    assert run(spark, shows, records) == {(2, 1), (2, 2), (2, 3), (3, 6)}
    assert (3, 5) in run(spark, shows, records, alpha=0.0)
