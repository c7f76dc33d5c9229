"""Results that were once cut short: each case is lost or wrong under the narrower rule."""

import datetime
import inspect
import random
import re
from statistics import median

from auralake.operators import catalog, charts, scoring, text
from auralake.plans import reference

DAY = datetime.date


def test_days_of_all_notations(spark):
    """Every notation of problem 1 gives the UTC day of its instant; a day alone is that day in any zone."""
    cases = {
        "2021-03-04T05:06:07Z": DAY(2021, 3, 4), "2021-03-04T23:30:00-05:00": DAY(2021, 3, 5), "Thu, 04 Mar 2021 08:00:00 GMT": DAY(2021, 3, 4), "1614844800": DAY(2021, 3, 4),
        "1614844800000": DAY(2021, 3, 4), "03/04/2021 11:00 AM": DAY(2021, 3, 4), "4.3.2021 11:00": DAY(2021, 3, 4), "March 4, 2021": DAY(2021, 3, 4), "2021-03-04": DAY(2021, 3, 4),
        "20210304": DAY(2021, 3, 4), "2021-03-04 00:30:00": DAY(2021, 3, 3), "2021-03-04 at noon": DAY(2021, 3, 4), "TBD": None, "2021-13-04": None, "": None, None: None,
    }
    rows = spark.createDataFrame([(i, t, "h") for i, t in enumerate(cases)], "id long, published_date string, feed_host string")
    hosts = spark.createDataFrame([("h", "Europe/Berlin")], "feed_host string, time_zone string")
    out = catalog.with_days(rows, hosts)
    assert out.columns == [*rows.columns, "day"]
    assert {r["published_date"]: r["day"] for r in out.collect()} == cases


def test_names_of_one_word_capitals_and_digits(spark):
    """Single names, capitals, digits and numbers that continue a run; whatever the language column says."""
    said = "Speaker 1: You heard about eight sleep. It's called the Pod 5. Visit eightsleep dot com slash tucker. All of our probiotics, like Vital Reds and AG1. LMNT, then lmnt and LMNT of Bank Of America The 7."
    df = spark.createDataFrame([(1, "en", said), (2, None, "Ask Thorne."), (3, "EN-us", ""), (4, "de", None)], "doc_id long, lang string, text string")
    got = {(r.doc_id, r.name): r.n for r in text.name_candidates(df, "doc_id", "text").collect()}
    assert got == {(1, "Pod 5"): 1, (1, "eightsleep"): 1, (1, "Vital Reds"): 1, (1, "AG1"): 1, (1, "LMNT"): 2, (1, "Bank Of America The 7"): 1, (2, "Ask Thorne"): 1}


def _names_by_force(t):
    """All token intervals of a sentence that are whole runs, by their definition and not by a scan."""
    out = []
    t0 = text.NAME_LABEL.sub("", t, count=1).strip() or t.strip()
    for s in re.split(r"(?<=[.!?])\s+", t0):
        k = re.findall(r"[A-Za-z0-9][A-Za-z0-9'&+-]*", s)
        start = lambda x: (x[0].isupper() or bool(re.search("[0-9]", x) and re.search("[A-Za-z]", x)))
        opens = [start(x) and x.lower() not in text.NAME_STOPWORDS for x in k]
        goes = [start(x) or x.isdigit() for x in k]
        whole = [(i, j) for i in range(len(k)) for j in range(i, len(k)) if opens[i] and all(goes[i + 1 : j + 1]) and (j + 1 == len(k) or not goes[j + 1]) and not any(opens[h] and all(goes[h + 1 : i + 1]) for h in range(i))]
        for i, j in whole:
            while k[j].lower() in text.NAME_STOPWORDS:
                j -= 1
            out.append(" ".join(k[i : j + 1]))
    return [n for n in out + text.NAME_SITE.findall(t) if len(n) > 1]


def test_names_against_brute_force():
    rnd = random.Random(3)
    words = ["The", "the", "of", "Of", "Bank", "AG1", "5", "7", "ag1", "sleep", "I", "A", "LMNT", "One", "x.", "Pod.", "B!", "acme dot com", "b-12", "Bob:"]
    for _ in range(500):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 14)))
        assert text.names_in(t) == _names_by_force(t), t


def test_verdicts_of_windows(spark):
    """Every verdict, with its precedence; the neighbours come from the episodes at hand."""
    d = datetime.date.fromisoformat
    e = [("a", "2020-01-10", "Episode 1", 1), ("a", "2020-03-10", "x", 2), ("a", "2020-12-01", "x", 3), ("b", "2020-05-05", "Episode 7", 4), ("c", "2020-05-05", "x", 5), ("l", "2020-01-01", "x", 6), ("l", "2020-06-01", "x", 7), ("t", "2020-05-05", "Part", 8), ("j", "1970-01-01", "x", 9)]
    ep = spark.createDataFrame([(i, k, d(day), t, "trailer" if k == "t" else None) for k, day, t, i in e], "id long, entity string, day date, title string, episode_type string")
    cases = [
        ("a", "2020-02-01", "2020-03-01", 0, "missing"), ("a", "2020-06-01", "2020-07-01", 0, "unknown"), ("a", "2020-03-01", "2020-04-01", 1, "filled"), ("a", "2019-01-01", "2019-02-01", 0, "before_launch"),
        ("a", "2020-01-01", "2020-02-01", 1, "launch"), ("a", "2021-01-01", "2021-02-01", 0, "unknown"), ("b", "2020-01-01", "2020-02-01", 0, "missing"), ("c", "2020-01-01", "2020-02-01", 0, "unknown"),
        ("l", "2020-02-01", "2020-03-01", 0, "not_publishing"), ("t", "2020-04-01", "2020-05-01", 0, "before_launch"), ("j", "2020-01-01", "2020-02-01", 0, "unknown"), ("z", "2020-01-01", "2020-02-01", 0, "unknown"),
    ]
    cov = spark.createDataFrame([("s", k, d(a), d(b), n) for k, a, b, n, _ in cases], "study string, entity string, win_start date, win_end date, n_episodes long")
    listings = spark.createDataFrame([("l", d("2020-01-01"), d("2020-02-10"), 5), ("l", d("2020-02-11"), d("2020-06-01"), None)], "entity string, oldest date, read date, n_items long")
    got = {(r.entity, str(r.win_start)): r.verdict for r in catalog.classify_windows(cov, ep, listings, catalog.start_evidence(ep)).collect()}
    assert got == {(k, a): v for k, a, _, _, v in cases}
    bare = {(r.entity, str(r.win_start)): r.verdict for r in catalog.classify_windows(cov, ep).collect()}
    assert bare["a", "2020-02-01"] == bare["l", "2020-02-01"] == "missing" and bare["a", "2019-01-01"] == bare["b", "2020-01-01"] == "unknown"


def test_turnover_to_a_hundred_days_with_moves_and_bands(spark):
    """Against all pairs of days, by the bins and bands written out."""
    rnd = random.Random(5)
    days = [0, 1, 4, 30, 44, 60, 99, 160]
    ranks = {t: dict(zip(rnd.sample(range(90), 60), range(1, 61))) for t in days}
    origin = datetime.date(2020, 1, 1)
    df = spark.createDataFrame([("s", origin + datetime.timedelta(t), k, r) for t, m in ranks.items() for k, r in m.items()], "series string, day date, entity long, rank int")
    want = {}
    for a in days:
        for b in days:
            for lo, hi in ((1, 1), (2, 3), (4, 9), (10, 20), (21, 45), (46, 100)):
                if lo <= b - a <= hi:
                    x, y = ranks[a], ranks[b]
                    both = x.keys() & y.keys()
                    part = [(k := [e for e, r in x.items() if p <= r <= q]) and sum(e in y for e in k) / len(k) for p, q in ((1, 10), (11, 50), (51, 100))]
                    want.setdefault(lo, []).append([len(both) / len(x.keys() | y.keys()), len(both) / len(x), median(abs(x[e] - y[e]) for e in both), *part])
    got = {int(re.match(r"\d+", r.gap)[0]): r for r in charts.turnover(df).collect()}
    assert set(got) == set(want) and 46 in got
    for lo, rows in want.items():
        r = got[lo]
        assert r.pairs == len(rows)
        assert [r.median_jaccard, r.median_retention, r.median_move, r.retain_1_10, r.retain_11_50, r.retain_51_100] == [round(median(c), 6) for c in zip(*rows)]


def test_settings_are_those_of_the_reference(spark, tmp_path):
    """2,000 replicates, descriptions up to 1,000 characters, days with at least 0.95 of the depth in distinct entities."""
    assert inspect.signature(scoring.paired_bootstrap).parameters["iterations"].default == 2000
    spark.createDataFrame([(1, "x" * 1000), (2, "y" * 1001)], "id long, description string").write.parquet(f"{tmp_path}/episodes.parquet")
    short = {r.id: r.short for r in reference.clean_descriptions(spark, str(tmp_path)).collect()}
    assert short == {1: "x" * 1000, 2: "y" * 997 + "..."}
    noon = datetime.datetime(2024, 1, 1, 12)
    rows = [(day, n, k) for day, n in ((0, 47), (1, 48), (2, 60)) for k in range(n) for _ in range(2)]
    events = [(i, "click", noon + datetime.timedelta(days=day), k, float(k)) for i, (day, n, k) in enumerate(rows)]
    spark.createDataFrame(events, "event_id long, event_type string, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {}
    for r in reference.daily_entities(spark, str(tmp_path)).collect():
        got.setdefault(r.day.day, []).append((r.rank, r.entity))
    assert {k: sorted(v) for k, v in got.items()} == {2: [(i + 1, 47 - i) for i in range(48)], 3: [(i + 1, 59 - i) for i in range(50)]}
