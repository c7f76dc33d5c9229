"""Text, chart, catalog, label, scoring, sampling and graph operators on small fixtures and against brute force."""

import itertools
import random
import threading
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.functions import scalar as fn
from auralake.operators import catalog, charts, evaluation, labels, sampling, scoring, selection, text
from auralake.operators.graph import connected_components
from auralake.session import broadcast_if_small, shared_dir

SEG = "episode_id long, seg_index int, start_s double, end_s double, text string"
LEX = {"topics": {"sleep": {"terms": ["sleep", "deep sleep"]}}, "narratives": {"n": {"terms": ["never\\w+"]}}, "products": {"p": {"terms": ["magnesium"]}}}


def test_lexicon_prefers_long_and_gates_patterns(spark):
    rows = [(1, 0, 0.0, 1.0, "BOB: Deep sleep helps. Nevermore! Magnesium and sleep, nevermore."), (1, 1, None, None, None), (2, 0, 0.0, 2.0, "")]
    df = spark.createDataFrame(rows, SEG)
    got = {(r.section, r.term): r.n_sent for r in text.lexical_counts(df, LEX).collect()}
    assert got == {("topics", "deep sleep"): 1, ("topics", "sleep"): 1, ("products", "magnesium"): 1, ("narratives", "never\\w+"): 1}
    ep = {r.episode_id: r for r in text.scan_episodes(df).collect()}
    assert (ep[1].n_seg, ep[1].n_sent, ep[1].n_words, ep[1].speaker_prefixes, ep[2].n_sent) == (2, 3, 8, 1, 0)
    assert text.lexical_counts(df.limit(0), LEX).count() == 0


def test_units_cover_words_and_times(spark):
    t = 'One two. "Three!" ' + "w " * 100
    spans = text.unit_spans(t, 45)
    assert " ".join(t[a:b] for a, b in spans).split() == t.split() and all(len(t[a:b].split()) <= 45 for a, b in spans)
    u = text.transcript_units(spark.createDataFrame([(1, 0, 0.0, 10.0, "Ab cd. Ef."), (1, 1, None, 3.0, "x"), (1, 2, 1.0, 2.0, None)], SEG)).orderBy("unit_index").collect()
    assert [(r.unit_index, r.timing_quality) for r in u] == [(0, "interpolated"), (1, "interpolated"), (2, "unavailable")] and u[0].end_seconds == 6.0
    with pytest.raises(ValueError):
        text.unit_spans("a", 4)


@pytest.mark.parametrize("seed", range(5))
def test_windows(seed):
    rnd = random.Random(seed)
    words = [rnd.randrange(1, 46) for _ in range(rnd.randrange(0, 60))]
    w = text.window_bounds(words, 100, 30)
    assert sorted({i for a, b in w for i in range(a, b)}) == list(range(len(words)))
    for (a, b), (c, _) in zip(w, w[1:]):
        assert sum(words[a:b]) >= 100 and a < c <= b and sum(words[a : b - 1]) < 100
        assert sum(words[c + 1 : b]) < 30


def test_quotes_and_overlaps():
    assert text.locate_words("I I think it it works", "i think it works") == (0, 21)
    assert text.locate_words("a b", "c") is None and text.locate_words("a", "") is None
    assert text.trim_repeated_prefix("we went to the big house", "to the big house and slept") == "and slept"
    assert text.trim_repeated_prefix("a b", "c d") == "c d"
    assert text.edit_rate(["a", "b"], ["a", "c", "b"]) == 0.5 and text.edit_rate([], ["a"]) is None


def test_weights_and_cells(spark):
    d = [date(2019, 1, 1), date(2019, 4, 1), date(2019, 7, 1)]
    df = spark.createDataFrame([("s", x) for x in d], "series string, day date")
    assert sum(r.weight for r in charts.midpoint_weights(df).collect()) == 181
    c = charts.snapshot_cells(df).collect()
    assert sum(r.hi_hour - r.lo_hour for r in c) == 182 * 24


def test_select_daily_pages(spark):
    t0 = datetime(2020, 1, 1, 10)
    rows = []
    for path, page, at, arch, ranks in [("a1", 1, t0, "w", range(1, 51)), ("a2", 2, t0 + timedelta(minutes=59), "w", range(50, 101)), ("a3", 2, t0 + timedelta(minutes=61), "w", range(51, 101)), ("b1", 1, t0 + timedelta(hours=3), "w", range(1, 60)), ("c2", 2, t0, "x", range(51, 101))]:
        rows += [("s", arch, path, page, at, r) for r in ranks]
    df = spark.createDataFrame(rows, "source string, archive string, path string, page int, captured_at timestamp, rank int")
    got = charts.select_daily(df, ["source"]).collect()
    assert len(got) == 100 and {r.path for r in got} == {"a1", "a2"} and [r.path for r in got if r.rank == 50] == ["a1"]
    tie = spark.createDataFrame([("s", "w", "late", 1, t0 + timedelta(hours=1), 1), ("s", "w", "early", 1, t0, 1)], df.schema)
    assert [r.path for r in charts.select_daily(tie, ["source"]).collect()] == ["early"]
    assert charts.select_daily(df.limit(0), ["source"]).count() == 0


def test_nearest_in_time_ties_go_to_the_earlier(spark):
    rows = spark.createDataFrame([(1, "k", date(2020, 1, 10)), (2, "k", date(2019, 1, 1)), (3, "z", date(2020, 1, 1)), (4, "k", date(2020, 1, 15))], "id int, key string, day date")
    known = spark.createDataFrame([("k", date(2020, 1, 5), 50), ("k", date(2020, 1, 15), 150), ("k", date(2020, 1, 5), 40)], "key string, day date, v int")
    got = {r.id: r.resolved for r in charts.nearest_in_time(rows, known, "key", "day", "v").collect()}
    assert got == {1: 40, 2: 40, 3: None, 4: 150}


def test_complete_to_and_stale(spark):
    df = spark.createDataFrame([("s", date(2020, 1, 1), "a", 1), ("s", date(2020, 1, 1), "b", 2), ("s", date(2020, 1, 1), "c", 4), ("s", date(2020, 1, 2), "a", 1), ("s", date(2020, 1, 2), "b", 2), ("s", date(2020, 1, 2), "c", 4)], "series string, day date, entity string, rank int")
    assert {r.complete_to for r in charts.complete_to(df).collect()} == {2}
    assert sorted((r.day.day, r.is_stale) for r in charts.stale_days(df).collect()) == [(1, False), (2, True)]


@pytest.mark.parametrize("seed", range(6))
def test_assignment_is_optimal(seed):
    rnd = np.random.default_rng(seed)
    n, m = map(int, rnd.integers(1, 6, 2))
    w = np.round(rnd.random((n, m)) * (rnd.random((n, m)) > 0.3), 3)
    got = sum(w[i, j] for i, j in scoring.assign(w))
    small, big = (n, m) if n <= m else (m, n)
    x = w if n <= m else w.T
    best = max(sum(x[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
    assert abs(got - best) < 1e-9 and len({i for i, _ in scoring.assign(w)}) == len(scoring.assign(w))


def test_agreement_statistics(spark):
    none = spark.createDataFrame([], "u long, v long, w long")
    assert scoring.weighted_kappa(none, "v", "w", 3).first().kappa is None
    df = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 2, 2), (4, 0, 2)], "u long, v long, w long")
    assert abs(scoring.weighted_kappa(df, "v", "w", 3).first().kappa - (1 - 1 / ((2 * 1 * 0 + 2 * 2 * 1 + 1 * 1 * 0.5 + 2 * 1 * 0.5 + 1 * 1 * 0.5 + 1 * 2 * 0.5 + 1 * 1 * 1) / 4))) < 1e-9
    same = spark.createDataFrame([(1, 5), (1, 5), (2, 7), (2, 7)], "u long, v long")
    assert scoring.krippendorff_alpha(same, "u", "v").first().alpha == 1.0
    auc = spark.createDataFrame([(0.1, False), (0.4, True), (0.4, False), (0.9, True)], "s double, p boolean")
    assert scoring.auroc(auc, "s", F.col("p")).first().auroc == 0.875
    many = spark.createDataFrame([((i * 7919 % 101) / 10, i % 3 == 0) for i in range(300)], "s double, p boolean")
    assert scoring.auroc(many, "s", F.col("p"), hot_rows=5).first() == scoring.auroc(many, "s", F.col("p")).first()
    assert scoring.auroc(auc.filter("p"), "s", F.col("p")).first().auroc is None


def test_bootstrap_of_equal_runs_is_zero(spark):
    df = spark.createDataFrame([(i, 1, 0, 1, 1, 0, 1) for i in range(50)], "doc_id long, tp_a int, fp_a int, fn_a int, tp_b int, fp_b int, fn_b int")
    r = scoring.paired_bootstrap(df, "doc_id", 100).first()
    assert (r.n, r.delta, r.low, r.high, r.share_positive) == (50, 0.0, 0.0, 0.0, 0.0)


def test_gold_clusters(spark):
    rows = [(1, "a", "x", 0, 9), (1, "b", "x", 1, 8), (1, "c", "x", 40, 50), (1, "b", "y", 0, 9)]
    got = {(r.label, r.tight_start, r.tight_end, r.env_start, r.env_end, r.support, r.tier) for r in scoring.cluster_atoms(spark.createDataFrame(rows, "item long, annotator string, label string, span_start long, span_end long"), "item").collect()}
    assert got == {("x", 1, 8, 0, 9, 2, "required"), ("x", 40, 50, 40, 50, 1, "singleton"), ("y", 0, 9, 0, 9, 1, "singleton")}


def test_detections_bridge_groups(spark):
    rows = [(1, "t", 0, 3, ["a"], 0, 0), (1, "t", 2, 4, ["b"], 0, 1), (1, "t", 4, 6, ["a", "b"], 1, 0), (1, "t", 8, 9, ["a"], 1, 1)]
    got = labels.merge_detections(spark.createDataFrame(rows, "episode_id long, axis string, span_start long, span_end long, labels array<string>, window_index int, position long")).collect()
    assert sorted((r.span_start, r.span_end, tuple(r.labels), r.n_detections) for r in got) == [(0, 6, ("a", "b"), 3), (8, 9, ("a",), 1)]


def test_claims_keep_the_best(spark):
    rows = [(1, "host", 0, 2, "sleep helps memory a lot", "q1", 0.4, 0, 0), (1, "host", 1, 3, "sleep helps memory much", "q2", 0.9, 1, 0), (1, "host", 5, 6, "sleep helps memory much", "q2", 0.9, 1, 1)]
    got = labels.merge_claims(spark.createDataFrame(rows, "episode_id long, role string, span_start long, span_end long, claim string, quote string, confidence double, window_index int, position long")).collect()
    assert sorted((r.span_start, r.span_end, r.claim, r.n_candidates) for r in got) == [(0, 3, "sleep helps memory much", 2), (5, 6, "sleep helps memory much", 1)]


def test_membership_and_links(spark):
    old = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, s string")
    new = spark.createDataFrame([(2, None), (3, "q"), (4, "w")], "k int, s string")
    assert {(r.k, r.change) for r in catalog.membership_diff(old, new, ["k"], ["s"]).collect()} == {(1, "removed"), (3, "changed"), (4, "added")}
    rows = spark.createDataFrame([("a", None, 7), ("b", 3, 7), ("c", None, 7)], "entity string, direct_id long, store_podcast_id long")
    links = spark.createDataFrame([("a", None), ("b", 9)], "entity string, podcast_id long")
    assert {r.entity: r.podcast_id for r in catalog.resolve_links(rows, links).collect()} == {"a": None, "b": 3, "c": 7}


def test_spread(spark):
    df = spark.createDataFrame([("g", i) for i in range(10)] + [("h", 0)], "g string, i int")
    got = sorted((r.g, r.i) for r in sampling.spread_evenly(df, ["g"], ["i"], 3).collect())
    assert got == [("g", int(i * 10 / 3 + 10 / 6)) for i in range(3)] + [("h", 0)]
    x = spark.createDataFrame([("g" if i % 3 else None, i, i // 7) for i in range(200)], "g string, i int, o int")
    for f in (lambda h: sampling.split_strata(x, "g", "i", 0.3, "s", h), lambda h: sampling.round_robin(x, "g", ["o", "i"], h)):  # chunks change nothing
        assert sorted(map(tuple, f(10).collect()), key=repr) == sorted(map(tuple, f(10**6).collect()), key=repr)
    assert sampling.greedy_fill([5, 6, 4], 10) == [True, False, True]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)] + [(200, x) for x in range(201, 260)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: find(v) for v in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_functions(spark):
    df = spark.createDataFrame([("Ep. 12: The Sleep Show (Rerun) 2019", "https://dts.podtrac.com/redirect.mp3/www.x.com:443/a/long-file-name.mp3?x=1", "1:02:03", "<p>a  b</p>")], "t string, u string, d string, h string")
    r = df.select(fn.norm_title("t").alias("n"), fn.title_numbers("t").alias("k"), fn.unwrap_tracking_url("u").alias("u"), fn.media_key("u").alias("m"), fn.parse_duration("d").alias("s"), fn.clean_html("h").alias("h"), fn.snippet("t", "sleep", 10).alias("x"), fn.parse_json_output(F.lit('```json\n{"a": [1,],}\n```')).alias("j"), fn.capture_time(F.lit("20200102030405")).alias("c"), fn.gap_label(F.lit(7)).alias("g"), fn.bare_id(F.lit("spotify:show:abc")).alias("b"), fn.fold_accents(F.lit("Éa")).alias("f")).first()
    assert (r.n, r.k, r.s, r.h, r.j, r.g, r.b, r.f) == ("thesleepshow2019", ["12"], 3723, "a b", '{"a": [1]}', "5-9 days", "abc", "ea")
    assert r.u == "https://www.x.com:443/a/long-file-name.mp3?x=1" and r.m == "long-file-name" and "Sleep" in r.x and r.c.year == 2020
    bad = spark.createDataFrame([("x:y",), (None,), ("",)], "d string").select(fn.parse_duration("d").alias("s")).collect()
    assert all(b.s is None for b in bad)


def test_wer_and_shared_folder(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("", "a"), (None, "a")], "a string, b string")
    assert [r.w for r in df.select(text.word_error_rate("a", "b").alias("w")).collect()][0] == pytest.approx(1 / 3)
    assert shared_dir(spark).startswith("file://")
    big = spark.range(10)
    assert broadcast_if_small(big, 5) is big


def test_capped_selection_takes_each_episode_once(spark):
    d0 = date(2020, 1, 1)
    rows = [("p", w, i, d0 + timedelta(days=i), i != 3, i == 5) for i in range(8) for w in (d0, d0 + timedelta(days=2))]
    got = selection.select_with_caps(spark.createDataFrame(rows, "entity string, win_start date, episode_id long, day date, own boolean, done boolean"), 3).collect()
    assert len(got) == 6 and len({r.episode_id for r in got}) == 6 and 5 in {r.episode_id for r in got if r.win_start == d0} and 3 not in {r.episode_id for r in got}


def test_captures(spark):
    d0 = date(2020, 1, 1)
    caps = spark.createDataFrame([("p", d0 + timedelta(days=i), g) for i, g in [(1, "a"), (12, "b"), (13, "b"), (30, "c")]], "entity string, day date, digest string")
    wins = spark.createDataFrame([("p", d0, d0 + timedelta(days=10)), ("p", d0 + timedelta(days=10), d0 + timedelta(days=20)), ("p", d0 + timedelta(days=40), d0 + timedelta(days=50))], "entity string, win_start date, win_end date")
    assert sorted((r.day - d0).days for r in selection.next_captures(caps, wins).collect()) == [12, 30]
    assert selection.balanced_shards([5, 3, 3, 2], 2) == [0, 1, 1, 0]


def test_import_plan(spark):
    d = date(2020, 1, 2)
    old = spark.createDataFrame([(7, 1, "g", d, "Title of an episode"), (8, 1, None, d, "Short")], "id long, podcast_id long, guid string, day date, title string")
    new = spark.createDataFrame([("a", 1, "g", None, None), ("b", 1, "x", d, "SHORT!"), ("c", 1, None, d + timedelta(days=1), "title of an episode"), ("d", 1, None, d + timedelta(days=1), "short"), ("e", 2, "g", d, "Short")], "ref string, podcast_id long, guid string, day date, title string")
    assert {(r.ref, r.action, r.id) for r in selection.import_plan(new, old).collect()} == {("a", "guid", 7), ("b", "day_title", 8), ("c", "adjacent_day", 7), ("d", "insert", None), ("e", "insert", None)}


def test_reposts_against_all_pairs(spark, data):
    from auralake.plans.reference import dated_episodes

    e = dated_episodes(spark, data)
    rows = e.filter("day is not null and podcast_id is not null and duration_seconds > 300").select("id", "podcast_id", "day", "duration_seconds", fn.norm_title("title").alias("n")).filter(F.length("n") >= 8).collect()
    want = {}
    for x in rows:
        for r in sorted(rows, key=lambda r: (r.day, r.id)):
            if x.podcast_id != r.podcast_id and (r.day, r.id) < (x.day, x.id) and abs(x.duration_seconds - r.duration_seconds) <= 1:
                a, b = x.n, r.n
                if abs(len(a) - len(b)) <= 0.1 * max(len(a), len(b)) and selection.title_ratio(a, b) >= 0.9 or (a in b or b in a) and (min(len(a), len(b)) >= 12 or x.duration_seconds == r.duration_seconds or (x.day - r.day).days <= 7):
                    want.setdefault(x.id, r.id)
    assert {r.id: r.first_id for r in selection.reposts(e).collect()} == want and want


def _reposts_by_all_pairs(rows):
    """first_id by id of (id, podcast_id, day, duration_seconds, title)."""
    want = {}
    for x in rows:
        for r in sorted(rows, key=lambda r: (r[2], r[0])):
            if x[1] != r[1] and (r[2], r[0]) < (x[2], x[0]) and abs(x[3] - r[3]) <= 1:
                a, b = x[4], r[4]
                if abs(len(a) - len(b)) <= 0.1 * max(len(a), len(b)) and selection.title_ratio(a, b) >= 0.9 or (a in b or b in a) and (min(len(a), len(b)) >= 12 or x[3] == r[3] or (x[2] - r[2]).days <= 7):
                    want.setdefault(x[0], r[0])
    return want


def test_reposts_of_odd_titles(spark, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd") for _ in range(n)) for n in (8, 8, 9, 11, 12, 14, 20, 31, 44, 210) for _ in range(3)] + ["ab" * 20]
    rows = []
    for k in range(700):
        t = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4))):  # edits at single places
            t[rng.randrange(len(t))] = rng.choice(("", "a", "xy", "z"))
        t = "".join(t) + rng.choice(("", "", "q" * rng.randrange(5)))
        if len(t) >= 8:
            rows.append((k, rng.randrange(4), date(2020, 1, 1) + timedelta(days=rng.randrange(40)), rng.choice((1599, 1600, 1601, 1602, 1615, 1616, 4000)), t))
    e = spark.createDataFrame(rows, "id long, podcast_id long, day date, duration_seconds int, title string")
    want = _reposts_by_all_pairs(rows)
    assert len(want) > 100 and {r.id: r.first_id for r in selection.reposts(e).collect()} == want
    monkeypatch.setattr(selection, "GROUP", 40)  # groups in parts
    assert {r.id: r.first_id for r in selection.reposts(e).collect()} == want


def test_reposts_of_one_duration(spark):
    """Eight thousand different titles of like length and one duration: 32 million pairs, of which a few are alike."""
    rng = random.Random(6)
    rows = [(k, k % 7, date(2020, 1, 1) + timedelta(days=k % 300), 1800, "".join(rng.choice("etaoinshrdlu") for _ in range(45))) for k in range(8_000)]
    rows += [(10_000 + k, 9, date(2021, 1, 1), 1800, rows[k][4][:20] + "z" + rows[k][4][21:]) for k in range(0, 8_000, 1_000)]
    e = spark.createDataFrame(rows, "id long, podcast_id long, day date, duration_seconds int, title string")
    late = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        assert {r.id: r.first_id for r in selection.reposts(e).collect()} == {10_000 + k: k for k in range(0, 8_000, 1_000)}
    finally:
        late.cancel()


def test_item_scores(spark):
    g = spark.createDataFrame([("i", "g1", "x", 0, 9, 0, 9, "required"), ("i", "g2", "x", 20, 29, 20, 29, "required"), ("i", "g3", "x", 40, 49, 40, 49, "singleton"), ("i", "g4", "x", 60, 69, 60, 69, "rejected")], "item string, gold_id string, label string, tight_start long, tight_end long, env_start long, env_end long, tier string")
    p = spark.createDataFrame([("i", "p1", "x", 0, 9), ("i", "p2", "x", 41, 49), ("i", "p3", "x", 60, 69), ("i", "p4", "y", 0, 9)], "item string, pred_id string, label string, span_start long, span_end long")
    assert tuple(evaluation.score_items(p, g).first()) == ("i", 1, 1, 2, 1, 1)
    assert evaluation.pool(evaluation.score_items(p, g)).first().f1 == 2 / 5
    o = evaluation.apply_overlay(g, spark.createDataFrame([("i", "g3", "rejected"), ("i", "g1", "rejected")], "item string, gold_id string, tier string"))
    assert {r.gold_id: r.tier for r in o.collect()} == {"g1": "required", "g2": "required", "g3": "rejected", "g4": "rejected"}
    plants = spark.createDataFrame([("i", "a", "x", 1, 2), ("i", "b", "y", 1, 2), ("i", "c", "x", 300, 301), ("i", "d", "x", 41, 42), ("i", "e", "x", 5, 25)], "item string, plant_id string, label string, span_start long, span_end long")
    assert {r.plant_id: r.outcome for r in evaluation.check_plants(plants, g).collect()} == {"a": "ok", "b": "contradicted", "c": "missing", "d": "singleton", "e": "split"}
    c = spark.createDataFrame([("absent", 1, None, None), ("lower", 2, 1, None), ("lower", 2, 3, None), ("to", 1, 4, 4), ("to", None, 4, 4)], "kind string, base_rank int, twin_rank int, want int")
    assert {r.kind: (r.pairs, r.rate) for r in evaluation.contrast_rates(c).collect()} == {"absent": (1, 1.0), "lower": (2, 0.5), "to": (1, 1.0)}


def test_runs_and_chunks(spark):
    assert text.claim_runs([True, True, False, True, True, True], [False, True, False, False, False, False], 2) == [(0, 1), (3, 4), (5, 5)]
    w = spark.createDataFrame([("a", 0, 8.0, 8.4, "x"), ("a", 1, 8.0, 8.4, "x"), ("a", 0, 9.6, 9.8, "y"), ("a", 1, 9.6, 9.8, "y")], "audio_id string, chunk int, start_s double, end_s double, word string")
    c = spark.createDataFrame([("a", 0, 0.0, 10.0), ("a", 1, 8.0, 18.0)], "audio_id string, chunk int, c_start double, c_end double")
    assert sorted((r.word, r.chunk) for r in text.merge_chunk_words(w, c).collect()) == [("x", 0), ("y", 1)]
