"""Queries of the core operators over the whole tables, each with its SQL where SQL can express it.

The ids in the docstrings are those of the operator inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auralake.functions import scalar as fn
from auralake.operators import catalog, charts, evaluation, intervals, labels, sampling, scoring, selection, text
from auralake.plans.problems import instants_sql
from auralake.session import read
from auralake.sources import captures, jsonl, transcripts
from auralake.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: A lexicon as a user would pass it: literals, and one regular expression.
LEXICON = {
    "topics": {"sleep": {"terms": ["sleep", "tend to sleep", "naps"]}, "food": {"terms": ["bread", "kelp", "oysters", "umami"]}},
    "evidence": {"doctor": {"terms": ["my doctor said"]}},
    "narratives": {"plenty": {"terms": [r"is plenty\.?"]}},
    "hedges": {"terms": ["i don't think", "honestly"]},
}
DEPTH = 50
SERIES = ("purchase", "click", "view", "signup", "error", "search")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Transcript segments, second deliveries taken off."""
    return read(spark, d, "transcript_segments").distinct()


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """events as ranked lists: a series per type, a day's entities ranked by value."""
    e = read(spark, d, "events").select("event_id", F.col("event_type").alias("series"), F.to_date("ts").alias("day"), F.col("user_id").alias("entity"), "value")
    return e.withColumn("rank", F.row_number().over(W.partitionBy("series", "day").orderBy(F.desc("value"), "event_id"))).drop("value", "event_id")


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes, second deliveries taken off."""
    e = read(spark, d, "episodes").select("id", "podcast_id", "title", "duration_seconds", "published_date", "episode_type", "feed_host").distinct()
    return e.withColumn("entity", F.concat(F.lit("podcast:"), F.col("podcast_id").cast("string")))


def dated_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes with the UTC day of their date, in whatever notation it is written (null where it denotes none)."""
    return catalog.with_days(episodes(spark, d), read(spark, d, "feed_hosts"))


def windows(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "window_targets").select("study", "entity", "window_label", catalog.day_of("win_start").alias("win_start"), catalog.day_of("win_end").alias("win_end"))
    return w.filter("entity is not null and win_start < win_end").distinct()


_SEG = "seg as (select distinct * from transcript_segments)"
_SPK = "'^\\s*(?:Speaker\\s*\\d+|[A-Z][A-Za-z .''-]{1,40})\\s*:\\s+'"
_LABEL = "'(?i)^(?:speaker\\s*\\d+|[A-Z][A-Za-z.''-]{1,30})\\s*:'"
_SENT = (
    _SEG
    + f""", body as (select episode_id, seg_index, start_s, end_s, regexp_matches(coalesce(text, ''), {_SPK}) as pre, regexp_replace(coalesce(text, ''), {_SPK}, '') as b from seg),
cutup as (select *, string_split(regexp_replace(b, '([.!?])[\\s\\x0B]+([A-Z"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as p from body),
sent0 as (select episode_id, seg_index, start_s, unnest(p) as s0, unnest(range(1, len(p) + 1)) as k from cutup),
sent as (select episode_id, seg_index, k, regexp_replace(s0, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') as sentence from sent0 where regexp_replace(s0, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') <> '')"""
)
_LIT = "my doctor said|tend to sleep|i don''t think|honestly|oysters|bread|sleep|umami|kelp|naps"
_HITS = (
    _SENT
    + f""", lex(term, section, label) as (values ('sleep','topics','sleep'),('tend to sleep','topics','sleep'),('naps','topics','sleep'),('bread','topics','food'),('kelp','topics','food'),('oysters','topics','food'),('umami','topics','food'),
 ('my doctor said','evidence','doctor'),('i don''t think','hedges','hedges'),('honestly','hedges','hedges')),
f0 as (select episode_id, seg_index, k, sentence, unnest(list_distinct(regexp_extract_all(lower(sentence), '\\b({_LIT})\\b'))) as term from sent),
lit as (select f0.episode_id, f0.seg_index, f0.k, f0.sentence, lex.section, lex.label, lex.term from f0 join lex using (term)),
hits as (select * from lit union select distinct episode_id, seg_index, k, sentence, 'narratives', 'plenty', 'is plenty\\.?' from lit where regexp_matches(lower(sentence), 'is plenty\\.?'))"""
)


@query(f"with {_HITS} select episode_id, section, label, term, count(*) as n_sent from hits group by all")
def lexical_counts(spark, d):
    """X1, X4, A10."""
    return text.lexical_counts(segments(spark, d), LEXICON)


_STATS = f"""{_SENT}, st as (select episode_id, count(*) as n_sent, sum(len(list_filter(regexp_split_to_array(sentence, '[\\s\\x0B]+'), lambda w: w <> ''))) as n_words from sent group by 1),
sg as (select episode_id, count(*) as n_seg, coalesce(max(end_s), 0.0) as duration, count(*) filter (pre) as speaker_prefixes from body group by 1),
ep as (select sg.episode_id, n_seg, coalesce(n_sent, 0) as n_sent, coalesce(n_words, 0)::bigint as n_words, duration, speaker_prefixes from sg left join st using (episode_id))"""


@query(f"with {_STATS} select * from ep")
def scan_episode_stats(spark, d):
    """A11."""
    return text.scan_episodes(segments(spark, d))


@query(
    f"""with {_HITS}, num as (select *, row_number() over (partition by episode_id order by seg_index, k) - 1 as sent_index from sent),
lab as (select episode_id, seg_index, k, array_to_string(list_sort(list_distinct(list(section || ':' || label))), '|') as labels from hits group by all)
select n.episode_id, n.seg_index, sent_index, labels, left(sentence, 600) as sentence from num n join lab using (episode_id, seg_index, k)"""
)
def matched_sentences(spark, d):
    """X5."""
    return text.matched_sentences(segments(spark, d), LEXICON)


@query(
    f"""with {_HITS}, c as (select episode_id, section, count(*) as n from hits group by all),
st as (select episode_id, count(*) as n_sent from sent group by 1), e as (select distinct episode_id from seg),
w as (select e.episode_id, coalesce(n_sent, 0) as n_sent, coalesce(sum(n) filter (section = 'topics'), 0)::bigint as topics, coalesce(sum(n) filter (section = 'evidence'), 0)::bigint as evidence, coalesce(sum(n) filter (section = 'hedges'), 0)::bigint as hedges
 from e left join st using (episode_id) left join c using (episode_id) group by 1, 2)
select *, (topics + evidence + hedges) / greatest(n_sent, 1)::double as density from w"""
)
def section_density(spark, d):
    """A12, A13."""
    s = segments(spark, d)
    return text.section_density(text.lexical_counts(s, LEXICON), text.scan_episodes(s), ["topics", "evidence", "hedges"])


@query(
    """with w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s\\x0B]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, len(w) as n_words, case when len(w) > 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end as g from w)
select doc_id, n_words, case when g is null then 0.0 else 1 - len(list_distinct(g)) / len(g)::double end as ratio from g"""
)
def ngram_repeat_ratio(spark, d):
    """A14, Z13."""
    return text.repeated_ngram_ratio(read(spark, d, "documents"), "doc_id", "text")


@query(f"with {_SEG}, e as (select distinct id, podcast_id from episodes), h as (select seg.episode_id, podcast_id from seg join e on e.id = seg.episode_id where regexp_matches(lower(coalesce(text, '')), 'sleep|naps')) select podcast_id, count(*) as segments, count(distinct episode_id) as episodes from h group by 1")
def corpus_count(spark, d):
    """X8, A38."""
    e = read(spark, d, "episodes").select(F.col("id").alias("episode_id"), "podcast_id").distinct()
    return text.search(segments(spark, d), "sleep|naps").join(e, "episode_id").groupBy("podcast_id").agg(F.count(F.lit(1)).alias("segments"), F.countDistinct("episode_id").alias("episodes"))


@query(
    f"""with {_SEG}, h as (select *, regexp_matches(lower(coalesce(text, '')), 'umami') as is_hit from seg),
n as (select *, max(case when is_hit then 1 else 0 end) over (partition by episode_id order by seg_index rows between 1 preceding and 1 following) as m from h)
select episode_id, seg_index, is_hit from n where m = 1"""
)
def corpus_context(spark, d):
    """X9."""
    return text.context(segments(spark, d), "umami", 1).select("episode_id", "seg_index", "is_hit")


@query(f"with {_SEG} select episode_id, count(*) filter (regexp_matches(lower(coalesce(text,'')), 'bread')) as n_a, count(*) filter (regexp_matches(lower(coalesce(text,'')), 'kelp')) as n_b from seg group by 1 having n_a > 0 and n_b > 0")
def corpus_cooc(spark, d):
    """X10, U8."""
    return text.cooccurrence(segments(spark, d), "bread", "kelp")


@query("select doc_id, left(sha256('s1' || chr(31) || doc_id::varchar), 16) as score from documents where regexp_matches(lower(coalesce(text, '')), 'sleep') order by score, doc_id limit 50")
def corpus_sample(spark, d):
    """A sampling operator (bottom 50 by hash of all matches)."""
    hits = read(spark, d, "documents").filter(F.coalesce("text", F.lit("")).rlike("(?i)sleep"))
    return sampling.bottom_k(hits, 50, "s1", "doc_id").select("doc_id", "score")


@query(f"with {_SEG}, r as (select *, row_number() over (partition by episode_id order by seg_index) as r from seg) select episode_id, count(*) filter (regexp_matches(coalesce(text, ''), {_LABEL})) >= greatest(2, count(*) // 4) as labelled from r where r <= 50 group by 1")
def speaker_label_flags(spark, d):
    """S5."""
    return text.has_speaker_labels(segments(spark, d))


@query(f"with {_SEG}, m as (select *, last_value(start_s ignore nulls) over (partition by episode_id order by seg_index rows between unbounded preceding and 1 preceding) as l from seg) select episode_id, count(*) as n_segments, count(*) filter (start_s is null) as untimed, count(*) filter (start_s < l) as regressions from m group by 1")
def time_regressions(spark, d):
    """A19."""
    return labels.time_regressions(segments(spark, d))


@query()
def transcript_units(spark, d):
    """S3, X2."""
    return text.transcript_units(segments(spark, d))


@query()
def unit_windows(spark, d):
    """W16 (a recurrence; tested against brute force)."""
    return text.unit_windows(text.transcript_units(segments(spark, d)), 120, 30)


@query()
def episode_exposure(spark, d):
    """A16, A17, A18."""
    return labels.exposure(text.transcript_units(segments(spark, d)))


@query(f"""with {_SEG}, t as (select episode_id, count(*) as n, max(end_s) as s, string_agg(coalesce(text, ''), ' ' order by seg_index) as body from seg group by 1),
w as (select episode_id, coalesce(s, 0) as s, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)?') as w from t),
v as (select *, w[greatest(len(w) - 199, 1):] as tl from w)
select episode_id, len(w) > greatest(50, ceil(s / 60 * 300)) or coalesce(len(tl) >= 50 and list_max(list_transform(list_distinct(tl), lambda x: len(list_filter(tl, lambda y: y = x)))) >= 0.6 * len(tl), false)
 or (len(w) >= 30 and 1 - len(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) / greatest(len(w) - 4, 1)::double >= 0.5) as implausible from v""")
def implausible_transcripts(spark, d):
    """texts are put together per transcript, in the order of segments."""
    t = segments(spark, d).groupBy("episode_id").agg(F.max("end_s").alias("seconds"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_index", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("body"))
    return text.implausible(t, "episode_id", "body", "seconds")


# ---- charts ------------------------------------------------------------------------------------------
_R = "r as (select event_type as series, cast(ts as date) as day, user_id as entity, row_number() over (partition by event_type, cast(ts as date) order by value desc, event_id) as rank from events)"
_DAYS = _R + ", days as (select distinct series, day from r)"
_BEST = _R + ", e0 as (select series, day, entity, min(rank) as top from r group by all), e1 as (select series, day, entity, row_number() over (partition by series, day order by top) as rank from e0), b0 as (select * from e1 where rank <= 50), fd as (select series, day from b0 group by all having count(*) >= 0.95 * 50), best as (select b0.* from b0 join fd using (series, day))"


def best_ranks(spark, d):
    """Ranks among a day's distinct entities, each by its best; of days that have at least 0.95 of the depth."""
    r = ranked(spark, d).groupBy("series", "day", "entity").agg(F.min("rank").alias("best"))
    r = r.withColumn("rank", F.row_number().over(W.partitionBy("series", "day").orderBy("best"))).drop("best")
    return charts.daily_entities(r, DEPTH)


@query(f"with {_R} select series, count(*) as n_rows, count(distinct day) as days, count(distinct entity) as entities, min(day) as first_day, max(day) as last_day, max(rank) as deepest from r group by 1")
def chart_profile(spark, d):
    """A1, A4."""
    return charts.profile(ranked(spark, d), ["series"])


_DD = _R + ", dd as (select series, day, max(rank) as depth, count(distinct case when rank <= 50 then rank end) as n_ranks from r group by all), dl as (select *, n_ranks >= 0.95 * 50 as is_full from dd)"


@query(
    f"""with {_DD} select series, count(*) as days, count(*) filter (is_full) as full_days, median(depth) as median_depth, count(distinct date_trunc('month', day)) as months,
(date_diff('month', min(day), max(day)) + 1)::int as span_months, round(100.0 * count(distinct date_trunc('month', day)) / (date_diff('month', min(day), max(day)) + 1), 1) as fill_pct from dl group by 1"""
)
def chart_coverage(spark, d):
    """A2."""
    return charts.coverage(charts.daily_depth(ranked(spark, d), DEPTH))


@query(f"with {_DAYS}, g as (select series, date_diff('day', lag(day) over (partition by series order by day), day) as gap from days) select series, median(gap) as median_gap, quantile_cont(gap, 0.9) as p90_gap, max(gap) as max_gap from g where gap is not null group by 1")
def gap_stats(spark, d):
    """A3, Z12."""
    return charts.gap_statistics(ranked(spark, d))


@query(f"with {_R} select series, year(day) as year, count(distinct entity) as entities from r group by all")
def churn_by_year(spark, d):
    """A5."""
    return charts.churn_by_year(ranked(spark, d))


_WT = "wt as (select series, day, date_diff('day', coalesce(lag(day) over w, day), coalesce(lead(day) over w, day)) / 2.0 as weight from days window w as (partition by series order by day))"


@query(f"with {_DAYS}, {_WT} select * from wt")
def exposure_weights(spark, d):
    """W2."""
    return charts.midpoint_weights(ranked(spark, d))


_CELL = "t as (select *, date_diff('day', date '1970-01-01', day) * 24.0 + 12 as t from days), cell as (select series, day, coalesce((lag(t) over w + t) / 2, t - 12) as lo_hour, coalesce((lead(t) over w + t) / 2, t + 12) as hi_hour from t window w as (partition by series order by day))"


@query(f"with {_DAYS}, {_CELL} select * from cell")
def snapshot_cells(spark, d):
    """W3."""
    return charts.snapshot_cells(ranked(spark, d))


_PC = "r as (select distinct chart as series, last_seen_at::date as day, podcast_id as entity, chart_rank as rank from podcast_charts where last_seen_at is not null and chart_rank is not null and chart is not null and podcast_id is not null), days as (select distinct series, day from r)"


def _lists_sql(period: str, days: str, depth: int) -> str:
    return f"""with {days}, {_CELL},
x as (select series, day, lo_hour, hi_hour, unnest(generate_series(date_trunc('{period}', date '1970-01-01' + floor(lo_hour / 24)::int)::timestamp, date_trunc('{period}', date '1970-01-01' + floor(hi_hour / 24)::int)::timestamp, interval 1 {period}))::date as p_start from cell),
y as (select *, (p_start + interval 1 {period})::date as p_end from x),
z as (select *, date_diff('day', date '1970-01-01', p_start) * 24.0 as a, date_diff('day', date '1970-01-01', p_end) * 24.0 as b from y),
e as (select series, max(hi_hour) as end_hour from cell group by 1),
c as (select z.*, least(hi_hour, b) - greatest(lo_hour, a) as hours from z join e using (series) where least(hi_hour, b) - greatest(lo_hour, a) > 0 and b <= end_hour),
info as (select series, p_start, p_end, count(*) filter (day >= p_start and day < p_end) as snapshots_in_period, sum(case when day >= p_start and day < p_end then hours else 0 end) as own from c group by all),
bb as (select series, day, entity, min(rank) as rank from r where rank <= {depth} group by all),
pts as (select c.series, p_start, entity, sum(hours / 24 * ({depth} + 1 - rank)) as points, min(rank) as best_rank from c join bb using (series, day) group by all),
k as (select *, row_number() over (partition by series, p_start order by round(points, 6) desc, best_rank, entity) as period_rank from pts)
select series, p_start, entity, period_rank, round(points, 2) as points, round(points / date_diff('day', p_start, p_end), 3) as mean_points, best_rank, snapshots_in_period, round(own / (date_diff('day', p_start, p_end) * 24), 3) as coverage
from k join info using (series, p_start) where period_rank <= 10"""


@query(_lists_sql("week", _DAYS, DEPTH))
def weekly_lists(spark, d):
    """W4, J14 on weeks: a top-k report."""
    return charts.periodic_lists(ranked(spark, d), DEPTH, "week", 10)


@query(_lists_sql("month", _PC, 200))
def monthly_lists(spark, d):
    """W4, J14 on the chart table: a top-k report."""
    c = read(spark, d, "podcast_charts").select(F.col("chart").alias("series"), F.to_date("last_seen_at").alias("day"), F.col("podcast_id").alias("entity"), F.col("chart_rank").alias("rank"))
    return charts.periodic_lists(c.na.drop().distinct(), 200, "month", 10)


@query(f"with {_DD}, p as (select *, list_position(['purchase','click','view','signup','error','search'], series) as p from dl where is_full), q as (select *, row_number() over (partition by day order by p) as n from p where p > 0) select day, series, depth from q where n = 1")
def best_source(spark, d):
    """W5, W6, P3."""
    return charts.best_source_per_day(charts.daily_depth(ranked(spark, d), DEPTH), SERIES)


@query("with r as (select distinct chart as series, last_seen_at::date as day, chart_rank as rank, podcast_id from podcast_charts where last_seen_at is not null and chart_rank is not null), n as (select series, day, count(*) as n_entries from r group by all), k as (select *, row_number() over (partition by series, day order by rank) as pos from (select distinct series, day, rank from r)) select n.series, n.day, n_entries, c.complete_to from n join (select series, day, count(*) filter (rank = pos) as complete_to from k group by all) c using (series, day)")
def complete_ranks(spark, d):
    """A27, A28."""
    r = read(spark, d, "podcast_charts").select(F.col("chart").alias("series"), F.to_date("last_seen_at").alias("day"), F.col("chart_rank").alias("rank"), "podcast_id").filter("day is not null and rank is not null").distinct()
    return charts.complete_to(r)


@query(f"with {_BEST} select * from best")
def daily_entities(spark, d):
    """W7."""
    return best_ranks(spark, d)


@query(
    f"""with {_BEST}, x as (select *, count(*) over (partition by series, day) as n from best), dd as (select distinct series, day from best),
pr as (select a.series, a.day as d1, b.day as d2, date_diff('day', a.day, b.day) as days from dd a join dd b on a.series = b.series and a.day < b.day and date_diff('day', a.day, b.day) <= 100),
sh as (select pr.series, d1, d2, days, max(x.n) as na, count(y.entity) as k, median(abs(x.rank - y.rank)) as mv, {", ".join(f"count(*) filter (x.rank between {lo} and {hi}) as a{lo}, count(y.entity) filter (x.rank between {lo} and {hi}) as k{lo}" for lo, hi in ((1, 10), (11, 50), (51, 100)))}
 from pr join x on x.series = pr.series and x.day = d1 left join best y on y.series = pr.series and y.day = d2 and y.entity = x.entity group by all),
nb as (select series, day as d2, count(*) as nb from best group by all),
g as (select series, case when days = 1 then '1 day' when days <= 3 then '2-3 days' when days <= 9 then '4-9 days' when days <= 20 then '10-20 days' when days <= 45 then '21-45 days' else '46-100 days' end as gap, k / (na + nb - k)::double as j, k / na::double as r, case when k >= 5 then mv end as mv,
 {", ".join(f"case when a{lo} > 0 then k{lo} / a{lo}::double end as r{lo}" for lo in (1, 11, 51))} from sh join nb using (series, d2))
select series, gap, count(*) as pairs, round(median(j), 6) as median_jaccard, round(median(r), 6) as median_retention, round(median(mv), 6) as median_move, {", ".join(f"round(median(r{lo}), 6) as retain_{lo}_{hi}" for lo, hi in ((1, 10), (11, 50), (51, 100)))} from g group by all"""
)
def turnover(spark, d):
    """J18, U5, A25, F25."""
    return charts.turnover(best_ranks(spark, d))


@query(
    f"""with {_BEST}, e as (select *, date_trunc('month', day)::date as month from best), u as (select series, month, count(distinct entity) as entities, count(distinct day) as snapshots from e group by all having count(distinct day) >= 4),
s as (select series, month, day, list(distinct entity) as s from e group by all)
select series, month, max(snapshots) as snapshots, max(entities) as entities, round(median(len(s) / entities::double), 6) as median_single_coverage,
round(len(list_intersect(arg_min(s, day), arg_max(s, day))) / len(list_distinct(list_concat(arg_min(s, day), arg_max(s, day))))::double, 6) as first_last_jaccard from s join u using (series, month) group by all"""
)
def month_coverage(spark, d):
    """A24."""
    return charts.month_coverage(best_ranks(spark, d))


@query(
    f"""with {_BEST}, x as (select day as day_a, entity, rank as ra from best where series = 'click'), y as (select day as day_b, entity, rank as rb from best where series = 'view'),
nr as (select day_a, day_b, row_number() over (partition by day_a order by abs(date_diff('day', day_a, day_b)), day_b) as n from (select distinct day_a from x) join (select distinct day_b from y) on abs(date_diff('day', day_a, day_b)) <= 1),
dd as (select day_a, day_b from nr where n = 1), na as (select day_a, count(*) as n_a from x group by 1), nb as (select day_b, count(*) as n_b from y group by 1),
sh as (select dd.day_a, dd.day_b, ra, rb from dd join x using (day_a) join y on y.day_b = dd.day_b and y.entity = x.entity),
rk as (select *, rank() over (partition by day_a order by ra) as pa, rank() over (partition by day_a order by rb) as pb from sh),
ag as (select day_a, count(*) as shared, case when count(*) >= 5 then corr(pa, pb) end as spearman from rk group by 1)
select dd.day_a, dd.day_b, n_a, n_b, coalesce(shared, 0) as shared, round(coalesce(shared, 0) / (n_a + n_b - coalesce(shared, 0))::double, 6) as jaccard, round(100.0 * coalesce(shared, 0) / least(n_a, n_b), 4) as overlap_pct, round(spearman, 6) as spearman
from dd join na using (day_a) join nb using (day_b) left join ag on ag.day_a = dd.day_a"""
)
def agreement_spearman(spark, d):
    """J11, G13."""
    return charts.agreement(best_ranks(spark, d), "click", "view")


_POP = f"with {_BEST}, days as (select distinct series, day from best), {_WT}, pop as (select series, entity, count(*) as n_obs, round(sum(weight), 1) as est_days, min(rank) as best_rank, median(rank) as median_rank, min(day) as first_seen, max(day) as last_seen from best join wt using (series, day) group by all)"


@query(f"{_POP} select * from pop")
def population(spark, d):
    """A6, A7, A9."""
    b = best_ranks(spark, d)
    return charts.population(b, charts.midpoint_weights(b))


@query(f"{_POP} select series, threshold, count(*) filter (est_days >= threshold and n_obs >= 3) as entities from pop, (values (1.0), (3.0), (7.0), (14.0)) t(threshold) group by all")
def threshold_curve(spark, d):
    """A8."""
    b = best_ranks(spark, d)
    return charts.threshold_curve(charts.population(b, charts.midpoint_weights(b)), [1, 3, 7, 14])


_KEY = "nullif(regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g'), '')"


@query(
    f"""with o as (select distinct id, {_KEY.format('title')} as key, 'p' || id::varchar as ref from podcasts union all select distinct null::bigint, {_KEY.format("case when json_valid(record) then record->>'collectionName' end")}, 'r' || result_id::varchar from search_results),
c as (select key, id, count(*) as n from o where id is not null and key is not null group by all), m as (select key, id as mode_id from (select *, row_number() over (partition by key order by n desc, id) as r from c) where r = 1)
select ref, coalesce(id::varchar, mode_id::varchar, 'title:' || o.key) as entity from o left join m using (key)"""
)
def resolve_by_title(spark, d):
    """J9, F1, U1."""
    p = read(spark, d, "podcasts").select("id", fn.title_key("title").alias("key"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("ref")).distinct()
    r = read(spark, d, "search_results").select(F.lit(None).cast("long").alias("id"), fn.title_key(F.get_json_object("record", "$.collectionName")).alias("key"), F.concat(F.lit("r"), F.col("result_id").cast("string")).alias("ref")).distinct()
    return charts.resolve_by_title(p.unionByName(r)).select("ref", "entity")


@query(
    """with r as (select event_id, user_id, ts::date as day from events where event_type = 'error'), k as (select user_id, ts::date as day, min(event_id) as v from events where event_type = 'purchase' group by all),
j as (select r.event_id, k.v, row_number() over (partition by r.event_id order by abs(date_diff('day', k.day, r.day)), k.day, k.v) as n from r join k using (user_id))
select r.event_id, j.v as resolved from r left join j on j.event_id = r.event_id and n = 1"""
)
def nearest_entity(spark, d):
    """J10."""
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    known = e.filter("event_type = 'purchase'").select("user_id", "day", F.col("event_id").alias("v"))
    return charts.nearest_in_time(e.filter("event_type = 'error'").select("event_id", "user_id", "day"), known, "user_id", "day", "v").select("event_id", "resolved")


@query(f"with {_R}, l as (select series, day, string_agg(rank || ':' || entity, ',' order by rank, entity) as l from r group by all) select series, day, coalesce(lag(l) over (partition by series order by day) = l, false) as is_stale from l")
def stale_days(spark, d):
    """S24, R8."""
    return charts.stale_days(ranked(spark, d))


@query("with x as (select case when event_type = 'purchase' then 'paid' end as a, case when value >= 50 then 'high' end as b, case when event_type in ('click', 'view') then 'seen' end as c from events) select label, count(*) as n from (select a as label from x union all select b from x union all select c from x) where label is not null group by 1")
def labelled_union(spark, d):
    """P1, P2."""
    e = read(spark, d, "events").select("event_type", "value")
    return charts.labelled_union(e, {"paid": F.col("event_type") == "purchase", "high": F.col("value") >= 50, "seen": F.col("event_type").isin("click", "view")}).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with c as (select event_type, ts::date as day, date_trunc('hour', ts) as hr, row_number() over (partition by event_type, date_trunc('hour', ts) order by value desc, event_id) as rank, event_id from events),
s as (select event_type, day, hr, count(*) as n from c group by all), w as (select *, row_number() over (partition by event_type, day order by n desc, hr) as k from s)
select c.event_type, c.hr as captured_at, c.rank, c.event_id from c join w on w.event_type = c.event_type and w.hr = c.hr and w.k = 1"""
)
def select_daily(spark, d):
    """An hour of events is a capture."""
    e = read(spark, d, "events").withColumn("at", F.date_trunc("hour", "ts"))
    w = W.partitionBy("event_type", "at").orderBy(F.desc("value"), "event_id")
    c = e.select("event_type", "event_id", F.col("at").alias("captured_at"), F.row_number().over(w).alias("rank"), F.lit("a").alias("archive"), F.col("at").cast("string").alias("path"), F.lit(1).alias("page"))
    return charts.select_daily(c, ["event_type"]).select("event_type", "captured_at", "rank", "event_id")


# ---- catalog -----------------------------------------------------------------------------------------
# the day of the instant in whatever notation (a day alone is that day in any zone), else the day a text begins with
_ZONED = r"case when contains(published_date, ':') or regexp_matches(published_date, '\d{8}[Tt ]?\d{6}') then coalesce(h.time_zone, 'UTC') else 'UTC' end"
_DAYS_OF = "day_of as (with " + instants_sql(f"select distinct published_date as raw, {_ZONED} as zone, {_ZONED} as host_zone from episodes left join feed_hosts h using (feed_host)", "raw, host_zone") + " select * from instants)"
_EP = f"""{_DAYS_OF}, ep as (select distinct id, podcast_id, title, duration_seconds, published_date, episode_type, feed_host,
coalesce(date '1970-01-01' + floor(u / 86400.0)::int, case when regexp_matches(published_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then try_cast(left(published_date, 10) as date) end) as day, 'podcast:' || podcast_id as entity
from episodes left join feed_hosts h using (feed_host) left join day_of on raw = published_date and host_zone = {_ZONED})"""
_WIN = "win as (select distinct study, entity, window_label, win_start, win_end from (select study, entity, window_label, try_cast(left(trim(win_start), 10) as date) as win_start, try_cast(left(trim(win_end), 10) as date) as win_end from window_targets) where entity is not null and win_start < win_end)"
_TR = "tr as (select distinct episode_id from transcripts)"


@query(f"with {_EP}, p as (select distinct id, title from podcasts) select p.id as podcast_id, max(p.title) as title, count(distinct ep.id) as n_episodes, sum(case when duration_seconds > 0 then duration_seconds end)::bigint as seconds from ep join p on p.id = ep.podcast_id group by 1")
def episodes_per_podcast(spark, d):
    """J1, J2, S32, Z26."""
    p = read(spark, d, "podcasts").select(F.col("id").alias("podcast_id"), F.col("title").alias("show")).distinct()
    e = episodes(spark, d).join(p, "podcast_id")
    return e.groupBy("podcast_id").agg(F.max("show").alias("title"), F.countDistinct("id").alias("n_episodes"), F.sum(F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))).alias("seconds"))


@query(f"with {_EP}, {_WIN}, t as (select distinct id, episode_id from transcripts) select distinct w.study, w.entity, w.window_label, ep.id as episode_id, t.id as transcript_id from win w left join ep on ep.entity = w.entity and ep.day >= w.win_start and ep.day < w.win_end left join t on t.episode_id = ep.id")
def study_export(spark, d):
    """J3, J15."""
    w = windows(spark, d)
    hit = catalog.episodes_in_windows(dated_episodes(spark, d).select("entity", "day", F.col("id").alias("episode_id")), w)
    t = read(spark, d, "transcripts").select(F.col("id").alias("transcript_id"), "episode_id").distinct()
    keys = ["study", "entity", "window_label", "win_start", "win_end"]
    return w.join(hit.select(*keys, "episode_id"), keys, "left").join(t, "episode_id", "left").select("study", "entity", "window_label", "episode_id", "transcript_id").distinct()


_COV = f"{_EP}, {_WIN}, {_TR}, wk as (select distinct study, entity, win_start, win_end from win), cov as (select w.*, count(distinct ep.id) as n_episodes, count(distinct tr.episode_id) as n_done from wk w left join ep on ep.entity = w.entity and ep.day >= win_start and ep.day < win_end left join tr on tr.episode_id = ep.id group by all)"


def _coverage(spark, d):
    return catalog.window_coverage(windows(spark, d), dated_episodes(spark, d).select("entity", "day", F.col("id").alias("episode_id")), read(spark, d, "transcripts"))


@query(f"with {_COV} select * from cov")
def window_coverage(spark, d):
    """J4, Z6."""
    return _coverage(spark, d)


@query(f"with {_COV} select study, count(*) as windows, count(*) filter (n_episodes > 0) as filled, count(*) filter (n_done > 0) as transcribed, round(avg(n_episodes), 6) as mean_episodes from cov group by 1")
def coverage_by_study(spark, d):
    """J5, A21, A23."""
    return catalog.coverage_by_study(_coverage(spark, d))


@query("with m as (select distinct study, entity from window_targets where study is not null and entity is not null) select a.study as a, b.study as b, count(*) as shared from m a join m b on a.entity = b.entity and a.study < b.study group by all")
def shared_studies(spark, d):
    """J6."""
    return catalog.shared_members(read(spark, d, "window_targets").filter("entity is not null"), "entity", "study")


@query(f"with {_EP}, {_TR} select podcast_id, count(distinct id) as missing from ep where not exists (select 1 from tr where tr.episode_id = ep.id) group by 1")
def missing_transcripts(spark, d):
    """J7, Z28."""
    return episodes(spark, d).join(read(spark, d, "transcripts").select(F.col("episode_id").alias("id")), "id", "left_anti").groupBy("podcast_id").agg(F.countDistinct("id").alias("missing"))


@query(f"with {_WIN}, a as (select entity, window_label, max(win_start) as s, max(win_end) as e from win where study = 'corpus_full' group by all), b as (select entity, window_label, max(win_start) as s, max(win_end) as e from win where study = 'monthly_top' group by all) select coalesce(a.entity, b.entity) as entity, coalesce(a.window_label, b.window_label) as window_label, case when a.entity is null then 'added' when b.entity is null then 'removed' else 'changed' end as change from a full join b on a.entity = b.entity and a.window_label = b.window_label where a.entity is null or b.entity is null or a.s is distinct from b.s or a.e is distinct from b.e")
def membership_diff(spark, d):
    """U3, U4, R7."""
    w = windows(spark, d).filter("window_label is not null").groupBy("study", "entity", "window_label").agg(F.max("win_start").alias("s"), F.max("win_end").alias("e"))
    return catalog.membership_diff(w.filter("study = 'corpus_full'"), w.filter("study = 'monthly_top'"), ["entity", "window_label"], ["s", "e"])


_RR = "\\b(?:re-?broadcast|encore(?: presentation)?|best of|replay|rerun|re-?run|repeat|re-?release[d]?|re-?air(?:ed)?|classic|from the archives?|vault|throwback|revisited|rewind|fbf|flashback|selects|playlist)\\b|\\(r\\)|\\[r\\]"
_EPNO = "\\b(?:ep(?:isode)?|no)\\.?\\s*#?\\d+\\b|^\\s*#?\\d+\\s*[:.\\-|]|\\|\\s*#?\\d+\\s*$|#\\d+|\\bs\\d+\\s*e\\d+\\b|\\bseason \\d+,? episode \\d+\\b"
_NORM = "regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '" + _RR + "', ' ', 'g'), '" + _EPNO + "', ' ', 'g'), '[^a-z0-9]+', '', 'g')"
_NUMS = "list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(coalesce({0}, ''), '\\d+'), lambda n: not regexp_matches(n, '^(19|20)\\d\\d$')), lambda n: regexp_replace(n, '^0+', ''))))"
_MARK = "regexp_matches(lower(coalesce({0}, '')), '" + _RR + "')"


@query(
    f"""with {_EP}, e as (select distinct id, podcast_id, title, day, duration_seconds, {_NORM.format('title')} as norm from ep where day is not null and podcast_id is not null),
f as (select *, row_number() over (partition by podcast_id, norm order by day, id) as n from e where length(norm) >= 6), j as (select x.*, y.id as first_id, y.title as t1, y.day as d1, y.duration_seconds as s1 from f x join f y on x.podcast_id = y.podcast_id and x.norm = y.norm and y.n = 1 and x.id <> y.id)
select id, first_id, case when {_MARK.format('title')} and not {_MARK.format('t1')} then 'marker' else 'duration' end as reason from j
where ({_MARK.format('title')} and not {_MARK.format('t1')}) or ({_NUMS.format('title')} = {_NUMS.format('t1')} and s1 > 0 and duration_seconds > 0 and (abs(s1 - duration_seconds) <= 2 or (abs(s1 - duration_seconds) <= greatest(5.0, 0.01 * greatest(s1, duration_seconds)) and date_diff('day', d1, day) > 90)))"""
)
def same_title_copies(spark, d):
    """W18, F11, Z17."""
    return catalog.same_title_copies(dated_episodes(spark, d))


@query(
    f"""with {_EP}, e as (select id, podcast_id, day, try_cast(nullif(regexp_extract(title, '^\\s*#?(\\d{{1,4}})\\s*[:.|\\-]\\s', 1), '') as int) as n0, nullif(regexp_extract(title, '^\\s*#?(\\d{{1,4}})\\s*[:.|\\-]\\s', 1), '') as s0 from ep where day is not null and podcast_id is not null),
n as (select id, podcast_id, day, case when regexp_matches(s0, '^(19|20)\\d\\d$') then null else n0 end as number from e),
m as (select podcast_id, day, max(max(number)) over (partition by podcast_id order by day) as reached from n group by podcast_id, day)
select id, number, reached from n join m using (podcast_id, day) where number is not null and reached >= 50 and number < reached - 15"""
)
def old_numbers(spark, d):
    """W17."""
    return catalog.old_numbers(dated_episodes(spark, d))


@query(
    f"""with {_EP}, e as (select id, podcast_id, title, day, duration_seconds as s, {_NORM.format('title')} as norm, {_NUMS.format('title')} as nums, {_MARK.format('title')} as mark from ep where day is not null and duration_seconds > 600), f as (select * from e where length(norm) >= 12),
j as (select x.id, y.id as first_id, row_number() over (partition by x.id order by y.day, y.id) as n from f x join f y on x.podcast_id = y.podcast_id and y.day < x.day - 7 and abs(x.s - y.s) <= greatest(5, floor(0.01 * x.s)) and (contains(x.norm, y.norm) or contains(y.norm, x.norm)) and x.nums = y.nums and (x.norm <> y.norm or abs(x.s - y.s) <= 2 or (x.mark and not y.mark)))
select id, first_id from j where n = 1"""
)
def rerun_of_earlier(spark, d):
    """J16."""
    return catalog.rerun_of_earlier(dated_episodes(spark, d))


@query(f"with {_EP}, e as (select id, podcast_id, day, {_KEY.format('title')} as key from ep) select podcast_id, day, key, min(id) as id, count(*) as copies from e group by podcast_id, day, key, case when day is null or key is null then id end")
def day_copies(spark, d):
    """F1, and of W19 the same-day rule only."""
    return catalog.day_copies(dated_episodes(spark, d))


@query(f"with {_EP}, dd as (select distinct entity, day from ep where day is not null and entity is not null), g as (select entity, lag(day) over (partition by entity order by day) as p, day, date_diff('day', lag(day) over (partition by entity order by day), day) as days from dd), c as (select entity, median(days) as cadence from g where p is not null group by 1) select entity, p as gap_start, day as gap_end, days, cadence from g join c using (entity) where days >= 28")
def publishing_gaps(spark, d):
    """W22, W23."""
    return catalog.publishing_gaps(dated_episodes(spark, d).filter("entity is not null"))


_NO1 = r"coalesce(try_cast(nullif(regexp_extract(coalesce(title, ''), '{0}', 1), '') as int), try_cast(nullif(regexp_extract(coalesce(title, ''), '{0}', 2), '') as int))".format(catalog._NUMBER.replace("'", "''"))
_SE1 = r"try_cast(nullif(regexp_extract(coalesce(title, ''), '{0}', 1), '') as int)".format(catalog._SEASON.replace("'", "''"))


@query(
    f"""with {_COV}, held as (select *, min(day) over (partition by entity) as born from ep where day >= date '{catalog.EARLIEST_DAY}' and entity is not null),
mk as (select entity, day, born, {_NO1} as no, {_SE1} as se, lower(coalesce(episode_type, '')) = 'trailer' as trailer, regexp_matches(coalesce(title, ''), '{catalog._LAUNCH.replace("'", "''")}') as says from held),
ev as (select entity, bool_or(trailer or (coalesce(no in (0, 1), false) and coalesce(se <= 1, true)) or says) as launch, coalesce(min(no) > 1, false) or coalesce(min(se) > 1, false) as late from mk where day <= born + {catalog.LAUNCH_DAYS} group by 1),
nth as (select entity, date_diff('day', born, day) > {catalog.ISOLATED_DAYS} as apart from (select *, row_number() over (partition by entity order by day, id) as n from held) where n = {catalog.ISOLATED_RANK} + 1),
w as (select cov.study, cov.entity, win_start, win_end, n_episodes, min(born) as born, max(case when day < win_start then day end) as p, min(case when day >= win_end then day end) as nx from cov left join held on held.entity = cov.entity group by all),
f as (select w.*, coalesce(launch, false) as launch, coalesce(late, false) or coalesce(apart, false) as truncated from w left join ev on ev.entity = w.entity left join nth on nth.entity = w.entity)
select study, entity, win_start, win_end, case when n_episodes > 0 and born <= win_start then 'filled' when born is null then 'unknown'
 when born >= win_end or n_episodes > 0 then case when truncated then 'missing' when launch then case when n_episodes > 0 then 'launch' else 'before_launch' end else 'unknown' end
 when p is not null and nx is not null and (truncated or (date_diff('day', p, win_start) <= {catalog.NEAR_DAYS} and date_diff('day', win_end, nx) <= {catalog.NEAR_DAYS})) then 'missing' else 'unknown' end as verdict from f"""
)
def classify_windows(spark, d):
    """W22, A26."""
    e = dated_episodes(spark, d)
    return catalog.classify_windows(_coverage(spark, d), e, evidence=catalog.start_evidence(e))


@query(f"with {_EP}, e as (select *, count(*) over (partition by podcast_id) as n, row_number() over (partition by podcast_id order by day, id) - 1 as p from ep where day is not null and podcast_id is not null) select id, podcast_id from e where n <= 5 or p in (floor(0.5 * n / 5), floor(1.5 * n / 5), floor(2.5 * n / 5), floor(3.5 * n / 5), floor(4.5 * n / 5))")
def spread_evenly(spark, d):
    """A sampling operator."""
    return sampling.spread_evenly(dated_episodes(spark, d).filter("day is not null and podcast_id is not null"), ["podcast_id"], ["day", "id"], 5).select("id", "podcast_id")


@query("with c as (select distinct feed_host, first_seen_at, floor(date_diff('day', date '2010-01-01', first_seen_at::date) / 7) as bucket from episodes where first_seen_at is not null) select feed_host, bucket::bigint as bucket, min(first_seen_at) as first_seen_at from c group by all")
def weekly_captures(spark, d):
    """Z2, Z15."""
    return catalog.pick_captures(read(spark, d, "episodes").select("feed_host", "first_seen_at").filter("first_seen_at is not null"), ["feed_host"], "first_seen_at", "2010-01-01")


@query("with p as (select distinct id, podchaser_id, title from podcasts), t as (select regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') as k, id from p where title is not null), u as (select k, min(id) as podcast_id from t group by 1 having count(distinct id) = 1) select distinct r.result_id, u.podcast_id from search_results r left join u on u.k = nullif(regexp_replace(lower(case when json_valid(record) then record->>'collectionName' end), '[^a-z0-9]+', '', 'g'), '')")
def unique_title_lookup(spark, d):
    """J23, Z14."""
    idx = read(spark, d, "podcasts").select(fn.title_key("title").alias("k"), F.col("id").alias("podcast_id"))
    r = read(spark, d, "search_results").select("result_id", fn.title_key(F.get_json_object("record", "$.collectionName")).alias("k"))
    return catalog.unique_key_lookup(r, idx, "k", "podcast_id").select("result_id", "podcast_id").distinct()


@query("select status, episode_type, count(distinct id) as n, count(distinct podcast_id) as podcasts from episodes group by all")
def table_stats(spark, d):
    """Z26, A21."""
    return read(spark, d, "episodes").groupBy("status", "episode_type").agg(F.countDistinct("id").alias("n"), F.countDistinct("podcast_id").alias("podcasts"))


@query("with e as (select distinct id, title, duration_seconds, published_date, podcast_id from episodes) select unnest(['title_known', 'duration_positive', 'dated', 'has_podcast']) as rule, unnest([count(*) filter (title is null or title = ''), count(*) filter (not coalesce(duration_seconds > 0, false)), count(*) filter (not coalesce(regexp_matches(published_date, '^\\d{4}-'), false)), count(*) filter (podcast_id is null)]) as violations from e")
def contract_violations(spark, d):
    """D3, D5, D4."""
    e = read(spark, d, "episodes").select("id", "title", "duration_seconds", "published_date", "podcast_id").distinct()
    return catalog.violations(e, {"title_known": F.col("title") != "", "duration_positive": F.col("duration_seconds") > 0, "dated": F.col("published_date").rlike(r"^\d{4}-"), "has_podcast": F.col("podcast_id").isNotNull()})


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest_rows(spark, d):
    """U7, S34, Z23, D2."""
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return catalog.latest(e, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("with e as (select c_custkey as k, c_name as v from customer where c_nationkey < 15), n as (select c_custkey as k, c_mktsegment as v from customer where c_nationkey >= 10) select * from n union all select * from e where k not in (select k from n)")
def upsert_rows(spark, d):
    """U7, U2."""
    c = read(spark, d, "customer")
    return catalog.upsert(c.filter("c_nationkey < 15").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), c.filter("c_nationkey >= 10").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")), ["k"])


@query("with e as (select c_custkey as k, c_name as v from customer where c_nationkey < 15), n as (select c_custkey as k, c_mktsegment as v from customer where c_nationkey >= 10) select * from e union all select * from n where k not in (select k from e)")
def append_new_rows(spark, d):
    """U6."""
    c = read(spark, d, "customer")
    return catalog.append_new(c.filter("c_nationkey < 15").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), c.filter("c_nationkey >= 10").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")), ["k"])


@query("with c as (select distinct podcast_id, chart, chart_rank from podcast_charts where podcast_id is not null and chart is not null), g as (select podcast_id, string_agg(chart || ':' || coalesce(chart_rank::varchar, '-'), ',' order by chart, coalesce(chart_rank::varchar, '-')) as charts from c group by 1) select * from g")
def charts_of_podcasts(spark, d):
    """A37, A20."""
    c = read(spark, d, "podcast_charts").select("podcast_id", "chart", "chart_rank").filter("podcast_id is not null and chart is not null").distinct()
    item = F.struct("chart", F.coalesce(F.col("chart_rank").cast("string"), F.lit("-")).alias("r"))
    return c.groupBy("podcast_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["chart"], F.lit(":"), x["r"])), ",").alias("charts"))


# ---- intervals ---------------------------------------------------------------------------------------
_AU = "au as (select distinct episode_id, span_kind, round(start_s * 1000)::bigint as s, round(end_s * 1000)::bigint as e from audio_spans where episode_id is not null and span_kind is not null), ok as (select * from au where s is not null and e is not null and e > s)"


def _spans(spark, d):
    a = read(spark, d, "audio_spans").filter("episode_id is not null and span_kind is not null").select("episode_id", "span_kind", F.round(F.col("start_s") * 1000).cast("long").alias("s"), F.round(F.col("end_s") * 1000).cast("long").alias("e"))
    return a.filter("s is not null and e is not null and e > s").distinct()


@query(f"with {_AU}, m as (select *, max(e) over (partition by episode_id, span_kind order by s, e rows between unbounded preceding and 1 preceding) as b from ok), i as (select *, sum(case when b is null or s > b + 500 then 1 else 0 end) over (partition by episode_id, span_kind order by s, e) as island from m) select episode_id, span_kind, s, e, island from i")
def interval_islands(spark, d):
    """Spans at most half a second apart."""
    return intervals.islands(_spans(spark, d), ["episode_id", "span_kind"], "s", "e", gap=500).select("episode_id", "span_kind", "s", "e", "island")


@query(f"with {_AU} select a.episode_id, a.s as o_start, a.e as o_end, b.s as s_start, b.e as s_end from ok a join ok b on a.episode_id = b.episode_id and a.span_kind = 'omitted' and b.span_kind = 'speech' and a.s < b.e and b.s < a.e")
def overlapping_spans(spark, d):
    """J12, J13, F15."""
    x = _spans(spark, d)
    o = x.filter("span_kind = 'omitted'").select("episode_id", F.col("s").alias("o_start"), F.col("e").alias("o_end"))
    s = x.filter("span_kind = 'speech'").select("episode_id", F.col("s").alias("s_start"), F.col("e").alias("s_end"))
    return intervals.overlap_join(o, s, ["episode_id"], 60_000, ("o_start", "o_end", "s_start", "s_end"), inclusive=False)


@query(
    """with e as (select event_type, row_number() over (partition by event_type order by ts, event_id) as pos, value as p from events), x as (select *, pos - row_number() over (partition by event_type order by pos) as g from e where p >= 20),
r as (select event_type, g, min(pos) as s, max(pos) as e, max(p) as t from x group by all having max(p) >= 80), m as (select *, max(e) over (partition by event_type order by s, e rows between unbounded preceding and 1 preceding) as b from r),
i as (select *, sum(case when b is null or s > b + 3 then 1 else 0 end) over (partition by event_type order by s, e) as k from m) select event_type, min(s) as span_start, max(e) as span_end, max(t) as peak from i group by event_type, k"""
)
def hysteresis_spans(spark, d):
    """W24, X11."""
    e = read(spark, d, "events").select("event_type", F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id")).cast("long").alias("pos"), F.col("value").alias("p"))
    return intervals.hysteresis_spans(e, ["event_type"], "pos", "p", 80, 20, 2)


# ---- sampling ----------------------------------------------------------------------------------------
_SC = "left(sha256('{0}' || chr(31) || {1}::varchar), 16)"


@query(f"select doc_id, source from (select doc_id, source, row_number() over (partition by source order by {_SC.format('s2', 'doc_id')}, doc_id) as n from documents) where n <= 3")
def sample_per_source(spark, d):
    """A sampling operator."""
    return sampling.bottom_k(read(spark, d, "documents").select("doc_id", "source"), 3, "s2", "doc_id", ["source"]).select("doc_id", "source")


@query(f"with x as (select doc_id, source, {_SC.format('s3', 'doc_id')} as score from documents), y as (select *, row_number() over (partition by source order by score, doc_id) as n from x) select doc_id, source from y where n <= 5 order by score, doc_id limit 40")
def sample_with_caps(spark, d):
    """A sampling operator."""
    return sampling.with_caps(read(spark, d, "documents").select("doc_id", "source"), 40, 5, "source", "s3", "doc_id").select("doc_id", "source")


@query(f"with x as (select doc_id, kind, row_number() over (partition by kind order by {_SC.format('s4', 'doc_id')}, doc_id) as n, count(*) over (partition by kind) as c from documents) select doc_id, kind, case when n <= round(c * 0.2) then 'test' else 'dev' end as split from x")
def stratified_split(spark, d):
    """T8."""
    return sampling.split_strata(read(spark, d, "documents").select("doc_id", "kind"), "kind", "doc_id", 0.2, "s4").select("doc_id", "kind", "split")


@query("select doc_id, source, row_number() over (partition by source order by created_at nulls first, doc_id) as turn from documents")
def round_robin(spark, d):
    """W28, T12, W29."""
    return sampling.round_robin(read(spark, d, "documents").select("doc_id", "source", "created_at"), "source", ["created_at", "doc_id"]).drop("created_at")


@query("select source, quantile_disc(n_chars, 0.9) as q from documents where n_chars is not null group by 1")
def quantile_per_source(spark, d):
    """T6."""
    return sampling.quantile_lower(read(spark, d, "documents").filter("n_chars is not null"), ["source"], "n_chars", 0.9)


@query(f"with a as (select doc_id from (select doc_id, row_number() over (partition by kind order by {_SC.format('s5', 'doc_id')}, doc_id) as n from documents) where n <= 20), b as (select doc_id from (select doc_id, row_number() over (partition by source order by {_SC.format('s6', 'doc_id')}, doc_id) as n from documents) where n <= 5) select doc_id, case when ka is not null and kb is not null then 'kind|source' when ka is not null then 'kind' else 'source' end as strata from (select coalesce(a.doc_id, b.doc_id) as doc_id, a.doc_id as ka, b.doc_id as kb from a full join b using (doc_id))")
def review_strata(spark, d):
    """A sampling operator."""
    x = read(spark, d, "documents").select("doc_id", "kind", "source")
    return sampling.strata_union({"kind": sampling.bottom_k(x, 20, "s5", "doc_id", ["kind"]), "source": sampling.bottom_k(x, 5, "s6", "doc_id", ["source"])}, "doc_id")


# ---- scoring -----------------------------------------------------------------------------------------
_T, _P = "coalesce(kind = 'transcript', false)", "coalesce(regexp_matches(text, '[!?]'), false)"
_CF = f"count(*) filter ({_T} and {_P}) as tp, count(*) filter (not {_T} and {_P}) as fp, count(*) filter ({_T} and not {_P}) as fn"


def _judged(spark, d):
    return read(spark, d, "documents").select("doc_id", "source", "lang", "kind", "n_chars", (F.col("kind") == "transcript").alias("truth"), F.col("text").rlike("[!?]").alias("guess"))


@query(f"select source, tp, fp, fn, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as recall, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end as f1 from (select source, {_CF} from documents group by 1)")
def confusion_prf(spark, d):
    """A29, G12."""
    return scoring.confusion(_judged(spark, d), ["source"], F.col("truth"), F.col("guess"))


@query(f"with x as (select 'all' as level, '' as value, {_CF} from documents union all select 'source', coalesce(source, ''), {_CF} from documents group by 1, source union all select 'lang', coalesce(lang, ''), {_CF} from documents group by 1, lang) select *, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end as f1 from x")
def confusion_breakdown(spark, d):
    """A29, A30, A36."""
    return scoring.confusion_breakdown(_judged(spark, d), ["source", "lang"], F.col("truth"), F.col("guess"))


@query("with p as (select (l_linenumber - 1) % 5 as a, case when l_quantity < 10 then 0 when l_quantity < 20 then 1 when l_quantity < 30 then 2 when l_quantity < 40 then 3 else 4 end as b from lineitem), n as (select count(*) as n from p), r as (select a, count(*) as k from p group by 1), c as (select b, count(*) as k from p group by 1) select n, 1 - (select sum(abs(a - b) / 4.0) from p) * n / (select sum(abs(r.a - c.b) / 4.0 * r.k * c.k) from r, c) as kappa from n")
def weighted_kappa(spark, d):
    """G8."""
    q = F.col("l_quantity")
    p = read(spark, d, "lineitem").select(((F.col("l_linenumber") - 1) % 5).alias("a"), F.when(q < 10, 0).when(q < 20, 1).when(q < 30, 2).when(q < 40, 3).otherwise(4).alias("b"))
    return scoring.weighted_kappa(p, "a", "b", 5)


@query("with v as (select l_orderkey as u, l_returnflag as v, count(*) as n from lineitem group by all), m as (select u, sum(n) as m from v group by 1 having sum(n) >= 2), vv as (select v.* from v join m using (u)), o as (select sum(x.n * y.n / (m - 1)::double) as o from vv x join vv y on x.u = y.u and x.v <> y.v join m on m.u = x.u), t as (select v, sum(n) as k from vv group by 1), s as (select sum(k) as n from t), e as (select sum(a.k * b.k) as e from t a, t b where a.v <> b.v) select n::bigint as n, 1 - (o / n) / (e / (n * (n - 1))) as alpha from o, s, e")
def kripp_alpha(spark, d):
    """G9."""
    return scoring.krippendorff_alpha(read(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@query("with x as (select n_chars as s, kind = 'transcript' as p from documents where n_chars is not null), n as (select count(*) filter (p) as positives, count(*) filter (not p) as negatives from x), r as (select p, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as r from x) select positives, negatives, ((select sum(r) from r where p) - positives * (positives + 1) / 2.0) / (positives * negatives)::double as auroc from n")
def auroc(spark, d):
    """G10."""
    return scoring.auroc(read(spark, d, "documents"), "n_chars", F.col("kind") == "transcript")


@query()
def paired_bootstrap(spark, d):
    """G11, G14 (resampling; tested on its statistics)."""
    j = _judged(spark, d)
    t, a, b = F.coalesce("truth", F.lit(False)), F.coalesce("guess", F.lit(False)), F.coalesce(F.col("n_chars") > 800, F.lit(False))
    n = lambda c: F.when(c, 1).otherwise(0)
    items = j.select("doc_id", n(t & a).alias("tp_a"), n(~t & a).alias("fp_a"), n(t & ~a).alias("fn_a"), n(t & b).alias("tp_b"), n(~t & b).alias("fp_b"), n(t & ~b).alias("fn_b"))
    return scoring.paired_bootstrap(items, "doc_id")


@query()
def optimal_match(spark, d):
    """Omitted spans and speech spans of an episode by overlap (tested against brute force)."""
    o = overlapping_spans(spark, d)
    w = F.least("o_end", "s_end") - F.greatest("o_start", "s_start")
    return scoring.optimal_match(o.withColumn("w", w.cast("double")), "episode_id", "o_start", "s_start", "w")


def _atoms(spark, d):
    """Audio spans as annotations of three annotators over units of ten seconds."""
    a = _spans(spark, d)
    s, e = F.col("s"), F.col("e")
    return a.select(F.col("episode_id").alias("item"), "episode_id", ((s + e) % 3).cast("string").alias("annotator"), F.lit("span").alias("axis"), F.col("span_kind").alias("label"), F.lit("host").alias("role"), F.floor(s / 10000).alias("span_start"), F.floor(e / 10000).alias("span_end"), (((s * 7 + e) % 100) / 100).alias("confidence")).distinct()


_ATOMS = _AU + ", atom as (select distinct episode_id, ((s + e) % 3)::varchar as annotator, span_kind as label, floor(s / 10000)::bigint as span_start, floor(e / 10000)::bigint as span_end, ((s * 7 + e) % 100) / 100.0 as confidence from ok)"
_ISL = _ATOMS + ", m as (select *, max(span_end) over (partition by episode_id, label order by span_start, span_end rows between unbounded preceding and 1 preceding) as b from atom), i as (select *, sum(case when b is null or span_start > b + 1 then 1 else 0 end) over (partition by episode_id, label order by span_start, span_end rows unbounded preceding) as k from m)"


@query()
def gold_clusters(spark, d):
    """G2, A31, J19."""
    return scoring.cluster_atoms(_atoms(spark, d), "item")


@query(f"with {_ISL} select episode_id, 'span' as axis, label, 'host' as role, min(span_start) as span_start, max(span_end) as span_end, count(*) as n_sources, max(confidence) as confidence from i group by episode_id, label, k")
def annotation_islands(spark, d):
    """W11, W15, G1."""
    return labels.annotation_islands(_atoms(spark, d))


@query(f"with {_ISL} select episode_id, 'span' as axis, min(span_start) as span_start, max(span_end) as span_end, [label] as labels, count(*) as n_detections from i group by episode_id, label, k")
def merged_detections(spark, d):
    """W10."""
    return labels.merge_detections(_atoms(spark, d).select("episode_id", "axis", "span_start", "span_end", F.array("label").alias("labels"), F.lit(0).alias("window_index"), F.xxhash64("label", "annotator", "confidence").alias("position")))


@query()
def merged_claims(spark, d):
    """Sentences of overlapping windows of a document as claims."""
    s = text.scan_sentences(read(spark, d, "documents").select(F.col("doc_id").alias("episode_id"), F.lit(0).alias("seg_index"), F.lit(None).cast("double").alias("start_s"), "text"))
    c = s.select("episode_id", F.lit("host").alias("role"), F.col("n_in_segment").cast("long").alias("span_start"), F.col("n_in_segment").cast("long").alias("span_end"), F.col("sentence").alias("claim"), F.col("sentence").alias("quote"), F.lit(0.5).alias("confidence"))
    again = F.explode(F.array(F.lit(0), F.lit(1)))
    return labels.merge_claims(c.withColumn("window_index", again).withColumn("position", F.col("span_start")))


@query("with a as (select user_id as episode_id, event_type as product_key, date_diff('hour', timestamp '2024-01-01', ts) as s, event_id from events), m as (select *, max(s + 6) over (partition by episode_id, product_key order by s, s + 6 rows between unbounded preceding and 1 preceding) as b from a), i as (select *, sum(case when b is null or s > b + 1 then 1 else 0 end) over (partition by episode_id, product_key order by s) as k from (select episode_id, product_key, s, max(b) as b0, min(b) as b, count(*) as c from m group by all)) select episode_id, product_key, min(s) as span_start, max(s + 6) as span_end, sum(c)::bigint as n_mentions from i group by episode_id, product_key, k")
def merged_products(spark, d):
    """W13, W14."""
    e = read(spark, d, "events")
    s = F.floor((F.unix_seconds(F.date_trunc("hour", "ts")) - 1704067200) / 3600)
    p = e.select(F.col("user_id").alias("episode_id"), F.col("event_type").alias("product_key"), s.alias("span_start"), (s + 6).alias("span_end"), F.col("event_id").cast("string").alias("name"), (F.col("value") / 100).alias("confidence"))
    return labels.merge_products(p).select("episode_id", "product_key", "span_start", "span_end", "n_mentions")


@query()
def validated_atoms(spark, d):
    """Kinds of broken rules among spans against the units of their transcripts."""
    u = text.transcript_units(segments(spark, d)).select("episode_id", "unit_index")
    return labels.validate_atoms(_atoms(spark, d), u, ["omitted", "speech"], ["span"]).groupBy("error_kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_ATOMS}, p as (select episode_id, label, count(*) as n, max(confidence) as top from atom group by all) select episode_id, string_agg(label || ':' || n || ':' || round(top * 100)::int, ',' order by label) as labels, sum(n)::bigint as n_annotations from p group by 1")
def label_summary(spark, d):
    """A15."""
    s = labels.label_summary(_atoms(spark, d))
    flat = F.transform(F.map_entries("labels"), lambda x: F.concat_ws(":", x["key"], x["value"]["n"].cast("string"), F.round(x["value"]["top"] * 100).cast("int").cast("string")))
    return s.select("episode_id", F.array_join(flat, ",").alias("labels"), "n_annotations")


# ---- functions, sources, streams ---------------------------------------------------------------------
@query(
    f"""with e as (select distinct id, title from episodes where title is not null) select id, {_KEY.format('title')} as key, {_NORM.format('title')} as norm, array_to_string({_NUMS.format('title')}, ',') as numbers, lower(trim(regexp_replace(title, '[\\s\\x0B]+', ' ', 'g'))) as quote, split_part(title, '.', 1) as parent,
left(sha256('o' || chr(31) || id::varchar), 16) as score from e"""
)
def title_functions(spark, d):
    """F1, F7, F8, F11, F29, T10."""
    e = read(spark, d, "episodes").select("id", "title").filter("title is not null").distinct()
    return e.select("id", fn.title_key("title").alias("key"), fn.norm_title("title").alias("norm"), F.array_join(fn.title_numbers("title"), ",").alias("numbers"), fn.normalized_quote("title").alias("quote"), fn.topic_parent("title").alias("parent"), fn.sample_score("o", F.col("id")).alias("score"))


@query("with e as (select distinct id, audio_url from episodes where audio_url is not null) select id, regexp_replace(regexp_replace(lower(audio_url), '^https?://(www\\.)?', ''), '^([^/]+?):(?:80|443)(/|$)', '\\1\\2') as identity, case when length(regexp_extract(audio_url, '/([^/?#]+?)\\.(?:mp3|m4a|ogg|wav|aac)(?:[?#].*)?$', 1)) >= 8 then lower(regexp_extract(audio_url, '/([^/?#]+?)\\.(?:mp3|m4a|ogg|wav|aac)(?:[?#].*)?$', 1)) end as media from e")
def url_functions(spark, d):
    """S23, Z5, Z27, F31."""
    e = read(spark, d, "episodes").select("id", "audio_url").filter("audio_url is not null").distinct()
    return e.select("id", fn.url_identity(fn.unwrap_tracking_url("audio_url")).alias("identity"), fn.media_key("audio_url").alias("media"))


@query("with t as (select doc_id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) > 2)) as t from documents), p as (select distinct id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(description, '')), '[a-z0-9]+'), lambda x: length(x) > 2)) as t from podcasts) select doc_id, len(t) as n_tokens from t")
def claim_token_counts(spark, d):
    """F9, Z7."""
    return read(spark, d, "documents").select("doc_id", F.size(fn.claim_tokens(F.coalesce("text", F.lit("")))).alias("n_tokens"))


@query("with c as (select distinct id, categories from podcasts where categories is not null), g as (select id, unnest(from_json(categories, '[\"VARCHAR\"]')) as g from c), s as (select g, count(distinct id) as podcasts from g group by 1) select array_to_string(list_filter(regexp_split_to_array(lower(g), '[^a-z0-9]+'), lambda w: w not in ('', 'and')), '-') as slug, sum(podcasts)::bigint as podcasts from s group by 1")
def genre_slugs(spark, d):
    """F2, F28, J8."""
    c = read(spark, d, "podcasts").select("id", F.explode(F.from_json("categories", "array<string>")).alias("g")).distinct()
    per = c.groupBy("g").agg(F.countDistinct("id").alias("podcasts"))
    return per.groupBy(fn.genre_slug("g").alias("slug")).agg(F.sum("podcasts").alias("podcasts"))


@query("select distinct id, case when length(t) > 1000 then left(t, 997) || '...' else t end as short from (select id, trim(regexp_replace(regexp_replace(description, '<[^>]+>', ' ', 'g'), '[\\s\\x0B]+', ' ', 'g')) as t from episodes where description is not null)")
def clean_descriptions(spark, d):
    """S21."""
    return read(spark, d, "episodes").filter("description is not null").select("id", fn.clean_html("description").alias("short")).distinct()


@query("select date_trunc('minute', ts) as bucket, event_type, count(*) as n, sum(value) as total from events group by all")
def usage_buckets(spark, d):
    """R2, R3, F23, A34 (batch form of the stream)."""
    return jobs.usage_buckets(read(spark, d, "events"))


@query("with s as (select unnest(generate_series(date_trunc('hour', ts) - interval 45 minutes, ts, interval 15 minutes)) as w_start, ts from events) select w_start, count(*) as n from s where ts >= w_start and ts < w_start + interval 1 hour group by 1")
def sliding_rate(spark, d):
    """R6 (batch form of the stream)."""
    return jobs.sliding_rate(read(spark, d, "events"))


@query("with m as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as p from events), i as (select *, sum(case when p is null or ts >= p + interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k from m) select user_id, min(ts) as s_start, max(ts) + interval 30 minutes as s_end, count(*) as n from i group by user_id, k")
def user_sessions(spark, d):
    """Extension: session windows (batch form of the stream)."""
    return jobs.sessions(read(spark, d, "events"))


@query(f"with {_SEG}, t as (select episode_id, round(start_s * 1000)::bigint as a, round(end_s * 1000)::bigint as b, trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '[\\s\\x0B]+', ' ', 'g')) as text from seg where start_s is not null and end_s is not null and text is not null and not contains(text, '<') and not contains(text, '-->') and not contains(text, chr(10)) and not contains(text, chr(13))) select * from t where text <> '' and not regexp_matches(text, '^\\d*$')")
def cue_round_trip(spark, d):
    """Timed segments written as cues, one body per transcript, and parsed back."""
    s = segments(spark, d).filter("start_s is not null and end_s is not null and text is not null and not contains(text, '<') and not contains(text, '-->') and not contains(text, '\n') and not contains(text, '\r') and trim(text) <> ''")
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    stamp = lambda v: F.format_string("%02d:%02d:%02d,%03d", F.floor(v / 3600000), F.floor(v / 60000) % 60, F.floor(v / 1000) % 60, v % 1000)
    cue = F.concat((F.col("seg_index") + 1).cast("string"), F.lit("\n"), stamp(ms("start_s")), F.lit(" --> "), stamp(ms("end_s")), F.lit("\n"), F.col("text"))
    body = s.groupBy("episode_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_index", cue.alias("c")))), lambda x: x["c"]), "\n\n").alias("body"))
    p = transcripts.parse_transcripts(body, "episode_id", "body")
    return p.select("episode_id", F.round(F.col("start_s") * 1000).cast("long").alias("a"), F.round(F.col("end_s") * 1000).cast("long").alias("b"), "text")


@query("with e as (select distinct id, podcast_id, episode_guid, title, audio_url, duration_seconds from episodes where podcast_id is not null and audio_url is not null and not contains(coalesce(title, ''), '<') and not contains(coalesce(title, ''), ']]>')) select podcast_id, coalesce(nullif(trim(episode_guid), ''), audio_url) as guid, nullif(regexp_replace(title, '^[\\s]+|[\\s]+$', '', 'g'), '') as title, duration_seconds, audio_url from e")
def feed_round_trip(spark, d):
    """Episodes written as feed items, one body per podcast and block of ids, and parsed back."""
    e = read(spark, d, "episodes").select("id", "podcast_id", "episode_guid", "title", "audio_url", "duration_seconds").filter("podcast_id is not null and audio_url is not null and not contains(coalesce(title, ''), '<') and not contains(coalesce(title, ''), ']]>')").distinct()
    tag = lambda n, c: F.coalesce(F.concat(F.lit(f"<{n}><![CDATA["), c, F.lit(f"]]></{n}>")), F.lit(""))
    item = F.concat(F.lit("<item>"), tag("guid", F.col("episode_guid")), tag("title", F.col("title")), tag("itunes:duration", F.col("duration_seconds").cast("string")), F.lit('<enclosure type="audio/mpeg" url="'), F.replace(F.col("audio_url"), F.lit("&"), F.lit("&amp;")), F.lit('"/></item>'))
    feed = e.groupBy("podcast_id", F.floor(F.col("id") / 1000).alias("block")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("body"))
    p = captures.parse_feed(feed.select(F.struct("podcast_id", "block").alias("k"), "body"), "k", "body")
    trim = F.nullif(F.regexp_replace("title", r"^\s+|\s+$", ""), F.lit(""))
    return p.select("k.podcast_id", "guid", trim.alias("title"), "duration_seconds", "audio_url")


@query("select user_id, 'true' as trusted, strftime(ts, '%Y%m%d%H%M%S') as at, event_type as original from events")
def listing_round_trip(spark, d):
    """Events written as capture listings, one per user and day, and parsed back."""
    e = read(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.array(F.date_format("ts", "yyyyMMddHHmmss"), "event_type").alias("r"))
    head = F.array(F.array(F.lit("timestamp"), F.lit("original")))
    b = e.groupBy("user_id", "day").agg(F.to_json(F.concat(head, F.collect_list("r"))).alias("body"))
    p = captures.parse_listing(b.select(F.struct("user_id", "day").alias("k"), "body"), "k", "body")
    return p.select("k.user_id", F.col("trusted").cast("string").alias("trusted"), "at", "original")


# ---- selection and evaluation ------------------------------------------------------------------------
def _candidates(spark, d):
    hit = catalog.episodes_in_windows(dated_episodes(spark, d).select("entity", "day", F.col("id").alias("episode_id")).distinct(), windows(spark, d).select("entity", "win_start", "win_end").distinct())
    t = read(spark, d, "transcripts").select("episode_id").distinct().withColumn("done", F.lit(True))
    return hit.join(t, "episode_id", "left").withColumn("done", F.coalesce("done", F.lit(False))).withColumn("own", F.lit(True)).select("entity", "win_start", "win_end", "episode_id", "day", "own", "done")


@query(f"with {_EP}, {_WIN}, w as (select distinct entity, win_start, win_end from win), j as (select w.entity, win_start, win_end, ep.id as episode_id, row_number() over (partition by ep.id order by win_start, win_end, w.entity) as n from w join ep on ep.entity = w.entity and ep.day >= win_start and ep.day < win_end) select entity, win_start, win_end, episode_id from j where n = 1")
def first_windows(spark, d):
    """W21 without a cap."""
    return selection.first_window(_candidates(spark, d).select("entity", "win_start", "win_end", "episode_id"), "episode_id", ["win_start", "win_end", "entity"])


@query()
def capped_selection(spark, d):
    """W21, W20 (what a window takes depends on those before it)."""
    return selection.select_with_caps(_candidates(spark, d).drop("win_end").distinct(), 2)


def _feed_captures(spark, d):
    return read(spark, d, "episodes").select(F.concat(F.lit("podcast:"), F.col("podcast_id").cast("string")).alias("entity"), F.to_date("first_seen_at").alias("day"), F.md5(F.coalesce("audio_url", F.lit(""))).alias("digest"), "first_seen_at").filter("entity is not null and day is not null").distinct()


@query()
def next_captures(spark, d):
    """Z1 (a frontier that moves from window to window)."""
    return selection.next_captures(_feed_captures(spark, d).select("entity", "day", "digest"), windows(spark, d).select("entity", "win_start", "win_end"))


_CAP = "cap as (select distinct 'podcast:' || podcast_id as entity, first_seen_at, first_seen_at::date as day from episodes where podcast_id is not null and first_seen_at is not null)"


@query(f"with {_WIN}, {_CAP}, w as (select entity, max(win_start) as target from win group by 1), r as (select cap.entity, first_seen_at, target, day, row_number() over (partition by cap.entity order by case when extract(hour from first_seen_at) < 12 then 0 else 1 end, abs(date_diff('day', target, day)), first_seen_at) as place from cap join w using (entity)) select entity, first_seen_at, place from r where place <= 3")
def ranked_captures(spark, d):
    """Z3: a top-k report; captures of the morning stand for direct hits."""
    c = _feed_captures(spark, d).select("entity", "first_seen_at").distinct().join(windows(spark, d).groupBy("entity").agg(F.max("win_start").alias("target")), "entity")
    return selection.rank_captures(c, ["entity"], F.col("target"), "first_seen_at", F.hour("first_seen_at") < 12).filter("place <= 3").select("entity", "first_seen_at", "place")


@query(f"with {_WIN}, {_CAP}, w as (select distinct entity, win_start, win_end from win), g as (select w.entity, win_start, win_end, min(case when day >= win_end and day <= win_end + 14 then first_seen_at end) as a, max(case when day > win_start and day < win_end then first_seen_at end) as b from w join cap using (entity) group by all) select entity, win_start, win_end, coalesce(a, b) as chosen from g where coalesce(a, b) is not null")
def chosen_captures(spark, d):
    """Z4."""
    c = windows(spark, d).select("entity", "win_start", "win_end").distinct().join(_feed_captures(spark, d).select("entity", "first_seen_at").distinct(), "entity")
    return selection.choose_capture(c, ["entity", "win_start", "win_end"], "win_end", "first_seen_at", 14, "win_start")


@query(
    f"""with {_EP}, g as (select distinct id, episode_guid, coalesce(has_rss_transcript, false) as h from episodes), x as (select ep.id, podcast_id, h, nullif(episode_guid, '') as guid, day, {_KEY.format('title')} as key from ep join g using (id)),
i as (select * from x where not h), e as (select * from x where h)
select 'r' || i.id as ref, case when g.id is not null then 'guid' when dd.id is not null then 'day_title' when n.id is not null then 'adjacent_day' else 'insert' end as action, coalesce(g.id, dd.id, n.id) as id
from i left join (select podcast_id, guid, min(id) as id from e where guid is not null group by all) g on g.podcast_id = i.podcast_id and g.guid = i.guid
left join (select podcast_id, day, key, min(id) as id from e where day is not null and key is not null group by all) dd on dd.podcast_id = i.podcast_id and dd.day = i.day and dd.key = i.key
left join (select podcast_id, dn as day, key, min(id) as id from (select podcast_id, unnest([day - 1, day + 1]) as dn, key, id from e where day is not null and length(key) >= 12) group by all) n on n.podcast_id = i.podcast_id and n.day = i.day and n.key = i.key"""
)
def import_plan(spark, d):
    """Episodes without a feed transcript as incoming rows, those with one as the existing."""
    g = read(spark, d, "episodes").select("id", F.nullif("episode_guid", F.lit("")).alias("guid"), F.coalesce("has_rss_transcript", F.lit(False)).alias("h")).distinct()
    x = dated_episodes(spark, d).join(g, "id").select("id", "podcast_id", "guid", "day", "title", "h")
    return selection.import_plan(x.filter("not h").withColumn("ref", F.concat(F.lit("r"), F.col("id").cast("string"))), x.filter("h"))


@query(
    f"""with p as (select distinct id, {_KEY.format('title')} as k, {_KEY.format('publisher')} as sp from podcasts), r as (select distinct result_id, result_position, {_KEY.format("case when json_valid(record) then record->>'collectionName' end")} as k, {_KEY.format("case when json_valid(record) then record->>'artistName' end")} as rp from search_results),
j as (select p.id as show_id, result_id, case when sp = rp then 1 else 3 end as tier, row_number() over (partition by p.id order by case when sp = rp then 1 else 3 end, result_position nulls first, result_id) as n from p join r on p.k = r.k) select show_id, result_id, tier from j where n = 1"""
)
def best_matches(spark, d):
    """J21, P12."""
    f = lambda n: F.get_json_object("record", f"$.{n}")
    r = read(spark, d, "search_results").select("result_id", F.col("result_position").alias("position"), f("collectionName").alias("title"), f("artistName").alias("publisher")).distinct()
    return selection.best_match(r, read(spark, d, "podcasts").select(F.col("id").alias("show_id"), "title", "publisher").distinct())


@query()
def reposts(spark, d):
    """J17, F12, F13 (difflib; tested against brute force)."""
    return selection.reposts(dated_episodes(spark, d))


@query()
def item_scores(spark, d):
    """The third annotator against the gold of the first two."""
    a = _atoms(spark, d)
    gold = scoring.cluster_atoms(a.filter("annotator <> '2'"), "item").withColumn("gold_id", F.concat_ws("|", "label", "tight_start", "tight_end"))
    mine = a.filter("annotator = '2'").withColumn("pred_id", F.concat_ws("|", "label", "span_start", "span_end")).select("item", "pred_id", "label", "span_start", "span_end").distinct()
    return evaluation.score_items(mine, gold)


@query()
def annotator_f1(spark, d):
    """G5, J19, A31."""
    return evaluation.pairwise_f1(_atoms(spark, d).select("item", "annotator", "label", "span_start", "span_end"))


@query()
def held_out_annotators(spark, d):
    """G6."""
    return evaluation.leave_one_out(_atoms(spark, d).select("item", "annotator", "label", "span_start", "span_end"))


@query("with t as (select unnest([100.0, 300.0, 800.0, 2000.0]) as threshold), x as (select n_chars, coalesce(kind = 'transcript', false) as t from documents), a as (select threshold, count(*) filter (coalesce(n_chars >= threshold, false) and t) as tp, count(*) filter (coalesce(n_chars >= threshold, false) and not t) as fp, count(*) filter (not coalesce(n_chars >= threshold, false) and t) as fn from t, x group by 1) select *, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end as f1 from a")
def threshold_sweep(spark, d):
    """X12."""
    return evaluation.sweep(read(spark, d, "documents"), "n_chars", F.col("kind") == "transcript", [100, 300, 800, 2000])


@query("select 'k' as key, sum((props->>'k')::double) as total, count(*) as n from events where json_valid(props) and props->>'k' is not null")
def usage_totals(spark, d):
    """A35."""
    return evaluation.map_totals(read(spark, d, "events"), "props")


@query("select event_id, try_cast(props->>'k' as bigint) as k from events")
def usage_columns(spark, d):
    """S27."""
    return jsonl.flatten_usage(read(spark, d, "events"), ["event_id"], "props", {"k": "$.k"})


@query("select kind, source, count(*) as items, sum(('0x' || left(sha256(doc_id::varchar), 8))::bigint)::varchar as fingerprint from documents group by all")
def item_composition(spark, d):
    """A36."""
    return evaluation.composition(read(spark, d, "documents"), "doc_id", ["kind", "source"])


@query("with r as (select strftime(ts, '%Y-%m-%d') as bucket, event_type, count(*) as n, sum(value) as total from events group by all) select bucket, event_type as metric, total from r")
def daily_usage(spark, d):
    """A34, Z22, F23."""
    e = read(spark, d, "events").groupBy(fn.bucket_key(F.col("ts"), "day").alias("bucket"), F.col("event_type").alias("metric"))
    return e.agg(F.sum("value").alias("total"))


@query("with v as (select event_type as metric, ts::date as day, sum(value) as value from events group by all) select metric, avg(value) as mean, min(value) as low, max(value) as high, count(*) as n from v group by 1")
def repeat_means(spark, d):
    """G16."""
    return evaluation.mean_of_repeats(read(spark, d, "events").groupBy(F.col("event_type").alias("metric"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("value")))


@query("with m as (select doc_id, lower(coalesce(text, '')) as t from documents), x as (select doc_id, unnest(['absolute', 'hedged', 'speculative']) as level, unnest([len(regexp_extract_all(t, '\\b(always|never|definitely|proven)\\b')), len(regexp_extract_all(t, '\\b(might|probably|i don''t think|tend to)\\b')), len(regexp_extract_all(t, '\\b(maybe|could it be|i suppose)\\b'))]) as n from m) select * from x where n > 0")
def certainty_markers(spark, d):
    """F21."""
    return text.certainty_markers(read(spark, d, "documents"), "doc_id", "text")


@query()
def name_candidates(spark, d):
    """F22, on all documents, whatever their ``lang`` says."""
    return text.name_candidates(read(spark, d, "documents"), "doc_id", "text")


@query("select chart, count(*) as n, case when regexp_matches(chart, '^(apple|spotify)_([a-z]{2})_(top|genre_\\d+)$') then split_part(chart, '_', 1) || ':' || split_part(chart, '_', 2) || ':show:' || coalesce(nullif(regexp_extract(chart, 'genre_(\\d+)$', 1), ''), 'all') end as canonical from podcast_charts group by 1")
def canonical_charts(spark, d):
    """F3, J8, S12."""
    c = read(spark, d, "podcast_charts").groupBy("chart").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("canonical", fn.canonical_chart("chart"))


@query("with e as (select distinct id, title from episodes) select id, try_cast(nullif(regexp_extract(title, '(?i)(?:episode|ep\\.?|#)\\s*(\\d{1,5})', 1), '') as int) as number from e")
def episode_numbers(spark, d):
    """F26."""
    return read(spark, d, "episodes").select("id", "title").distinct().select("id", fn.numbering(F.lit(None).cast("string"), F.col("title")).alias("number"))
