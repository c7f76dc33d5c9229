"""Queries of the general data-preparation operators (problems 1 and 4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.operators import intervals, timestamps
from auralake.session import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 1: the instant of every date that denotes one and isn't written canonically."""
    rows = timestamps.dated_rows(read(spark, d, "episodes"), read(spark, d, "podcast_charts"), read(spark, d, "feed_hosts"))
    other = rows.filter(F.col("raw").isNotNull() & ~F.col("raw").rlike(timestamps.CANONICAL))
    found = timestamps.normalise_timestamps(other.distinct())
    return found.filter("utc_second is not null").select("src", "rec_id", "chart", "utc_second").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 4: continuous periods and the gaps between them."""
    return intervals.coverage_periods(read(spark, d, "audio_spans"), read(spark, d, "window_targets"))


QUERIES = {f.__name__: f for f in (p1_found, p4_found)}

_MON = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
_DAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,?\s+)?"
_CLK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?:\s*([AaPp])[Mm]\b)?"
#: Notations as DuckDB reads them: pattern, and the places of year, month, day, hour, minute, second, half, zone.
_NOTATIONS = (
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[T ]{_CLK}\s*(.*?))?$", r"\1|\2|\3|\4|\5|\6|\7|\8"),
    (r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})(Z?)$", r"\1|\2|\3|\4|\5|\6||\7"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {_CLK}$", r"\3|\1|\2|\4|\5|\6|\7|"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}) {_CLK}$", r"\3|\2|\1|\4|\5|\6|\7|"),
    (rf"^{_DAY}(\d{{1,2}}) {_MON} (\d{{2,4}})(?: {_CLK}\s*(.*?))?$", r"\3|\2|\1|\4|\5|\6|\7|\8"),
    (rf"^{_MON} (\d{{1,2}}), (\d{{4}}) {_CLK}\s*(.*?)$", r"\3|\1|\2|\4|\5|\6|\7|\8"),
    (rf"^{_DAY}{_MON} (\d{{1,2}}) {_CLK} (\d{{4}})$", r"\7|\1|\2|\3|\4|\5|\6|"),
)


def instants_sql(rows: str, keys: str) -> str:
    """CTEs that end in ``instants`` ({keys}, u): the same instants by another road, strptime and DuckDB's own time zones.

    ``rows`` selects the key columns, raw and zone.
    """
    case = " ".join(f"when regexp_matches(t, '{p}') then regexp_replace(t, '{p}', '{r}')" for p, r in _NOTATIONS)
    abb = ", ".join(f"('{k}', {v})" for k, v in timestamps.ABBREVIATIONS.items())
    return rf"""
rows as ({rows}),
cand as (select *, regexp_replace(raw, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') as t from rows where raw is not null),
epoch as (select {keys}, case length(t) when 10 then try_cast(t as bigint) when 13 then try_cast(t as bigint) // 1000 end as u from cand where regexp_full_match(t, '\d{{10}}|\d{{13}}')),
fields as (select {keys}, zone, string_split(case {case} end, '|') as f from cand where not regexp_full_match(t, '\d{{10}}|\d{{13}}')),
parts as (select *, case when length(f[1]) = 2 then '20' || f[1] else f[1] end as y, case when regexp_full_match(f[2], '\d+') then try_cast(f[2] as int) else (instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(left(f[2], 3))) + 2) // 3 end as mo,
  try_cast(f[3] as int) as d, coalesce(try_cast(f[4] as int), 0) as h0, coalesce(try_cast(f[5] as int), 0) as mi, coalesce(try_cast(f[6] as int), 0) as s, lower(f[7]) as half, trim(f[8]) as z from fields where f is not null),
clock as (select *, case when half = '' then h0 when h0 between 1 and 12 then h0 % 12 + case when half = 'p' then 12 else 0 end else 99 end as h from parts),
local as (select *, try_strptime(format('{{}}-{{:02d}}-{{:02d}} {{:02d}}:{{:02d}}:{{:02d}}', y, mo, d, h, mi, s), '%Y-%m-%d %H:%M:%S') as l from clock),
abb(a, m) as (values {abb}),
offs as (select local.*, regexp_extract(z, '^(?:UTC|GMT)?([+-]\d{{2}}:?\d{{2}})', 1) as o, abb.m, regexp_extract(z, '([A-Z][A-Za-z]+/[A-Za-z_]+)', 1) as region from local left join abb on abb.a = upper(regexp_replace(z, '[\[\]]', '', 'g')) where l is not null),
named as (select *, case when z = '' then zone when o = '' and m is null and region <> '' then region end as tz, case when o <> '' then (try_cast(o[2:3] as int) * 60 + try_cast(right(o, 2) as int)) * case o[1] when '-' then -1 else 1 end else m end as off from offs),
inst as (select {keys}, l, tz, off, case when tz is not null then timezone(tz, l) end as w from named),
civil as (select {keys}, case when tz is not null then epoch(case when timezone(tz, w - interval 1 hour) = l then w - interval 1 hour else w end)::bigint when off is not null then epoch(l)::bigint - off * 60 end as u from inst),
instants as (select distinct {keys}, u from (select * from epoch union all select * from civil) where u is not null)"""


def _p1_sql() -> str:
    rows = r"""select * from (select 'episodes' as src, id as rec_id, '' as chart, published_date as raw, coalesce(h.time_zone, 'UTC') as zone from episodes e left join feed_hosts h using (feed_host)
  union select 'podcast_charts', podcast_id, chart, first_seen_at, 'UTC' from podcast_charts) where not regexp_full_match(raw, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z')"""
    return f"with {instants_sql(rows, 'src, rec_id, chart')} select src, rec_id, chart, u as utc_second from instants"


ORACLE = {
    "p1_found": _p1_sql(),
    "p4_found": """
with raw as (
  select span_kind as src, cast(episode_id as varchar) as entity, cast(round(start_s * 1000) as bigint) as s, cast(round(end_s * 1000) as bigint) as e
  from audio_spans where episode_id is not null and span_kind in ('omitted', 'speech') and not isnan(start_s) and not isnan(end_s)
  union all
  select 'window', entity, date_diff('day', date '1970-01-01', try_cast(left(trim(win_start), 10) as date)), date_diff('day', date '1970-01-01', try_cast(left(trim(win_end), 10) as date))
  from window_targets where entity is not null),
ok as (select distinct src, entity, s, e from raw where s is not null and e is not null and e > s),
m as (select *, max(e) over (partition by src, entity order by s, e rows between unbounded preceding and 1 preceding) as before from ok),
i as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by src, entity order by s, e rows unbounded preceding) as k from m),
p as (select src, entity, k, min(s) as s, max(e) as e from i group by src, entity, k),
g as (select src, entity, lag(e) over (partition by src, entity order by k) as s, s as e from p)
select src, entity, 'period' as piece, s as start_at, e as end_at from p
union all select src, entity, 'gap', s, e from g where s is not null""",
}
