"""Catalog and study operators: links, windows, selection, second airings, membership, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auralake.functions.scalar import has_rerun_marker, leading_number, norm_title, title_key, title_numbers
from auralake.operators.scan import CHUNK, HOT_ROWS, assign_chunks, running
from auralake.operators.timestamps import CANONICAL, normalise_timestamps
from auralake.session import broadcast_if_small


def day_of(c: Column | str) -> Column:
    """The day of an ISO text (its first 10 characters), null if it is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(F.substring(F.trim(c), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def with_days(episodes: DataFrame, hosts: DataFrame) -> DataFrame:
    """Add ``day``, the UTC day of the instant that ``published_date`` denotes (problem 1, with the zone of ``feed_host``).

    A day without a time is that day in any zone. Text that denotes no instant
    keeps the day it begins with, if any. Canonical text needs no dictionary.
    """
    zones = broadcast_if_small(hosts.groupBy("feed_host").agg(F.min("time_zone").alias("__host")))
    date = F.col("published_date")
    timed = date.contains(":") | date.rlike(r"\d{8}[Tt ]?\d{6}")
    rows = episodes.join(zones, "feed_host", "left").withColumns({"raw": F.when(~date.rlike(CANONICAL), date), "zone": F.when(timed, F.col("__host"))})
    written = F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}"), day_of("published_date"))
    day = F.date_from_unix_date(F.floor(F.col("utc_second") / 86400).cast("int"))
    return normalise_timestamps(rows).withColumn("day", F.coalesce(day, written)).select(*episodes.columns, "day")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order`` (the view over an append log that an upsert gives)."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return top.select(*keys, "r.*").select(*df.columns)


def append_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows and those incoming ones whose key is new, one of each (INSERT OR IGNORE)."""
    fresh = incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh)


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace existing ones of the same key."""
    return existing.join(incoming.select(*keys), list(keys), "left_anti").unionByName(incoming)


def membership_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], state: Sequence[str]) -> DataFrame:
    """(keys, change): added, removed or changed members of a revision; equal ones are left out.

    States are compared null-safely, whatever the order of rows.
    """
    h = lambda df: df.select(*keys, F.struct(*state).alias("s"))
    both = h(old).withColumnRenamed("s", "o").join(h(new).withColumnRenamed("s", "n"), list(keys), "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return both.select(*keys, change.alias("change")).filter("change is not null")


def episodes_in_windows(episodes: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs of a window and an episode of its entity with start <= day < end.

    Both sides meet on (entity, month): windows are exploded over the months
    they touch, so there is no nested loop; the pair is unique as a day has one month.
    """
    w = windows.filter("win_start < win_end").withColumn("m", F.explode(F.expr("sequence(trunc(win_start, 'month'), trunc(date_sub(win_end, 1), 'month'), interval 1 month)")))
    e = episodes.filter("day is not null").withColumn("m", F.trunc("day", "month"))
    return w.join(e, ["entity", "m"]).filter("day >= win_start and day < win_end").drop("m")


def window_coverage(windows: DataFrame, episodes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Per window the episodes in it and those with a transcript; windows without any stay."""
    hit = episodes_in_windows(episodes, windows).join(transcripts.select("episode_id").distinct().withColumn("done", F.lit(1)), "episode_id", "left")
    keys = ["study", "entity", "win_start", "win_end"]
    agg = hit.groupBy(*keys).agg(F.countDistinct("episode_id").alias("n_episodes"), F.countDistinct(F.when(F.col("done") == 1, F.col("episode_id"))).alias("n_done"))
    return windows.select(*keys).distinct().join(agg, keys, "left").na.fill(0, ["n_episodes", "n_done"])


def coverage_by_study(cov: DataFrame) -> DataFrame:
    """Per study windows, those filled and those with a transcript, mean episodes."""
    return cov.groupBy("study").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("n_episodes") > 0).alias("filled"), F.count_if(F.col("n_done") > 0).alias("transcribed"), F.round(F.avg("n_episodes"), 6).alias("mean_episodes"))


def shared_members(members: DataFrame, key: str, group: str) -> DataFrame:
    """Per pair of groups (a < b) the members in both. A member's groups are few, so pairs are built per member."""
    g = members.filter(F.col(group).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(group)).alias("g")).filter(F.size("g") > 1)
    pairs = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, F.size("g")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return g.select(key, F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def same_title_copies(episodes: DataFrame) -> DataFrame:
    """(id, first_id, reason): episodes that air the earliest episode of their show and normalised title again.

    The earliest of each title (6 characters and more; ordered by day, id) is the
    reference. A copy carries a marker of a second airing that the reference has
    not, or has equal title numbers and a duration within 2 seconds, or within
    max(5 s, 1 %) over 90 days later. Unknown durations match nothing.
    """
    e = episodes.filter("day is not null and podcast_id is not null").select("id", "podcast_id", "title", "day", "duration_seconds", norm_title("title").alias("norm")).filter(F.length("norm") >= 6)
    first = e.groupBy("podcast_id", "norm").agg(F.min(F.struct("day", "id", "title", "duration_seconds")).alias("f"))
    j = e.join(first, ["podcast_id", "norm"]).filter("id <> f.id")
    d1, d2 = F.col("f.duration_seconds"), F.col("duration_seconds")
    known = (d1 > 0) & (d2 > 0)
    diff = F.abs(d1 - d2)
    same = known & ((diff <= 2) | ((diff <= F.greatest(F.lit(5.0), 0.01 * F.greatest(d1, d2))) & (F.date_diff("day", F.col("f.day")) > 90)))
    marker = has_rerun_marker("title") & ~has_rerun_marker(F.col("f.title"))
    numbers = title_numbers("title") == title_numbers(F.col("f.title"))
    reason = F.when(marker, "marker").when(numbers & same, "duration")
    return j.select("id", F.col("f.id").alias("first_id"), reason.alias("reason")).filter("reason is not null")


def old_numbers(episodes: DataFrame, gap: int = 15, least: int = 50) -> DataFrame:
    """(id, number, reached): leading episode numbers far below what the show had reached by that day.

    Numbers are first reduced to the greatest per (show, day); the running
    maximum runs over days, so a frame by day and never by rows.
    """
    e = episodes.filter("day is not null and podcast_id is not null").select("id", "podcast_id", "day", leading_number("title").alias("number"))
    per_day = e.groupBy("podcast_id", "day").agg(F.max("number").alias("m"))
    w = W.partitionBy("podcast_id").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    top = per_day.withColumn("reached", F.max("m").over(w)).drop("m")
    return e.filter("number is not null").join(top, ["podcast_id", "day"]).filter((F.col("reached") >= least) & (F.col("number") < F.col("reached") - gap)).select("id", "number", "reached")


def rerun_of_earlier(episodes: DataFrame, min_days: int = 7, min_seconds: int = 600) -> DataFrame:
    """(id, first_id): episodes whose recording their own show published over ``min_days`` earlier under a containing title.

    Durations within max(5 s, 1 %) meet through bands of a 1 % logarithmic
    scale: a record probes its band and the next ones, an equi-join by (show,
    band). Titles need 12 characters, equal numbers, and one must contain the
    other; the earliest such episode is given.
    """
    band = F.floor(F.log("duration_seconds") / F.lit(0.0101)).cast("int")
    e = episodes.filter(F.col("day").isNotNull() & (F.col("duration_seconds") > min_seconds)).select("id", "podcast_id", "title", "day", "duration_seconds", norm_title("title").alias("norm"), band.alias("band")).filter(F.length("norm") >= 12)
    probe = e.withColumn("band", F.explode(F.sequence(F.col("band") - 2, F.col("band") + 2))).alias("x")
    r = e.alias("r")
    d = F.col("x.duration_seconds")
    fits = (
        (F.col("r.day") < F.date_sub("x.day", min_days))
        & (F.abs(F.col("r.duration_seconds") - d) <= F.greatest(F.lit(5), F.floor(0.01 * d)))
        & (F.col("x.norm").contains(F.col("r.norm")) | F.col("r.norm").contains(F.col("x.norm")))
        & (title_numbers(F.col("x.title")) == title_numbers(F.col("r.title")))
        & ((F.col("r.norm") != F.col("x.norm")) | (F.abs(F.col("r.duration_seconds") - d) <= 2) | (has_rerun_marker(F.col("x.title")) & ~has_rerun_marker(F.col("r.title"))))
    )
    hit = probe.join(r, [F.col("x.podcast_id") == F.col("r.podcast_id"), F.col("x.band") == F.col("r.band")]).filter(fits)
    return hit.groupBy(F.col("x.id").alias("id")).agg(F.min_by("r.id", F.struct("r.day", "r.id")).alias("first_id"))


def day_copies(episodes: DataFrame) -> DataFrame:
    """W19 (same-day rule): one row per (show, title key, day): the least id and the number of copies; episodes without a day or key stay alone."""
    e = episodes.select("id", "podcast_id", "day", title_key("title").alias("key"))
    alone = F.when(F.col("day").isNull() | F.col("key").isNull(), F.col("id"))
    return e.groupBy("podcast_id", "day", "key", alone.alias("__a")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("podcast_id", "day", "key", "id", "copies")


def publishing_gaps(episodes: DataFrame, min_days: int = 28) -> DataFrame:
    """Per show the stretches of at least ``min_days`` without an episode, with its median cadence.

    (entity, gap_start, gap_end, days, cadence). Days are reduced to distinct
    ones first; a show's days are bounded by the calendar.
    """
    days = episodes.filter("day is not null").select("entity", "day").distinct()
    w = W.partitionBy("entity").orderBy("day")
    g = days.withColumn("prev", F.lag("day").over(w)).withColumn("days", F.date_diff("day", "prev")).filter("prev is not null")
    cadence = g.groupBy("entity").agg(F.median("days").alias("cadence"))
    return g.filter(F.col("days") >= min_days).join(cadence, "entity").select("entity", F.col("prev").alias("gap_start"), F.col("day").alias("gap_end"), "days", "cadence")


# Fixed values of W22: junk dates lie before EARLIEST_DAY; days around a window that count as near, and behind the first episode that count as its launch; the day of rank ISOLATED_RANK over ISOLATED_DAYS behind the first marks the first as isolated.
EARLIEST_DAY, NEAR_DAYS, LAUNCH_DAYS, ISOLATED_RANK, ISOLATED_DAYS = "1995-01-01", 92, 14, 4, 365
_LAUNCH = (
    r"(?i)\b(trailer|teaser|introducing|coming soon|sneak (peek|preview)|welcome to|pilot)\b"
    r"|\b(episode|ep\.?|chapter)\s*#?0*[01]\b|^\s*#?0*1\s*[:.)\-|]|\bs0*1\s*:?\s*e0*1\b"
)
_NUMBER = r"(?i)\b(?:episode|ep|no)\.?\s*#?\s*(\d{1,4})\b|(?:^|\s)#(\d{1,4})\b"
_SEASON = r"(?i)\b(?:season\s*|s)(\d{1,2})\s*[:,]?\s*(?:e|ep\b|episode\b)"


def start_evidence(episodes: DataFrame) -> DataFrame:
    """(entity, launch, truncated): what its first episodes say of an entity's start.

    launch: one of the first two weeks is a trailer, is number 0 or 1 (of season
    0 or 1, or none), or reads as a launch. truncated: they are numbered from
    above 1, of a season above 1, or the fifth day is over a year behind the first.
    """
    e = episodes.filter(F.col("day") >= F.lit(EARLIEST_DAY).cast("date")).withColumn("first", F.min("day").over(W.partitionBy("entity")))
    title = F.coalesce(F.col("title"), F.lit(""))
    number = F.coalesce(F.regexp_extract(title, _NUMBER, 1).try_cast("int"), F.regexp_extract(title, _NUMBER, 2).try_cast("int"))
    season = F.regexp_extract(title, _SEASON, 1).try_cast("int")
    marked = (F.lower(F.coalesce("episode_type", F.lit(""))) == "trailer") | (number.isin(0, 1) & F.coalesce(season <= 1, F.lit(True))) | title.rlike(_LAUNCH)
    early = e.filter(F.col("day") <= F.date_add("first", LAUNCH_DAYS)).groupBy("entity").agg(F.max(F.coalesce(marked, F.lit(False))).alias("launch"), (F.coalesce(F.min(number) > 1, F.lit(False)) | F.coalesce(F.min(season) > 1, F.lit(False))).alias("late"))
    place = F.row_number().over(W.partitionBy("entity").orderBy("day", "id"))
    apart = e.select("entity", "id", "day", "first", place.alias("n")).filter(F.col("n") == ISOLATED_RANK + 1).select("entity", (F.date_diff("day", "first") > ISOLATED_DAYS).alias("apart"))
    return early.join(apart, "entity", "left").select("entity", "launch", (F.col("late") | F.coalesce("apart", F.lit(False))).alias("truncated"))


def classify_windows(cov: DataFrame, episodes: DataFrame, listings: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """(study, entity, win_start, win_end, verdict) of windows: filled, launch, missing, not_publishing, before_launch, unknown.

    By precedence: a window with episodes whose entity is known before it is
    filled. A listing that spans a window accounts for it: filled or
    not_publishing. The window before the first known day, or around it, is
    missing if the feed drops items (truncated, or a listing that skips episodes
    at hand), else launch or before_launch if the first episode is marked as a
    start, else unknown. A later window is missing if there are episodes within
    ``NEAR_DAYS`` on both sides, or on both sides and the feed is truncated.

    listings: entity, oldest, read (days), n_items (null if unknown). evidence:
    entity, launch, truncated, and manual where the entity's link is one made by
    hand (such a one is never before its launch). Without them a listing covers
    nothing and no start is marked. An entity's days are bounded by the calendar.
    """
    spark = cov.sparkSession
    if listings is None:
        listings = spark.createDataFrame([], "entity string, oldest date, read date, n_items long")
    if evidence is None:
        evidence = spark.createDataFrame([], "entity string, launch boolean, truncated boolean")
    if "manual" not in evidence.columns:
        evidence = evidence.withColumn("manual", F.lit(False))
    held = episodes.filter(F.col("day") >= F.lit(EARLIEST_DAY).cast("date")).groupBy("entity").agg(F.array_sort(F.collect_set("day")).alias("days"))
    read = listings.join(held, "entity", "left").withColumn("n_held", F.size(F.filter(F.coalesce("days", F.array().cast("array<date>")), lambda x: (x >= F.col("oldest")) & (x <= F.col("read")))))
    read = read.withColumn("skips", F.coalesce(F.col("n_held") > F.col("n_items") * 1.1 + 2, F.lit(False)))
    before = F.max("read").over(W.partitionBy("entity").orderBy("oldest", "read").rowsBetween(W.unboundedPreceding, -1))
    runs = read.filter("not skips").withColumn("new", F.when(F.col("oldest") <= F.date_add(before, 1), 0).otherwise(1))
    runs = runs.withColumn("k", F.sum("new").over(W.partitionBy("entity").orderBy("oldest", "read").rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy("entity", "k").agg(F.min("oldest").alias("oldest"), F.max("read").alias("read")).groupBy("entity").agg(F.collect_list(F.struct("oldest", "read")).alias("spans"))
    seen = read.groupBy("entity").agg(F.min("oldest").alias("listed"), F.max("skips").alias("skips"))
    j = cov.join(held, "entity", "left").join(spans, "entity", "left").join(seen, "entity", "left").join(evidence.groupBy("entity").agg(*[F.max(c).alias(c) for c in ("launch", "truncated", "manual")]), "entity", "left")
    start, end, yes = F.col("win_start"), F.col("win_end"), lambda c: F.coalesce(c, F.lit(False))
    j = j.withColumns({
        "first": F.least(F.col("days")[0], F.col("listed")),
        "covered": yes(F.exists("spans", lambda x: (x["oldest"] <= start) & (end <= F.date_add(x["read"], 1)))),
        "prev": F.array_max(F.filter("days", lambda x: x < start)),
        "next": F.array_min(F.filter("days", lambda x: x >= end)),
    })
    some = F.col("n_episodes") > 0
    near = (F.date_diff(start, "prev") <= NEAR_DAYS) & (F.date_diff("next", end) <= NEAR_DAYS)
    both = F.col("prev").isNotNull() & F.col("next").isNotNull()
    verdict = (
        F.when(some & yes(F.col("first") <= start), "filled").when(F.col("first").isNull(), "unknown")
        .when(F.col("covered"), F.when(some, "filled").otherwise("not_publishing"))
        .when(
            (F.col("first") >= end) | some,
            F.when(yes(F.col("truncated")) | yes(F.col("skips")), "missing").when(yes(F.col("launch")), F.when(some, "launch").when(yes(F.col("manual")), "unknown").otherwise("before_launch")).otherwise("unknown"),
        )
        .when(both & (near | yes(F.col("truncated"))), "missing").otherwise("unknown")
    )
    return j.select("study", "entity", "win_start", "win_end", verdict.alias("verdict"))


def pick_captures(captures: DataFrame, keys: Sequence[str], at: str, origin: str, bucket_days: int = 7) -> DataFrame:
    """The earliest capture per key and bucket of days counted from ``origin``."""
    b = F.floor(F.date_diff(F.to_date(at), F.lit(origin).cast("date")) / bucket_days)
    return captures.withColumn("bucket", b).groupBy(*keys, "bucket").agg(F.min(at).alias(at))


def resolve_links(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Podcast of an entity by precedence: its own id, a manual link (even to nothing), the least catalog id of its store id.

    rows: entity, direct_id, store_podcast_id; links: entity, podcast_id (null
    where a person ruled the link out).
    """
    l = links.select("entity", F.col("podcast_id").alias("__l"), F.lit(True).alias("__ruled"))
    j = rows.join(l, "entity", "left")
    return j.withColumn("podcast_id", F.when(F.col("direct_id").isNotNull(), F.col("direct_id")).when(F.col("__ruled"), F.col("__l")).otherwise(F.col("store_podcast_id"))).drop("__l", "__ruled")


def unique_key_lookup(rows: DataFrame, index: DataFrame, key: str, value: str) -> DataFrame:
    """The value of a key that has exactly one in the index, else null."""
    one = index.filter(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(value).alias("__n"), F.min(value).alias(value)).filter("__n = 1").drop("__n")
    return rows.join(one, key, "left")


def first_seen_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Running number of rows per key in ``order`` (in chunks for hot keys)."""
    cut, chunked = assign_chunks(df, keys, order[0], hot_rows)
    return running(cut, keys, order, {"position": ("sum", F.lit(1), True)}, chunked).drop(CHUNK)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of each condition that rows must hold; null counts as a violation. One pass."""
    agg = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return agg.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])))
