"""Ranked-list time series: coherent daily snapshots, exposure, coverage, turnover, agreement, monthly lists.

Series hold one row per (series, day, entity) with a rank. Windows run over a
series' days, whose number is bounded by the calendar, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auralake.functions.scalar import gap_label, jaccard


def select_daily(captures: DataFrame, keys: Sequence[str], tolerance_seconds: int = 3600, depth: int = 100) -> DataFrame:
    """The best coherent snapshot per (keys, UTC day).

    Needs archive, path, page, captured_at, rank. A capture of the lowest page
    anchors a candidate; of each other page the nearest capture of the same
    archive within the tolerance joins it. A rank on two pages is the lower
    page's. The candidate with most ranks within ``depth``, then most rows, then
    the earliest (time, archive, path) wins. Null keys group together.
    """
    day = [*keys, "__day"]
    rows = captures.withColumns({"__day": F.to_date("captured_at"), "__arch": F.coalesce(F.col("archive"), F.lit("")), "__page": F.coalesce(F.col("page"), F.lit(1))})
    caps = rows.groupBy(*day, "__arch", "path", "__page").agg(F.min("captured_at").alias("at"))
    caps = caps.withColumn("__low", F.min("__page").over(W.partitionBy(*day)))
    eq = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in day]
    anchors = caps.filter(F.col("__page") == F.col("__low")).alias("a")
    gap = F.abs(F.unix_micros("b.at") - F.unix_micros("a.at"))
    own = (F.col("b.path") == F.col("a.path")) & (F.col("b.__page") == F.col("a.__page"))
    paired = anchors.join(caps.alias("b"), [*eq, F.col("a.__arch") == F.col("b.__arch"), own | (F.col("b.__page") != F.col("a.__page")) & (gap <= tolerance_seconds * 1_000_000)])
    paired = paired.select(*[F.col(f"a.{k}").alias(k) for k in day], F.col("a.__arch").alias("__arch"), F.col("a.path").alias("a_path"), F.col("a.at").alias("a_at"), F.col("b.path").alias("path"), F.col("b.__page").alias("__page"), F.col("b.at").alias("b_at"), gap.alias("gap"))
    one = W.partitionBy(*day, "__arch", "a_path", "__page").orderBy("gap", "b_at", "path")
    pages = paired.withColumn("__n", F.row_number().over(one)).filter("__n = 1").drop("__n", "gap", "b_at")
    p, r = pages.alias("p"), rows.alias("r")
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"r.{k}")) for k in day] + [F.col("p.__arch") == F.col("r.__arch"), F.col("p.path") == F.col("r.path"), F.col("p.__page") == F.col("r.__page")]
    cand = p.join(r, on).select("r.*", "a_path", "a_at")
    first = W.partitionBy(*day, "__arch", "a_path", "rank").orderBy("__page", "captured_at", "path")
    cand = cand.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    score = cand.groupBy(*day, "__arch", "a_path", "a_at").agg(F.count_if(F.col("rank").between(1, depth)).alias("full"), F.count(F.lit(1)).alias("n"))
    best = W.partitionBy(*day).orderBy(F.desc("full"), F.desc("n"), "a_at", "__arch", "a_path")
    won = score.withColumn("__n", F.row_number().over(best)).filter("__n = 1").select(*day, "__arch", "a_path")
    c, w = cand.alias("c"), won.alias("w")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}")) for k in day] + [F.col("c.__arch") == F.col("w.__arch"), F.col("c.a_path") == F.col("w.a_path")]
    return c.join(w, on, "left_semi").drop("__day", "__arch", "__page", "a_path", "a_at")


def profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A1: rows, days, entities, first and last day, deepest rank per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("day").alias("days"), F.countDistinct("entity").alias("entities"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.max("rank").alias("deepest"))


def daily_depth(df: DataFrame, depth: int, share: float = 0.95) -> DataFrame:
    """A2: (series, day, depth, n_ranks, is_full): ranks within ``depth`` and whether nearly all are there."""
    in_depth = F.when(F.col("rank") <= depth, F.col("rank"))
    agg = df.groupBy("series", "day").agg(F.max("rank").alias("depth"), F.countDistinct(in_depth).alias("n_ranks"))
    return agg.withColumn("is_full", F.col("n_ranks") >= share * depth)


def coverage(daily: DataFrame) -> DataFrame:
    """A2: per series days, full days, median depth, months spanned, months with a day and their share."""
    month = F.trunc("day", "month")
    agg = daily.groupBy("series").agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.col("is_full")).alias("full_days"), F.median("depth").alias("median_depth"),
        F.countDistinct(month).alias("months"), (F.months_between(F.max(month), F.min(month)) + 1).cast("int").alias("span_months"),
    )
    return agg.withColumn("fill_pct", F.round(100 * F.col("months") / F.col("span_months"), 1))


def gap_statistics(days: DataFrame) -> DataFrame:
    """A3: median, 90th percentile (interpolated) and greatest number of days between a series' snapshot days."""
    w = W.partitionBy("series").orderBy("day")
    gaps = days.select("series", "day").distinct().withColumn("gap", F.date_diff("day", F.lag("day").over(w))).filter("gap is not null")
    return gaps.groupBy("series").agg(F.median("gap").alias("median_gap"), F.percentile("gap", 0.9).alias("p90_gap"), F.max("gap").alias("max_gap"))


def midpoint_weights(days: DataFrame) -> DataFrame:
    """(series, day, weight): half the days to either neighbour; the ends stop at their day, so weights sum to the span."""
    w = W.partitionBy("series").orderBy("day")
    lo, hi = F.coalesce(F.lag("day").over(w), F.col("day")), F.coalesce(F.lead("day").over(w), F.col("day"))
    return days.select("series", "day").distinct().withColumn("weight", F.date_diff(hi, lo) / F.lit(2.0))


def snapshot_cells(days: DataFrame) -> DataFrame:
    """(series, day, lo_hour, hi_hour) in hours since 1970: a day's share of time around its noon; the ends reach half a day outward."""
    w = W.partitionBy("series").orderBy("day")
    t = F.unix_date("day") * 24.0 + 12.0
    d = days.select("series", "day").distinct().withColumn("t", t)
    lo = F.coalesce((F.lag("t").over(w) + F.col("t")) / 2, F.col("t") - 12)
    hi = F.coalesce((F.lead("t").over(w) + F.col("t")) / 2, F.col("t") + 12)
    return d.select("series", "day", lo.alias("lo_hour"), hi.alias("hi_hour"))


def periodic_lists(obs: DataFrame, depth: int, period: str = "month", top: int | None = None) -> DataFrame:
    """Time-weighted ranked list per series and period (month or week).

    Points of an entity are the days of its snapshots' cells inside the period
    times (depth + 1 - rank). Cells meet periods through the sequence of period
    starts they touch. Periods that end after the last cell are left out. Ranked
    by points, best rank, entity.
    """
    best = obs.filter(F.col("rank") <= depth).groupBy("series", "day", "entity").agg(F.min("rank").alias("rank"))
    cells = snapshot_cells(obs)
    hour = lambda c: F.unix_date(c) * 24.0
    first = F.trunc(F.date_from_unix_date(F.floor(F.col("lo_hour") / 24).cast("int")), period)
    last = F.trunc(F.date_from_unix_date(F.floor(F.col("hi_hour") / 24).cast("int")), period)
    step = F.expr(f"interval 1 {period}")
    c = cells.withColumn("p_start", F.explode(F.sequence(first, last, step))).withColumn("p_end", (F.col("p_start") + step).cast("date"))
    c = c.withColumn("hours", F.least("hi_hour", hour("p_end")) - F.greatest("lo_hour", hour("p_start"))).filter("hours > 0")
    ends = cells.groupBy("series").agg(F.max("hi_hour").alias("end_hour"))
    c = c.join(ends, "series").filter(hour("p_end") <= F.col("end_hour"))
    inside = (F.col("day") >= F.col("p_start")) & (F.col("day") < F.col("p_end"))
    info = c.groupBy("series", "p_start", "p_end").agg(F.count_if(inside).alias("snapshots_in_period"), F.sum(F.when(inside, F.col("hours")).otherwise(0.0)).alias("own_hours"))
    pts = c.join(best, ["series", "day"]).groupBy("series", "p_start", "entity").agg(F.sum(F.col("hours") / 24 * (depth + 1 - F.col("rank"))).alias("points"), F.min("rank").alias("best_rank"))
    w = W.partitionBy("series", "p_start").orderBy(F.desc(F.round("points", 6)), "best_rank", "entity")
    ranked = pts.withColumn("period_rank", F.row_number().over(w)).filter(F.col("period_rank") <= (top or depth))
    out = ranked.join(info, ["series", "p_start"])
    days = F.date_diff("p_end", "p_start")
    return out.select("series", "p_start", "entity", "period_rank", F.round("points", 2).alias("points"), F.round(F.col("points") / days, 3).alias("mean_points"), "best_rank", "snapshots_in_period", F.round(F.col("own_hours") / (days * 24), 3).alias("coverage"))


def best_source_per_day(daily: DataFrame, preference: Sequence[str]) -> DataFrame:
    """Per day the full series that stands first in ``preference``; others are not used."""
    order = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("series"))
    w = W.partitionBy("day").orderBy("p")
    return daily.filter("is_full").withColumn("p", order).filter("p > 0").withColumn("n", F.row_number().over(w)).filter("n = 1").select("day", "series", "depth")


def complete_to(df: DataFrame) -> DataFrame:
    """(series, day, n_entries, complete_to): the greatest N with all ranks 1..N present."""
    w = W.partitionBy("series", "day").orderBy("rank")
    ranks = df.select("series", "day", "rank").distinct().withColumn("pos", F.row_number().over(w))
    n = df.groupBy("series", "day").agg(F.count(F.lit(1)).alias("n_entries"))
    return n.join(ranks.groupBy("series", "day").agg(F.count_if(F.col("rank") == F.col("pos")).alias("complete_to")), ["series", "day"])


def daily_entities(df: DataFrame, depth: int, share: float = 0.95) -> DataFrame:
    """Best rank per (series, day, entity) within depth, only of days nearly complete."""
    best = df.filter((F.col("rank") <= depth) & F.col("entity").isNotNull()).groupBy("series", "day", "entity").agg(F.min("rank").alias("rank"))
    full = best.groupBy("series", "day").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= share * depth)
    return best.join(full.select("series", "day"), ["series", "day"], "left_semi")


# Bands of ranks whose retention is told apart.
BANDS = ((1, 10), (11, 50), (51, 100))


def turnover(entities: DataFrame, max_gap: int = 100) -> DataFrame:
    """Per series and bin of days between two snapshots: pairs, and medians of Jaccard, retention, rank move and retention by band.

    A pair's move is the median of its shared entities' rank moves, null below 5
    shared; its retention of a band is the share of the earlier day's entities
    within the band that the later day has, null where the band is empty. Each
    day's entities are one array (bounded by the depth of a chart); days meet
    through the offsets 1..max_gap, an equi-join instead of all pairs.
    """
    sets = entities.groupBy("series", "day").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("entity", "rank")))).alias("m")).withColumn("s", F.array_sort(F.map_keys("m")))
    later = sets.select("series", F.explode(F.sequence(F.lit(1), F.lit(max_gap))).alias("days"), F.col("day").alias("later"), F.col("s").alias("s2"), F.col("m").alias("m2"))
    later = later.withColumn("day", F.date_sub("later", F.col("days")))
    pairs = sets.join(later, ["series", "day"]).withColumn("gap", gap_label(F.col("days"))).filter("gap is not null")
    pairs = pairs.withColumn("both", F.array_intersect("s", "s2"))
    moves = F.array_sort(F.transform("both", lambda k: F.abs(F.element_at("m", k) - F.element_at("m2", k)).cast("double")))
    pairs = pairs.withColumn("moves", moves)
    n = F.size("moves")
    move = F.when(n >= 5, (F.element_at("moves", F.floor((n + 1) / 2).cast("int")) + F.element_at("moves", F.floor(n / 2).cast("int") + 1)) / 2)

    def retained(lo: int, hi: int) -> Column:
        within = lambda keys: F.size(F.filter(keys, lambda k: F.element_at("m", k).between(lo, hi)))
        return F.when(within("s") > 0, within("both") / within("s"))

    bands = {f"retain_{lo}_{hi}": retained(lo, hi) for lo, hi in BANDS}
    pairs = pairs.select("series", "gap", jaccard(F.col("s"), F.col("s2")).alias("j"), (F.size("both") / F.size("s")).alias("r"), move.alias("move"), *[c.alias(b) for b, c in bands.items()])
    medians = {"median_jaccard": "j", "median_retention": "r", "median_move": "move"} | {b: b for b in bands}
    return pairs.groupBy("series", "gap").agg(F.count(F.lit(1)).alias("pairs"), *[F.round(F.median(c), 6).alias(b) for b, c in medians.items()])


def month_coverage(entities: DataFrame, min_days: int = 4) -> DataFrame:
    """Per series and month with enough snapshots: entities seen, median share a single day shows, Jaccard of first and last day."""
    e = entities.withColumn("month", F.trunc("day", "month"))
    per_day = e.groupBy("series", "month", "day").agg(F.array_sort(F.collect_set("entity")).alias("s"))
    union = e.groupBy("series", "month").agg(F.countDistinct("entity").alias("entities"), F.countDistinct("day").alias("snapshots"))
    d = per_day.join(union.filter(F.col("snapshots") >= min_days), ["series", "month"])
    return d.groupBy("series", "month").agg(
        F.max("snapshots").alias("snapshots"), F.max("entities").alias("entities"), F.round(F.median(F.size("s") / F.col("entities")), 6).alias("median_single_coverage"),
        F.round(jaccard(F.min_by("s", "day"), F.max_by("s", "day")), 6).alias("first_last_jaccard"),
    )


def agreement(entities: DataFrame, a: str, b: str, tolerance: int = 1) -> DataFrame:
    """Per day of series ``a`` the nearest day of ``b`` within the tolerance (of two equally near the earlier): overlap, Jaccard, Spearman.

    Spearman needs 5 shared entities; it is the correlation of ranks among the shared ones.
    """
    x = entities.filter(F.col("series") == a).select(F.col("day").alias("day_a"), "entity", F.col("rank").alias("ra"))
    y = entities.filter(F.col("series") == b).select(F.col("day").alias("day_b"), "entity", F.col("rank").alias("rb"))
    near = x.select("day_a").distinct().withColumn("day_b", F.explode(F.expr(f"sequence(date_sub(day_a, {tolerance}), date_add(day_a, {tolerance}))")))
    near = near.join(y.select("day_b").distinct(), "day_b")
    w = W.partitionBy("day_a").orderBy(F.abs(F.date_diff("day_b", "day_a")), "day_b")
    days = near.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    na = x.groupBy("day_a").agg(F.count(F.lit(1)).alias("n_a"))
    nb = y.groupBy("day_b").agg(F.count(F.lit(1)).alias("n_b"))
    shared = days.join(x, "day_a").join(y, ["day_b", "entity"])
    avg_rank = lambda c: F.rank().over(W.partitionBy("day_a").orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy("day_a", c)) - 1) / 2
    ranked = shared.withColumns({"pa": avg_rank("ra"), "pb": avg_rank("rb")})
    agg = ranked.groupBy("day_a").agg(F.count(F.lit(1)).alias("shared"), F.when(F.count(F.lit(1)) >= 5, F.corr("pa", "pb")).alias("spearman"))
    out = days.join(na, "day_a").join(nb, "day_b").join(agg, "day_a", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out.select("day_a", "day_b", "n_a", "n_b", "shared", F.round(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), 6).alias("jaccard"), F.round(100 * F.col("shared") / F.least("n_a", "n_b"), 4).alias("overlap_pct"), F.round("spearman", 6).alias("spearman"))


def population(entities: DataFrame, weights: DataFrame) -> DataFrame:
    """Per series and entity: observed days, sum of weights (rounded to 1), best and median rank, first and last day."""
    e = entities.join(weights, ["series", "day"])
    return e.groupBy("series", "entity").agg(F.count(F.lit(1)).alias("n_obs"), F.round(F.sum("weight"), 1).alias("est_days"), F.min("rank").alias("best_rank"), F.median("rank").alias("median_rank"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))


def threshold_curve(pop: DataFrame, thresholds: Sequence[float], min_obs: int = 3) -> DataFrame:
    """Per series and threshold the entities whose estimate reaches it, of at least ``min_obs`` observations."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    return pop.select("series", "est_days", "n_obs", t).groupBy("series", "threshold").agg(F.count_if((F.col("est_days") >= F.col("threshold")) & (F.col("n_obs") >= min_obs)).alias("entities"))


def resolve_by_title(obs: DataFrame) -> DataFrame:
    """Entity of each row: its own id, else the id most often seen with its title key (ties: the least), else 'title:' and the key."""
    counts = obs.filter("id is not null and key is not null").groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("key").orderBy(F.desc("n"), "id")
    mode = counts.withColumn("r", F.row_number().over(w)).filter("r = 1").select("key", F.col("id").alias("mode_id"))
    return obs.join(mode, "key", "left").withColumn("entity", F.coalesce(F.col("id").cast("string"), F.col("mode_id").cast("string"), F.concat(F.lit("title:"), F.col("key")))).drop("mode_id")


def nearest_in_time(rows: DataFrame, known: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """To each row the ``value`` known for its key on the nearest day (of two equally near the earlier; then the least value).

    An as-of join both ways: rows and known days are one ordered stream per key,
    on which the last value before and the first value behind are carried.
    """
    k = known.filter(F.col(value).isNotNull()).groupBy(key, day).agg(F.min(value).alias("__v"))
    both = rows.withColumn("__v", F.lit(None).cast(k.schema["__v"].dataType)).withColumn("__is", F.lit(1)).unionByName(k.withColumn("__is", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(day, "__is")
    here = F.when(F.col("__is") == 0, F.struct(F.col(day).alias("d"), F.col("__v").alias("v")))
    before = F.last(here, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    behind = F.first(here, ignorenulls=True).over(w.rowsBetween(W.currentRow, W.unboundedFollowing))
    m = both.withColumns({"__b": before, "__a": behind}).filter("__is = 1")
    db, da = F.date_diff(F.col(day), F.col("__b.d")), F.date_diff(F.col("__a.d"), F.col(day))
    pick = F.when(da.isNull() | (db <= da), F.col("__b.v")).otherwise(F.col("__a.v"))
    return m.withColumn("resolved", pick).drop("__v", "__is", "__b", "__a")


def stale_days(df: DataFrame) -> DataFrame:
    """(series, day, is_stale): a day whose ranked entities equal those of the day before it in the record."""
    lists = df.groupBy("series", "day").agg(F.array_sort(F.collect_list(F.struct("rank", "entity"))).alias("l"))
    h = lists.select("series", "day", F.sha2(F.to_json("l"), 256).alias("h"))
    w = W.partitionBy("series").orderBy("day")
    return h.select("series", "day", F.coalesce(F.lag("h").over(w) == F.col("h"), F.lit(False)).alias("is_stale"))


def churn_by_year(df: DataFrame) -> DataFrame:
    """A5: distinct entities per series and year."""
    return df.groupBy("series", F.year("day").alias("year")).agg(F.countDistinct("entity").alias("entities"))


def labelled_union(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Rows of each mask under its name; a row may carry several names. One pass over the rows."""
    names = F.array_compact(F.array(*[F.when(m, F.lit(n)) for n, m in masks.items()]))
    return df.withColumn("label", F.explode(names))
