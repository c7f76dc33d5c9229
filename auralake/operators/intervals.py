"""Interval operators: continuous periods, gaps, islands, hysteresis spans, overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auralake.operators.scan import CHUNK, HOT_ROWS, assign_chunks, running


def periods_and_gaps(
    df: DataFrame, keys: Sequence[str], start: str = "start_at", end: str = "end_at", touch: int = 0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Merge overlapping, nested and touching intervals per key; list periods and the gaps between.

    Rows with a null bound, or whose end is not after its start, are none. Equal
    starts are first reduced to the longest (map-side), which also removes
    repeated rows. Sorted by start, each start is compared with the running
    maximum of the ends before it; a start beyond that maximum (plus ``touch``)
    begins an island, and islands are numbered by a cumulative sum. A gap is
    read off the row that begins an island, so no second sort is needed. Hot
    keys are cut into chunks (see ``scan``). Null keys form a group of their own.

    Output: keys, ``piece`` ('period' or 'gap'), ``start_at``, ``end_at``.
    An empty input gives an empty output of the same schema.
    """
    valid = (
        df.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start)))
        .groupBy(*keys, F.col(start).alias("__s")).agg(F.max(end).alias("__e"))
    )
    cut, chunked = assign_chunks(valid, keys, "__s", hot_rows)
    order = ["__s"]
    seen = running(cut, keys, order, {"__m": ("max", F.col("__e"), False)}, chunked)
    new = F.when(F.col("__m").isNull() | (F.col("__s") > F.col("__m") + F.lit(touch)), 1).otherwise(0)
    marked = seen.withColumn("__new", new)
    labelled = running(marked, keys, order, {"__island": ("sum", F.col("__new"), True)}, chunked)
    # One row per (key, island): the period, and the gap before it where there is one.
    per = labelled.groupBy(*keys, "__island").agg(
        F.min("__s").alias("__from"), F.max("__e").alias("__to"),
        F.max(F.when(F.col("__new") == 1, F.col("__m"))).alias("__before"),
    )
    piece = lambda kind, a, b: F.struct(F.lit(kind).alias("piece"), a.alias("start_at"), b.alias("end_at"))
    pieces = F.filter(
        F.array(piece("period", F.col("__from"), F.col("__to")), piece("gap", F.col("__before"), F.col("__from"))),
        lambda x: x["start_at"].isNotNull(),
    )
    return per.select(*keys, F.inline(pieces))


def audio_span_bounds(spans: DataFrame) -> DataFrame:
    """(src, entity, start_at, end_at) of audio spans, bounds in rounded milliseconds; NaN and infinite bounds are null."""

    def ms(c: str) -> Column:
        v = F.col(c)
        return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e12), F.round(v * 1000).cast("long"))

    return spans.filter(F.col("episode_id").isNotNull() & F.col("span_kind").isin("omitted", "speech")).select(
        F.col("span_kind").alias("src"), F.col("episode_id").cast("string").alias("entity"),
        ms("start_s").alias("start_at"), ms("end_s").alias("end_at"),
    )


def window_bounds(windows: DataFrame) -> DataFrame:
    """(src, entity, start_at, end_at) of target windows, bounds in days since 1970 (a time of day is dropped)."""

    def day(c: str) -> Column:
        return F.unix_date(F.expr(f"try_to_timestamp(substr(trim({c}), 1, 10), 'yyyy-MM-dd')").cast("date")).cast("long")

    return windows.filter(F.col("entity").isNotNull()).select(
        F.lit("window").alias("src"), "entity", day("win_start").alias("start_at"), day("win_end").alias("end_at")
    )


def coverage_periods(spans: DataFrame, windows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Problem 4: periods and gaps of audio spans per episode and of target windows per entity."""
    both = audio_span_bounds(spans).unionByName(window_bounds(windows))
    return periods_and_gaps(both, ["src", "entity"], hot_rows=hot_rows)


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Label each row with the number of its island (gaps-and-islands), keeping all rows and columns.

    Intervals whose start is at most ``gap`` after the running end join. Rows are
    ordered by (start, end); repeated rows keep their number. A column named
    ``island`` is replaced.
    """
    df = df.drop("island", "__m", "__new")
    cut, chunked = assign_chunks(df, keys, start, hot_rows)
    seen = running(cut, keys, [start, end], {"__m": ("max", F.col(end), False)}, chunked)
    marked = seen.withColumn("__new", F.when(F.col("__m").isNull() | (F.col(start) > F.col("__m") + gap), 1).otherwise(0))
    return running(marked, keys, [start, end], {"island": ("sum", F.col("__new"), True)}, chunked).drop("__m", "__new", CHUNK)


def hysteresis_spans(df: DataFrame, keys: Sequence[str], pos: str, p: str, seed: float, extend: float, bridge: int) -> DataFrame:
    """Runs of positions with ``p >= extend`` that hold a ``p >= seed``; runs at most ``bridge`` apart join."""
    over = W.partitionBy(*keys).orderBy(pos)
    runs = (
        df.filter(F.col(p) >= extend).withColumn("__g", F.col(pos) - F.row_number().over(over))
        .groupBy(*keys, "__g").agg(F.min(pos).alias("span_start"), F.max(pos).alias("span_end"), F.max(p).alias("__top"))
        .filter(F.col("__top") >= seed)
    )
    joined = islands(runs, keys, "span_start", "span_end", gap=bridge + 1)
    return joined.groupBy(*keys, "island").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.max("__top").alias("peak")).drop("island")


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int, bounds: tuple[str, str, str, str], inclusive: bool = True) -> DataFrame:
    """Pairs of overlapping intervals of one key, found through buckets of ``width`` (no nested loop).

    Both sides are exploded over the buckets they touch and joined by (keys,
    bucket); a pair is kept only in the bucket of the later start, so it comes
    out once.
    """
    ls, le, rs, re = bounds

    def buckets(df: DataFrame, s: str, e: str, at: str) -> DataFrame:
        return df.withColumn(at, F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))

    a, b = buckets(left, ls, le, "__b").alias("a"), buckets(right, rs, re, "__b").alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "__b"]]
    hit = (F.col(f"a.{ls}") <= F.col(f"b.{re}")) & (F.col(f"b.{rs}") <= F.col(f"a.{le}")) if inclusive else (F.col(f"a.{ls}") < F.col(f"b.{re}")) & (F.col(f"b.{rs}") < F.col(f"a.{le}"))
    once = F.col("a.__b") == F.floor(F.greatest(F.col(f"a.{ls}"), F.col(f"b.{rs}")) / width)
    right_cols = [F.col(f"b.{c}") for c in right.columns if c not in keys]
    return a.join(b, [*on, hit, once]).select(*[F.col(f"a.{c}") for c in left.columns], *right_cols)
