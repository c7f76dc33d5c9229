"""Deterministic sampling: bottom-k by hash, caps per group, stratified splits, round robin, even spacing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auralake.functions.scalar import sample_score
from auralake.operators.scan import CHUNK, HOT_ROWS, assign_chunks, running


def bottom_k(df: DataFrame, k: int, seed: str, ident: str, by: Sequence[str] = ()) -> DataFrame:
    """The k rows of least hash per group (over all without one); ties by the identifier.

    Over all rows the plan is a top-k without a full sort; per group the window
    keeps k rows map-side (group limit).
    """
    scored = df.withColumn("score", sample_score(seed, F.col(ident)))
    if not by:
        return scored.orderBy("score", ident).limit(k)
    w = W.partitionBy(*by).orderBy("score", ident)
    return scored.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def with_caps(df: DataFrame, n: int, cap: int, group: str, seed: str, ident: str) -> DataFrame:
    """T5: n rows in hash order of which at most ``cap`` are of one group."""
    return bottom_k(df, cap, seed, ident, [group]).orderBy("score", ident).limit(n)


def split_strata(df: DataFrame, stratum: str, ident: str, share: float, seed: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``split``: per stratum the first round(n * share) rows in hash order are 'test', the others 'dev'.

    Strata are few and large, so places are counted in chunks of the hash order.
    """
    score = sample_score(seed, F.col(ident))
    scored = df.withColumns({"__score": score, "__at": F.conv(F.substring(score, 1, 12), 16, 10).cast("long")})
    sizes = scored.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(stratum, "__g")
    cut, chunked = assign_chunks(scored, [stratum], "__at", hot_rows)
    placed = running(cut, [stratum], ["__at", "__score", ident], {"__p": ("sum", F.lit(1), True)}, chunked)
    out = placed.join(sizes, F.col(stratum).eqNullSafe(F.col("__g")))
    return out.withColumn("split", F.when(F.col("__p") <= F.round(F.col("__n") * share), "test").otherwise("dev")).drop("__score", "__at", "__p", "__n", "__g", CHUNK)


def round_robin(df: DataFrame, group: str, order: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``turn``, the place of a row in its group (nulls first); ordering by (turn, group) deals the groups in rounds.

    The first order column is a number, date or time: a hot group is cut into chunks of it.
    """
    cut, chunked = assign_chunks(df, [group], order[0], hot_rows)
    return running(cut, [group], order, {"turn": ("sum", F.lit(1), True)}, chunked).drop(CHUNK)


def spread_evenly(df: DataFrame, group: Sequence[str], order: Sequence[str], cap: int) -> DataFrame:
    """At most ``cap`` rows of a group, evenly spaced in order: those at floor(i * step + step / 2)."""
    w = W.partitionBy(*group)
    n = F.count(F.lit(1)).over(w)
    pos = F.row_number().over(w.orderBy(*order)) - 1
    rows = df.withColumns({"__n": n, "__p": pos})
    # position p is taken iff some i < cap has floor((i + 0.5) * n / cap) = p
    i = F.ceil(F.col("__p") * cap / F.col("__n") - 0.5)
    i = F.greatest(i, F.lit(0))
    taken = (i < cap) & (F.floor((i + 0.5) * F.col("__n") / cap) == F.col("__p"))
    return rows.filter((F.col("__n") <= cap) | taken).drop("__n", "__p")


def quantile_lower(df: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """The value at ceil(q * n) in order (no interpolation)."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc({q}) within group (order by {value})").alias("q"))


def greedy_fill(sizes: list[float], capacity: float) -> list[bool]:
    """Which items of a list a container takes in order, skipping those that don't fit (one bounded container)."""
    out, used = [], 0.0
    for s in sizes:
        fits = used + s <= capacity
        used += s if fits else 0
        out.append(fits)
    return out


def strata_union(parts: dict[str, DataFrame], ident: str) -> DataFrame:
    """(ident, strata): the identifiers of several samples with the sorted names of those they are in."""
    df = None
    for name, part in parts.items():
        x = part.select(ident).distinct().withColumn("stratum", F.lit(name))
        df = x if df is None else df.unionByName(x)
    return df.groupBy(ident).agg(F.array_join(F.array_sort(F.collect_set("stratum")), "|").alias("strata"))
