"""Annotations on transcript units: merging across windows, claims, products, exposure, validation.

Order-dependent merges run per (episode, axis): inputs are the annotations of
one transcript, ordered fully by (start, end, window, position).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auralake.operators.intervals import islands


def annotation_islands(atoms: DataFrame) -> DataFrame:
    """One annotation per run of touching spans of (episode, axis, label, role); its hull, sources and best confidence."""
    keys = ["episode_id", "axis", "label", "role"]
    i = islands(atoms, keys, "span_start", "span_end", gap=1)
    return i.groupBy(*keys, "island").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.count(F.lit(1)).alias("n_sources"), F.max("confidence").alias("confidence")).drop("island")


def _fold(items: list[tuple], gap: int, touch: Callable[[tuple, tuple], bool], unite: Callable[[list[tuple]], tuple]) -> list[tuple]:
    """Groups of items (start, end, ...) in order of start: each item is united with all groups within ``gap`` that it touches.

    A united group takes the place of its first part. Groups that the sweep has
    left behind are set aside, so an item meets only those still within reach.
    """
    near: dict[int, tuple] = {}
    left: list[tuple] = []
    for place, item in enumerate(items):
        for k in [k for k, g in near.items() if g[1] + gap < item[0]]:
            left.append(near.pop(k))
        met = [k for k, g in near.items() if touch(g, item)]
        whole = unite([near[k] for k in met[:1]] + [item] + [near[k] for k in reversed(met[1:])])
        for k in met[1:]:
            del near[k]
        near[met[0] if met else place] = whole
    return sorted([*left, *near.values()], key=lambda g: g[:2])


def merge_detections(rows: DataFrame) -> DataFrame:
    """Detections of one episode and axis that overlap or touch and share a label, transitively.

    Labels and hull grow while scanning, and one detection may bridge groups
    before it, so the result depends on the order: (start, end, window_index,
    position). Output: episode_id, axis, span_start, span_end, labels (sorted),
    n_detections.
    """

    def touch(g: tuple, x: tuple) -> bool:
        return not g[2].isdisjoint(x[2])

    def unite(gs: list[tuple]) -> tuple:
        return (min(g[0] for g in gs), max(g[1] for g in gs), frozenset().union(*(g[2] for g in gs)), sum(g[3] for g in gs))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["span_start", "span_end", "window_index", "position"])
        groups = _fold([(s, e, frozenset(labels), 1) for s, e, labels in zip(x["span_start"], x["span_end"], x["labels"])], 1, touch, unite)
        out = [(pdf["episode_id"].iloc[0], pdf["axis"].iloc[0], s, e, sorted(labels), n) for s, e, labels, n in groups]
        return pd.DataFrame(out, columns=["episode_id", "axis", "span_start", "span_end", "labels", "n_detections"])

    return rows.groupBy("episode_id", "axis").applyInPandas(run, "episode_id long, axis string, span_start long, span_end long, labels array<string>, n_detections int")


def _tokens(s: str) -> frozenset:
    import re

    return frozenset(t for t in re.findall(r"[a-z0-9]+", s.casefold()) if len(t) > 2)


def _quote(s: str) -> str:
    return " ".join(s.split()).casefold()


def claims_alike(a: str, b: str) -> float:
    """token Jaccard of two claims, equality where one has no tokens."""
    x, y = _tokens(a), _tokens(b)
    return len(x & y) / len(x | y) if x and y else float(_quote(a) == _quote(b))


def merge_claims(rows: DataFrame, least: float = 0.55) -> DataFrame:
    """Versions of one claim from overlapping windows: overlapping spans, one role, and the same quote or a text near that of the group's best.

    The best (highest confidence, the first of equals) may change while
    scanning in the order (start, end, window_index, position).
    """

    # a group is (start, end, its best version as (claim, quote, confidence), versions)
    def touch(g: tuple, x: tuple) -> bool:
        return g[0] <= x[1] and (_quote(g[2][1]) == _quote(x[2][1]) or claims_alike(x[2][0], g[2][0]) >= least)

    def unite(gs: list[tuple]) -> tuple:
        return (min(g[0] for g in gs), max(g[1] for g in gs), max((g[2] for g in gs), key=lambda v: v[2]), sum(g[3] for g in gs))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["span_start", "span_end", "window_index", "position"])
        versions = zip(x["claim"], x["quote"], x["confidence"])
        groups = _fold([(s, e, v, 1) for s, e, v in zip(x["span_start"], x["span_end"], versions)], 0, touch, unite)
        out = [(pdf["episode_id"].iloc[0], pdf["role"].iloc[0], s, e, v[0], v[2], n) for s, e, v, n in groups]
        return pd.DataFrame(out, columns=["episode_id", "role", "span_start", "span_end", "claim", "confidence", "n_candidates"])

    return rows.groupBy("episode_id", "role").applyInPandas(run, "episode_id long, role string, span_start long, span_end long, claim string, confidence double, n_candidates int")


def merge_products(rows: DataFrame) -> DataFrame:
    """Mentions of one product key whose spans overlap or touch; the name of the most confident (first of equals)."""
    keys = ["episode_id", "product_key"]
    i = islands(rows, keys, "span_start", "span_end", gap=1)
    best = F.max_by("name", F.struct("confidence", (-F.col("span_start")).alias("s"), (-F.col("span_end")).alias("e")))
    return i.groupBy(*keys, "island").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), best.alias("name"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_mentions")).drop("island")


def exposure(units: DataFrame) -> DataFrame:
    """Per episode units, words, span in seconds and timing quality (all unavailable, partial, interpolated, segment)."""
    q = F.col("timing_quality")
    agg = units.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("n_units"), F.sum("n_words").alias("n_words"), F.round(F.max("end_seconds") - F.min("start_seconds"), 3).alias("span_seconds"),
        F.bool_and(q == "unavailable").alias("__all"), F.bool_or(q == "unavailable").alias("__any"), F.bool_or(q == "interpolated").alias("__int"),
    )
    quality = F.when(F.col("__all"), "unavailable").when(F.col("__any"), "partial").when(F.col("__int"), "interpolated").otherwise("segment")
    return agg.withColumn("timing_quality", quality).drop("__all", "__any", "__int")


def time_regressions(segments: DataFrame) -> DataFrame:
    """Per episode segments, untimed ones, and starts below the last known start before them."""
    w = W.partitionBy("episode_id").orderBy("seg_index").rowsBetween(W.unboundedPreceding, -1)
    s = segments.withColumn("last", F.last("start_s", ignorenulls=True).over(w))
    return s.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_segments"), F.count_if(F.col("start_s").isNull()).alias("untimed"), F.count_if(F.col("start_s") < F.col("last")).alias("regressions"))


def first_in_windows(units_in_windows: DataFrame) -> DataFrame:
    """Each unit once, from the first window that holds it."""
    return units_in_windows.groupBy("episode_id", "unit_index").agg(F.min("window_index").alias("window_index"))


def match_score(kind: Column, iou: Column, coefficient: Column, same_label: Column, quote: Column, tokens: Column) -> Column:
    """F16: score of a predicted against a gold atom; detection by span, claim by quote then text, product by key.

    A claim's score with a quote overlap may exceed 1, as defined.
    """
    detection = F.when(~same_label, 0.0).when(iou >= 0.5, iou).when(coefficient >= 0.5, F.greatest(iou, F.lit(0.01))).otherwise(0.0)
    claim = F.when(coefficient <= 0, 0.0).when(quote >= 1, 1.0).when(quote > 0, 0.5 + 0.5 * quote + 0.25 * tokens).when(tokens >= 0.6, 0.25 + 0.25 * tokens).otherwise(0.0)
    return F.when(kind == "detection", detection).when(kind == "claim", claim).otherwise(F.when(coefficient <= 0, 0.0).when(same_label, 1.0).otherwise(0.0))


def validate_atoms(atoms: DataFrame, units: DataFrame, labels: list[str], axes: list[str]) -> DataFrame:
    """Add ``error_kind`` of each atom (null if sound), the first broken rule in a fixed order.

    atoms: episode_id, span_start, span_end, axis, label, confidence. units: the
    units of each episode (unit_index).
    """
    last = units.groupBy("episode_id").agg(F.max("unit_index").alias("__last"))
    j = atoms.join(last, "episode_id", "left")
    dup = F.row_number().over(W.partitionBy("episode_id", "span_start", "span_end", "axis", "label").orderBy(F.desc("confidence")))
    j = j.withColumn("__dup", dup)
    kind = (
        F.when(F.col("__last").isNull() | (F.col("span_start") < 0) | (F.col("span_end") > F.col("__last")), "span_out_of_window")
        .when(F.col("span_start") > F.col("span_end"), "reversed_span").when(~F.coalesce(F.col("label").isin(labels), F.lit(False)), "mixed_or_unknown_labels")
        .when(~F.coalesce(F.col("axis").isin(axes) & F.col("confidence").between(0, 1), F.lit(False)), "invalid_field").when(F.col("__dup") > 1, "duplicate_annotation")
    )
    return j.withColumn("error_kind", kind).drop("__last", "__dup")


def label_summary(atoms: DataFrame) -> DataFrame:
    """Per episode a map of label to (count, greatest confidence), sorted by label."""
    per = atoms.groupBy("episode_id", "label").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("top"))
    return per.groupBy("episode_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.struct("n", "top"))))).alias("labels"), F.sum("n").alias("n_annotations"))


def label_adjacency(left: DataFrame, right: DataFrame, least: float = 0.8, min_count: int = 3) -> DataFrame:
    """Pairs of different labels that two annotators put on spans of IoU at least ``least``, seen ``min_count`` times and more."""
    a, b = left.alias("a"), right.alias("b")
    inter = F.least("a.span_end", "b.span_end") - F.greatest("a.span_start", "b.span_start") + 1
    union = (F.col("a.span_end") - F.col("a.span_start") + 1) + (F.col("b.span_end") - F.col("b.span_start") + 1) - inter
    j = a.join(b, (F.col("a.episode_id") == F.col("b.episode_id")) & (F.col("a.bucket") == F.col("b.bucket"))).filter((F.col("a.label") != F.col("b.label")) & (inter / union >= least))
    return j.groupBy(F.least("a.label", "b.label").alias("label_a"), F.greatest("a.label", "b.label").alias("label_b")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
