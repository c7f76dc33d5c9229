"""Scores and agreement: counts to P/R/F1, kappa, alpha, AUROC, bootstrap, optimal matching, gold clustering."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralake.functions.scalar import f1_score, safe_ratio
from auralake.operators.scan import HOT_ROWS, assign_chunks, running


def confusion(df: DataFrame, keys: Sequence[str], truth: Column, predicted: Column) -> DataFrame:
    """Tp, fp, fn, precision, recall, f1 per key (zero-safe); nulls count as false."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    agg = df.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.withColumns({"precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn), "f1": f1_score(tp, fp, fn)})


def confusion_breakdown(df: DataFrame, by: Sequence[str], truth: Column, predicted: Column) -> DataFrame:
    """The same over all and by each column of ``by``, in one pass by grouping sets; level tells which."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    base = df.select(*by, F.when(t & p, 1).otherwise(0).alias("tp"), F.when(~t & p, 1).otherwise(0).alias("fp"), F.when(t & ~p, 1).otherwise(0).alias("fn"))
    cols = [F.col(c) for c in by]
    level = F.lit("all")
    for c in by:
        level = F.when(F.grouping(c) == 0, F.lit(c)).otherwise(level)
    value = F.coalesce(*[c.cast("string") for c in cols], F.lit("")) if by else F.lit("")
    g = base.groupingSets([[], *[[c] for c in cols]], *cols).agg(level.alias("level"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return g.select("level", value.alias("value"), "tp", "fp", "fn", f1_score(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def weighted_kappa(df: DataFrame, a: str, b: str, levels: int) -> DataFrame:
    """Linearly weighted kappa of two codes 0..levels-1; null under two pairs or without expected disagreement.

    The table of codes (at most levels squared cells) is aggregated first; the
    marginals meet on one row of arrays.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    row = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.aggregate(F.filter("t", lambda x: x["i"] == i), F.lit(0).cast("long"), lambda acc, x: acc + x["n"]))
    colm = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.aggregate(F.filter("t", lambda x: x["j"] == i), F.lit(0).cast("long"), lambda acc, x: acc + x["n"]))
    t = cells.agg(F.collect_list(F.struct(F.col(a).cast("int").alias("i"), F.col(b).cast("int").alias("j"), "n")).alias("t")).withColumns({"r": row, "c": colm})
    total = F.aggregate("r", F.lit(0).cast("long"), lambda acc, x: acc + x)
    num = F.aggregate("t", F.lit(0.0), lambda acc, x: acc + F.abs(x["i"] - x["j"]) / F.lit(levels - 1.0) * x["n"])
    pairs = F.flatten(F.transform("r", lambda x, i: F.transform("c", lambda y, j: F.abs(i - j) / F.lit(levels - 1.0) * x * y)))
    den = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)
    return t.select(total.alias("n"), F.when((total >= 2) & (den > 0), 1 - num * total / den).alias("kappa"))


def krippendorff_alpha(df: DataFrame, unit: str, value: str, ordinal: bool = False) -> DataFrame:
    """Alpha of coded units (nominal, or squared differences of numeric codes); units of one value don't count.

    Within a unit equal values are counted first, so a unit of many coders is as
    wide as its different values.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(unit, value).agg(F.count(F.lit(1)).alias("n"))
    m = per.groupBy(unit).agg(F.sum("n").alias("m"), F.collect_list(F.struct(F.col(value).alias("v"), "n")).alias("vs")).filter("m >= 2")
    delta = (lambda x, y: F.pow(x - y, 2).cast("double")) if ordinal else (lambda x, y: F.when(x == y, F.lit(0.0)).otherwise(F.lit(1.0)))
    inner = F.aggregate(F.flatten(F.transform("vs", lambda x: F.transform("vs", lambda y: delta(x["v"], y["v"]) * x["n"] * y["n"]))), F.lit(0.0), lambda acc, d: acc + d)
    obs = m.agg(F.sum(inner / (F.col("m") - 1)).alias("o"), F.sum("m").alias("n"))
    totals = m.select(F.inline("vs")).groupBy("v").agg(F.sum("n").alias("k")).agg(F.collect_list(F.struct("v", "k")).alias("vs"))
    exp = F.aggregate(F.flatten(F.transform("vs", lambda x: F.transform("vs", lambda y: delta(x["v"], y["v"]) * x["k"] * y["k"]))), F.lit(0.0), lambda acc, d: acc + d)
    # two tables of one row each, laid side by side without a join
    both = obs.select("o", "n", F.lit(None).cast("double").alias("e")).unionByName(totals.select(F.lit(None).cast("double").alias("o"), F.lit(None).cast("long").alias("n"), exp.alias("e")))
    both = both.agg(F.max("o").alias("o"), F.max("n").alias("n"), F.max("e").alias("e"))
    return both.select("n", F.when(F.col("e") > 0, 1 - (F.col("o") / F.col("n")) / (F.col("e") / (F.col("n") * (F.col("n") - 1)))).alias("alpha"))


def auroc(df: DataFrame, score: str, positive: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """P(positive scores higher) + half the ties, from counts per distinct score; null without both classes.

    Scores are aggregated first; the running count over distinct scores is taken
    in chunks of their order where there are many (see ``operators.scan``).
    """
    per = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q")).withColumn("one", F.lit(1))
    per, chunked = assign_chunks(per, ["one"], "s", hot_rows)
    run = running(per, ["one"], ["s"], {"below": ("sum", F.col("q"), False)}, chunked)
    agg = run.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("wins"))
    return agg.select("positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("wins") / (F.col("positives") * F.col("negatives"))).alias("auroc"))


def paired_bootstrap(items: DataFrame, ident: str, iterations: int = 2000, seed: int = 0) -> DataFrame:
    """(n, delta, low, high, share_positive) of pooled F1 of run b minus run a over paired items.

    Poisson bootstrap: in each replicate an item counts as often as a hash of
    (item, replicate) says, so replicates are sums that partition freely. Needs
    tp_a, fp_a, fn_a, tp_b, fp_b, fn_b per item.
    """
    # cumulative Poisson(1) probabilities
    cum = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(0, 7)]).tolist()
    u = F.pmod(F.xxhash64(F.col(ident), F.col("rep"), F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cum), F.lit(0))
    reps = items.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(iterations)))).withColumn("w", F.when(F.col("rep") == 0, 1).otherwise(weight))
    sums = reps.groupBy("rep").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("tp_a", "fp_a", "fn_a", "tp_b", "fp_b", "fn_b")], F.count(F.lit(1)).alias("n"))
    d = sums.select("rep", "n", (f1_score(F.col("tp_b"), F.col("fp_b"), F.col("fn_b")) - f1_score(F.col("tp_a"), F.col("fp_a"), F.col("fn_a"))).alias("d"))
    boot = F.when(F.col("rep") > 0, F.col("d"))
    return d.agg(F.max("n").alias("n"), F.max(F.when(F.col("rep") == 0, F.col("d"))).alias("delta"), F.percentile(boot, 0.025).alias("low"), F.percentile(boot, 0.975).alias("high"), F.avg(F.when(F.col("rep") > 0, (F.col("d") > 0).cast("double"))).alias("share_positive"))


def assign(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a one-to-one assignment of greatest total weight; pairs of weight 0 are dropped.

    Shortest augmenting paths with potentials, O(n^2 m).
    """
    if weights.size == 0:
        return []
    flip = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if flip else weights).astype(float)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, prev = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            prev[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            d = least[j1]
            u[match[used]] += d
            v[used] -= d
            least[~used] -= d
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[prev[j0]]
            j0 = prev[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    pairs = [(j, i) for i, j in pairs] if flip else pairs
    return sorted((i, j) for i, j in pairs if weights[i, j] > 0)


def optimal_match(pairs: DataFrame, item: str, left: str, right: str, weight: str) -> DataFrame:
    """The optimal one-to-one pairs of each item from its scored pairs (an item holds few of them)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ls, rs = sorted(pdf[left].unique()), sorted(pdf[right].unique())
        w = np.zeros((len(ls), len(rs)))
        li, ri = {x: i for i, x in enumerate(ls)}, {x: i for i, x in enumerate(rs)}
        for a, b, s in zip(pdf[left], pdf[right], pdf[weight]):
            w[li[a], ri[b]] = max(w[li[a], ri[b]], s)
        return pd.DataFrame([(pdf[item].iloc[0], ls[i], rs[j], w[i, j]) for i, j in assign(w)], columns=[item, left, right, weight])

    types = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.filter(F.col(weight) > 0).select(item, left, right, F.col(weight).cast("double").alias(weight)).groupBy(item).applyInPandas(run, f"{item} {types[item]}, {left} {types[left]}, {right} {types[right]}, {weight} double")


def cluster_atoms(atoms: DataFrame, item: str, support_needed: float = 2.0) -> DataFrame:
    """Gold atoms of an item from annotators' spans (item, annotator, label, span_start, span_end).

    Annotators join in order of their ids; each one's atoms are matched with the
    clusters of its label so far by optimal assignment on IoU (at least half),
    unmatched ones open clusters. tight is the shortest member (ties: the
    smaller start), the envelope is the hull; support of at least
    ``support_needed`` annotators makes a cluster required, else singleton.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        clusters: list[dict] = []
        for who in sorted(pdf["annotator"].unique()):
            mine = pdf[pdf["annotator"] == who].sort_values(["label", "span_start", "span_end"]).to_dict("records")
            w = np.zeros((len(mine), len(clusters)))
            for i, a in enumerate(mine):
                for j, c in enumerate(clusters):
                    if a["label"] == c["label"]:
                        inter = max(0, min(a["span_end"], c["tight"][1]) - max(a["span_start"], c["tight"][0]) + 1)
                        union = (a["span_end"] - a["span_start"] + 1) + (c["tight"][1] - c["tight"][0] + 1) - inter
                        w[i, j] = inter / union if inter / union >= 0.5 else 0.0
            taken = dict(assign(w)) if w.size else {}
            for i, a in enumerate(mine):
                span = (a["span_start"], a["span_end"])
                if i in taken:
                    c = clusters[taken[i]]
                    c["members"].append(span)
                    c["tight"] = min(c["members"], key=lambda s: (s[1] - s[0], s[0]))
                    c["support"] += 1
                else:
                    clusters.append({"label": a["label"], "members": [span], "tight": span, "support": 1})
        rows = [(pdf[item].iloc[0], c["label"], *c["tight"], min(s for s, _ in c["members"]), max(e for _, e in c["members"]), c["support"], "required" if c["support"] >= support_needed else "singleton") for c in clusters]
        return pd.DataFrame(rows, columns=[item, "label", "tight_start", "tight_end", "env_start", "env_end", "support", "tier"])

    t = {f.name: f.dataType.simpleString() for f in atoms.schema}
    return atoms.groupBy(item).applyInPandas(run, f"{item} {t[item]}, label {t['label']}, tight_start long, tight_end long, env_start long, env_end long, support int, tier string")
