"""Scoring of predictions against gold, repeats, held-out annotators, planted items, contrast pairs, policy sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralake.functions.scalar import f1_score, iou, overlap_coefficient, safe_ratio
from auralake.operators.scoring import cluster_atoms, optimal_match


def scored_pairs(preds: DataFrame, golds: DataFrame) -> DataFrame:
    """F16: pairs of a predicted and a gold atom of one item, axis-free label and overlapping hull, with their score.

    preds: item, pred_id, label, span_start, span_end; golds: item, gold_id,
    label, tight_start, tight_end, env_start, env_end, tier. Score: IoU with the
    tight span if at least a half, else by overlap coefficient, else by lying
    inside the hull with at least half the tight length.
    """
    p, g = preds.alias("p"), golds.alias("g")
    j = p.join(g, (F.col("p.item") == F.col("g.item")) & (F.col("p.label") == F.col("g.label"))).filter("p.span_start <= g.env_end and g.env_start <= p.span_end")
    s, e, a, b = (F.col(c) for c in ("p.span_start", "p.span_end", "g.tight_start", "g.tight_end"))
    i, c = iou(s, e, a, b), overlap_coefficient(s, e, a, b)
    inside = (s >= F.col("g.env_start")) & (e <= F.col("g.env_end")) & ((e - s + 1) >= 0.5 * (b - a + 1))
    score = F.when(i >= 0.5, i).when((c >= 0.5) | inside, F.greatest(i, F.lit(0.01))).otherwise(0.0)
    return j.select(F.col("p.item").alias("item"), "pred_id", "gold_id", score.alias("score")).filter("score > 0")


def score_items(preds: DataFrame, golds: DataFrame) -> DataFrame:
    """(item, tp, required_tp, fp, fn, unscored) after an optimal one-to-one matching.

    Rejected golds are left out before matching. A match with a required or
    acceptable gold is a true positive; one with a singleton is unscored; an
    unmatched prediction is a false positive, an unmatched required gold a false
    negative.
    """
    g = golds.filter("tier <> 'rejected'")
    m = optimal_match(scored_pairs(preds, g), "item", "pred_id", "gold_id", "score")
    pm = preds.select("item", "pred_id").join(m.select("item", "pred_id", "gold_id"), ["item", "pred_id"], "left").join(g.select("item", "gold_id", "tier"), ["item", "gold_id"], "left")
    by_pred = pm.groupBy("item").agg(F.count_if(F.col("tier").isin("required", "acceptable")).alias("tp"), F.count_if(F.col("tier") == "required").alias("required_tp"), F.count_if(F.col("gold_id").isNull()).alias("fp"), F.count_if(F.col("tier") == "singleton").alias("unscored"))
    gm = g.filter("tier = 'required'").select("item", "gold_id").join(m.select("item", "gold_id").withColumn("hit", F.lit(1)), ["item", "gold_id"], "left")
    by_gold = gm.groupBy("item").agg(F.count_if(F.col("hit").isNull()).alias("fn"))
    out = by_pred.join(by_gold, "item", "full_outer").na.fill(0)
    return out.select("item", "tp", "required_tp", "fp", "fn", "unscored")


def pool(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summed counts with precision, strict recall and F1."""
    s = scores.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "required_tp", "fp", "fn")])
    tp, fp, fn, rt = (F.col(c) for c in ("tp", "fp", "fn", "required_tp"))
    return s.withColumns({"precision": safe_ratio(tp, tp + fp), "strict_recall": safe_ratio(rt, rt + fn), "f1": f1_score(tp, fp, fn)})


def pairwise_f1(atoms: DataFrame) -> DataFrame:
    """Matched F1 of every two annotators over all items: atoms of one label with an IoU of at least a half match one-to-one.

    atoms: item, annotator, label, span_start, span_end. Pairs arise within an
    item only (equi-join on item and label).
    """
    ident = F.concat_ws("|", "annotator", "label", "span_start", "span_end")
    x = atoms.withColumn("aid", ident).distinct()
    a, b = x.alias("a"), x.alias("b")
    s = iou(F.col("a.span_start"), F.col("a.span_end"), F.col("b.span_start"), F.col("b.span_end"))
    j = a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.annotator") < F.col("b.annotator"))).filter(s >= 0.5)
    pairs = j.select(F.struct(F.col("a.item").alias("item"), F.col("a.annotator").alias("x"), F.col("b.annotator").alias("y")).alias("k"), F.col("a.aid").alias("l"), F.col("b.aid").alias("r"), s.alias("w"))
    pairs = pairs.withColumn("key", F.to_json("k"))
    m = optimal_match(pairs, "key", "l", "r", "w").withColumn("k", F.from_json("key", "struct<item:string,x:string,y:string>"))
    hits = m.groupBy(F.col("k.x").alias("x"), F.col("k.y").alias("y")).agg(F.count(F.lit(1)).alias("matched"))
    n = x.groupBy("annotator").agg(F.count(F.lit(1)).alias("n"))
    out = hits.join(n.select(F.col("annotator").alias("x"), F.col("n").alias("nx")), "x").join(n.select(F.col("annotator").alias("y"), F.col("n").alias("ny")), "y")
    return out.select("x", "y", "matched", "nx", "ny", (2 * F.col("matched") / (F.col("nx") + F.col("ny"))).alias("f1"))


def leave_one_out(atoms: DataFrame) -> DataFrame:
    """(held_out, tp, fp, fn, f1): gold built without each annotator, against whom the annotator is scored.

    The held-out annotator is a column, so one clustering pass serves all.
    """
    who = atoms.select("item", F.col("annotator").alias("held_out")).distinct()
    rest = atoms.join(who, "item").filter("annotator <> held_out").withColumn("key", F.to_json(F.struct("item", "held_out")))
    gold = cluster_atoms(rest.select("key", "annotator", "label", "span_start", "span_end"), "key")
    gold = gold.withColumn("gold_id", F.concat_ws("|", "label", "tight_start", "tight_end")).withColumnRenamed("key", "item")
    mine = atoms.withColumn("item", F.to_json(F.struct("item", F.col("annotator").alias("held_out"))))
    mine = mine.withColumn("pred_id", F.concat_ws("|", "label", "span_start", "span_end")).select("item", "pred_id", "label", "span_start", "span_end").distinct()
    s = score_items(mine, gold).withColumn("held_out", F.get_json_object("item", "$.held_out"))
    return pool(s, ["held_out"]).select("held_out", "tp", "fp", "fn", "f1")


def apply_overlay(golds: DataFrame, rulings: DataFrame) -> DataFrame:
    """Tiers of singletons replaced by a ruling on their gold_id; other tiers stay. rulings: item, gold_id, tier."""
    r = rulings.select("item", "gold_id", F.col("tier").alias("__t"))
    return golds.join(r, ["item", "gold_id"], "left").withColumn("tier", F.when(F.col("tier") == "singleton", F.coalesce("__t", "tier")).otherwise(F.col("tier"))).drop("__t")


def check_plants(plants: DataFrame, golds: DataFrame) -> DataFrame:
    """(item, plant_id, outcome): missing, contradicted (another label overlaps), split (several golds), singleton, ok."""
    p, g = plants.alias("p"), golds.alias("g")
    j = p.join(g, (F.col("p.item") == F.col("g.item")) & (F.col("p.span_start") <= F.col("g.env_end")) & (F.col("g.env_start") <= F.col("p.span_end")), "left")
    same = F.col("g.label") == F.col("p.label")
    agg = j.groupBy(F.col("p.item").alias("item"), "plant_id").agg(F.count_if(same).alias("n"), F.count_if(same & (F.col("g.tier") == "required")).alias("req"), F.count_if(F.col("g.label").isNotNull() & ~same).alias("other"))
    outcome = F.when((F.col("n") == 0) & (F.col("other") > 0), "contradicted").when(F.col("n") == 0, "missing").when(F.col("n") > 1, "split").when(F.col("req") == 0, "singleton").otherwise("ok")
    return agg.select("item", "plant_id", outcome.alias("outcome"))


def contrast_rates(pairs: DataFrame) -> DataFrame:
    """Per kind of contrast the share whose targeted value changed as specified; pairs whose base was not found don't count.

    pairs: kind ('absent', 'unchanged', 'lower', 'higher' or 'to'), base_rank,
    twin_rank (null: none found), want (for 'to').
    """
    b, t = F.col("base_rank"), F.col("twin_rank")
    ok = F.when(F.col("kind") == "absent", t.isNull()).when(F.col("kind") == "unchanged", b == t).when(F.col("kind") == "lower", t < b).when(F.col("kind") == "higher", t > b).otherwise(t == F.col("want"))
    return pairs.filter(b.isNotNull()).groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.coalesce(ok, F.lit(False)).cast("double")).alias("rate"))


def sweep(df: DataFrame, score: str, truth: Column, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, tp, fp, fn, f1) of a policy grid, in one pass."""
    t = F.coalesce(truth, F.lit(False))
    x = df.select(F.col(score).alias("s"), t.alias("t"), F.explode(F.array(*[F.lit(float(v)) for v in thresholds])).alias("threshold"))
    hit = F.coalesce(F.col("s") >= F.col("threshold"), F.lit(False))
    a = x.groupBy("threshold").agg(F.count_if(hit & F.col("t")).alias("tp"), F.count_if(hit & ~F.col("t")).alias("fp"), F.count_if(~hit & F.col("t")).alias("fn"))
    return a.withColumn("f1", f1_score(F.col("tp"), F.col("fp"), F.col("fn")))


def mean_of_repeats(reports: DataFrame) -> DataFrame:
    """(metric, mean, low, high, n) over repeats; null values don't count."""
    return reports.filter("value is not null").groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))


def map_totals(df: DataFrame, column: str) -> DataFrame:
    """Summed values per key over JSON maps of numbers; broken JSON counts nothing."""
    return df.select(F.explode(F.from_json(column, "map<string,double>")).alias("key", "v")).groupBy("key").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


def composition(df: DataFrame, ident: str, strata: Sequence[str]) -> DataFrame:
    """Items per stratum with an order-free fingerprint of their ids."""
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("items"), F.sum(F.conv(F.substring(F.sha2(F.col(ident).cast("string"), 256), 1, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias("fingerprint"))
