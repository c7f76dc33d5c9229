"""Ordered running values per key that stay parallel when one key is hot.

A plain window puts all rows of a key into one task. Here the rows of hot keys
are cut into chunks of their order at approximate quantiles; running values are
taken inside a chunk and joined with what the chunks before it carry over. Keys
that are not hot form one chunk. With no hot key at all the plan is the plain
window without further joins; the result is the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = "__chunk"
#: A key is hot beyond this many rows, and beyond 1/MAX_HOT of all rows.
HOT_ROWS = 1_000_000
#: So at most MAX_HOT keys are hot: what is collected of them has a bound.
MAX_HOT = 128
MAX_CHUNKS = 512


def assign_chunks(df: DataFrame, keys: Sequence[str], order: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, bool]:
    """Add the chunk of each row; the second value tells whether any key is hot.

    Only hot keys (at most ``MAX_HOT``) with at most ``MAX_CHUNKS`` cut points
    each reach the driver. Rows of equal ``order`` fall into one chunk.
    """
    total = df.count()
    least = max(hot_rows, total // MAX_HOT)
    if total <= least:
        return df.withColumn(CHUNK, F.lit(0)), False
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > least)
    hot = [r.asDict() for r in counts.collect()]
    if not hot:
        return df.withColumn(CHUNK, F.lit(0)), False
    spark = df.sparkSession
    parts = min(MAX_CHUNKS, max(2, -(-max(h["__n"] for h in hot) // least) * 2))
    marks = [i / parts for i in range(1, parts)]
    schema = df.select(*keys).schema
    hot_df = F.broadcast(spark.createDataFrame([tuple(h[k] for k in keys) for h in hot], schema))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    cuts = (
        df.alias("r").join(hot_df.alias("h"), same, "left_semi")
        .groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx(order, marks, 2000))).alias("__cuts"))
    )
    cuts = spark.createDataFrame(cuts.collect(), cuts.schema)
    out = (
        df.alias("r").join(F.broadcast(cuts).alias("h"), same, "left")
        .select("r.*", F.when(F.col("h.__cuts").isNull() | F.col(f"r.{order}").isNull(), F.lit(0)).otherwise(F.size(F.filter("h.__cuts", lambda c: c < F.col(f"r.{order}")))).alias(CHUNK))
    )
    return out, True


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, tuple[str, Column, bool]],
    chunked: bool,
) -> DataFrame:
    """Add running values over rows in ``order`` within ``keys``.

    ``values`` maps the new column to (kind, value, inclusive); kind is ``last``
    (the last value that isn't null), ``max`` or ``sum``. A row without a
    predecessor gets null (sum: 0 if exclusive).
    """
    local = W.partitionBy(*keys, CHUNK).orderBy(*order)
    before, upto = local.rowsBetween(W.unboundedPreceding, -1), local.rowsBetween(W.unboundedPreceding, 0)
    make = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max, "sum": lambda c: F.sum(c)}
    add = {n: make[k](v).over(upto if inc else before) for n, (k, v, inc) in values.items()}
    out = df.withColumns(add)
    if chunked:
        at = F.struct(*[F.col(o) for o in order])
        whole = {
            "last": lambda v: F.max_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), at)),
            "max": F.max,
            "sum": F.sum,
        }
        per = df.groupBy(*keys, CHUNK).agg(*[whole[k](v).alias(f"__c_{n}") for n, (k, v, _) in values.items()])
        earlier = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
        per = per.select(
            *[F.col(k).alias(f"__k_{k}") for k in keys], F.col(CHUNK).alias("__k_chunk"),
            *[make[k](F.col(f"__c_{n}")).over(earlier).alias(f"__c_{n}") for n, (k, _, _) in values.items()],
        )
        out = out.join(per, [*[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col(CHUNK) == F.col("__k_chunk")], "left")
        both = {
            "last": lambda a, b: F.coalesce(a, b),
            "max": lambda a, b: F.greatest(a, b),
            "sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
        }
        out = out.withColumns({n: both[k](F.col(n), F.col(f"__c_{n}")) for n, (k, _, _) in values.items()})
        out = out.drop(*[f"__c_{n}" for n in values], *[f"__k_{k}" for k in keys], "__k_chunk")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n, (k, _, _) in values.items() if k == "sum"})
