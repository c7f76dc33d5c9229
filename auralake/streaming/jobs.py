"""Usage buckets with late data, snapshot replacement, idempotent stores, leases with expiry.

Event time is the time of the reservation, so a completion that comes late is
counted in its original bucket as long as the watermark allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def usage_buckets(events: DataFrame, window: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Events and their total per key and tumbling bucket, batch or stream (with a watermark)."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    return src.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("bucket"), "event_type", "n", "total")


def sliding_rate(events: DataFrame, window: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Events per sliding window."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    return src.groupBy(F.window("ts", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("w_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: sessions per user: events no more than ``gap`` apart."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    return src.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("s_start"), F.col("w.end").alias("s_end"), "n")


def replace_snapshots(path: str, day: str = "captured_on") -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that replaces the partitions of the days a batch holds (a day's snapshot is the last delivered)."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)

    return write


def label_store(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of attempts: each batch is one folder under its id, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def label_view(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: its first success (which clears failures), else its last failure; and the number of attempts."""
    w = W.partitionBy(*keys)
    ranked = attempts.withColumn("__ok", F.when(F.col("ok"), 0).otherwise(1))
    order = [F.col("__ok"), F.when(F.col("ok"), F.col("at")).asc_nulls_last(), F.col("at").desc()]
    return ranked.withColumns({"n_attempts": F.count(F.lit(1)).over(w), "__n": F.row_number().over(w.orderBy(*order))}).filter("__n = 1").drop("__n", "__ok")


def read_store(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    except AnalysisException:
        return None


_LEASE_OUT = "scope string, lease_id string, granted boolean, active int"
_LEASE_STATE = "leases string"


def grant_leases(requests: DataFrame, limit: int, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Grants of leases per scope with a limit on those active at once; a lease ends when released or when its time is over.

    requests (a stream): scope, lease_id, action ('take' or 'release'), ts. A
    take of an active lease is granted again without counting twice.
    """
    import json

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            state.remove()
            return
        rows = []
        for pdf in batches:
            for r in pdf.sort_values(["ts", "lease_id"]).itertuples():
                now = r.ts.timestamp()
                held = {k: t for k, t in held.items() if t > now}
                if r.action == "release":
                    held.pop(r.lease_id, None)
                    continue
                ok = r.lease_id in held or len(held) < limit
                if ok:
                    held[r.lease_id] = now + ttl_seconds
                rows.append((key[0], r.lease_id, ok, len(held)))
        state.update((json.dumps(held),))
        if held:
            wm = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(int(max(held.values()) * 1000), wm + 1))
        yield pd.DataFrame(rows, columns=["scope", "lease_id", "granted", "active"])

    return requests.withWatermark("ts", late).groupBy("scope").applyInPandasWithState(step, _LEASE_OUT, _LEASE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
