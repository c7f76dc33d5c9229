"""JSONL and Parquet sources and sinks, with a manifest that is checked before reads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSCRIPT = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("source", T.StringType()), T.StructField("language", T.StringType()), T.StructField("index", T.IntegerType()),
    T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType()),
])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, plain or compressed by the file's ending; a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, codec: str = "gzip") -> tuple[int, str]:
    """Canonical rows (columns in name order, nulls kept) as compressed JSON lines; (rows, fingerprint).

    The fingerprint sums row hashes, so it doesn't depend on the order of rows.
    """
    rows = df.select(*sorted(df.columns))
    rows.write.mode("errorifexists").option("compression", codec).option("ignoreNullFields", "false").json(path)
    n, h = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).cast("decimal(38,0)"))).first()
    return n, str(h or 0)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(episode_id, source, seg_index, start_s, end_s, text) of transcript files named episode_<id>.jsonl[.zst].

    Where a file has no segment, its summary is one untimed segment.
    """
    raw = read_jsonl(spark, path, TRANSCRIPT).withColumn("episode_id", F.regexp_extract(F.input_file_name(), r"episode_(\d+)", 1).try_cast("long"))
    source = raw.filter("type = 'metadata'").groupBy("episode_id").agg(F.first("source").alias("source"))
    cols = ["episode_id", F.col("index").alias("seg_index"), F.col("start").alias("start_s"), F.col("end").alias("end_s"), "text"]
    seg = raw.filter("type = 'segment'").select(*cols)
    rest = raw.filter("type = 'summary' and text is not null and text <> ''").join(seg.select("episode_id").distinct(), "episode_id", "left_anti")
    rest = rest.select("episode_id", F.lit(0).alias("seg_index"), F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s"), "text")
    return seg.unionByName(rest).join(source, "episode_id", "left").select("episode_id", "source", "seg_index", "start_s", "end_s", "text")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A zstd Parquet table; empty tables keep their schema."""
    w = df.write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


SHARDS = 64


def build_corpus(segments: DataFrame, path: str, shards: int = SHARDS) -> dict:
    """Corpus rows (episode_id, seg_index, text) in shards of pmod(episode_id, shards), and a manifest.

    Refuses a path that exists. Blanks are collapsed; null texts are left out;
    equal rows count once. A shard with a hot episode is spread over several
    files by seg_index.
    """
    spark = segments.sparkSession
    rows = segments.select("episode_id", "seg_index", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")).filter("text is not null and text <> ''").distinct()
    rows = rows.withColumn("shard", F.pmod("episode_id", F.lit(shards)).cast("int"))
    rows.repartition("shard", F.pmod(F.xxhash64("episode_id", "seg_index"), F.lit(8))).write.mode("errorifexists").option("compression", "zstd").partitionBy("shard").parquet(f"{path}/rows")
    back = spark.read.parquet(f"{path}/rows")
    n, e = back.agg(F.count(F.lit(1)), F.countDistinct("episode_id")).first()
    manifest = {"rows": n, "episodes": e, "shards": shards}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    return manifest


def open_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a corpus whose manifest is there and fits; else an error."""
    lines = spark.read.text(f"{path}/manifest").limit(2).collect()
    if len(lines) != 1:
        raise ValueError("the manifest of the corpus is damaged")
    manifest = json.loads(lines[0][0])
    rows = spark.read.parquet(f"{path}/rows")
    if rows.count() != manifest["rows"]:
        raise ValueError("the corpus does not hold the rows of its manifest")
    return rows


def episode_rows(corpus: DataFrame, episode_id: int, shards: int = SHARDS) -> DataFrame:
    """Rows of one episode; the shard is derived so that other partitions are pruned."""
    return corpus.filter((F.col("shard") == episode_id % shards) & (F.col("episode_id") == episode_id))


def read_ids(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """Distinct episode ids of a list (one a line) or a column of a CSV file."""
    if column:
        ids = spark.read.option("header", True).csv(path).select(F.col(column).try_cast("long").alias("episode_id"))
    else:
        ids = spark.read.text(path).select(F.trim("value").try_cast("long").alias("episode_id"))
    return ids.filter("episode_id is not null").distinct()


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def union_tables(*tables: DataFrame) -> DataFrame:
    """Rows of tables by column name; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def flatten_usage(df: DataFrame, keys: list[str], usage: str, paths: dict[str, str]) -> DataFrame:
    """JSON usage as integer columns (name -> JSON path); missing or broken values are null."""
    return df.select(*keys, *[F.get_json_object(usage, p).try_cast("long").alias(n) for n, p in paths.items()])


def publish_scan(episodes: DataFrame, counts: DataFrame, sentences: DataFrame, path: str) -> dict:
    """The three tables of a scan and, last, their manifest: without it nothing counts as published. Refuses an existing path."""
    spark = episodes.sparkSession
    manifest = {}
    for name, df in (("episodes", episodes), ("counts", counts), ("sentences", sentences)):
        write_table(df, f"{path}/{name}")
        manifest[name] = spark.read.parquet(f"{path}/{name}").count()
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    return manifest
