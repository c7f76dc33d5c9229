"""Transcript bodies of any common format to segments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralake.functions.scalar import col

_SEGMENTS = "array<struct<start_s:double,end_s:double,text:string>>"
_CUE = r"((?:\d{1,2}:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*((?:\d{1,2}:)?\d{1,2}:\d{2}[.,]\d{1,3})"
_STAMP = r"^\s*\[?\(?((?:\d{1,2}:)?\d{1,2}:\d{2})\)?\]?\s*$"


def kind_of(body: Column | str) -> Column:
    """Json, cues (SRT and VTT), stamped, html or plain by what the body looks like; null for nothing."""
    b = F.trim(col(body))
    return (
        F.when(b.isNull() | (b == ""), F.lit(None)).when(b.rlike(r"^[\[{]"), "json").when(b.rlike(_CUE), "cues").when(b.rlike(f"(?m){_STAMP}"), "stamped")
        .when(b.rlike(r"(?i)<(?:html|body|p|div|br)\b"), "html").otherwise("plain")
    )


def seconds(stamp: Column) -> Column:
    """Seconds of [HH:]MM:SS[.mmm]."""
    p = F.transform(F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":"), lambda x: x.try_cast("double"))
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc * 60 + x)


def strip_html(c: Column | str) -> Column:
    """Text of HTML without script, style, nav, header and footer; blanks collapsed."""
    t = F.regexp_replace(col(c), r"(?is)<(script|style|nav|header|footer)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def cue_segments(body: Column) -> Column:
    """Segments of SRT or VTT: blocks apart by blank lines, tags and cue numbers taken off, empty cues dropped."""
    blocks = F.filter(F.split(F.regexp_replace(body, r"\r\n?", "\n"), r"\n\s*\n"), lambda b: b.rlike(_CUE))

    def one(b: Column) -> Column:
        text = F.regexp_replace(b, rf"(?s)^.*?{_CUE}[^\n]*\n?", "")
        lines = F.filter(F.split(F.regexp_replace(text, r"<[^>]+>", ""), r"\n"), lambda x: ~F.trim(x).rlike(r"^\d*$"))
        return F.struct(seconds(F.regexp_extract(b, _CUE, 1)).alias("start_s"), seconds(F.regexp_extract(b, _CUE, 2)).alias("end_s"), F.trim(F.regexp_replace(F.array_join(lines, " "), r"\s+", " ")).alias("text"))

    return F.filter(F.transform(blocks, one), lambda s: s["text"] != "")


def json_segments(body: Column) -> Column:
    """Segments of JSON with body or text, startTime or start, endTime or end."""
    item = "struct<startTime:double,start:double,endTime:double,end:double,body:string,text:string>"
    segs = F.coalesce(F.from_json(body, f"struct<segments:array<{item}>>")["segments"], F.from_json(body, f"array<{item}>"))
    out = F.transform(segs, lambda s: F.struct(F.coalesce(s["startTime"], s["start"]).alias("start_s"), F.coalesce(s["endTime"], s["end"]).alias("end_s"), F.trim(F.coalesce(s["body"], s["text"])).alias("text")))
    return F.filter(out, lambda s: s["text"].isNotNull() & (s["text"] != ""))


def stamped_segments(body: Column) -> Column:
    """Text between lines that are times; a segment ends where the next begins, the last has no end."""
    lines = F.transform(F.split(F.regexp_replace(body, r"\r\n?", "\n"), "\n"), lambda x: F.trim(x))
    empty = F.lit(None).cast(_SEGMENTS)
    start = F.struct(F.coalesce(empty, F.array().cast(_SEGMENTS)).alias("done"), F.lit(None).cast("double").alias("at"), F.lit("").alias("buf"))

    def close(acc: Column, end: Column) -> Column:
        seg = F.array(F.struct(acc["at"].alias("start_s"), end.alias("end_s"), F.trim(acc["buf"]).alias("text")))
        return F.when((F.trim(acc["buf"]) != "") & acc["at"].isNotNull(), F.concat(acc["done"], seg)).otherwise(acc["done"])

    def step(acc: Column, line: Column) -> Column:
        t = seconds(F.regexp_extract(line, _STAMP, 1))
        stamp = line.rlike(_STAMP)
        return F.struct(F.when(stamp, close(acc, t)).otherwise(acc["done"]).alias("done"), F.when(stamp, t).otherwise(acc["at"]).alias("at"), F.when(stamp, F.lit("")).otherwise(F.concat_ws(" ", acc["buf"], line)).alias("buf"))

    return F.aggregate(lines, start, step, lambda acc: close(acc, F.lit(None).cast("double")))


def parse_transcripts(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, kind, seg_index, start_s, end_s, text) of transcript bodies; a body without text gives no rows.

    Broken JSON gives no rows. Each body is parsed where it is, by expressions.
    """
    staged = df.select(key, F.col(body).alias("__b"), kind_of(body).alias("kind"))
    whole = lambda t: F.array(F.struct(F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s"), t.alias("text")))
    b = F.col("__b")
    segs = (
        F.when(F.col("kind") == "json", json_segments(b)).when(F.col("kind") == "cues", cue_segments(b)).when(F.col("kind") == "stamped", stamped_segments(b))
        .when(F.col("kind") == "html", whole(strip_html(b))).otherwise(whole(F.trim(F.regexp_replace(b, r"\s+", " "))))
    )
    return staged.withColumn("__s", segs).select(key, "kind", F.posexplode("__s").alias("seg_index", "s")).select(key, "kind", "seg_index", "s.*").filter("text is not null and text <> ''")
