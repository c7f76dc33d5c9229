"""Archived chart pages, feeds and capture listings to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralake.functions.scalar import clean_html, parse_duration


def parse_listing(df: DataFrame, key: str, body: str) -> DataFrame:
    """Rows of a capture listing (a JSON array of arrays with a header row).

    (key, trusted, at, original, status, mime, digest): '[]' is a true empty
    listing (trusted, no rows); an empty or malformed body is not trusted. Every
    key keeps at least one row, of nulls where it lists nothing.
    """
    rows = F.from_json(F.col(body), "array<array<string>>")
    header = F.get(rows, F.lit(0))
    trusted = rows.isNotNull() & ((F.size(rows) == 0) | (F.coalesce(F.array_contains(header, "timestamp"), F.lit(False)) & F.forall(rows, lambda r: F.size(r) == F.size(header))))
    d = df.select(key, rows.alias("r"), header.alias("h"), F.coalesce(trusted, F.lit(False)).alias("trusted"))
    body_rows = F.when(F.col("trusted") & (F.size("r") > 1), F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(1))))
    d = d.withColumn("x", F.explode_outer(body_rows))
    pick = lambda n: F.get("x", F.array_position("h", n).cast("int") - 1)
    return d.select(key, "trusted", pick("timestamp").alias("at"), pick("original").alias("original"), pick("statuscode").alias("status"), pick("mimetype").alias("mime"), pick("digest").alias("digest"))


def parse_ranked_json(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """Ranked rows of a JSON array; the unit is episode where items carry an episode, else show. Broken JSON gives none."""
    items = F.from_json(F.col(body), "array<struct<showUri:string,showName:string,showPublisher:string,episodeUri:string,episodeName:string>>")
    x = df.select(*keys, F.posexplode(items).alias("pos", "i"))
    return x.select(*keys, (F.col("pos") + 1).alias("rank"), F.when(F.col("i.episodeUri").isNotNull(), "episode").otherwise("show").alias("unit"), F.coalesce("i.episodeName", "i.showName").alias("name"), F.col("i.showPublisher").alias("publisher"), F.coalesce("i.episodeUri", "i.showUri").alias("entity_id"))


def chart_slug(c: Column) -> Column:
    """struct(region, genre, page) of a slug like 'itunes/us-arts-podcasts?page=2'."""
    bare = F.regexp_replace(c, r"[?&].*$", "")
    return F.struct(
        F.regexp_extract(bare, r"(?:^|/)([a-z]{2})-", 1).alias("region"), F.regexp_replace(F.regexp_extract(bare, r"(?:^|/)[a-z]{2}-(.*)$", 1), r"-podcasts$", "").alias("genre"),
        F.coalesce(F.nullif(F.regexp_extract(c, r"[?&]page=(\d+)", 1), F.lit("")).try_cast("int"), F.lit(1)).alias("page"),
    )


def parse_ranked_html(df: DataFrame, keys: list[str], body: str, row: str = r"(?s)<tr\b.*?</tr>") -> DataFrame:
    """Rank, name and link of each row of a chart table; the first row of a rank counts."""
    rows = F.regexp_extract_all(F.col(body), F.lit(f"({row})"), F.lit(1))
    x = df.select(*keys, F.posexplode(rows).alias("pos", "r"))
    rank = F.regexp_extract("r", r"(?s)<td[^>]*>\s*(?:<[^>]+>\s*)*(\d{1,4})\b", 1).try_cast("int")
    link = F.regexp_extract("r", r"""href=["']([^"']+)["']""", 1)
    name = F.trim(F.regexp_replace(F.regexp_extract("r", r"(?s)<a\b[^>]*>(.*?)</a>", 1), r"(?:<[^>]+>|\s)+", " "))
    t = x.select(*keys, "pos", rank.alias("rank"), name.alias("name"), F.nullif(link, F.lit("")).alias("entity_url")).filter("rank is not null and name <> ''")
    return t.groupBy(*keys, "rank").agg(F.min_by(F.struct("name", "entity_url"), "pos").alias("v")).select(*keys, "rank", "v.*")


def salvage_items(c: Column, marker: str) -> Column:
    """JSON objects behind a marker in a page, also where the page breaks off: only objects that are whole (without nesting)."""
    tail = F.regexp_extract(c, rf"(?s){marker}(.*)$", 1)
    return F.regexp_extract_all(tail, F.lit(r"(\{[^{}]*\})"), F.lit(1))


def parse_feed(df: DataFrame, key: str, body: str) -> DataFrame:
    """Items of an RSS feed: (key, pos, guid, title, published, duration_seconds, audio_url, description).

    Only items with an audio enclosure count, the first enclosure each; the guid
    falls back to the link, then the enclosure, then the title. Malformed XML
    gives what items are whole.
    """
    items = F.regexp_extract_all(F.col(body), F.lit(r"(?s)(<item\b.*?</item>)"), F.lit(1))
    x = df.select(key, F.posexplode(items).alias("pos", "i"))

    def tag(n: str) -> Column:
        v = F.regexp_extract("i", rf"(?s)<{n}\b[^>]*>(.*?)</{n}>", 1)
        return F.nullif(F.trim(F.regexp_replace(v, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")), F.lit(""))

    enclosures = F.regexp_extract_all(F.col("i"), F.lit(r"(<enclosure\b[^>]*>)"), F.lit(1))
    audio = F.get(F.filter(enclosures, lambda e: e.rlike(r"""type=["']audio/""") | e.rlike(r"""url=["'][^"']+\.(?:mp3|m4a)\b""")), F.lit(0))
    url = F.nullif(F.regexp_extract(audio, r"""url=["']([^"']+)["']""", 1), F.lit(""))
    t = x.select(key, "pos", tag("guid").alias("g"), tag("link").alias("l"), tag("title").alias("title"), tag("pubDate").alias("published"), parse_duration(tag("itunes:duration")).alias("duration_seconds"), F.replace(url, F.lit("&amp;"), F.lit("&")).alias("audio_url"), clean_html(tag("description")).alias("description"))
    return t.filter("audio_url is not null").select(key, "pos", F.coalesce("g", "l", "audio_url", "title").alias("guid"), "title", "published", "duration_seconds", "audio_url", "description")


def parsed_and_failed(df: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """(key, n_rows, failed): how many rows each capture gave; one that gave none failed. The run never aborts."""
    n = parsed.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return df.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.col("n_rows").isNull().alias("failed"))
