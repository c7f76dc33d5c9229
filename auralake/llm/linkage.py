"""Problem 6: matching shows and raw search records that share no key.

Collective graph linkage. Attributes are pairs of words (two of the title, or
one of the title and one of the publisher); rare ones weigh more. Records that
share attributes are edges of a candidate graph; meta-blocking keeps an edge
whose weight is at least a share of the greatest at either end. Each edge gets a
similarity from title, publisher, dates, counts and genre; similarity is then
propagated until it is stable, and can carry an edge over the threshold or under it:
- two differing publisher names between which several other shows match are one
  publisher, so what speaks for their shows apart from the name counts;
- a record without a publisher is judged by its neighbours of the same feed: by what
  these are to the same podcast (and likewise a podcast by those of its feed).
The best podcast of a result with a confidence over the threshold is its match.
Records that are equal in all attributes are one class until the end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.llm.neardup import fold, near
from auralake.session import cut, written

THRESHOLD = 0.5
#: Share of the greatest weight at either end that an edge must reach.
PRUNE = 0.5
#: Weight of what neighbours say, and when it is stable; without stability within MAX_ROUNDS an error is raised.
ALPHA, EPSILON, MAX_ROUNDS = 0.5, 0.005, 50
#: Matching shows that make two publisher names one, and how alike a show must be apart from its publisher to count.
ALIAS_SHOWS, ALIAS_LEAST = 3, 0.8

# Words that name no show or publisher.
TITLE_STOP = frozenset("the a an of at and podcast show tm".split())
PUBLISHER_STOP = frozenset("the by ltd inc llc gmbh network radio productions audio collective media studios studio and co".split())
_WORD = re.compile(r"[^\W\d_]+")
_SUBTITLE = re.compile(r"\s[-–—|]\s|:\s|\s\(|\s\[")

_SIDE = "key string, title array<string>, head array<string>, publisher array<string>, day int, count int, genres array<string>, feed string, attrs array<string>"


def _words(s: str | None, stop: frozenset[str]) -> list[str]:
    if not isinstance(s, str):
        return []
    return [w for w in _WORD.findall(fold(s)) if w not in stop]


def _day(s) -> int | None:
    if not isinstance(s, str):
        return None
    try:
        return (date.fromisoformat(s[:10]) - date(1970, 1, 1)).days
    except ValueError:
        return None


def _attributes(title: list[str], publisher: list[str]) -> list[str]:
    t, p = sorted(set(title)), sorted(set(publisher))
    two = [f"t {a} {b}" for i, a in enumerate(t) for b in t[i + 1 :]] or [f"s {a}" for a in t]
    return two + [f"p {a} {b}" for a in t for b in p]


def read_record(text) -> dict:
    """The fields of a raw record; of broken JSON those that are whole."""
    if not isinstance(text, str):
        return {}
    try:
        r = json.loads(text)
        return r if isinstance(r, dict) else {}
    except ValueError:
        out: dict = {}
        for k, v in re.findall(r'"(\w+)":\s*("(?:[^"\\]|\\.)*"|-?\d+(?=[,}\s]))', text):
            try:
                out[k] = json.loads(v)
            except ValueError:
                continue
        return out


def _feed(url) -> str | None:
    return re.sub(r"^https?://(?:www\.)?", "", url.strip().lower()).rstrip("/") or None if isinstance(url, str) else None


def _side(title, publisher, day, count, genres, feed) -> tuple:
    t = _words(title, TITLE_STOP)
    head = _words(_SUBTITLE.split(title)[0], TITLE_STOP) if isinstance(title, str) else []
    p = _words(publisher, PUBLISHER_STOP)
    n = int(count) if isinstance(count, (int, float)) and not isinstance(count, bool) and count == count and 0 < count < 2**31 else None
    g = sorted({x for x in genres if isinstance(x, str)})
    return t, head, p, day, n, g, _feed(feed), _attributes(t, p)


def _key(side: tuple) -> str:
    import xxhash

    return xxhash.xxh128_hexdigest(repr(side))


def _podcast_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, t, p, d, n, c, f in zip(*[pdf[x] for x in ("id", "title", "publisher", "latest_episode_date", "episode_count", "categories", "feed")]):
            try:
                genres = json.loads(c) if isinstance(c, str) else []
            except ValueError:
                genres = []
            s = _side(t, p, _day(d), n, genres if isinstance(genres, list) else [], f)
            rows.append((i, _key(s), *s))
        yield _frame(rows)


def _result_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, text in zip(pdf["id"], pdf["record"]):
            r = read_record(text)
            s = _side(r.get("collectionName"), r.get("artistName"), _day(r.get("releaseDate")), r.get("trackCount"), [r.get("primaryGenreName")], r.get("feedUrl"))
            rows.append((i, _key(s), *s))
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["id", "key", "title", "head", "publisher", "day", "count", "genres", "feed", "attrs"]).astype({"day": "Int32", "count": "Int32"})


def _loosely(x: str, y: str) -> bool:
    """One edit apart, or two in words of 6 letters and more."""
    if near(x, y):
        return True
    if min(len(x), len(y)) < 6 or abs(len(x) - len(y)) > 2:
        return False
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1] <= 2


def found_again(a: list[str], b: list[str], close) -> float:
    """Share of the words of the shorter list that the longer holds, each once."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    left, hit = list(b), 0
    for w in sorted(a, key=lambda w: w not in left):
        k = left.index(w) if w in left else next((k for k, v in enumerate(left) if close(w, v)), None)
        if k is not None:
            del left[k]
            hit += 1
    return hit / len(a)


def similarity(p: dict, r: dict) -> tuple[float, float | None]:
    """(how alike a podcast and a result are without their neighbours, the same without their publishers).

    The title must be found whole (up to typing errors), else the second value is
    None; then the publisher decides, and where one side has none, dates, counts
    and genre do.
    """
    t1, t2 = list(p["title"]), list(r["title"])
    title = max(found_again(t1, t2, _loosely) if len(t2) >= len(t1) or not t2 else 0.0, found_again(t1, list(r["head"]), _loosely) * (len(r["head"]) >= len(t1)), found_again(list(p["head"]), t2, _loosely) * (len(t2) >= len(p["head"]) >= 2))
    if title < 1:
        return 0.3 * title, None
    days = abs(p["day"] - r["day"]) if p["day"] is not None and r["day"] is not None else None
    off = abs(p["count"] - r["count"]) if p["count"] is not None and r["count"] is not None else None
    few = off is not None and off <= max(4, 0.05 * p["count"])
    far = off is not None and max(p["count"], r["count"]) > 1.8 * min(p["count"], r["count"]) and off > 10
    genre = bool(set(p["genres"]) & set(r["genres"])) if len(p["genres"]) and len(r["genres"]) else None
    support = 0.03 * ((days is not None and days <= 45) + bool(few) + bool(genre))
    if days is not None:
        alone = 0.8 + support if days <= 45 else 0.2
    elif off is not None:
        alone = 0.8 + support if few else 0.25 if far else 0.6
    else:
        alone = 0.55 if genre is False else 0.7
    if len(p["publisher"]) and len(r["publisher"]):
        same = found_again(list(p["publisher"]), list(r["publisher"]), _loosely)
        return (0.88 + support if same == 1 else 0.15 + 0.2 * same), alone
    return alone, alone


def _score_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    none = lambda v: None if pd.isna(v) else int(v)
    for pdf in batches:
        out = []
        for x in pdf.to_dict("records"):
            p = {k: x[f"p_{k}"] for k in ("title", "head", "publisher", "genres")} | {k: none(x[f"p_{k}"]) for k in ("day", "count")}
            r = {k: x[f"r_{k}"] for k in ("title", "head", "publisher", "genres")} | {k: none(x[f"r_{k}"]) for k in ("day", "count")}
            out.append((x["p_key"], x["r_key"], *similarity(p, r), " ".join(sorted(p["publisher"])), " ".join(sorted(r["publisher"])), " ".join(sorted(p["title"])), x["p_feed"], x["r_feed"]))
        yield pd.DataFrame(out, columns=["p_key", "r_key", "s0", "alone", "p_party", "r_party", "show", "p_feed", "r_feed"])


def propagate(scored: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Edges (p_key, r_key, s0, alone, p_party, r_party, show, p_feed, r_feed) with their stable similarity ``s``.

    Only edges whose titles match take part. What neighbours say are sums over
    groups (two publishers; a podcast and a feed), joined back: no pairs of edges
    are formed. Raises an error if it isn't stable after MAX_ROUNDS.
    """
    c = F.col
    edges = cut(scored.filter("alone is not null").withColumn("s", c("s0")))
    named = (c("p_party") != "") & (c("r_party") != "")
    for _ in range(MAX_ROUNDS):
        top = edges.groupBy("r_key").agg(F.max("s").alias("top"))
        # a show tells of its two publishers if its record has no better podcast
        says = edges.filter(named).join(top, "r_key").filter((c("alone") >= ALIAS_LEAST) & (c("s") >= c("top")))
        alias = says.groupBy("p_party", "r_party").agg(F.countDistinct("show").alias("shows"), F.avg("alone").alias("n_alias")).filter(c("shows") >= ALIAS_SHOWS).drop("shows")
        by_record = edges.filter(named & c("r_feed").isNotNull()).groupBy("p_key", "r_feed").agg(F.sum("s").alias("sum_r"), F.count(F.lit(1)).alias("n_r"))
        by_show = edges.filter(named & c("p_feed").isNotNull()).groupBy("r_key", "p_feed").agg(F.sum("s").alias("sum_p"), F.count(F.lit(1)).alias("n_p"))
        told = edges.join(alias, ["p_party", "r_party"], "left").join(by_record, ["p_key", "r_feed"], "left").join(by_show, ["r_key", "p_feed"], "left")
        zero = lambda x: F.coalesce(x, F.lit(0))
        feeds = (zero(c("sum_r")) + zero(c("sum_p"))) / (zero(c("n_r")) + zero(c("n_p")))
        # 0.08 is what one name adds to a show that matches apart from it
        mixed = lambda n: (1 - alpha) * c("s0") + alpha * n
        new = F.when(named & c("n_alias").isNotNull() & (c("alone") >= ALIAS_LEAST), F.greatest("s", mixed(c("n_alias") + 0.08))).when(~named & (zero(c("n_r")) + zero(c("n_p")) > 0), mixed(feeds)).otherwise(c("s"))
        moved = cut(told.select(*[x for x in edges.columns if x != "s"], new.alias("s"), F.abs(new - c("s")).alias("step")))
        far = moved.agg(F.max("step")).first()[0] or 0.0
        edges = moved.drop("step")
        if far < EPSILON:
            return edges
    raise RuntimeError("similarities did not settle")


def match_shows(podcasts: DataFrame, results: DataFrame, threshold: float = THRESHOLD, alpha: float = ALPHA) -> DataFrame:
    """(podcast_id, result_id, confidence) of the pairs that describe one show.

    A result has at most one podcast (of equal confidence the least key's
    class, with all its equal podcasts); a podcast may have several results or
    none. Null ids, records without a title and broken JSON without a whole
    title give no match; repeated rows count once; empty tables give an empty
    result; further columns are ignored.
    """
    p = podcasts.filter("id is not null").select(F.col("id").cast("long"), "title", "publisher", "latest_episode_date", "episode_count", "categories", F.col("rss_url").alias("feed") if "rss_url" in podcasts.columns else F.lit(None).cast("string").alias("feed")).distinct()
    r = results.filter("result_id is not null").select(F.col("result_id").cast("long").alias("id"), "record").distinct()
    p = written(p.mapInPandas(_podcast_batches, f"id long, {_SIDE}"), "shows")
    r = written(r.mapInPandas(_result_batches, f"id long, {_SIDE}"), "records")
    body = ("title", "head", "publisher", "day", "count", "genres", "feed")

    def classes(df: DataFrame, tag: str) -> DataFrame:
        one = df.groupBy("key").agg(F.min(F.struct(*body, "attrs")).alias("v"))
        return one.select(F.col("key").alias(f"{tag}_key"), *[F.col(f"v.{c}").alias(f"{tag}_{c}") for c in (*body, "attrs")])

    pc, rc = classes(p, "p"), classes(r, "r")
    pa, ra = pc.select("p_key", F.explode("p_attrs").alias("attr")), rc.select("r_key", F.explode("r_attrs").alias("attr"))
    df = pa.groupBy("attr").agg(F.count(F.lit(1)).alias("np")).join(ra.groupBy("attr").agg(F.count(F.lit(1)).alias("nr")), "attr")
    rare = df.select("attr", (1 / F.log2(1 + F.col("np") + F.col("nr"))).alias("weight"))
    edges = pa.join(rare, "attr").join(ra, "attr").groupBy("p_key", "r_key").agg(F.sum("weight").alias("weight"))
    edges = written(edges, "candidates")
    top_p = edges.groupBy("p_key").agg(F.max("weight").alias("top_p"))
    top_r = edges.groupBy("r_key").agg(F.max("weight").alias("top_r"))
    kept = edges.join(top_p, "p_key").join(top_r, "r_key").filter((F.col("weight") >= PRUNE * F.col("top_p")) | (F.col("weight") >= PRUNE * F.col("top_r")))
    full = kept.select("p_key", "r_key").join(pc.drop("p_attrs"), "p_key").join(rc.drop("r_attrs"), "r_key")
    scored = full.mapInPandas(_score_batches, "p_key string, r_key string, s0 double, alone double, p_party string, r_party string, show string, p_feed string, r_feed string")
    scored = propagate(scored, alpha)
    best = scored.filter(F.col("s") >= threshold).groupBy("r_key").agg(F.max(F.struct("s", "p_key")).alias("m")).select("r_key", "m.p_key", F.round("m.s", 4).alias("confidence"))
    ids = best.join(p.select(F.col("id").alias("podcast_id"), F.col("key").alias("p_key")), "p_key").join(r.select(F.col("id").alias("result_id"), F.col("key").alias("r_key")), "r_key")
    return ids.groupBy("podcast_id", "result_id").agg(F.max("confidence").alias("confidence"))
