"""Selecting and planning: windows to episodes with caps, captures, imports, tiers of matches, second postings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auralake.functions.scalar import norm_title, title_key
from auralake.session import broadcast_if_small, written


def first_window(candidates: DataFrame, episode: str, order: Sequence[str]) -> DataFrame:
    """W21 (no cap): each episode once, in the first of its windows by ``order``, with its place in that window."""
    rest = [c for c in candidates.columns if c != episode]
    one = candidates.groupBy(episode).agg(F.min_by(F.struct(*rest), F.struct(*order, episode)).alias("r")).select(episode, "r.*")
    return one.select(*candidates.columns)


def select_with_caps(candidates: DataFrame, cap: int) -> DataFrame:
    """Per entity, windows in order of start take at most ``cap`` episodes not yet taken: own ones first, finished ones first, the rest evenly spaced in time.

    What a window takes depends on the windows before it, so an entity's
    candidates are scanned in order (an entity's windows and episodes, not a table).
    candidates: entity, win_start, episode_id, day, own (boolean), done (boolean).
    """

    def centres(pool: list, n: int) -> list:
        """The middle one of each of ``n`` equal parts of the pool in order of time; all of a pool that isn't larger."""
        inorder = sorted(pool, key=lambda r: (r[1], r[0]))
        m = len(inorder)
        return inorder if m <= n else [inorder[m * odd // (2 * n)] for odd in range(1, 2 * n, 2)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out, entity = set(), [], pdf["entity"].iloc[0]
        for start, part in sorted(pdf.groupby("win_start"), key=lambda x: x[0]):
            free = [(e, d, o, k) for e, d, o, k in zip(part["episode_id"], part["day"], part["own"], part["done"]) if e not in taken]
            picked: list = []
            for own in (True, False):
                for done in (True, False):
                    pool = list({r[0]: r for r in free if bool(r[2]) == own and bool(r[3]) == done and r[0] not in {p[0] for p in picked}}.values())
                    picked += centres(pool, max(0, cap - len(picked)))
            taken |= {r[0] for r in picked}
            out += [(entity, start, r[0], i) for i, r in enumerate(sorted(picked, key=lambda r: (r[1], r[0])), 1)]
        return pd.DataFrame(out, columns=["entity", "win_start", "episode_id", "priority"])

    return candidates.groupBy("entity").applyInPandas(run, "entity string, win_start date, episode_id long, priority int")


def rank_captures(captures: DataFrame, keys: Sequence[str], target: Column, at: str, direct: Column) -> DataFrame:
    """Z3: the captures of each key, direct hits before redirects, then by distance in time (of two equally far the earlier)."""
    w = W.partitionBy(*keys).orderBy(F.when(direct, 0).otherwise(1), F.abs(F.date_diff(F.to_date(at), target)), at)
    return captures.withColumn("place", F.row_number().over(w))


def choose_capture(captures: DataFrame, keys: Sequence[str], point: str, at: str, lag_days: int, floor: str) -> DataFrame:
    """Per key the first capture in [point, point + lag], else the last one in (floor, point); keys without either are left out."""
    d = F.to_date(at)
    after = F.min(F.when((d >= F.col(point)) & (d <= F.date_add(point, lag_days)), F.col(at)))
    before = F.max(F.when((d > F.col(floor)) & (d < F.col(point)), F.col(at)))
    return captures.groupBy(*keys).agg(F.coalesce(after, before).alias("chosen")).filter("chosen is not null")


def next_captures(captures: DataFrame, targets: DataFrame) -> DataFrame:
    """Per entity each window (in order of end) takes its earliest unused capture at or after the moving frontier, else the latest unused one inside it.

    Captures of a digest already taken are skipped. captures: entity, day, digest;
    targets: entity, win_start, win_end. An entity's windows depend on each other.
    """

    def run(key: tuple, caps: pd.DataFrame, wins: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(set(zip(caps["day"], caps["digest"])))
        used, frontier, out = set(), None, []
        for start, end in sorted(set(zip(wins["win_start"], wins["win_end"])), key=lambda w: (w[1], w[0])):
            least = end if frontier is None or frontier < end else frontier
            pick = next(((d, g) for d, g in rows if d >= least and g not in used), None) or next(((d, g) for d, g in reversed(rows) if start <= d < end and g not in used), None)
            if pick:
                used.add(pick[1])
                frontier = pick[0]
                out.append((key[0], start, end, pick[0], pick[1]))
        return pd.DataFrame(out, columns=["entity", "win_start", "win_end", "day", "digest"])

    return captures.groupBy("entity").cogroup(targets.groupBy("entity")).applyInPandas(run, "entity string, win_start date, win_end date, day date, digest string")


def import_plan(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(ref, action, id): what an incoming row would do: update the episode of its guid, else of its (day, title), else of its title (12 characters and more) on a neighbouring day, else insert.

    Both sides: podcast_id, guid, day, title; incoming also ref, existing also
    id. Of several episodes the least id counts. Unknown guids and titles match nothing.
    """
    i = incoming.select("ref", "podcast_id", "guid", "day", title_key("title").alias("key"))
    e = existing.select("id", "podcast_id", "guid", "day", title_key("title").alias("key"))
    by_guid = e.filter("guid is not null").groupBy("podcast_id", "guid").agg(F.min("id").alias("g"))
    by_day = e.filter("day is not null and key is not null").groupBy("podcast_id", "day", "key").agg(F.min("id").alias("d"))
    near = by_day.filter(F.length("key") >= 12).select("podcast_id", F.explode(F.array(F.date_sub("day", 1), F.date_add("day", 1))).alias("day"), "key", F.col("d").alias("n"))
    near = near.groupBy("podcast_id", "day", "key").agg(F.min("n").alias("n"))
    j = i.join(by_guid, ["podcast_id", "guid"], "left").join(by_day, ["podcast_id", "day", "key"], "left").join(near, ["podcast_id", "day", "key"], "left")
    action = F.when(F.col("g").isNotNull(), "guid").when(F.col("d").isNotNull(), "day_title").when(F.col("n").isNotNull(), "adjacent_day").otherwise("insert")
    return j.select("ref", action.alias("action"), F.coalesce("g", "d", "n").alias("id"))


def best_match(results: DataFrame, shows: DataFrame) -> DataFrame:
    """Per show the best result of its title key: with its publisher's key before without, then by position, then id.

    results: result_id, position, title, publisher; shows: show_id, title, publisher.
    """
    r = results.select("result_id", "position", title_key("title").alias("k"), title_key("publisher").alias("rp")).filter("k is not null")
    s = shows.select("show_id", title_key("title").alias("k"), title_key("publisher").alias("sp")).filter("k is not null")
    tier = F.when(F.col("rp") == F.col("sp"), 1).otherwise(3)
    j = s.join(r, "k").withColumn("tier", tier)
    return j.groupBy("show_id").agg(F.min(F.struct("tier", "position", "result_id")).alias("b")).select("show_id", "b.result_id", "b.tier")


def title_ratio(a: str, b: str) -> float:
    """difflib ratio of two normalised titles."""
    return SequenceMatcher(None, a, b).ratio()


#: Least ratio of two titles of one recording.
LEAST_RATIO = 0.9
#: Seconds of duration whose titles are compared in one group; a group of more titles is split.
SECONDS, GROUP = 16, 20_000
#: Width of a title's vector of letter pairs; titles compared at once.
_WIDTH, _SLAB = 512, 1_024


def _pair_vectors(titles: list[str]) -> np.ndarray:
    """A row per title: roots of the counts of its letter pairs, by hash. The product of two rows is at least the number of pairs in both titles."""
    raw = np.frombuffer("".join(titles).encode(), dtype=np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(titles)), [len(t) for t in titles])
    at = row[1:] * _WIDTH + ((raw[:-1] * 256 + raw[1:]) * 2654435761 >> 16) % _WIDTH
    counts = np.bincount(at[row[1:] == row[:-1]], minlength=len(titles) * _WIDTH)
    return np.sqrt(counts, dtype=np.float32).reshape(len(titles), _WIDTH)


def _least_shared(la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """How many letter pairs titles of these lengths share at least, if one contains the other or their ratio is at least LEAST_RATIO.

    A title of n letters shares n - 1 with one that contains it. A ratio means M
    letters in matching blocks; between two blocks is at least one of the
    la + lb - 2M other letters, and a block of n letters shares n - 1.
    """
    shorter, total = np.minimum(la, lb), la + lb
    matched = np.ceil(LEAST_RATIO / 2 * total - 1e-6)
    like = np.abs(la - lb) * 10 <= np.maximum(la, lb)
    return np.where(like, np.minimum(shorter - 1, 3 * matched - total - 1), shorter - 1)


def _might_match(a: list[str], b: list[str], va: np.ndarray, vb: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places in ``a`` and ``b`` of all titles of which one contains the other or whose ratio is at least LEAST_RATIO, and of some more."""
    sizes, kind = np.unique([len(t) for t in a + b], return_inverse=True)
    least = (_least_shared(sizes[:, None], sizes[None, :]) - 0.01).astype(np.float32)
    of_a, of_b = kind[: len(a)], kind[len(a) :]
    for at in range(0, len(a), _SLAB):
        i, j = np.nonzero(va[at : at + _SLAB] @ vb.T >= least[of_a[at : at + _SLAB]][:, of_b])
        yield from zip((i + at).tolist(), j.tolist())


def _alike_titles(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a group's titles, those alike at durations at most a second apart: (n, d) and the (first_n, first_d) that may be its earlier posting, ``week`` where only within 7 days."""
    group, low, high = key
    rows = {d: list(x.itertuples(index=False, name=None)) for d, x in pdf[["n", "d", "side", "lo_day", "lo_id", "hi_day", "hi_id", "podcast"]].groupby("d")}
    vectors: dict[int, np.ndarray] = {}
    out = []
    for d in sorted(d for d in rows if d // SECONDS == group):
        near = [e for e in (d, d + 1) if e in rows]
        vectors = {e: vectors[e] if e in vectors else _pair_vectors([r[0] for r in rows[e]]) for e in near}
        for e in near:
            for i, j in _might_match([r[0] for r in rows[d]], [r[0] for r in rows[e]], vectors[d], vectors[e]):
                u, v = rows[d][i], rows[e][j]
                # each pair once; in a split group the pairs of one side are compared elsewhere; one podcast alone repeats itself
                if d == e and i >= j or low != high and u[2] == v[2] or u[7] == v[7]:
                    continue
                a, b = u[0], v[0]
                within, like = a in b or b in a, abs(len(a) - len(b)) * 10 <= max(len(a), len(b))
                for x, r in ((u, v), (v, u)):
                    if r[3:5] >= x[5:7]:
                        continue
                    if within and (min(len(a), len(b)) >= 12 or d == e) or like and title_ratio(x[0], r[0]) >= LEAST_RATIO:
                        out.append((x[0], x[1], r[0], r[1], False))
                    elif within:
                        out.append((x[0], x[1], r[0], r[1], True))
    return pd.DataFrame(out, columns=["n", "d", "first_n", "first_d", "week"])


def alike_titles(episodes: DataFrame) -> DataFrame:
    """(n, d, first_n, first_d, week): titles of ``episodes`` (id, podcast_id, day, d, n) that are alike, equal ones aside.

    Different titles of a few seconds of duration are one group; groups that are
    too large are split, and pairs of parts compared.
    """
    c = F.col
    t = F.struct(F.unix_date("day").alias("day"), "id")
    one = F.when(F.min("podcast_id") == F.max("podcast_id"), F.min("podcast_id").cast("string"))
    titles = episodes.groupBy("n", "d").agg(F.min(t).alias("lo"), F.max(t).alias("hi"), one.alias("podcast"))
    own = F.floor(c("d") / SECONDS)
    titles = titles.withColumn("group", F.explode(F.when(c("d") % SECONDS == 0, F.array(own, own - 1)).otherwise(F.array(own))))
    titles = titles.select("n", "d", "group", *[c(f"{x}.{y}").alias(f"{x}_{y}") for x in ("lo", "hi") for y in ("day", "id")], F.coalesce("podcast", F.concat_ws(" ", F.lit("several"), "n", "d")).alias("podcast"))
    titles = written(titles, "repost-titles")
    large = written(titles.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts")).filter("parts > 1"), "repost-groups")
    if large.isEmpty():
        titles = titles.withColumns({x: F.lit(0) for x in ("side", "low", "high")})
    else:
        titles = titles.join(broadcast_if_small(large), "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        titles = titles.withColumn("side", F.pmod(F.xxhash64("n", "d"), c("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), c("parts") - 1)))
        titles = titles.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")}).drop("parts", "other")
    return titles.groupBy("group", "low", "high").applyInPandas(_alike_titles, "n string, d long, first_n string, first_d long, week boolean")


def reposts(episodes: DataFrame, min_seconds: int = 600) -> DataFrame:
    """(id, first_id): episodes that another podcast published earlier: durations at most a second apart and nearly equal or contained titles.

    Different titles are compared once, whatever the number of records that bear
    them: first by letter pairs, which rules no alike titles out, then exactly.
    Of the records of an alike title only the first two of different podcasts
    can be the earliest one. Records without an id are left out.
    """
    c = F.col
    e = episodes.filter(c("id").isNotNull() & c("day").isNotNull() & c("podcast_id").isNotNull() & (c("duration_seconds") > min_seconds))
    e = written(e.select("id", "podcast_id", "day", c("duration_seconds").cast("long").alias("d"), norm_title("title").alias("n")).filter(F.length("n") >= 8), "repost-records")
    shared = e.groupBy("n", "d").agg((F.min("podcast_id") != F.max("podcast_id")).alias("shared")).filter("shared")
    pairs = alike_titles(e).unionByName(shared.select("n", "d", c("n").alias("first_n"), c("d").alias("first_d"), F.lit(False).alias("week")))
    pairs = written(pairs, "repost-pairs")

    known = e.withColumnsRenamed({"n": "first_n", "d": "first_d"}).join(broadcast_if_small(pairs.select("first_n", "first_d").distinct()), ["first_n", "first_d"])
    firsts = known.groupBy("first_n", "first_d", "podcast_id").agg(F.min(F.struct("day", "id")).alias("t"))
    first = firsts.groupBy("first_n", "first_d").agg(F.min(F.struct("t", "podcast_id")).alias("f"))
    other = firsts.join(first, ["first_n", "first_d"]).filter(c("podcast_id") != c("f.podcast_id")).groupBy("first_n", "first_d").agg(F.min("t").alias("g"))
    first = first.join(other, ["first_n", "first_d"], "left")
    x = e.join(broadcast_if_small(pairs), ["n", "d"])
    hit = x.filter("not week").join(broadcast_if_small(first), ["first_n", "first_d"])
    hit = hit.withColumn("r", F.when(c("f.podcast_id") != c("podcast_id"), c("f.t")).otherwise(c("g"))).filter(c("r") < F.struct("day", "id")).select("id", c("r.id").alias("first_id"), c("r.day").alias("first_day"))

    if not pairs.filter("week").isEmpty():
        band = F.floor(F.unix_date("day") / 7)
        r = known.select("first_n", "first_d", band.alias("at"), c("id").alias("first_id"), c("day").alias("first_day"), c("podcast_id").alias("first_podcast"))
        soon = x.filter("week").withColumn("at", F.explode(F.array(band, band - 1))).join(r, ["first_n", "first_d", "at"])
        soon = soon.filter((c("first_podcast") != c("podcast_id")) & (F.struct("first_day", "first_id") < F.struct("day", "id")) & (F.date_diff("day", "first_day") <= 7))
        hit = hit.unionByName(soon.select("id", "first_id", "first_day"))
    return hit.groupBy("id").agg(F.min_by("first_id", F.struct("first_day", "first_id")).alias("first_id"))


def balanced_shards(sizes: list[float], shards: int) -> list[int]:
    """Shard of each item, longest first to the least loaded (a bounded list of work packages)."""
    load, out = [0.0] * shards, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = min(range(shards), key=lambda s: (load[s], s))
        load[k] += sizes[i]
        out[i] = k
    return out
