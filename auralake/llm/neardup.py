"""Problem 3: records of one recording among episodes with small edits.

A title is read into its content words (decorations, the show's own title,
episode and part numbers taken off). Two titles are alike if the longer holds at
least LEAST of the words of the shorter, up to an edit each.

Candidates: of the shorter title at most a quarter of the words may be missing, so
of its rarest words, that many and one more, at least one is in the longer. These
are looked up in an index of all words, together with a band of publication and a
band of duration; words an edit apart come from a join on the vocabulary. Keys
that stay hot are split. Words are bits of a vector of 64, an edit apart the same
bit where one spelling is the common one. Hamming check: at most tau bits of the
shorter may be missing in the longer. tau follows from the number of words, so no
alike pair is lost. (Pigeonring prunes before such a check: at most tau missing
imply a start segment whose chains miss at most their share. On 64 bits the check
itself is one bit count; the ring's chains can prune nothing that it keeps, and made
the join's code too large to be compiled.) What is left is compared exactly.
Exact copies are one class throughout and only expanded at the end, and only where
pairs are asked for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auralake.operators.timestamps import CANONICAL, parse_instants
from auralake.session import broadcast_if_small, written

#: Days between publications, share of the longer duration.
DAYS, SHARE = 3, 0.01
#: Width of the bands of publication (days) and of the logarithm of durations in the index.
TIME_BAND, LENGTH_BAND = 12, 0.1
#: A key of the index with more records is split.
HOT_KEY = 20_000
#: Share of the shorter title's content words that must be found again, up to an edit each.
LEAST = 0.75

# Words that carry no content in titles, numerals, decorations.
STOP = frozenset("a an the of and on in at to for with w why need needs feat ft featuring new hd audio video encore repost rerun extended replay rebroadcast remastered explicit clean bonus is are".split())
NUMERALS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
_PART = re.compile(r"[\s,(\-–—|:]*\(?\b(?:part|pt)\b\.?\s*(\d{1,3}|[ivx]{1,4}|one|two|three|four|five|six|seven|eight|nine|ten)\b\)?", re.IGNORECASE)
_EPISODE = re.compile(r"(?:\b(?:episode|ep|folge|no)\b\.?\s*#?|#)\s*(\d{1,6})\b", re.IGNORECASE)
_LEADING = re.compile(r"^\W*(\d{1,6})\s*[:.)\-–—|]\s+")
_CUT = re.compile(r"(?:…|\.\.\.)\s*(?:\[[^\]]*\]|\([^)]*\)|\W)*$")
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT, _TOKEN = re.compile(r"\d"), re.compile(r"[^\W\d_]+|\d+")


def fold(s: str) -> str:
    """Lower case without accents, blanks collapsed."""
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return " ".join(s.casefold().split())


@lru_cache(maxsize=200_000)
def _show_words(show: str) -> str:
    return " ".join(_WORD.findall(fold(show)))


def read_title(title: str, show: str | None) -> tuple[list[str], int | None, int | None, bool]:
    """(content words, episode number, part number, cut off?) of a title; ``show`` is the podcast's own title."""
    t = fold(title)
    cut_off = ("..." in t or "…" in t) and bool(_CUT.search(t))
    part = None
    if ("part" in t or "pt" in t) and (m := list(_PART.finditer(t))):
        p = m[-1][1]
        part = int(p) if p.isdigit() else NUMERALS.get(p)
        t = t[: m[-1].start()] + " " + t[m[-1].end() :]
    number = None
    if _DIGIT.search(t) and (m := _EPISODE.search(t) or _LEADING.search(t)):
        number = int(m[1])
        t = t[: m.start()] + " " + t[m.end() :]
    words = []
    toks = _TOKEN.findall(t)
    k = 0
    while k < len(toks):  # numbers behind a misspelled "episode" or "part"
        w, then = toks[k], toks[k + 1] if k + 1 < len(toks) else ""
        if number is None and then.isdigit() and near(w, "episode"):
            number, k = int(then), k + 2
        elif part is None and (then.isdigit() or then in NUMERALS) and near(w, "part"):
            part, k = int(then) if then.isdigit() else NUMERALS[then], k + 2
        else:
            if not w.isdigit():
                words.append(w)
            k += 1
    if show and (s := _show_words(show).split()):
        k = len(s)
        for at in (0, len(words) - k) if len(words) > k else ():
            if words[at : at + k] == s:
                rest = words[:at] + words[at + k :]
                if sum(w not in STOP for w in rest) >= 4:
                    words = rest
                    break
        else:
            # a title of the show with a word in front, as "New!"
            for at in range(1, min(4, len(words) - k)):
                if words[at : at + k] == s and all(w in STOP for w in words[:at]) and sum(w not in STOP for w in words[at + k :]) >= 4:
                    words = words[at + k :]
                    break
    content = [w for w in words if w not in STOP and len(w) > 1]
    return content, number, part, cut_off


def near(x: str, y: str) -> bool:
    """Equal, or one letter inserted, left out, replaced or swapped with the next (words of 4 letters and more)."""
    if x == y:
        return True
    n, m = len(x), len(y)
    if min(n, m) < 3 or abs(n - m) > 1:
        return False
    i, k = 0, min(n, m)
    while i < k and x[i] == y[i]:
        i += 1
    if n == m:
        return x[i + 1 :] == y[i + 1 :] or (x[i : i + 2] == y[i : i + 2][::-1] and x[i + 2 :] == y[i + 2 :])
    return x[i:] == y[i + 1 :] if n < m else x[i + 1 :] == y[i:]


def alike(a: list[str], b: list[str], cut_a: bool, cut_b: bool) -> float:
    """Share of the shorter word list found again in the longer, each word once and up to one edit.

    Of a cut-off title the last word matches any word it begins.
    """
    if len(a) > len(b):
        a, b, cut_a, cut_b = b, a, cut_b, cut_a
    if not a:
        return 0.0
    left = list(b)
    hit = 0
    rest = []
    for w in a:
        if w in left:
            left.remove(w)
            hit += 1
        else:
            rest.append(w)
    total = len(a)
    for w in rest:
        k = next((k for k, v in enumerate(left) if near(w, v)), None)
        if k is None:
            k = next((k for k, v in enumerate(left) if (cut_a and w == a[-1] and v.startswith(w)) or (cut_b and v == b[-1] and w.startswith(v))), None)
        if k is not None:
            del left[k]
            hit += 1
        elif cut_a and w == a[-1] and len(w) < 3:
            total -= 1
    return hit / max(1, total)


_READ = "words array<string>, number int, part int, cut boolean"


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for title, show in zip(pdf["title"].tolist(), pdf["show"].tolist()):
            rows.append(read_title(title, show if isinstance(show, str) else None) if isinstance(title, str) else ([], None, None, False))
        read = pd.DataFrame(rows, columns=["words", "number", "part", "cut"]).astype({"number": "Int32", "part": "Int32"})
        yield pd.concat([pdf[["id", "utc", "duration"]].reset_index(drop=True).astype({"utc": "Int64", "duration": "Int32"}), read], axis=1)


#: Words up to this length are found by leaving a letter out, longer ones by their ends.
_SHORT = 60
#: Marks the last word of a cut-off title.
_OPEN = "\x01"


def vocabulary(titles: DataFrame) -> DataFrame:
    """(word, score, place, loose, asked) of the words of ``titles`` (columns words, cut).

    Others may stand for a word in another title: those an edit apart, and cut-off
    words that begin it (marked). ``score`` counts the records that hold the word
    or one of these. ``place`` is the hash of the common spelling among the words
    an edit apart; a word is loose if one of these has another. ``asked`` are the
    places at which what may stand for the word is found. The table is of the
    size of the vocabulary, not of the records.
    """
    c = F.col
    ends = F.when(c("cut") & (F.size("words") > 0), F.array(F.concat(F.element_at("words", -1), F.lit(_OPEN)))).otherwise(F.array().cast("array<string>"))
    vocab = written(titles.select(F.explode(F.concat("words", ends)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")), "vocabulary")
    plain = vocab.filter(~c("word").endswith(_OPEN)).withColumn("n", F.length("word"))
    without = lambda i: F.concat(F.substring(c("word"), F.lit(1), i - 1), F.substring(c("word"), i + 1, c("n")))
    shorter = F.when(c("n").between(3, _SHORT + 1), F.transform(F.sequence(F.lit(1), F.least(c("n"), F.lit(_SHORT + 1))), without)).otherwise(F.array().cast("array<string>"))
    halves = F.when(c("n") >= _SHORT, F.array(F.concat(F.lit("<"), F.substring("word", 1, _SHORT // 2 - 1)), F.concat(F.lit(">"), F.expr(f"right(word, {_SHORT // 2 - 1})")))).otherwise(F.array().cast("array<string>"))
    keyed = plain.filter("n >= 3").select("word", "n", "df", F.explode(F.array_distinct(F.concat(F.array(F.when(c("n") <= _SHORT + 1, c("word")).otherwise(F.lit("<"))), shorter, halves))).alias("v")).filter("v <> '<'")
    x, y = keyed.select("word", "n", "v"), keyed.select(c("word").alias("other"), c("n").alias("m"), c("df").alias("other_df"), "v")
    near_ = x.join(y, "v").filter((c("word") != c("other")) & (F.abs(c("n") - c("m")) <= 1) & (F.levenshtein("word", "other", 2) >= 0)).select("word", "other", "other_df").distinct()
    near_ = written(near_, "spellings")

    open_ = vocab.filter(c("word").endswith(_OPEN)).select(c("word").alias("other"), F.expr("left(word, length(word) - 1)").alias("begin"), c("df").alias("other_df"))
    heads = plain.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.least(c("n"), F.lit(_SHORT))), lambda i: F.substring(c("word"), F.lit(1), i))).alias("v"))
    begun = heads.join(open_.withColumn("v", F.substring("begin", 1, _SHORT)), "v").filter(c("word").startswith(c("begin")))
    begun = written(begun.select("word", "other", "other_df", "begin"), "beginnings")
    completes = begun.select(c("other").alias("word"), c("word").alias("other")).join(plain.select(c("word").alias("other"), c("df").alias("other_df")), "other").select("word", "other", "other_df")

    best = plain.select("word", F.struct("df", "word").alias("b")).unionByName(near_.select("word", F.struct(c("other_df").alias("df"), c("other").alias("word")).alias("b")))
    place = best.groupBy("word").agg(F.max("b").alias("b")).select("word", F.xxhash64("b.word").alias("place"))
    place = place.unionByName(vocab.filter(c("word").endswith(_OPEN)).select("word", F.xxhash64("word").alias("place")))
    stands = near_.unionByName(begun.drop("begin")).unionByName(completes)
    there = stands.join(place.select(c("word").alias("other"), c("place").alias("other_place")), "other").groupBy("word").agg(F.sum("other_df").alias("more"), F.collect_set("other_place").alias("places"))
    strange = near_.join(place, "word").join(place.select(c("word").alias("other"), c("place").alias("other_place")), "other").filter("place <> other_place").select("word").distinct().withColumn("loose", F.lit(1))
    scores = vocab.join(place, "word").join(there, "word", "left").join(strange, "word", "left")
    return written(scores.select(
        "word", (c("df") + F.coalesce("more", F.lit(0))).alias("score"), "place", F.coalesce("loose", F.lit(0)).alias("loose"),
        F.array_distinct(F.concat(F.array("place"), F.coalesce("places", F.array().cast("array<long>")))).alias("asked")), "scores")


def _lookups(n: Column, cut: Column) -> Column:
    """How many words of a title must be looked up so that one of them is in any longer title that is alike."""
    need = lambda k: F.ceil(F.lit(LEAST) * k)
    return F.when(cut & (n >= 2), F.greatest(n - need(n) + 1, (n - 1) - need(n - 1) + 1)).otherwise(n - need(n) + 1)


def _verify_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = [alike(list(a), list(b), bool(ca), bool(cb)) >= LEAST for a, b, ca, cb in zip(pdf["wa"], pdf["wb"], pdf["ca"], pdf["cb"])]
        yield pdf.loc[keep, ["a", "b"]]


def dated_titles(episodes: DataFrame, podcasts: DataFrame, hosts: DataFrame) -> DataFrame:
    """(id, utc, duration, words, number, part, cut), one row per episode id; unknown durations are null."""
    e = episodes.filter("id is not null").select("id", "podcast_id", "title", "duration_seconds", "published_date", "feed_host").repartition("id").groupBy("id").agg(F.min(F.struct("podcast_id", "title", "duration_seconds", "published_date", "feed_host")).alias("e")).select("id", "e.*")
    zones = broadcast_if_small(hosts.groupBy("feed_host").agg(F.min("time_zone").alias("zone")))
    shows = broadcast_if_small(podcasts.filter("id is not null").groupBy(F.col("id").alias("podcast_id")).agg(F.max("title").alias("show")), 100_000)
    e = e.join(zones, "feed_host", "left").join(shows, "podcast_id", "left")
    # canonical text needs no patterns
    canonical = F.col("published_date").rlike(CANONICAL) & ~F.col("published_date").startswith("0000")
    e = e.withColumns({"at": F.when(canonical, F.unix_seconds(F.col("published_date").try_cast("timestamp"))), "raw": F.when(~canonical, F.col("published_date"))}).drop("published_date")
    e = parse_instants(e, out="utc").withColumn("utc", F.coalesce("utc", "at"))
    e = e.select("id", "title", "show", "utc", F.when(F.col("duration_seconds") > 0, F.col("duration_seconds").cast("int")).alias("duration"))
    return e.mapInPandas(_read_batches, f"id long, utc long, duration int, {_READ}")


def recordings(episodes: DataFrame, podcasts: DataFrame, hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): every episode with its class of exact copies, and the links between classes.

    members: id, rep (the least id of the class; a class has the same words,
    numbers, instant and duration); dated tells whether the record can be
    linked (an instant and words are known). links: a, b (reps, a < b).
    Null titles, dates that name no instant, and empty tables give no links.
    Columns beyond those read are ignored.
    """
    c = F.col
    read = dated_titles(episodes, podcasts, hosts)
    tail = F.when(c("cut"), F.element_at("words", -1)).otherwise(F.lit(""))
    linkable = c("utc").isNotNull() & (F.size("words") > 0)
    same = F.md5(F.concat_ws("\x02", F.array_join(F.array_sort("words"), " "), tail, *[F.coalesce(c(x).cast("string"), F.lit("")) for x in ("number", "part", "cut", "utc", "duration")]))
    read = read.withColumn("key", F.when(linkable, F.unhex(same)).otherwise(F.concat(F.lit("single-"), c("id").cast("string")).cast("binary"))).withColumn("dated", linkable)
    read = written(read.withColumn("rep", F.min("id").over(W.partitionBy("key"))).drop("key"), "titles")
    scores = vocabulary(read.filter("dated").select("words", "cut"))

    # one row per class: where to look its rarest words up, where it is found, and its bits
    one = read.filter("id = rep").drop("id")
    alone = c("cut") & (F.size("words") == 1)
    open_word = F.concat(F.element_at("words", -1), F.lit(_OPEN))
    word = one.filter("dated").select("rep", "words", "cut", F.explode(F.array_distinct(F.when(c("cut"), F.concat("words", F.array(open_word))).otherwise(c("words")))).alias("word"))
    word = word.select("rep", "word", F.size(F.filter("words", lambda w: w == c("word"))).alias("times"), (c("cut") & (F.element_at("words", -1) == c("word"))).alias("last"), c("word").endswith(_OPEN).alias("open"))
    word = word.join(broadcast_if_small(scores), "word")
    item = F.struct((c("open") | c("last") & (c("times") == 1)).alias("avoid"), "score", "place", "times", "asked")
    rings = word.groupBy("rep").agg(F.array_sort(F.collect_list(item)).alias("items"), F.bit_or(F.when(~c("open"), F.expr("shiftleft(1L, cast(pmod(place, 64) as int))"))).alias("bits"), F.sum(c("loose") * c("times")).alias("loose"))
    n = F.size("words")
    upto = F.aggregate("items", F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("w")), lambda acc, x: F.struct(
        (acc["sum"] + F.greatest(x["times"], F.lit(1))).cast("long").alias("sum"), F.when(acc["sum"] < c("lookups"), F.concat(acc["w"], x["asked"])).otherwise(acc["w"]).alias("w")))["w"]
    reps = one.join(rings, "rep", "left").withColumn("lookups", F.when(alone, 2).otherwise(_lookups(n, c("cut")))).withColumn("probes", F.array_distinct(upto)).withColumn("places", F.array_distinct(F.transform("items", lambda x: x["place"])))
    reps = reps.withColumn("tau", (n - F.ceil(F.lit(LEAST) * n) + c("loose") + c("cut").cast("int")).cast("int"))
    reps = written(reps.select("rep", "dated", "words", "number", "part", "cut", "utc", "duration", "bits", "tau", "probes", "places"), "classes")
    members = read.select("id", "rep", "dated")

    span, day = DAYS * 86400, TIME_BAND * 86400
    body = ["rep", "utc", "duration", "number", "part", "bits", "n", "cut"]
    dated = reps.filter("dated").withColumn("n", n)
    length = lambda x: F.floor(F.log1p(x.cast("double")) / LENGTH_BAND).cast("long")
    known = c("duration").isNotNull()
    # band -1: records of unknown duration, asked for by all; -2: all records, asked for by those
    index = dated.select(*body, F.explode("places").alias("w"), F.floor(c("utc") / day).alias("at"))
    index = index.withColumn("band", F.explode(F.when(known, F.array(length(c("duration")), F.lit(-2).cast("long"))).otherwise(F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long")))))
    index = index.select(F.xxhash64("w", "at", "band").alias("k"), *body)
    near_bands = F.concat(F.sequence(length(c("duration") * (1 - SHARE) - 0.01), length(c("duration") / (1 - SHARE) + 0.01)), F.array(F.lit(-1).cast("long")))
    ask = dated.select(*body, "tau", F.explode("probes").alias("w")).withColumn("band", F.explode(F.when(known, near_bands).otherwise(F.array(F.lit(-2).cast("long")))))
    ask = ask.withColumn("at", F.explode(F.array_distinct(F.array(F.floor((c("utc") - span) / day), F.floor((c("utc") + span) / day)))))
    ask = ask.select(F.xxhash64("w", "at", "band").alias("k"), *[c(x).alias(f"x_{x}") for x in ("rep", "utc", "duration", "number", "part", "bits", "n", "cut", "tau")])

    hot = index.groupBy("k").agg(F.count(F.lit(1)).alias("size")).filter(c("size") > HOT_KEY).select("k", F.ceil(c("size") / HOT_KEY).cast("int").alias("parts"))
    hot = written(hot, "hot-keys")
    if not hot.isEmpty():
        hot = broadcast_if_small(hot)
        index = index.join(hot, "k", "left").withColumn("salt", F.when(c("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("rep"), c("parts")).cast("int"))).drop("parts")
        ask = ask.join(hot, "k", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(c("parts") - 1, F.lit(0))))).drop("parts")
        on = ["k", "salt"]
    else:
        on = ["k"]
    missing, budget = "(x_bits & ~bits)", "(x_tau + cast(cut as int))"
    fits = (
        (c("x_rep") != c("rep")) & (c("x_n") <= c("n")) & (F.abs(c("x_utc") - c("utc")) <= span)
        & (c("x_duration").isNull() | c("duration").isNull() | (F.abs(c("x_duration") - c("duration")) <= SHARE * F.greatest("x_duration", "duration")))
        & (c("x_number").isNull() | c("number").isNull() | (c("x_number") == c("number")))
        & (c("x_part").isNull() | c("part").isNull() | (c("x_part") == c("part")))
        & F.expr(f"bit_count({missing}) <= {budget}")
    )
    hits = ask.hint("shuffle_hash").join(index, on).filter(fits)
    pairs = written(hits.select(F.least("x_rep", "rep").alias("a"), F.greatest("x_rep", "rep").alias("b")).distinct(), "candidates")
    w = reps.select("rep", "words", "cut")
    few = broadcast_if_small(pairs)
    first = w.select(c("rep").alias("a"), c("words").alias("wa"), c("cut").alias("ca")).join(few, "a")
    both = w.select(c("rep").alias("b"), c("words").alias("wb"), c("cut").alias("cb")).join(broadcast_if_small(first) if few is not pairs else first, "b")
    links = written(both.mapInPandas(_verify_batches, "a long, b long"), "links")
    return members, links


#: A class with more copies is split before its pairs are listed.
HOT_CLASS = 2_000


def duplicate_pairs(episodes: DataFrame, podcasts: DataFrame, hosts: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of episodes that are records of one recording, copies expanded."""
    c = F.col
    members, links = recordings(episodes, podcasts, hosts)
    m = members.filter("dated").select("id", "rep")
    size = m.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    copied = m.join(size.filter("size > 1").select("rep", F.ceil(c("size") / HOT_CLASS).cast("int").alias("parts")), "rep")
    x = copied.select("rep", c("id").alias("id_a"), F.pmod(F.xxhash64("id"), c("parts")).cast("int").alias("salt"))
    y = copied.select("rep", c("id").alias("id_b"), F.explode(F.sequence(F.lit(0), c("parts") - 1)).alias("salt"))
    within = x.join(y, ["rep", "salt"]).filter("id_a < id_b").select("id_a", "id_b")
    across = links.join(m.select(c("rep").alias("a"), c("id").alias("i")), "a").join(m.select(c("rep").alias("b"), c("id").alias("j")), "b")
    return within.unionByName(across.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")))


def duplicate_classes(episodes: DataFrame, podcasts: DataFrame, hosts: DataFrame) -> DataFrame:
    """(id, class_id, n_links), one row per episode: its group (least id of the connected records) and how many classes its own is linked with."""
    from auralake.operators.graph import connected_components

    members, links = recordings(episodes, podcasts, hosts)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    groups = connected_components(links, "a", "b")
    out = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return out.select("id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
