"""Text operators: sentence scan, lexicon matching, corpus search, units and windows."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.operators.scan import HOT_ROWS, assign_chunks, running

# Where sentences part, a speaker before a text, and a speaker label of a publisher's transcript.
SENTENCE_GAP = r"""(?<=[.!?])\s+(?=[A-Z"'(\[])"""
SPEAKER_PREFIX = r"^\s*(?:Speaker\s*\d+|[A-Z][A-Za-z .'-]{1,40})\s*:\s+"
SPEAKER_LABEL = r"(?i)^(?:speaker\s*\d+|[A-Z][A-Za-z.'-]{1,30})\s*:"
_REGEX_CHARS = set("\\[](){}?*+|^$")
#: Sections whose labels are nested; in others the section is its own label.
NESTED = ("topics", "frames", "evidence", "narratives", "products", "certainty")


def lexicon_rows(lexicon: Mapping) -> list[tuple[str, str, str, bool]]:
    """(section, label, term, is a regular expression) of a lexicon."""
    rows = []
    for section, body in lexicon.items():
        for label, spec in body.items() if section in NESTED else [(section, body)]:
            for t in spec["terms"]:
                t = t.strip().lower()
                if t:
                    rows.append((section, label, t, any(c in _REGEX_CHARS for c in t)))
    return rows


def word_count(c: Column) -> Column:
    """Tokens between blanks."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def scan_sentences(segments: DataFrame) -> DataFrame:
    """(episode_id, seg_index, start_s, n_in_segment, sentence, has_prefix): sentences of segments.

    A speaker prefix is taken off first. Null and empty texts give none. Blank
    stretches are no sentences.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    prefixed = text.rlike(SPEAKER_PREFIX)
    body = F.when(prefixed, F.regexp_replace(text, SPEAKER_PREFIX, "")).otherwise(text)
    parts = F.transform(F.split(body, SENTENCE_GAP, -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return (
        segments.select("episode_id", "seg_index", "start_s", prefixed.alias("has_prefix"), F.filter(parts, lambda s: s != "").alias("p"))
        .select("episode_id", "seg_index", "start_s", "has_prefix", F.posexplode("p").alias("n_in_segment", "sentence"))
    )


def match_lexicon(df: DataFrame, text: str, lexicon: Mapping) -> DataFrame:
    """Add ``hits``, the distinct (section, label, term) of a text's lexicon hits.

    One alternation of the literals, longest first, is run once a text; regular
    expressions count only where a literal hits. The lexicon is a parameter (it
    doesn't grow with the data), so terms map to labels by a literal map.
    """
    rows = lexicon_rows(lexicon)
    literal: dict[str, list[tuple[str, str]]] = {}
    for s, label, t, is_re in rows:
        if not is_re:
            literal.setdefault(t, []).append((s, label))
    terms = sorted(literal, key=lambda t: (-len(t), t))
    pattern = r"\b(" + "|".join(re.escape(t).replace(r"\ ", " ") for t in terms) + r")\b"
    low = F.lower(F.col(text))
    hit = lambda s, label, t: F.struct(F.lit(s).alias("section"), F.lit(label).alias("label"), F.lit(t).alias("term"))
    table = F.create_map(*[x for t in terms for x in (F.lit(t), F.array(*[hit(s, label, t) for s, label in literal[t]]))])
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)))
    hits = F.flatten(F.transform(found, lambda t: F.element_at(table, t)))
    out = df.withColumn("__lit", hits)
    extra = [F.when(low.rlike(t), F.array(hit(s, label, t))).otherwise(F.slice(F.array(hit("", "", "")), 1, 0)) for s, label, t, is_re in rows if is_re]
    merged = F.array_distinct(F.concat(F.col("__lit"), *extra)) if extra else F.col("__lit")
    return out.withColumn("hits", F.when(F.size("__lit") > 0, merged).otherwise(F.col("__lit"))).drop("__lit")


def lexical_counts(segments: DataFrame, lexicon: Mapping) -> DataFrame:
    """A10: (episode_id, section, label, term, n_sent): sentences with each hit, once a sentence."""
    s = match_lexicon(scan_sentences(segments), "sentence", lexicon).filter(F.size("hits") > 0)
    return s.select("episode_id", F.inline("hits")).groupBy("episode_id", "section", "label", "term").agg(F.count(F.lit(1)).alias("n_sent"))


def scan_episodes(segments: DataFrame) -> DataFrame:
    """(episode_id, n_seg, n_sent, n_words, duration, speaker_prefixes); episodes without sentences stay."""
    sent = scan_sentences(segments).groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_sent"), F.sum(word_count(F.col("sentence"))).alias("n_words"))
    seg = segments.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("n_seg"), F.coalesce(F.max("end_s"), F.lit(0.0)).alias("duration"),
        F.count_if(F.coalesce(F.col("text"), F.lit("")).rlike(SPEAKER_PREFIX)).alias("speaker_prefixes"),
    )
    joined = seg.join(sent, "episode_id", "left")
    return joined.select("episode_id", "n_seg", F.coalesce("n_sent", F.lit(0)).alias("n_sent"), F.coalesce("n_words", F.lit(0)).alias("n_words"), "duration", "speaker_prefixes")


def matched_sentences(segments: DataFrame, lexicon: Mapping, width: int = 600, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(episode_id, seg_index, sent_index, labels, sentence) of sentences with hits.

    sent_index runs over the episode; a long episode is numbered in chunks.
    """
    s = match_lexicon(scan_sentences(segments), "sentence", lexicon)
    labels = F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.concat(h["section"], F.lit(":"), h["label"])))), "|")
    s = s.select("episode_id", "seg_index", "n_in_segment", labels.alias("labels"), F.left(F.col("sentence"), F.lit(width)).alias("sentence"))
    s, chunked = assign_chunks(s, ["episode_id"], "seg_index", hot_rows)
    s = running(s, ["episode_id"], ["seg_index", "n_in_segment"], {"sent_index": ("sum", F.lit(1), False)}, chunked)
    return s.filter("labels <> ''").select("episode_id", "seg_index", "sent_index", "labels", "sentence")


def section_density(counts: DataFrame, episodes: DataFrame, sections: list[str]) -> DataFrame:
    """Hits per section as columns, missing ones 0, and the hits per sentence."""
    wide = counts.groupBy("episode_id").pivot("section", sections).agg(F.sum("n_sent")).na.fill(0)
    out = episodes.select("episode_id", "n_sent").join(wide, "episode_id", "left").na.fill(0, sections)
    total = sum((F.col(s) for s in sections[1:]), F.col(sections[0]))
    return out.withColumn("density", total / F.greatest("n_sent", F.lit(1)))


def repeated_ngram_ratio(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """(key, n_words, ratio): share of a text's n-grams that repeat another; under n + 1 words 0.

    All within the row by array functions; the text of a row is never split over rows.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    staged = df.select(key, words.alias("w")).withColumn("n_words", F.size("w"))
    grams = F.when(F.col("n_words") > n, F.transform(F.sequence(F.lit(0), F.col("n_words") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " ")))
    staged = staged.withColumn("g", grams)
    return staged.select(key, "n_words", F.when(F.col("g").isNull(), F.lit(0.0)).otherwise(1 - F.size(F.array_distinct("g")) / F.size("g")).alias("ratio"))


def search(segments: DataFrame, pattern: str) -> DataFrame:
    """Segments whose text (never the ids) matches a pattern, whatever the case."""
    return segments.filter(F.coalesce(F.col("text"), F.lit("")).rlike(f"(?i){pattern}"))


def context(segments: DataFrame, pattern: str, k: int) -> DataFrame:
    """Matching segments with up to k segments of their episode on either side, each row once.

    The neighbours are found by a flag carried over k rows, without a self join.
    """
    w = W.partitionBy("episode_id").orderBy("seg_index")
    hit = F.coalesce(F.col("text"), F.lit("")).rlike(f"(?i){pattern}")
    near = F.max(F.when(hit, 1).otherwise(0)).over(w.rowsBetween(-k, k))
    return segments.withColumn("is_hit", hit).withColumn("__n", near).filter("__n = 1").drop("__n")


def cooccurrence(segments: DataFrame, a: str, b: str) -> DataFrame:
    """Episodes in which both patterns occur (not necessarily in one segment)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return segments.groupBy("episode_id").agg(F.count_if(text.rlike(f"(?i){a}")).alias("n_a"), F.count_if(text.rlike(f"(?i){b}")).alias("n_b")).filter("n_a > 0 and n_b > 0")


_UNIT_END = re.compile(r"[.!?]+[\"']?(?:\s+|$)")


def unit_spans(text: str, max_words: int) -> list[tuple[int, int]]:
    """Character ranges of sentence-like units of at most ``max_words`` words."""
    if max_words < 5:
        raise ValueError("units hold at least 5 words")
    bounds = [0, *(m.end() for m in _UNIT_END.finditer(text)), len(text)]
    out = []
    for a, b in zip(bounds, bounds[1:]):
        words = [(a + m.start(), a + m.end()) for m in re.finditer(r"\S+", text[a:b])]
        out += [(words[i][0], words[min(i + max_words, len(words)) - 1][1]) for i in range(0, len(words), max_words)]
    return out


def transcript_units(segments: DataFrame, max_words: int = 45, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Units of segments with interpolated times.

    (episode_id, unit_index, unit_id, seg_index, text, n_words, start_seconds,
    end_seconds, timing_quality). Times are read off by character offset;
    quality is 'segment' if the segment is one unit, else 'interpolated', and
    'unavailable' without both times. Null and empty texts give no units.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ep, k, s, e, text in zip(pdf["episode_id"], pdf["seg_index"], pdf["start_s"], pdf["end_s"], pdf["text"]):
                if not isinstance(text, str):
                    continue
                spans = unit_spans(text, max_words)
                timed = s == s and e == e and s is not None and e is not None and len(text) > 0
                for j, (a, b) in enumerate(spans):
                    at = [round(s + (e - s) * x / len(text), 3) for x in (a, b)] if timed else [None, None]
                    quality = ("segment" if len(spans) == 1 else "interpolated") if timed else "unavailable"
                    rows.append((ep, k, j, text[a:b], len(text[a:b].split()), *at, quality))
            yield pd.DataFrame(rows, columns=["episode_id", "seg_index", "j", "text", "n_words", "start_seconds", "end_seconds", "timing_quality"])

    schema = "episode_id long, seg_index int, j int, text string, n_words int, start_seconds double, end_seconds double, timing_quality string"
    units = segments.select("episode_id", "seg_index", "start_s", "end_s", "text").mapInPandas(run, schema)
    units, chunked = assign_chunks(units, ["episode_id"], "seg_index", hot_rows)
    units = running(units, ["episode_id"], ["seg_index", "j"], {"unit_index": ("sum", F.lit(1), False)}, chunked)
    return units.select("episode_id", F.col("unit_index").cast("int").alias("unit_index"), F.concat(F.lit("u"), F.lpad((F.col("unit_index") + 1).cast("string"), 6, "0")).alias("unit_id"), "seg_index", "text", "n_words", "start_seconds", "end_seconds", "timing_quality")


def window_bounds(words: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open unit ranges of overlapping windows of at least ``size`` words."""
    if not 0 <= overlap < size:
        raise ValueError("the size must exceed the overlap, which is not negative")
    upto = [0, *accumulate(words)]  # words before each unit
    n, out = len(words), []
    first = 0
    while not out or out[-1][1] < n:
        if n == 0:
            break
        last = min(n, max(first + 1, bisect_left(upto, upto[first] + size)))
        out.append((first, last))
        # the next window takes units back until these hold the overlap
        first = max(first + 1, min(last, bisect_right(upto, upto[last] - overlap) - 1))
    return out


def unit_windows(units: DataFrame, size: int = 900, overlap: int = 150) -> DataFrame:
    """(episode_id, window_index, first_unit, last_unit, n_units, n_words), one row per window.

    The recurrence needs only the word counts of a transcript, so these alone are
    gathered per episode (an array of ints of one transcript), never the text.
    """

    @F.pandas_udf("array<struct<window_index:int,first_unit:int,last_unit:int,n_words:int>>")
    def cut(col: pd.Series) -> pd.Series:
        def one(ws):
            ws = [int(w) for w in ws]
            return [{"window_index": k, "first_unit": a, "last_unit": b - 1, "n_words": sum(ws[a:b])} for k, (a, b) in enumerate(window_bounds(ws, size, overlap), 1)]

        return col.map(one)

    listed = units.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("unit_index", "n_words"))).alias("u"))
    w = listed.select("episode_id", F.inline(cut(F.transform("u", lambda x: x["n_words"]))))
    return w.select("episode_id", "window_index", "first_unit", "last_unit", (F.col("last_unit") - F.col("first_unit") + 1).alias("n_units"), "n_words")


def has_speaker_labels(segments: DataFrame) -> DataFrame:
    """(episode_id, labelled): at least max(2, a quarter) of the first 50 segments begin with a speaker."""
    w = W.partitionBy("episode_id").orderBy("seg_index")
    first = segments.withColumn("__r", F.row_number().over(w)).filter("__r <= 50")
    agg = first.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("text"), F.lit("")).rlike(SPEAKER_LABEL)).alias("k"))
    return agg.select("episode_id", (F.col("k") >= F.greatest(F.lit(2), F.floor(F.col("n") / 4))).alias("labelled"))


# Words a minute (and the least limit), words of the tail and their least number, share of one word, words of a repeated run, and from how many words, share of repeats.
WORDS_A_MINUTE, LEAST_LIMIT, TAIL, LEAST_TAIL, RULED, RUN, LEAST_FOR_RUNS, REPEATED = 300, 50, 200, 50, 0.6, 5, 30, 0.5


def implausible(df: DataFrame, key: str, text: str, seconds: str) -> DataFrame:
    """(key, implausible): more words than can be said in the time, a tail ruled by one word, or half the 5-grams repeated.

    Words are runs of letters and digits, so signs part them as blanks do. An
    unknown duration counts as none: then at most the least limit is plausible.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?)"), F.lit(1))
    t = df.select(key, F.coalesce(F.col(seconds), F.lit(0.0)).alias("__s"), words.alias("w")).withColumn("n", F.size("w"))
    tail = F.slice("w", F.greatest(F.col("n") - TAIL + 1, F.lit(1)), TAIL)
    most = F.array_max(F.transform(F.array_distinct(tail), lambda x: F.size(F.filter(tail, lambda y: y == x))))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - RUN + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, RUN), " "))
    fast = F.col("n") > F.greatest(F.lit(LEAST_LIMIT), F.ceil(F.col("__s") / 60 * WORDS_A_MINUTE))
    ruled = (F.size(tail) >= LEAST_TAIL) & (most >= RULED * F.size(tail))
    repeated = (F.col("n") >= LEAST_FOR_RUNS) & (1 - F.size(F.array_distinct(grams)) / F.size(grams) >= REPEATED)
    return t.select(key, (F.coalesce(fast, F.lit(False)) | F.coalesce(ruled, F.lit(False)) | repeated).alias("implausible"))


def edit_rate(ref: list[str], hyp: list[str]) -> float | None:
    """Levenshtein distance of two token lists over the length of the first."""
    if not ref:
        return None
    row = list(range(len(hyp) + 1))
    for i, a in enumerate(ref, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(hyp, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1] / len(ref)


@F.pandas_udf(T.DoubleType())
def word_error_rate(a: pd.Series, b: pd.Series) -> pd.Series:
    """F14 (Arrow): word error rate of two texts; an empty reference gives null."""
    norm = lambda s: re.findall(r"[a-z0-9']+", s.lower()) if isinstance(s, str) else []
    return pd.Series([edit_rate(norm(x), norm(y)) for x, y in zip(a, b)], dtype="float64")


def locate_words(text: str, quote: str) -> tuple[int, int] | None:
    """character range of a quote as a contiguous run of words, else with stutters (a run of up to 4 words said again) collapsed."""
    toks = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+(?:['’][^\W_]+)*", text)]
    want = [m.group().lower() for m in re.finditer(r"[^\W_]+(?:['’][^\W_]+)*", quote)]
    if not want:
        return None

    def find(hay, needle):
        words = [w for w, _, _ in hay]
        for i in range(len(words) - len(needle) + 1):
            if words[i : i + len(needle)] == needle:
                return hay[i][1], hay[i + len(needle) - 1][2]
        return None

    def collapse(seq, word):
        out = []
        for x in seq:
            out.append(x)
            for k in range(1, 5):
                if len(out) >= 2 * k and [word(y) for y in out[-k:]] == [word(y) for y in out[-2 * k : -k]]:
                    del out[-k:]
                    break
        return out

    return find(toks, want) or find(collapse(toks, lambda t: t[0]), collapse(want, lambda w: w))


def trim_repeated_prefix(before: str, after: str, reach: int = 30, least: int = 3) -> str:
    """``after`` without the words it repeats from the end of ``before`` (at least ``least`` words, within ``reach`` of the seam)."""
    a = [w.lower().strip(".,!?;:\"'") for w in before.split()][-reach:]
    raw = after.split()
    b = [w.lower().strip(".,!?;:\"'") for w in raw][:reach]
    for n in range(min(len(a), len(b)), least - 1, -1):
        if a[-n:] == b[:n]:
            return " ".join(raw[n:])
    return after




# Phrases of certainty, firm to weak.
CERTAINTY = {"absolute": ["always", "never", "definitely", "proven"], "hedged": ["might", "probably", "i don't think", "tend to"], "speculative": ["maybe", "could it be", "i suppose"]}


def certainty_markers(df: DataFrame, key: str, text: str, phrases: Mapping[str, list[str]] = CERTAINTY) -> DataFrame:
    """(key, level, n): whole-word occurrences of the phrases of each level; levels without one are left out."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    counts = F.array(*[F.struct(F.lit(level).alias("level"), F.size(F.regexp_extract_all(low, F.lit(r"\b(" + "|".join(re.escape(p).replace(r"\ ", " ") for p in ps) + r")\b"), F.lit(1))).alias("n")) for level, ps in phrases.items()])
    return df.select(key, F.inline(counts)).filter("n > 0")


# Tokens of names, spelled domains, labels before a text, and words that are capitalised only because they open a sentence.
NAME_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9'&+-]*")
NAME_SITE = re.compile(r"\b([A-Za-z0-9][A-Za-z0-9-]+)(?:\s+dot\s+|\.)(?:com|co|org|net|io|health|shop|store|fm)\b", re.IGNORECASE)
NAME_LABEL = re.compile(r"^\s*(?:Speaker\s*\d+|[A-Z][A-Za-z .'-]{1,40})\s*:\s+")
NAME_STOPWORDS = frozenset(
    """a an and are as at be because but by do does for from had has have he her here his how i i'd i'll i'm i've if in is it it's its just let like
    look my no not now of oh ok okay on one or our right she so speaker thank thanks that that's the their then there these they this those to today
    um uh very was we we're well were what when where which who why with yeah yes you you're your all also check every get go keep try use visit""".split()
)


def names_in(text: str) -> list[str]:
    """every name candidate of a text in order, the names of spelled domains last.

    Within a sentence, a run of tokens that begin upper-case or mix letters and
    digits; a stop word neither begins nor ends a run, a number only continues one.
    """
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+", NAME_LABEL.sub("", text, count=1).strip() or text.strip()):
        run: list[str] = []
        for position, token in enumerate([*NAME_TOKEN.findall(sentence), ""]):
            name = token[:1].isupper() or any(c.isdigit() for c in token) and any(c.isalpha() for c in token)
            if name and token.lower() in NAME_STOPWORDS and (not run or position == 0):
                name = False
            if name or run and token.isdigit():
                run.append(token)
                continue
            while run and run[-1].lower() in NAME_STOPWORDS:
                run.pop()
            if run:
                out.append(" ".join(run))
            run = []
    return [n for n in out + NAME_SITE.findall(text) if len(n) > 1]


def name_candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, n): the candidates of :func:`names_in` and how often each occurs.

    Spellings that differ in case and signs only are one name, given as it is
    first spelt. No number of names per text is cut off.
    """
    kind = df.schema[key].dataType

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, re.sub("[^a-z0-9]+", "", n.lower()), n, i) for k, t in zip(b["key"], b["text"]) if t for i, n in enumerate(names_in(t))]
            yield pd.DataFrame(rows, columns=["key", "form", "name", "at"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("form", T.StringType()), T.StructField("name", T.StringType()), T.StructField("at", T.LongType())])
    names = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null").mapInPandas(found, schema)
    per = names.groupBy("key", "form").agg(F.min(F.struct("at", "name"))["name"].alias("name"), F.count(F.lit(1)).alias("n"))
    return per.select(F.col("key").alias(key), "name", "n")


def claim_runs(flags: list[bool], ends: list[bool], most: int) -> list[tuple[int, int]]:
    """Greedy runs of flagged units: a run grows to ``most`` units and stops behind a sentence's end."""
    # a stretch begins behind a unit without a flag or a sentence's end; each is cut into runs of ``most``
    heads = [k == 0 or not flags[k - 1] or ends[k - 1] for k in range(len(flags))]
    stretch = list(accumulate(map(int, heads)))
    out = []
    for _, units in groupby((k for k, f in enumerate(flags) if f), key=stretch.__getitem__):
        held = list(units)
        out += [(held[k], held[min(k + most, len(held)) - 1]) for k in range(0, len(held), most)]
    return out


def merge_chunk_words(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Words of overlapping time chunks, each kept by the chunk in whose share its middle lies.

    A chunk's share ends halfway through its overlap with the next. words:
    audio_id, chunk, start_s, end_s, word; chunks: audio_id, chunk, c_start, c_end.
    """
    w = W.partitionBy("audio_id").orderBy("chunk")
    c = chunks.withColumns({"lo": F.coalesce((F.lag("c_end").over(w) + F.col("c_start")) / 2, F.lit(float("-inf"))), "hi": F.coalesce((F.lead("c_start").over(w) + F.col("c_end")) / 2, F.lit(float("inf")))})
    mid = (F.col("start_s") + F.col("end_s")) / 2
    return words.join(c, ["audio_id", "chunk"]).filter((mid >= F.col("lo")) & (mid < F.col("hi"))).select(*words.columns)
