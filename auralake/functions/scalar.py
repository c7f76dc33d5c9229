"""Scalar column functions (ids F1-F34 of the survey), JVM-side unless marked."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title_key(c: Column | str) -> Column:
    """lower-case letters and digits only; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", ""), F.lit(""))


def genre_slug(c: Column | str) -> Column:
    """words joined by '-', without 'and'; names of the whole chart become 'all'; nothing left is null."""
    words = F.filter(F.split(F.lower(col(c)), "[^a-z0-9]+"), lambda w: ~w.isin("", "and"))
    slug = F.array_join(words, "-")
    return F.when(slug.isin("all", "all-podcasts", "top-podcasts", "podcasts"), "all").when(slug != "", slug)


def bare_id(c: Column | str) -> Column:
    """the last part of a 'spotify:...' id, other ids as they are."""
    return F.when(col(c).startswith("spotify:"), F.element_at(F.split(col(c), ":"), -1)).otherwise(col(c))


@F.pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """F5 (Arrow): NFKD without marks, case folded. Spark has no normalisation built in."""
    return s.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).casefold())


def core_title(folded: Column) -> Column:
    """a folded title without a leading 'the' and a trailing 'podcast' or 'show'."""
    t = F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "^the ", ""), " (?:podcast|show)$", ""))


def slugify(folded: Column) -> Column:
    """words of a folded text joined by '_'."""
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalized_quote(c: Column | str) -> Column:
    """blanks collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def product_key(c: Column | str) -> Column:
    """F8: the title key, else the normalised quote."""
    return F.coalesce(title_key(c), normalized_quote(c))


def claim_tokens(c: Column | str) -> Column:
    """distinct lower-case tokens of more than two letters or digits."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def claim_similarity(a: Column | str, b: Column | str) -> Column:
    """token Jaccard; without tokens on a side, equality of the quotes."""
    x, y = claim_tokens(a), claim_tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), (normalized_quote(a) == normalized_quote(b)).cast("double")).otherwise(jaccard(x, y))


# Markers of a second airing, and how titles number episodes.
_RERUN = (
    r"(?i)\b(?:re-?broadcast|encore(?: presentation)?|best of|replay|rerun|re-?run|repeat|re-?release[d]?|re-?air(?:ed)?|classic|from the archives?|vault|throwback|revisited|rewind|fbf|flashback|selects|playlist)\b"
    r"|\(r\)|\[r\]"
)
_EPISODE = r"(?i)\b(?:ep(?:isode)?|no)\.?\s*#?\d+\b|^\s*#?\d+\s*[:.\-|]|\|\s*#?\d+\s*$|#\d+|\bs\d+\s*e\d+\b|\bseason \d+,? episode \d+\b"


def norm_title(c: Column | str) -> Column:
    """letters and digits of a title without markers of a second airing and episode numbers."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), _RERUN, " "), _EPISODE, " ")
    return F.regexp_replace(t, "[^a-z0-9]+", "")


def has_rerun_marker(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(_RERUN)


def title_numbers(c: Column | str) -> Column:
    """sorted digit runs of a title without years and leading zeros."""
    runs = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(\d+)"), F.lit(1))
    kept = F.filter(runs, lambda n: ~n.rlike(r"^(19|20)\d\d$"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda n: F.regexp_replace(n, "^0+", ""))))


def leading_number(c: Column | str) -> Column:
    """An episode number that opens a title (no year)."""
    # Fixed value: the pattern of a leading number.
    return F.regexp_extract(col(c), r"^\s*#?(?!(?:19|20)\d\d\b)(\d{1,4})\s*[:.|\-](?=\s)", 1).try_cast("int")


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """intersection over union of two inclusive unit spans."""
    inter = F.greatest(F.least(a1, b1) - F.greatest(a0, b0) + 1, F.lit(0))
    return inter / ((a1 - a0 + 1) + (b1 - b0 + 1) - inter)


def overlap_coefficient(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """intersection over the shorter of two inclusive unit spans."""
    inter = F.greatest(F.least(a1, b1) - F.greatest(a0, b0) + 1, F.lit(0))
    return inter / F.least(a1 - a0 + 1, b1 - b0 + 1)


def char_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """intersection over union of two half-open character spans."""
    inter = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
    union = (a1 - a0) + (b1 - b0) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def snippet(c: Column | str, pattern: str, width: int) -> Column:
    """``width`` characters around the first match of a pattern, ellipses where text is cut; null without a match."""
    text = F.regexp_replace(col(c), r"\s+", " ")
    at = F.regexp_instr(text, F.lit(f"(?i){pattern}"))
    start = F.greatest(at - F.lit(width // 2), F.lit(1))
    body = F.substring(text, start, F.lit(width))
    return F.when(at > 0, F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(start + width <= F.length(text), "...").otherwise("")))


def bucket_key(ts: Column, window: str) -> Column:
    """fixed UTC bucket of an instant: minute, day or total."""
    formats = {"minute": "yyyy-MM-dd'T'HH:mm", "day": "yyyy-MM-dd"}
    return F.lit("total") if window == "total" else F.date_format(ts, formats[window])


# Bins of days between snapshots.
GAP_BINS = ((1, 1, "1 day"), (2, 3, "2-3 days"), (4, 9, "4-9 days"), (10, 20, "10-20 days"), (21, 45, "21-45 days"), (46, 100, "46-100 days"))


def gap_label(days: Column) -> Column:
    """the bin of a number of days, null outside."""
    out = F.lit(None).cast("string")
    for lo, hi, label in GAP_BINS:
        out = F.when(days.between(lo, hi), label).otherwise(out)
    return out


def parse_duration(c: Column | str) -> Column:
    """Seconds of '123', 'MM:SS' or 'HH:MM:SS', else null."""
    p = F.split(F.trim(col(c)), ":")
    n = F.transform(p, lambda x: x.try_cast("int"))
    sound = F.forall(n, lambda x: x.isNotNull() & (x >= 0))
    return F.when(sound, F.when(F.size(n) == 1, n[0]).when(F.size(n) == 2, n[0] * 60 + F.get(n, F.lit(1))).when(F.size(n) == 3, n[0] * 3600 + F.get(n, F.lit(1)) * 60 + F.get(n, F.lit(2))))


def clean_html(c: Column | str, limit: int = 1000) -> Column:
    """Tags taken off, blanks collapsed, cut with '...' at ``limit`` characters."""
    t = F.trim(F.regexp_replace(F.regexp_replace(col(c), r"<[^>]+>", " "), r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit - 3)), F.lit("..."))).otherwise(t)


def url_identity(c: Column | str) -> Column:
    """A URL without scheme, default port and 'www.'."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"^https?://(www\.)?", ""), r"^([^/]+?):(?:80|443)(?=/|$)", "$1")


def media_key(c: Column | str) -> Column:
    """The distinctive stem (8 characters and more) of a media file, else null."""
    stem = F.regexp_extract(col(c), r"/([^/?#]+?)\.(?:mp3|m4a|ogg|wav|aac)(?:[?#].*)?$", 1)
    return F.when(F.length(stem) >= 8, F.lower(stem))


#: Prefixes of redirecting trackers.
TRACKERS = r"^https?://(?:dts\.podtrac\.com/redirect\.[a-z0-9]+/|www\.podtrac\.com/pts/redirect\.[a-z0-9]+/|chtbl\.com/track/[^/]+/|pdst\.fm/e/|chrt\.fm/track/[^/]+/|op3\.dev/e/)"


def unwrap_tracking_url(c: Column | str, rounds: int = 5) -> Column:
    """known tracker prefixes peeled off, at most ``rounds`` deep."""
    out = col(c)
    for _ in range(rounds):
        out = F.when(out.rlike(TRACKERS), F.regexp_replace(F.regexp_replace(out, TRACKERS, ""), r"^(?!https?://)", "https://")).otherwise(out)
    return out


def capture_time(c: Column | str) -> Column:
    """an archive stamp yyyyMMddHHmmss as timestamp, null if malformed."""
    return F.try_to_timestamp(col(c), F.lit("yyyyMMddHHmmss"))


def sample_score(seed: str, *parts: Column) -> Column:
    """Deterministic order key: the first 16 hex digits of SHA-256 of seed and parts joined by U+001F."""
    return F.substring(F.sha2(F.concat_ws("\x1f", F.lit(seed), *[p.cast("string") for p in parts]), 256), 1, 16)


def topic_parent(c: Column | str) -> Column:
    """the text before the first dot of a hierarchical label."""
    return F.split_part(col(c), F.lit("."), F.lit(1))


def parse_json_output(c: Column | str) -> Column:
    """JSON text without a code fence and trailing commas, ready for from_json."""
    t = F.regexp_replace(F.trim(col(c)), r"^```[a-z]*\s*|\s*```$", "")
    return F.regexp_replace(t, r",(\s*[}\]])", "$1")


def fingerprint(*cols: Column) -> Column:
    """F32: SHA-256 of the canonical JSON of the values."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def safe_ratio(a: Column, b: Column) -> Column:
    """A / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def f1_score(tp: Column, fp: Column, fn: Column) -> Column:
    """G12."""
    return safe_ratio(2 * tp, 2 * tp + fp + fn)


def canonical_chart(c: Column | str) -> Column:
    """'<platform>:<region>:show:<genre>' of a chart name like 'apple_us_genre_1512' or 'spotify_us_top'; null if unmapped."""
    p = r"^(apple|spotify)_([a-z]{2})_(?:top|genre_(\d+))$"
    genre = F.coalesce(F.nullif(F.regexp_extract(col(c), p, 3), F.lit("")), F.lit("all"))
    return F.when(col(c).rlike(p), F.concat_ws(":", F.regexp_extract(col(c), p, 1), F.regexp_extract(col(c), p, 2), F.lit("show"), genre))


def numbering(tag: Column, title: Column) -> Column:
    """an episode number from its tag, else from the title."""
    return F.coalesce(tag.try_cast("int"), F.regexp_extract(title, r"(?i)(?:episode|ep\.?|#)\s*(\d{1,5})", 1).try_cast("int"))
