"""Problem 5: splitting oversized spans at natural boundaries.

Boundaries are the ends of sentences; inside a sentence over the limit also
blanks, and inside an unbroken run over the limit every character. Dynamic
programming over the boundary positions chooses the cuts: it minimises the
penalties of the cuts, the imbalance of the pieces and the overlap that is lost,
under the limit on length. A piece begins up to ``overlap`` characters before the
last cut, at the start of a word; only what the limit leaves no room for is lost,
and a cut that leaves room is preferred.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

LIMIT, OVERLAP = 600, 60
#: Penalties of a cut by kind, against an imbalance of at most 1 a piece.
PENALTY = {"line": 0.0, "sentence": 0.3, "word": 4.0, "none": 20.0}
#: Penalty of an overlap that is lost whole: more than a sentence's end costs, less than a cut between words.
LOST = 1.5
#: Two cuts inside one unbroken run are at least the limit divided by this apart.
APART = 8
KINDS = ("whole", "sentence", "word", "none")

_SENTENCE_END = re.compile(r"[.!?।॥](?=\s|$)|[。！？]|[\n\r\v\f\x85  ]")
_RUN = re.compile(r"\S+")


def _sentences(body: str) -> list[tuple[int, int]]:
    """Sentences of ``body`` as half-open ranges without blanks around them."""
    out, at = [], 0
    for m in [*_SENTENCE_END.finditer(body), None]:
        end = m.end() if m else len(body)
        piece = body[at:end]
        if piece.strip():
            lead = len(piece) - len(piece.lstrip())
            out.append((at + lead, at + len(piece.rstrip())))
        at = end
    return out


def _joined(body: str, at: int) -> bool:
    """Does the character at ``at`` belong to the one before it (a mark, a joiner, part of a pair)?"""
    ch = body[at]
    return ch > "\u02ff" and (unicodedata.combining(ch) != 0 or unicodedata.category(ch) in ("Mn", "Mc", "Me") or ch in "\u200d\ufe0f" or body[at - 1] == "\u200d")


def boundaries(body: str, limit: int) -> tuple[list[tuple[int, int, str]], str]:
    """((end of a piece, start of the next, kind of cut), finest kind needed) of a text over the limit."""
    found: list[tuple[int, int, str]] = []
    finest = "sentence"
    sents = _sentences(body)
    for k, (s, e) in enumerate(sents):
        if e - s > limit:
            runs = [(s + m.start(), s + m.end()) for m in _RUN.finditer(body[s:e])]
            if finest == "sentence":
                finest = "word"
            for j, (a, b) in enumerate(runs):
                if b - a > limit:
                    finest = "none"
                    found += [(c, c, "none") for c in range(a + 1, b) if not _joined(body, c)]
                if j + 1 < len(runs):
                    found.append((b, runs[j + 1][0], "word"))
        nxt = sents[k + 1][0] if k + 1 < len(sents) else len(body)
        found.append((e, nxt, "line" if "\n" in body[e:nxt] or "\r" in body[e:nxt] else "sentence"))
    return found, finest


def split(body: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, str]], str]:
    """((start, end, kind of the cut behind) of each piece, finest kind of cut needed) of a text without blanks around it."""
    n = len(body)
    if n <= limit:
        return [(0, n, "end")], "whole"
    marks, finest = boundaries(body, limit)
    if marks[-1][0] != n:
        marks.append((n, n, "sentence"))
    target = n / -(-n // max(1, limit - overlap // 2))
    m = len(marks)
    ends, begins = [x[0] for x in marks], [x[1] for x in marks]
    in_run = [x[2] == "none" for x in marks]
    cost_of = [PENALTY[x[2]] for x in marks]
    words = [w.start() for w in _RUN.finditer(body)]

    def overlapped(j: int, low: int) -> int:
        """The first place behind ``low`` where a piece may begin to repeat what stands before mark ``j``."""
        end, kind = ends[j], marks[j][2]
        if low >= end or overlap <= 0:
            return begins[j]
        if kind == "none":
            while low < end and (body[low].isspace() or _joined(body, low)):
                low += 1
            return low if low < end else begins[j]
        k = bisect_left(words, low)
        if k < len(words) and words[k] < end:
            return words[k]
        while low < end and _joined(body, low):  # an unbroken run longer than the overlap: any character
            low += 1
        return low if low < end else begins[j]

    full = [overlapped(j, max(0, ends[j] - overlap)) for j in range(m)]
    many = finest == "none"
    scale = 1 / limit
    if many:
        import numpy as np

        full_, begins_, ends_, cost_ = np.array(full), np.array(begins), np.array(ends), np.full(m, np.inf)
        lost_ = LOST * np.maximum(0, ends_ - full_) / max(1, overlap)
        plain = np.flatnonzero(~np.array(in_run))
    # cost and choice of the best division whose last piece ends at marks[i]
    cost = [float("inf")] * m
    back = [-2] * m
    lo = i = tight = 0
    per_lost = LOST / max(1, overlap)
    while i < m:
        end = ends[i]
        if many and in_run[i]:
            # a stretch of places in one unbroken run at once, from the marks before it
            k = i + 1
            while k < m and in_run[k] and ends[k] - end < limit // APART:
                k += 1
            while lo < i and end - begins[lo] > limit:
                lo += 1
            at = ends_[i:k]
            best_, choice_ = np.where(at <= limit, ((at - target) * scale) ** 2, np.inf), np.full(k - i, -1)
            before = plain[(plain >= lo) & (plain < i)]
            for js, starts, extra in ((np.arange(lo, i), full_[lo:i], 0.0), (before, begins_[before], lost_[before])):
                if len(js):
                    size = at[:, None] - starts[None, :]
                    c_ = np.where(size > limit, np.inf, (cost_[js] + extra)[None, :] + ((size - target) * scale) ** 2)
                    j_ = c_.argmin(axis=1)
                    c_ = c_[np.arange(k - i), j_]
                    better = c_ < best_
                    best_, choice_ = np.where(better, c_, best_), np.where(better, js[j_], choice_)
            cost_[i:k] = best_ + PENALTY["none"]
            cost[i:k] = cost_[i:k].tolist()
            back[i:k] = choice_.tolist()
            i = k
            continue
        best, choice = float("inf"), -2
        if end <= limit:
            best, choice = ((end - target) / limit) ** 2, -1
        while lo < i and end - begins[lo] > limit:
            lo += 1
        tight = max(tight, lo)  # behind it the whole overlap has room
        while tight < i and end - full[tight] > limit:
            tight += 1
        if many and i - tight > 40:
            c_ = cost_[tight:i] + ((end - full_[tight:i] - target) / limit) ** 2
            k = int(c_.argmin())
            if c_[k] < best:
                best, choice = float(c_[k]), tight + k
        else:
            shift = end - target
            for j in range(i - 1, tight - 1, -1):
                c = cost[j]
                if c < best:  # else it can't win, whatever the balance
                    d = (shift - full[j]) * scale
                    c += d * d
                    if c < best:
                        best, choice = c, j
        for j in range(lo, tight):
            # a cut that leaves less room; in a run the next character is as good and leaves more
            if in_run[j] or cost[j] + per_lost * (end - limit - full[j]) >= best:
                continue
            start = overlapped(j, max(end - limit, ends[j] - overlap))
            c = cost[j] + ((end - start - target) * scale) ** 2 + per_lost * max(0, ends[j] - full[j] - max(0, ends[j] - start))
            if c < best:
                best, choice = c, j
        cost[i] = best + (cost_of[i] if end < n else 0.0)
        if many:
            cost_[i] = cost[i]
        back[i] = choice
        i += 1
    path = []
    i = m - 1
    while i >= 0:
        path.append((i, back[i]))
        i = back[i]
    pieces: list[tuple[int, int, str]] = []
    for i, j in reversed(path):
        end = ends[i]
        start = 0 if j < 0 else overlapped(j, max(ends[j] - overlap, end - limit, pieces[-1][0] + 1))
        pieces.append((start, end, marks[i][2] if end < n else "end"))
    return pieces, finest


def _batches(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for span, ep, at, text in zip(pdf["span_id"].tolist(), pdf["episode_id"].tolist(), pdf["char_start"].tolist(), pdf["text"].tolist()):
                if not isinstance(text, str) or not (body := text.strip()):
                    continue
                lead = len(text) - len(text.lstrip())
                pieces, finest = split(body, limit, overlap)
                for k, (a, b, kind) in enumerate(pieces, 1):
                    offset = None if pd.isna(at) else int(at) + lead + a
                    shared = max(0, pieces[k - 2][1] - a) if k > 1 else 0
                    rows.append((span, None if pd.isna(ep) else int(ep), k, len(pieces), offset, b - a, shared, kind, finest, body[a:b]))
            cols = ["span_id", "episode_id", "piece_no", "n_pieces", "char_start", "n_chars", "overlap_chars", "cut_kind", "cut_at", "text"]
            yield pd.DataFrame(rows, columns=cols).astype({"episode_id": "Int64", "char_start": "Int64"})

    return run


def split_spans(spans: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of at most ``limit`` characters of every span, with their char_start in the transcript.

    Columns: span_id, episode_id, piece_no, n_pieces, char_start, n_chars,
    overlap_chars (shared with the piece before), cut_kind (of the cut behind),
    cut_at (finest kind needed in the span; 'whole' if it fits), text. Blanks
    around a span are left out; null, empty and blank texts give no piece; a
    null char_start gives null. Repeated rows give repeated pieces (see
    ``distinct_spans``). Each row is read on its own, so no group can be hot.
    """
    rows = spans.selectExpr("cast(span_id as long) span_id", "cast(episode_id as long) episode_id", "cast(char_start as long) char_start", "text")
    schema = "span_id long, episode_id long, piece_no int, n_pieces int, char_start long, n_chars int, overlap_chars int, cut_kind string, cut_at string, text string"
    return rows.mapInPandas(_batches(limit, overlap), schema)


def distinct_spans(spans: DataFrame) -> DataFrame:
    """Exact second deliveries of a span taken off."""
    return spans.select("span_id", "episode_id", "char_start", "text").distinct()


def oversized(spans: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(span_id, cut_at) of the spans that had to be cut."""
    return split_spans(spans, limit).filter("piece_no = 1 and cut_at <> 'whole'").select("span_id", "cut_at").distinct()
