"""Problem 2: transcript segments to ordered, clean speaker turns.

Per segment (a scalar pass, any split of the rows will do) an Aho-Corasick
automaton over labels' anchors, hesitation sounds and sound words finds hits;
rules on the hit's surroundings decide what it is, and the intervals of times,
notes and sounds are subtracted from the text. The text is cut at every possible
label; which of them are labels is decided per transcript against its roster of
full names, on counts alone. Running values over the pieces then build turns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.operators.scan import HOT_ROWS, assign_chunks, running
from auralake.session import broadcast_if_small, written

# Hesitation sounds.
FILLERS = ("uh", "uhh", "uhhh", "uhm", "uhmm", "um", "umm", "ummm", "er", "err", "erm", "ermm", "hm", "hmm", "hmmm", "mm", "mmm", "mhm", "eh", "ehm")
# Words that make a bracketed, starred or parenthesised stretch a note.
SOUND_WORDS = (
    "applause", "applauds", "audio", "background", "beep", "bell", "breath", "cheer", "chuckle", "clap", "clears throat", "closes", "cough", "cross-talk", "crosstalk", "cry",
    "door", "exhale", "fades", "gasp", "groan", "inaudible", "indistinct", "inhale", "jingle", "knock", "laugh", "laughter", "music", "mumbl", "noise", "opens", "outro", "intro",
    "overlapping", "pause", "phone", "playing", "ringing", "ring", "scream", "sigh", "silence", "sings", "singing", "snap", "sniff", "sob", "sound", "static", "theme", "unintelligible",
    "untranscribed", "whisper", "whistle", "yawn", "unclear", "redacted", "bleep",
)
# Phrases before a colon that are speech.
LEAD_INS = frozenset({"warning", "note", "question", "answer", "remember", "reminder", "fun fact", "spoiler", "tip", "update", "example", "quote", "the thing", "thing", "fact", "the point", "my point"})
COMMON = frozenset("a an and are at be but by for from had has have he her his i if in is it its like me my no not of on or our she so that the their them then there they this to was we what when where who why will with you your thing fact point".split())

_TIME = re.compile(
    r"\[\s*\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?:\s*(?:-->|-|–)\s*\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?)?\s*\]"
    r"|\(\s*\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?:\s*(?:-->|-|–)\s*\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?)?\s*\)"
    r"|(?<![\d:.])\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?(?:\s*(?:-->|-|–)\s*\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?)?(?![\d:])"
)
_SQUARE = re.compile(r"\[[^\[\]\n]+\]")
_PAREN = re.compile(r"\([^()\n]+\)")
_STAR = re.compile(r"(?<!\*)\*(?!\*)[^*\n]+\*(?!\*)")
_SONG = re.compile(r"[♪♫🎵🎶][^♪♫🎵🎶\n]*[♪♫🎵🎶]|[♪♫🎵🎶]")
_TAG = re.compile(r"</?(?!v[\s.])[A-Za-z][^<>\n]*>|</v>")
_VOICE = re.compile(r"<v(?:\.[^\s>]*)?\s+([^<>\n]+)>")

_MARKER = re.compile(r"\[[^a-z\[\]]*[A-Z][^a-z\[\]]*[A-Z_][^a-z\[\]]*\]$")  # a mark of a machine or editor in capitals
_TRAIL = re.compile(r"\s?(?:\.{2,}|…)|,")  # what goes with a hesitation sound
_COLON = re.compile(r"(?:\s*\([^()\n]+\))*\s*:")
#: What may follow a sound word inside its word.
_INFLECTED = re.compile(r"(?:e?s|e?d|l?ing|e|er|ers|ter|(?:b|p)(?:ed|ing)|ies|ying)?(?![^\W_])")
_WORDS = re.compile(r"[^\W_]+")
_LABEL_END = re.compile(r":(?=[\s*\x00]|$)")

_TOK = r"(?:[^\W\d_](?:[\w'’\-]*[^\W_])|[^\W\d_]\.?)"
_HON = r"(?:(?:dr|mr|mrs|ms|prof|hon|rev)\.?[ ]+)?"
_SPK = r"(?:speaker|spkr|spk|s)[ _]*\#?[ ]*\d{1,3}"
_NAME = rf"(?P<name>{_SPK}|{_HON}{_TOK}(?:[ ]{_TOK}){{0,2}})"
_PAR = r"(?:[ ]*(?:\([^()\n]+\)|\x00))*[ ]*"
#: A longer unbroken string is no name.
_NAME_WORD = 200
#: Words before a colon among which a label is looked for (names have three and a title; the others are notes in brackets).
_REACH = 24
_LABEL = tuple(
    re.compile(p, re.IGNORECASE)
    for p in (
        rf"(?P<at>(?:(?:>>+|[-–—])[ ]*)?\*\*\[?){_NAME}\]?{_PAR}:$",
        rf"(?P<at>(?:(?:>>+|[-–—])[ ]*)?\[){_NAME}\]{_PAR}:$",
        rf"(?:^|(?<=[\s\x00]))(?P<at>(?:>>+[ ]*|[-–—][ ]+)){_NAME}{_PAR}:$",
        rf"(?:^|(?<=[\s\x00\x01]))(?P<at>)(?P<name>{_SPK}){_PAR}:$",
        rf"(?:^\s*|[\n\x00]\s*|[.!?…][\"'”’)\]]*\s+|[ ]{{2,}})(?P<at>){_NAME}{_PAR}:$",
    )
)
_NUM = re.compile(rf"^{_SPK}$", re.IGNORECASE)
_HONOUR = re.compile(r"^(?:dr|mr|mrs|ms|prof|hon|rev)\.?\s+", re.IGNORECASE)


@lru_cache(maxsize=1)
def automaton():
    """Anchors, hesitation sounds and sound words in one automaton (built once per Python worker)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in SOUND_WORDS:
        a.add_word(w, ("sound", len(w)))
    for w in FILLERS:
        a.add_word(w, ("filler", len(w)))
    for w in ("[", "(", "*", "<", ":", "♪", "♫", "🎵", "🎶"):
        a.add_word(w, ("anchor", 1))
    a.make_automaton()
    return a


_LOWER = {i: i + 32 for i in range(65, 91)}


def _key(name: str) -> tuple[str, str, str] | None:
    """(kind, a, b) of a label's name; None if it can't be a label."""
    name = " ".join(name.split())
    if _NUM.match(name):
        return "num", "speaker " + str(int(re.sub(r"\D", "", name))), ""
    bare = _HONOUR.sub("", name)
    toks = bare.split(" ")
    low = [t.lower() for t in toks]
    if max(map(len, toks)) > _NAME_WORD:
        return None
    if " ".join(low) in LEAD_INS or any(t in COMMON for t in low if len(t) > 1):
        return None
    if len(toks) == 1:
        return ("one", low[0].rstrip("."), "") if len(low[0].rstrip(".")) > 1 else None
    words = [t for t in toks if len(t.rstrip(".")) > 1]
    if not (all(t[0].isupper() and t[1:] == t[1:].lower() for t in words) or all(t == t.upper() for t in words) or all(t == t.lower() for t in words)):
        if not all(t[0].isupper() for t in words):
            return None
    if len(low[0].rstrip(".")) == 1:
        return "initial", low[0][0], " ".join(low[1:]).rstrip(".")
    if len(low[-1].rstrip(".")) == 1:
        return "short", " ".join(low[:-1]), low[-1][0]
    return "full", low[0], " ".join(low[1:]).rstrip(".")


def scan(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, tuple[str, str, str]]]]:
    """(intervals to subtract, possible labels as (start, end, key)) of a text."""
    hits = [(e - n + 1, e + 1, k) for e, (k, n) in automaton().iter(text.translate(_LOWER))]
    noise: list[tuple[int, int]] = []
    hesitations: list[tuple[int, int]] = []
    voices: list[tuple[int, int, tuple[str, str, str]]] = []
    has_colon = False
    times = [m.span() for m in _TIME.finditer(text)] if ":" in text else []
    noise += times
    sounds = [(s, e) for s, e, k in hits if k == "sound" and not (s and text[s - 1].isalnum()) and _INFLECTED.match(text, e)]
    taken = 0

    def is_note(a: int, b: int) -> bool:
        """Whole sound words, and for each at most three other words, make a stretch a note."""
        n = sum(a < s and e < b for s, e in sounds)
        return n > 0 and len(_WORDS.findall(text, a, b)) <= 4 * n

    def covered(s: int, e: int) -> bool:
        return any(a <= s and e <= b for a, b in times)

    for s, e, kind in hits:
        if kind == "filler":
            before, after = text[s - 1] if s else " ", text[e] if e < len(text) else " "
            if before.isalnum() or after.isalnum() or before in "'’-_" or after in "'’_" or (after == "-" and e + 1 < len(text) and text[e + 1].isalnum()):
                continue
            tail = _TRAIL.match(text, e)
            hesitations.append((s, tail.end() if tail else e))
        elif kind == "anchor":
            ch = text[s]
            if ch == ":":
                has_colon = True
                continue
            if s < taken or covered(s, e):
                continue
            m = None
            if ch == "[":
                m = _SQUARE.match(text, s)
                if m and _COLON.match(text, m.end()):
                    continue  # a label in brackets
                if m and not is_note(*m.span()) and (m.group() != m.group().upper() or m.group() == m.group().lower() or not _MARKER.match(m.group())):
                    m = None
            elif ch == "(":
                m = _PAREN.match(text, s)
                if m and not is_note(*m.span()):
                    m = None
            elif ch == "*":
                m = _STAR.match(text, s)
                if m and not is_note(*m.span()):
                    m = None
            elif ch == "<":
                if v := _VOICE.match(text, s):
                    if key := _key(v[1]):
                        voices.append((v.start(), v.end(), key))
                        taken = v.end()
                    continue
                m = _TAG.match(text, s)
            else:
                m = _SONG.match(text, s)
            if m:
                noise.append(m.span())
                if ch != "<":
                    taken = m.end()
    labels = list(voices)
    if has_colon:
        masked = list(text)
        for s, e in noise:
            masked[s:e] = "\x00" * (e - s)
        for s, e in hesitations:  # a hesitation is no boundary before a label
            masked[s:e] = "\x01" * (e - s)
        flat = "".join(masked)
        for m in _LABEL_END.finditer(flat):
            lo = m.start()
            for _ in range(_REACH):
                lo = flat.rfind(" ", 0, lo) if lo > 0 else lo
            lo = max(0, lo)
            part = ("\x02" if lo else "") + flat[lo : m.end()]
            if any(s <= m.start() < e for s, e, _ in labels):
                continue
            for pattern in _LABEL:
                if hit := pattern.search(part):
                    if key := _key(hit["name"]):
                        start = lo + hit.start("at") - bool(lo)
                        end = m.end() + (2 if text.startswith("**", m.end()) else 0)
                        labels.append((start, end, key))
                    break
    labels.sort()
    return noise + hesitations, labels


def _near(x: str, y: str) -> bool:
    """Equal, or one letter inserted, left out, replaced or swapped with the next."""
    if x == y:
        return True
    n, m = len(x), len(y)
    if min(n, m) < 4 or abs(n - m) > 1:
        return False
    i = 0
    while i < min(n, m) and x[i] == y[i]:
        i += 1
    if n == m:
        return x[i + 1 :] == y[i + 1 :] or (x[i : i + 2] == y[i : i + 2][::-1] and x[i + 2 :] == y[i + 2 :])
    return x[i:] == y[i + 1 :] if n < m else x[i + 1 :] == y[i:]


def resolve(keys: list[tuple[str, str, str, int]]) -> list[tuple[str, str, str, str]]:
    """(kind, a, b, speaker) of the keys of one transcript that are labels.

    The roster holds the full names, those with most support first: how often a
    name stands in full, and how often its parts stand alone. A full name that
    is near a better supported one is a misspelling of it. Other keys take the
    best supported name that fits exactly, else nearly; a key that fits none is
    no label.
    """
    parts: dict[str, int] = {}
    for kind, a, b, n in keys:
        for w in (a,) if kind in ("one", "short") else (b,) if kind == "initial" else ():
            parts[w] = parts.get(w, 0) + n
    full: dict[tuple[str, str], int] = {}
    for kind, a, b, n in keys:
        if kind == "full":
            full[a, b] = full.get((a, b), 0) + n
    support = {f: n + parts.get(f[0], 0) + parts.get(f[1], 0) for f, n in full.items()}
    ranked = sorted(full, key=lambda f: (-support[f], -full[f], f))
    right: dict[tuple[str, str], tuple[str, str]] = {}
    for f in ranked:
        right[f] = next((right[g] for g in ranked if g in right and _near(f[0], g[0]) and _near(f[1], g[1])), f)
    out = []
    for kind, a, b, _ in keys:
        if kind == "num":
            out.append((kind, a, b, a))
            continue
        if kind == "full":
            fits = [lambda f: f == (a, b)]
        elif kind == "initial":
            fits = [lambda f: f[0].startswith(a) and f[1] == b, lambda f: f[0].startswith(a) and _near(f[1], b)]
        elif kind == "short":
            fits = [lambda f: f[0] == a and f[1].startswith(b), lambda f: _near(f[0], a) and f[1].startswith(b)]
        else:
            fits = [lambda f: a in f, lambda f: _near(f[0], a) or _near(f[1], a)]
        hit = next((right[f] for fit in fits for f in ranked if fit(f)), None)
        if hit:
            out.append((kind, a, b, " ".join(hit)))
    return out


def _without(text: str, start: int, end: int, noise: list[tuple[int, int]]) -> str:
    """text[start:end] minus the intervals; each leaves a blank."""
    out, at = [], start
    for s, e in noise:
        if e <= at or s >= end:
            continue
        out.append(text[at : max(at, s)])
        at = max(at, min(e, end))
    out.append(text[at:end])
    return " ".join(" ".join(out).split())


def _speech(clean: str) -> tuple[int, str]:
    kept = [w for w in clean.split() if any(c.isalnum() for c in w)]
    return len(kept), " ".join(kept)


_PIECES = "episode_id long, seg_index int, part long, piece_no int, kind string, a string, b string, n_words int, n_label int, words string, label_words string"


def _pieces(with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _PIECES.split(", ")]
        for pdf in batches:
            rows = []
            for ep, seg, text, part in zip(pdf["episode_id"].tolist(), pdf["seg_index"].tolist(), pdf["text"].tolist(), pdf["part"].tolist()):
                if not isinstance(text, str) or not text:
                    continue
                noise, labels = scan(text)
                noise.sort()
                cuts = [(0, 0, None), *labels]
                for k, (s, e, key) in enumerate(cuts):
                    to = cuts[k + 1][0] if k + 1 < len(cuts) else len(text)
                    n, words = _speech(_without(text, e, max(e, to), noise))
                    nl, lw = _speech(_without(text, s, e, noise)) if key else (0, "")
                    if key is None and n == 0:
                        continue
                    kind, a, b = key or (None, None, None)
                    rows.append((ep, None if seg != seg or seg is None else int(seg), part, k, kind, a, b, n, nl, words if with_text else None, lw if with_text else None))
            yield pd.DataFrame(rows, columns=names).astype({"seg_index": "Int32"})

    return run


def _resolve_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(ep, *r) for ep, keys in zip(pdf["episode_id"], pdf["keys"]) for r in resolve([(k["kind"], k["a"], k["b"], k["n"]) for k in keys])]
        yield pd.DataFrame(rows, columns=["episode_id", "kind", "a", "b", "speaker"])


def speaker_turns(segments: DataFrame, with_text: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(episode_id, turn_no, speaker, n_words, text) of every transcript in which a speaker label occurs.

    Exact second deliveries of a segment count once; different texts under one key
    (or under a null seg_index, which sorts first) all stay, in an
    order that only the texts decide. Null or empty texts give no words; a null episode_id is no transcript. Further columns are ignored.
    An empty table gives an empty result. Very long transcripts are cut into
    chunks of segments (see ``operators.scan``).
    """
    seg = segments.select(F.col("episode_id").cast("long"), F.col("seg_index").cast("int"), "text").filter("episode_id is not null")
    seg = seg.filter("text <> ''").withColumn("part", F.xxhash64("text")).dropDuplicates(["episode_id", "seg_index", "part"])
    pieces = written(seg.mapInPandas(_pieces(with_text), _PIECES), "pieces")

    keys = pieces.filter("kind is not null").groupBy("episode_id", "kind", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    listed = keys.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("kind", "a", "b", "n"))).alias("keys"))  # as many as a transcript has different labels
    resolved = listed.mapInPandas(_resolve_batches, "episode_id long, kind string, a string, b string, speaker string")
    resolved = written(resolved, "labels")
    small = broadcast_if_small(resolved)
    labelled = pieces.filter("kind is not null").join(small, ["episode_id", "kind", "a", "b"], "left")
    plain = pieces.filter("kind is null").withColumn("speaker", F.lit(None).cast("string"))
    rows = labelled.select(*plain.columns).unionByName(plain)
    rows = rows.join(broadcast_if_small(resolved.select("episode_id").distinct()), "episode_id", "left_semi")
    rejected = F.col("kind").isNotNull() & F.col("speaker").isNull()
    rows = rows.select(
        "episode_id", "seg_index", "part", "piece_no", "speaker",
        (F.col("n_words") + F.when(rejected, F.col("n_label")).otherwise(0)).alias("n"),
        F.when(rejected, F.concat_ws(" ", "label_words", "words")).otherwise(F.col("words")).alias("words"),
    )
    key, order = ["episode_id"], ["seg_index", "part", "piece_no"]
    rows, chunked = assign_chunks(rows, key, "seg_index", hot_rows)
    rows = running(rows, key, order, {"who": ("last", F.col("speaker"), True)}, chunked).drop("speaker")
    rows = rows.filter("n > 0").withColumn("who", F.coalesce("who", F.lit("unknown")))
    rows = running(rows, key, order, {"was": ("last", F.col("who"), False)}, chunked)
    rows = rows.withColumn("new", F.when(F.col("was") == F.col("who"), 0).otherwise(1))
    rows = running(rows, key, order, {"turn_no": ("sum", F.col("new"), True)}, chunked)
    aggs = [F.max("who").alias("speaker"), F.sum("n").alias("n_words")]
    if with_text:
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_index", "part", "piece_no", "words"))), lambda x: x["words"]), " ").alias("text"))
    return rows.groupBy("episode_id", "turn_no").agg(*aggs)
