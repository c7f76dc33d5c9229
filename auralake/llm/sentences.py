"""Problem 9: sentence boundaries across languages and scripts.

A line break always ends a sentence. Inside a line, quotations and brackets are
paired first; a terminator inside a pair ends nothing unless the pair closes
right behind it. What remains are terminators and gaps. In spaced scripts every
terminator is a node of a small lattice of readings (end, abbreviation, initial,
ordinal, decimal, address, ellipsis), resolved by what stands before and behind.
Stretches of a spaceless script are read into words by a lattice over a
dictionary that comes from the corpus (see ``words``); a gap, with a blank or
without, is classified by the closing particle before it and the opening word
behind it. Each document is read on its own, whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from auralake.llm.words import RUN, SPACELESS, Lattice, corpus_dictionary

# ---- fixed values: words and characters -------------------------------------------------------------
#: Never end a sentence: titles and words that lead to what follows.
LEADING = frozenset(
    "dr mr mrs ms prof st lt col gen capt sgt cpl maj cmdr rev hon sen rep gov pres fr hr hrn frau mme mlle mm sra srta dra sres dna vs cf approx ca bzw sog evtl ggf vgl env aprox av avda ee e.g i.e z.b d.h u.a p.ex p.ej "
    "π.χ κ κα κος δρ ул пр пер г-н г-жа т.е т.к डॉ श्री सं रु د أ p.e resp inkl exkl bspw avv dott ing sig mons exc exmo illmo".split()
)
#: Lead to a number, else are words.
NUMBERING = frozenset("no nos nr nrn fig figs sec secs p pp pag pág págs cap caps kap abb s art arts ext chap n vol ch par tab tbl eq op núm num d д стр с гл рис п αρ σελ κεφ सं रु n.º n.° º ° nº n° bd ziff tel".split())
#: May end a sentence: then a capital follows.
CLOSING = frozenset("etc inc ltd co corp llc plc jr sr bros al a.m p.m u.s u.k u.n m.d ph.d b.a m.a d.c usw usf uu руб коп г гг т.д т.п κ.ά κ.λπ min std str".split())
_ARTICLES = frozenset("el al del la o ao do da os los y e".split())
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
AFTER_ORDINAL = MONTHS | frozenset("jahrhundert jahrhunderts jahrhunderte staffel folge mal platz klasse stock auflage kapitel jahrestag geburtstag tag woche runde liga bezirk weltkrieg stunde minute etage reihe".split())
BEFORE_ORDINAL = frozenset("am im der die das dem den des vom zum zur beim ab bis seit jeder jede jedes ihre ihr seine sein unsere".split())
SHOUTING_NAMES = frozenset({"wow", "yahoo", "jeopardy", "oklahoma", "yum", "joomla"})
SAYING = frozenset("asked said wrote answered replied added whispered shouted says asks called cried laughed muttered explained insisted noted continued began sagte sagt fragte rief antwortete dit répond demande demanda dijo preguntó respondió disse perguntou".split())
SAID = re.compile(r"说|问|道[：，。！？]|答|喊|曰|말했|물었|대답했|외쳤|पूछा|कहा|बोला|बोली|बताया|قال|سأل|أجاب|صاح")

#: Documents whose sentences are handed on at once.
CHUNK = 2000

_BREAK = re.compile(r"\r\n|[\n\r\v\f\x85  ]")
_ITEM = re.compile(r"(?:[•◦▪‣⁃*–—-]|\d{1,3}[.)]|[a-zA-Z][)])\s+\S")
_CLOCK = re.compile(r"\[?\(?\d{1,2}:\d{2}(?::\d{2})?\)?\]?(?:\s|$)")
_TERM = ".!?…।॥؟۔。！？｡។៕။།;\u037e"
_TOKEN = re.compile(rf"[.!?…।॥؟۔。！？｡។៕။།]+|[;\u037e]|[“”„‟«»‹›「」『』（）《》〈〉【】()\[\]\"]|(?<=[{SPACELESS}])\s+(?=\S)|(?P<run>[{SPACELESS}]{{4,}})")
_PAIRS = {"“": "”", "„": "“”", "‟": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "《": "》", "〈": "〉", "【": "】", "(": ")", "[": "]"}
_CLOSERS = frozenset("”“»›」』）》〉】)]\"’'")
_QUOTES = frozenset("“”„‟«»‹›「」『』\"")
_ENDS_ALWAYS = frozenset("।॥۔。！？｡؟។៕။།")
_OPENING = frozenset("“„‟«‹「『《【(（[\"'‘¿¡")
_WORD_BEFORE = re.compile(r"[^\s“„«(\[\"'‘—–…/]*$")
_NEXT_WORD = re.compile(r"[^\s.,;:!?…।)\]”»\"“]+")
_CLAUSE_END = re.compile(r"[.!?।؟。！？“「«\"]")
_SPEECH = re.compile(r"(?:[A-ZÀ-ÞΑ-ΩА-Я][\w'’-]*\s+){1,3}(\w+)")

def _is_emoji(ch: str) -> bool:
    return unicodedata.category(ch) in ("So", "Sk") or ch in "️‍" or "\U0001f000" <= ch <= "\U0001faff"


def _caseless(ch: str) -> bool:
    return ch.isalpha() and not ch.isupper() and not ch.islower()


def _gap(line: str, s: int, e: int, lattice: Lattice) -> bool:
    """Does the blank line[s:e] behind a spaceless script part two sentences?

    In Thai it does, but before a mark of repetition or abbreviation. Elsewhere
    the word before it must be a closing particle or the one behind an opening
    word of a spaceless script, by the lattices of the stretches on both sides.
    """
    left, right = line[s - 1], line[e]
    if "฀" <= left <= "๿":
        return right not in "ๆฯ"
    k = s
    while k > 0 and RUN.match(line[k - 1]):
        k -= 1
    behind = RUN.match(line, e)
    if behind is None:
        return right in _OPENING and lattice.closes(line[k:s])
    return lattice.closes(line[k:s]) or lattice.opens(behind.group())


def _pair_up(line: str, tokens: list[re.Match]) -> dict[int, int]:
    """Open position -> close position of the paired quotations and brackets; what has no partner is plain."""
    stack: list[tuple[str, int]] = []
    pairs: dict[int, int] = {}
    for m in tokens:
        ch = m.group()
        if len(ch) != 1 or (ch not in _PAIRS and ch not in _CLOSERS):
            continue
        at = m.start()
        k = next((k for k in range(len(stack) - 1, -1, -1) if (stack[k][0] == '"' if ch == '"' else ch in _PAIRS.get(stack[k][0], ""))), None)
        if ch in "()[]" or k is not None:
            if k is not None and not (ch == "“" and stack[k][0] != "„"):
                pairs[stack[k][1]] = at
                del stack[k:]
                continue
        if ch in _PAIRS or ch == '"':
            stack.append((ch, at))
    return pairs


def _opens(line: str, at: int) -> bool:
    """May a sentence of a cased or caseless script begin at ``at``?"""
    n = len(line)
    while at < n and _is_emoji(line[at]):
        at += 1
        while at < n and line[at].isspace():
            at += 1
    if at >= n:
        return False
    ch = line[at]
    if ch in "—–-":
        k = at + 1
        while k < n and line[k].isspace():
            k += 1
        return k < n and (line[k].isupper() or line[k] in _OPENING or _caseless(line[k]))
    if ch in _OPENING:
        return True
    if ch.isalpha():
        if ch.islower():
            w = _NEXT_WORD.match(line, at)
            return bool(w) and any(c.isupper() for c in w.group()[1:3]) and "@" not in w.group()
        return True
    return ch.isdigit() or ch in "#$£€¥₹@"


def _period(line: str, start: int, s: int, e: int) -> bool:
    """The readings of a single full stop line[s:e] that doesn't end the line."""
    n = len(line)
    at = e
    while at < n and line[at].isspace():
        at += 1
    if at >= n:
        return True
    nxt = line[at]
    word = _WORD_BEFORE.search(line, max(start, s - 40), s).group()
    low = word.lower().rstrip(".")
    bare = low.lstrip("'’\"([")
    prev = line[s - 1] if s > start else ""
    if at == e:  # no blank behind
        token_end = at
        while token_end < n and not line[token_end].isspace():
            token_end += 1
        token = word + line[s:token_end]
        if "@" in token or "://" in token or low.startswith("www") or "/" in token:
            return False
        if nxt.isdigit():
            return False
        if nxt in _OPENING and nxt != "'":
            return bare not in LEADING and len(bare) > 1
        if _is_emoji(nxt):
            return True
        if not nxt.isalpha() or nxt.islower():
            w = _NEXT_WORD.match(line, at)
            return bool(w) and nxt.islower() and prev.isalpha() and len(bare) > 1 and re.match(r"[a-z][A-Z][a-z]+$", w.group()) is not None
        if bare in LEADING or bare in NUMBERING:
            return False
        if _caseless(nxt):
            return _caseless(prev) or prev.isdigit() or not prev.isascii() or prev in "%)”\"" or len(bare) > 1
        after = line[at + 1] if at + 1 < n else " "
        if after == ".":
            return prev.islower() and len(bare) > 1
        if len(bare) == 1 and prev.isupper():
            return False
        return after.islower() or after in "'’ " or after.isspace() or (after.isupper() and len(bare) > 1)
    if not _opens(line, at):
        return False
    nw = _NEXT_WORD.match(line, at)
    following = nw.group().lower() if nw else ""
    if bare in ("m", "m.") and re.search(r"\b[ap]\.\s?$", line[max(start, s - 5) : s - 1]):
        return True  # a. m., p. m. before a capital
    if bare in LEADING:
        return False
    if nxt.isdigit() and (bare in NUMBERING or bare.endswith("str")):
        return False
    if bare == "sr" and (not (before := line[start : s - len(word)].split()) or not before[-1][:1].isupper() or before[-1].lower() in _ARTICLES):
        return False  # a title, but not behind a name
    if bare in CLOSING:
        return not nxt.isdigit() or bare in ("etc", "inc", "a.m", "p.m", "u.s")
    if "." in bare:
        return all(len(x) <= 1 for x in bare.split(".")) is False or bare in CLOSING or bare.replace(".", "").isalpha() and word.isupper() or bare.split(".")[-1].isdigit()
    if len(bare) == 1 and prev.isalpha() and not (_caseless(prev) and not prev.isascii() and prev not in "د"):
        return False  # an initial, or a letter of an abbreviation written apart
    if bare.isdigit() and len(bare) <= 2 and nxt.isalpha():
        if following in AFTER_ORDINAL:
            return False
        before = line[start : s - len(word)].split()
        if before and before[-1].lower() in BEFORE_ORDINAL and nxt.isupper() and following not in ("im", "am", "die", "der", "das"):
            return False
    return True


def _ends(line: str, start: int, s: int, e: int) -> bool:
    """Does the run of terminators line[s:e], outside of any pair, end the sentence?"""
    run = line[s:e]
    n = len(line)
    if e >= n:
        return True
    if any(c in _ENDS_ALWAYS for c in run):
        return True
    if run in (";", "\u037e"):
        k = s - 1
        while k > start and not line[k].isalpha():
            k -= 1
        return run == "\u037e" or "\u0370" <= line[k] <= "\u03ff" or "\u1f00" <= line[k] <= "\u1fff"
    at = e
    while at < n and line[at].isspace():
        at += 1
    if at >= n:
        return True
    nxt = line[at]
    if run == ".":
        return _period(line, start, s, e)
    if "!" in run or "?" in run:
        if at == e:
            return nxt in _OPENING or nxt.isdigit() or nxt.isalpha() and not nxt.islower() or _is_emoji(nxt)
        if run == "!" and nxt.isupper():
            word = _WORD_BEFORE.search(line, max(start, s - 30), s).group()
            if word.lower() in SHOUTING_NAMES and word[:1].isupper() and s - len(word) > start:
                return False
        return _opens(line, at)
    # an ellipsis
    if _caseless(nxt):
        return "฀" <= nxt <= "๿" and at > e
    if at == e:
        return nxt.isupper() and s > start and line[s - 1].isalpha()
    return _opens(line, at)


def _quote_ends(line: str, start: int, qs: int, e: int) -> bool:
    """A pair that begins at ``qs`` closed before ``e`` right behind a terminator: does the sentence end there?"""
    n = len(line)
    at = e
    while at < n and line[at].isspace():
        at += 1
    if at >= n:
        return True
    nxt, first = line[at], not line[start:qs].strip(" \t —–-") or all(_is_emoji(c) or c.isspace() for c in line[start:qs])
    if line[qs] not in _QUOTES:
        return first and line[qs] in "([" and at > e and _opens(line, at)
    if nxt in ",،、，;:：.!?。…)" or nxt.islower() and not _opens(line, at):
        return False
    if nxt in "と" or line.startswith("って", at):
        return False
    if nxt in "—–-" and not _opens(line, at):
        return False
    if "가" <= nxt <= "힣" and at == e:
        return False
    if not first:
        return True
    if _caseless(nxt):
        stop = _CLAUSE_END.search(line, at)
        return not SAID.search(line[at : stop.start() + 1 if stop else n])
    if nxt.isupper():
        k = e - 1
        while k > qs and line[k] in "”“»›\"'’ \u00a0\u202f":
            k -= 1
        m = _SPEECH.match(line, at)
        return line[k] == "." or not (m and m.group(1).lower() in SAYING)
    return True


@lru_cache(maxsize=1)
def _given() -> Lattice:
    return Lattice()


def sentences(text: str, lattice: Lattice | None = None) -> list[tuple[int, int]]:
    """Half-open code-point offsets of the sentences of a text, without blanks around them.

    Without a lattice that of the given particles and opening words is used.
    """
    lattice = lattice or _given()
    out: list[tuple[int, int]] = []
    at = 0
    for br in _BREAK.finditer(text):
        _line(text[at : br.start()], at, out, lattice)
        at = br.end()
    _line(text[at:], at, out, lattice)
    return out


def _line(line: str, offset: int, out: list[tuple[int, int]], lattice: Lattice) -> None:
    body = line.strip()
    if not body:
        return
    lead = len(line) - len(line.lstrip())
    if _ITEM.match(body) or (_CLOCK.match(body) and body[-1] not in _TERM):
        out.append((offset + lead, offset + lead + len(body)))
        return
    line, offset = body, offset + lead
    tokens = list(_TOKEN.finditer(line))
    pairs = _pair_up(line, tokens)
    closes = {c: o for o, c in pairs.items()}
    n, start, skip, depth_end = len(line), 0, -1, -1
    cuts: list[tuple[int, int]] = []

    def cut(e: int) -> int:
        nonlocal start
        cuts.append((start, e))
        while e < n and line[e].isspace():
            e += 1
        start = e
        return e

    for m in tokens:
        s, e = m.span()
        if s < skip:
            continue
        ch = line[s]
        if s in pairs:
            depth_end = max(depth_end, pairs[s])
            continue
        if m.lastgroup == "run":
            if s > depth_end:
                for at in lattice.seams(m.group()):
                    cut(s + at)
            continue
        if ch not in _TERM and not ch.isspace():
            continue
        if ch.isspace():
            if s > depth_end and s > start and _gap(line, s, e, lattice):
                cut(s)
            continue
        if s > depth_end:
            # closing marks without a partner still belong to the sentence
            k = e
            while k < n and line[k] in "”’»)]』」" and k not in pairs and ch not in ";\u037e":
                k += 1
            if k >= n or _ends(line, start, s, k if k == e else e) and (k == e or _opens(line, k + (k < n and line[k].isspace()))):
                skip = cut(k)
            continue
        # inside a pair: only if the outermost pair closes right behind
        k, outer = e, None
        while k < n:
            j = k
            while j < n and line[j] in "   " and j - k < 2:
                j += 1
            if j in closes and (j == k or line[j] in "»›"):
                outer, k = closes[j], j + 1
            else:
                break
        if outer is None or k - 1 < depth_end:
            continue
        if _quote_ends(line, start, outer, k):
            skip = cut(k)
    if start < n:
        cuts.append((start, n))
    out.extend((offset + a, offset + b - (len(line[a:b]) - len(line[a:b].rstrip()))) for a, b in cuts if line[a:b].strip())


def split_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, char_start, char_end) of every sentence; a document of null, empty or blank text has none.

    The dictionary of the spaceless scripts comes from all documents (at most
    ``words.MAX_WORDS`` words, broadcast). Every row is then read on its own, so
    repeated documents give repeated sentences. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    shared = documents.sparkSession.sparkContext.broadcast(corpus_dictionary(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(shared.value)
        for pdf in batches:
            docs, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            for at in range(0, len(docs), CHUNK):  # so that few results are held at once
                ids, starts, ends = [], [], []
                for doc, text in zip(docs[at : at + CHUNK], texts[at : at + CHUNK]):
                    if isinstance(text, str):
                        for a, b in sentences(text, lattice):
                            ids.append(doc)
                            starts.append(a)
                            ends.append(b)
                yield pd.DataFrame({"doc_id": ids, "char_start": starts, "char_end": ends})

    return rows.mapInPandas(run, "doc_id long, char_start long, char_end long")
