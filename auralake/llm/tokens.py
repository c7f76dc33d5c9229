"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary.

Bytes become Latin-1 characters, over which an Aho-Corasick automaton of the
whole vocabulary finds every token that occurs in a word. From longest matches,
backtracking finds the one sequence whose neighbours are all compatible; that is
the sequence the merges give. Compatibility of two tokens (do the merges leave
them as they are, side by side?) is memoised, as are the ids of words.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

DEFAULT_FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
# Fixed value: how the vocabulary's texts are cut into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids are remembered per worker; longer words are not kept.
WORDS, WORD_BYTES = 400_000, 48
#: Documents whose ids are handed on at once.
CHUNK = 1000


class Encoder:
    """Exact encoder of a ranked byte vocabulary (lines of base64 token and rank)."""

    def __init__(self, ranks: bytes):
        import ahocorasick
        import regex

        self.ids = {base64.b64decode(t).decode("latin-1"): int(r) for t, r in (line.split() for line in ranks.splitlines() if line)}
        self.tokens = {r: t for t, r in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for t, r in self.ids.items():
            self.automaton.add_word(t, (r, len(t)))
        self.automaton.make_automaton()
        self.words = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def merged(self, s: str) -> list[int]:
        """The merges applied one by one, lowest rank first (for short strings)."""
        parts = list(s)
        while len(parts) > 1:
            k, low = -1, None
            for i in range(len(parts) - 1):
                r = self.ids.get(parts[i] + parts[i + 1])
                if r is not None and (low is None or r < low):
                    k, low = i, r
            if k < 0:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            ok = self.fits[key] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return ok

    def word(self, s: str) -> list[int]:
        """Ids of one word (Latin-1 characters for bytes)."""
        whole = self.ids.get(s)
        if whole is not None:
            return [whole]
        n = len(s)
        starts: list[list[int]] = [[] for _ in range(n)]  # the ids at each start, shortest first
        for end, (r, length) in self.automaton.iter(s):
            starts[end - length + 1].append(r)
        size = {r: len(self.tokens[r]) for m in starts for r in m}
        dead = [False] * (n + 1)
        path: list[tuple[int, int]] = []  # (id, its place among the matches at its start)
        at, turn = 0, len(starts[0]) - 1
        while at < n:
            here, prev = starts[at], path[-1][0] if path else None
            while turn >= 0:
                r = here[turn]
                if not dead[at + size[r]] and (prev is None or self.compatible(prev, r)):
                    break
                turn -= 1
            if turn >= 0:
                path.append((here[turn], turn))
                at += size[here[turn]]
                turn = len(starts[at]) - 1 if at < n else 0
            else:
                dead[at] = True
                r, turn = path.pop()
                at -= size[r]
                turn -= 1
        return [r for r, _ in path]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for w in self.words(text):
            ids = known.get(w)
            if ids is None:
                raw = w.encode("utf-8", "surrogatepass")
                ids = self.word(raw.decode("latin-1"))
                if len(raw) <= WORD_BYTES:
                    if len(known) >= WORDS:
                        known.clear()
                    known[w] = ids
            out += ids
        return out


_BUILT: dict[str, Encoder] = {}


def encoder(ranks: bytes) -> Encoder:
    """The encoder of a vocabulary, built once per Python process."""
    key = hashlib.md5(ranks).hexdigest()
    if key not in _BUILT:
        _BUILT[key] = Encoder(ranks)
    return _BUILT[key]


def vocabulary(folder: str = DEFAULT_FOLDER, name: str = VOCABULARY) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def encode_documents(documents: DataFrame, folder: str = DEFAULT_FOLDER, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens.

    Empty and null texts have the defined ids of an empty list. Texts are read
    whole, each row on its own: no shuffle. The vocabulary (under 1 MB, whatever
    the corpus) reaches the workers as a broadcast variable.
    """
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(folder, name))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(shared.value)
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):  # so that few lists of ids are held at once
                part = pdf.iloc[at : at + CHUNK]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [enc.encode(t) if isinstance(t, str) else [] for t in part["text"].tolist()]})

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], folder: str = DEFAULT_FOLDER, name: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and n_tokens of every document; null and empty texts have 0."""
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(folder, name))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(shared.value)
        for pdf in batches:
            n = [len(enc.encode(t)) if isinstance(t, str) else 0 for t in pdf["text"].tolist()]
            yield pdf[keep].assign(n_tokens=n)

    rows = documents.select(*keep, "text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep] + ["n_tokens int"])
    return rows.mapInPandas(run, schema)
