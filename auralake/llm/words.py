"""A dictionary of the spaceless scripts from the corpus, and word lattices over it.

Every stretch of a spaceless script (Thai, Lao, Khmer, Burmese, Han, kana) gives
all its substrings up to MAX_WORD characters; those that stand beside many
different neighbours are words (accessor variety, counted over all documents).
A lattice holds every reading of a stretch as a row of words and single
characters; the reading of greatest weight is taken, where a word weighs its
length times the logarithm of its variety. Particles that close a sentence and
words that open one are in every dictionary.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.session import written

#: Longest word in characters, least variety of a word, most words of a dictionary (the size of the model: it is broadcast).
MAX_WORD, LEAST_VARIETY, MAX_WORDS = 12, 3, 50_000
#: Variety of the words every dictionary holds.
GIVEN_VARIETY = 60

# Particles and endings that close a sentence.
FINALS = frozenset(
    "です ます ました ません でした でしょう ですね ですよ ますね ますよ ください ましょう だよ だね 吗 吧 呢 啊 呀 嘛 ครับ ค่ะ คะ นะครับ นะคะ จ้ะ จ๊ะ ล่ะครับ ล่ะคะ ຄັບ ເຈົ້າ ເດີ້ ហើយ ទេ បាទ ចាស ပါတယ် ပါသည် ပါဘူး ပါ့မယ် သလား လား".split()
)
# Words that open a sentence.
OPENERS = frozenset(
    "そして しかし でも だから また 次に それでは では さて 今日 今日は 今週 本当に どうして なぜ ところで ありがとう 但是 所以 不过 因此 然后 今天 本周 为什么 我们 你们 他们 谢谢 大家好 首先 最后 "
    "วันนี้ ขอบคุณ สวัสดี ทำไม แต่ เพราะ ดังนั้น ต่อไป แขกรับเชิญ ຂອບໃຈ ມື້ນີ້ ສະບາຍດີ ແຕ່ ເປັນຫຍັງ ថ្ងៃនេះ អរគុណ ប៉ុន្តែ ហេតុអ្វី សូមស្វាគមន៍ ဒီနေ့ ကျေးဇူးတင်ပါတယ် ဒါပေမဲ့ ဘာကြောင့် မင်္ဂလာပါ".split()
)
# Words in which an ending of the first list is no ending.
PLAIN = frozenset("ますます ますから ですから ですが ますが ですので ますので だから ですら それでは 大吗啡 吗啡 呢喃 啊哈 酒吧 网吧 吧台 คะแนน ចាសៗ".split())

#: Ranges of the spaceless scripts, each a class of characters.
SPACELESS = "฀-๿຀-໿ក-៹က-႟぀-ヿ㐀-鿿豈-﫿々"
RUN = re.compile(f"[{SPACELESS}]+")


class Lattice:
    """The best reading of a stretch by a dictionary of word -> variety."""

    def __init__(self, varieties: dict[str, int] | None = None):
        known = dict(varieties or {})
        for w in FINALS | OPENERS | PLAIN:
            known[w] = max(known.get(w, 0), GIVEN_VARIETY)
        self.weight = {w: len(w) * math.log(1 + v) for w, v in known.items() if len(w) > 1 or w in FINALS}
        self.longest = max(map(len, self.weight))
        self.known: dict[str, tuple[tuple[int, int], ...]] = {}
        self.calls = 0

    def words(self, run: str) -> tuple[tuple[int, int], ...]:
        """The words of a stretch as half-open ranges (of equal weight the reading of fewer words)."""
        got = self.known.get(run)
        if got is None:
            got = self._read(run)
            if len(run) <= 200:
                if len(self.known) >= 100_000:
                    self.known.clear()
                self.known[run] = got
        return got

    def _read(self, run: str) -> tuple[tuple[int, int], ...]:
        self.calls += 1
        n, weight, longest = len(run), self.weight, self.longest
        best = [0.0] + [-1.0] * n
        back = [0] * (n + 1)
        for i in range(n):
            here = best[i] - 1e-6  # so that fewer words win a tie
            if here > best[i + 1]:
                best[i + 1], back[i + 1] = here, i
            for j in range(i + 1, min(n, i + longest) + 1):
                w = weight.get(run[i:j])
                if w is not None and here + w > best[j]:
                    best[j], back[j] = here + w, i
        out = []
        while n > 0:
            out.append((back[n], n))
            n = back[n]
        return tuple(reversed(out))

    def seams(self, run: str) -> list[int]:
        """Places where a closing particle (or a row of them) ends and an opening word begins."""
        parts = self.words(run)
        out = []
        for (a, b), (c, d) in zip(parts, parts[1:]):
            if run[a:b] in FINALS and run[c:d] in OPENERS:
                out.append(c)
        return out

    def closes(self, run: str) -> bool:
        """Is the last word a closing particle?"""
        a, b = self.words(run)[-1]
        return run[a:b] in FINALS

    def opens(self, run: str) -> bool:
        """Is the first word an opening one?"""
        a, b = self.words(run)[0]
        return run[a:b] in OPENERS


def _run_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found: Counter[str] = Counter()
        for t in pdf["text"]:
            if isinstance(t, str):
                found.update(RUN.findall(t))
        yield pd.DataFrame({"run": list(found), "n": list(found.values())})


def _gram_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen: set[tuple[str, str, str]] = set()
        for run in pdf["run"]:
            n = len(run)
            for i in range(n):
                left = run[i - 1] if i else "^"
                for j in range(i + 2, min(n, i + MAX_WORD) + 1):
                    seen.add((run[i:j], left, run[j] if j < n else "$"))
            if len(seen) > 200_000:
                yield pd.DataFrame(list(seen), columns=["gram", "before", "behind"])
                seen = set()
        yield pd.DataFrame(list(seen), columns=["gram", "before", "behind"])


def corpus_dictionary(documents: DataFrame, max_words: int = MAX_WORDS) -> dict[str, int]:
    """word -> variety: the words of the spaceless scripts in ``documents`` (columns text and others).

    The variety of a string is the lesser of the number of different characters
    before and behind it; ends of stretches count as one each, so a word must
    stand among others. Counts cover all documents: equal stretches are put
    together before the shuffle and spread their substrings once. Null texts
    have none; without such scripts the dictionary is empty.
    """
    has = F.col("text").rlike(f"[{SPACELESS}]")
    runs = written(documents.select("text").filter(has).mapInPandas(_run_batches, "run string, n long").groupBy("run").agg(F.sum("n").alias("n")), "runs")
    grams = runs.select("run").mapInPandas(_gram_batches, "gram string, before string, behind string")
    sides = grams.groupBy("gram").agg(F.approx_count_distinct("before", 0.02).alias("l"), F.approx_count_distinct("behind", 0.02).alias("r"))
    variety = F.least("l", "r").cast("int")
    words = sides.select("gram", variety.alias("v")).filter(F.col("v") >= LEAST_VARIETY)
    top = words.orderBy(F.desc(F.length("gram") * F.log1p("v")), "gram").limit(max_words)
    return {r.gram: r.v for r in top.collect()}  # at most max_words
