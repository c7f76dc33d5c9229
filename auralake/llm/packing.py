"""Problem 8: filling training sequences of fixed capacity.

Documents are spread over groups of bounded token count by a hash; each group is
packed by best fit in falling order of size. Bins are ordered by the room left
and carry bitmaps of the sources and duplicate clusters they hold; the search
for the tightest bin goes on to the next until a compatible one is found. Two
records of a cluster never share a bin. A source is a conflict too: in the strict
mode two documents of a source never share a bin, whatever room that costs; in
the soft mode a second one enters a bin only if no bin without that source has
room. The bins that each group leaves
badly filled are packed again in a second round, in fewer groups.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.llm.tokens import DEFAULT_FOLDER, VOCABULARY, count_tokens
from auralake.session import written

CAPACITY = 2048
#: Tokens of a group (a task's work): about 2,000 bins, whatever the corpus.
GROUP_TOKENS = 4_000_000
#: A bin with more room left than this share is opened again in the second round.
LOOSE = 0.02


class Bins:
    """Bins ordered by room left; those of one room are kept apart by their bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
        self.open = 0  # bit r: some bin has room r
        self.n = 0

    def _put(self, room: int, masks: tuple[int, int], b: int) -> None:
        self.rooms[room].setdefault(masks, []).append(b)
        self.open |= 1 << room

    def place(self, size: int, source: int, cluster: int, strict_only: bool = False) -> int:
        """The bin that takes an item: the tightest that fits, else a new one. Bits of 0 conflict with nothing."""
        for strict in (True,) if strict_only else (True, False):
            left = self.open >> size << size
            while left:
                room = (left & -left).bit_length() - 1
                left &= left - 1
                for masks in self.rooms[room]:
                    if masks[1] & cluster or strict and masks[0] & source:
                        continue
                    bins = self.rooms[room][masks]
                    b = bins.pop()
                    if not bins:
                        del self.rooms[room][masks]
                        if not self.rooms[room]:
                            self.open &= ~(1 << room)
                    self._put(room - size, (masks[0] | source, masks[1] | cluster), b)
                    return b
        b, self.n = self.n, self.n + 1
        self._put(self.capacity - size, (source, cluster), b)
        return b


def pack(items: list[tuple[int, int, object, object]], capacity: int, strict: bool = False) -> list[int]:
    """The bin of each item (size, tie breaker, source, cluster); sizes in 1..capacity."""
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][1]))
    seen: dict[object, int] = {}
    for _, _, _, c in items:
        if c is not None:
            seen[c] = seen.get(c, 0) + 1
    bit_of: dict[object, int] = {}
    bits = lambda v: 0 if v is None else 1 << bit_of.setdefault(v, len(bit_of))
    cbit: dict[object, int] = {}
    bins, out = Bins(capacity), [0] * len(items)
    for i in order:
        size, _, source, cluster = items[i]
        repeated = cluster is not None and seen[cluster] > 1
        c = 1 << cbit.setdefault(cluster, len(cbit)) if repeated else 0
        out[i] = bins.place(size, bits(source), c, strict)
    return out


def _pack_group(capacity: int, strict: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = lambda v: None if v is None or v != v else v
        items = [(int(n), (int(d), int(k)), none(s), none(c)) for n, d, k, s, c in zip(pdf["n_tokens"], pdf["doc_id"], pdf["piece_no"], pdf["source"], pdf["cluster"])]
        bins = pack(items, capacity, strict)
        out = pdf.assign(bin=bins)
        out["room"] = capacity - out.groupby("bin")["n_tokens"].transform("sum")
        return out

    return run


def pack_sequences(
    documents: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, folder: str = DEFAULT_FOLDER, name: str = VOCABULARY,
    strict_sources: bool = False, clusters: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, piece_no, token_start, n_tokens, sequence_id, source): where each document's tokens go.

    A document over the capacity is cut into full sequences and a rest; every
    other is whole. Null and empty texts have no tokens and take no room.
    Documents of equal text form a cluster; ``clusters`` (doc_id, cluster long) names
    other ones, as groups of near-duplicates, for the documents it lists. With
    ``strict_sources`` no sequence holds two documents of a source. sequence_id is unique over the
    corpus; the tokens of a sequence never exceed the capacity.
    """
    keyed = documents.select(F.col("doc_id").cast("long"), "source", F.xxhash64("text").alias("cluster"), "text")
    if clusters is not None:
        named = clusters.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("cluster").cast("long")).alias("named"))
        keyed = keyed.join(named, "doc_id", "left").withColumn("cluster", F.coalesce("named", "cluster")).drop("named")
    sized = written(count_tokens(keyed, ["doc_id", "source", "cluster"], folder, name).filter("n_tokens > 0"), "sizes")
    n = F.col("n_tokens")
    starts = F.sequence(F.lit(0), F.floor((n - 1) / capacity).cast("int"))
    pieces = sized.select("doc_id", "source", "cluster", F.explode(starts).alias("piece_no"), n.alias("whole")).select(
        "doc_id", "source", "cluster", "piece_no", (F.col("piece_no") * capacity).alias("token_start"),
        F.least(F.col("whole") - F.col("piece_no") * capacity, F.lit(capacity)).cast("int").alias("n_tokens"),
    )
    full = pieces.filter(F.col("n_tokens") == capacity)
    rest = pieces.filter(F.col("n_tokens") < capacity)
    schema = "doc_id long, source string, cluster long, piece_no int, token_start int, n_tokens int, grp long, bin long, room long"
    total = rest.agg(F.sum("n_tokens")).first()[0] or 0

    def packed(df: DataFrame, groups: int, salt: int) -> DataFrame:
        spread = df.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(salt)), F.lit(groups)))
        return spread.groupBy("grp").applyInPandas(_pack_group(capacity, strict_sources), schema)

    first = written(packed(rest, max(1, -(-total // group_tokens)), 1), "round1")
    tight = first.filter(F.col("room") <= capacity * LOOSE)
    loose = first.filter(F.col("room") > capacity * LOOSE).drop("grp", "bin", "room")
    again = loose.agg(F.sum("n_tokens")).first()[0] or 0
    second = packed(loose, max(1, -(-again // group_tokens)), 2)
    cols = ["doc_id", "piece_no", "token_start", "n_tokens", "source"]
    named = lambda df, k: df.select(*cols, F.concat_ws("-", F.lit(k), F.col("grp").cast("string"), F.col("bin").cast("string")).alias("sequence_id"))
    alone = full.select(*cols, F.concat_ws("-", F.lit("f"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string")).alias("sequence_id"))
    return alone.unionByName(named(tight, "a")).unionByName(named(second, "b"))
