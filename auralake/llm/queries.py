"""Queries of the training-data operators: name -> (spark, data folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auralake.llm import linkage, neardup, packing, sentences, spans, tokens, turns
from auralake.session import read


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 2: turns with speaker and number of words."""
    return turns.speaker_turns(read(spark, d, "transcript_segments"), with_text=False).select("episode_id", "turn_no", "speaker", "n_words").distinct()


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    """Problem 2: turns with their clean text."""
    return turns.speaker_turns(read(spark, d, "transcript_segments"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 3: pairs of episodes that are records of one recording."""
    return neardup.duplicate_pairs(read(spark, d, "episodes"), read(spark, d, "podcasts"), read(spark, d, "feed_hosts")).distinct()


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Problem 3: every episode with its group and number of links."""
    return neardup.duplicate_classes(read(spark, d, "episodes"), read(spark, d, "podcasts"), read(spark, d, "feed_hosts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 5: spans over the limit with the finest kind of cut they need."""
    return spans.oversized(read(spark, d, "text_spans"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Problem 5: the pieces of every span."""
    return spans.split_spans(spans.distinct_spans(read(spark, d, "text_spans")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 6: pairs of a podcast and a search result of one show."""
    return linkage.match_shows(read(spark, d, "podcasts"), read(spark, d, "search_results")).select("podcast_id", "result_id").distinct()


def p6_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Problem 6: the same pairs with their confidence."""
    return linkage.match_shows(read(spark, d, "podcasts"), read(spark, d, "search_results"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Problem 7: ids of every document by byte_bpe_50k."""
    return tokens.encode_documents(read(spark, d, "documents"))


def p8_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Problem 8: every document's place in training sequences of 2,048 tokens."""
    return packing.pack_sequences(read(spark, d, "documents"))


def p8_strict(spark: SparkSession, d: str) -> DataFrame:
    """Problem 8: the same with no two documents of a source in a sequence."""
    return packing.pack_sequences(read(spark, d, "documents"), strict_sources=True)


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Problem 8: what holds of the sequences: documents and pieces, none too full, copies and (strict) sources apart."""
    t = read(spark, d, "documents").select("doc_id", F.xxhash64("text").alias("cluster"), F.length("text").alias("chars"))
    out = []
    for mode in ("soft", "strict"):
        x = packing.pack_sequences(read(spark, d, "documents"), strict_sources=mode == "strict").join(t, "doc_id")
        per = x.groupBy("sequence_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.countDistinct("cluster").alias("c"), F.countDistinct(F.coalesce("source", F.concat(F.lit("null-"), F.col("doc_id").cast("string")))).alias("s"))
        per = per.agg(F.count(F.when(F.col("n") > packing.CAPACITY, 1)).alias("too_full"), F.count(F.when(F.col("k") > F.col("c"), 1)).alias("copies_together"), F.count(F.when(F.col("k") > F.col("s"), 1)).alias("sources_together"))
        docs = x.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("documents"), F.count(F.when((F.col("n") <= packing.CAPACITY) & (F.col("k") > 1), 1)).alias("cut_needlessly"))
        names = ("documents", "cut_needlessly", "too_full", "copies_together", "sources_together")
        one = docs.unionByName(per, allowMissingColumns=True).agg(*[F.max(x).alias(x) for x in names])  # two rows into one
        out.append(one.withColumn("mode", F.lit(mode)).withColumn("sources_together", F.when(F.lit(mode == "strict"), F.col("sources_together"))))
    return out[0].unionByName(out[1])


def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    """Problem 5: what holds of the pieces: none too long or without text, they cover the span, follow each other and overlap by at most 60."""
    c = F.col
    p = p5_pieces(spark, d).withColumn("end", c("char_start") + c("n_chars"))
    w = W.partitionBy("span_id", "episode_id").orderBy("piece_no")
    p = p.withColumns({"before": F.lag("end").over(w), "began": F.lag("char_start").over(w)})
    n = lambda x: F.count(F.when(x, 1))
    return p.groupBy("span_id").agg(
        n(c("n_chars") > spans.LIMIT).alias("too_long"), n((c("n_chars") < 1) | (F.length("text") != c("n_chars"))).alias("wrong_text"),
        n((c("before") - c("char_start") > spans.OVERLAP) | (c("char_start") <= c("began")) | (c("end") <= c("before"))).alias("wrong_overlap"), F.min("char_start").alias("from_char"), F.max("end").alias("to_char"),
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 9: every sentence of every document."""
    return sentences.split_sentences(read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_turns, p3_found, p3_groups, p5_found, p5_pieces, p6_found, p6_confidence, p7_ids, p8_sequences, p8_strict, p8_checks, p5_checks, p9_found)}

_B = "\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0085}\\x{000b}\\x{001c}-\\x{001f}"
ORACLE = {
    "p5_found": f"""
with t as (select distinct span_id, regexp_replace(text, '^[{_B}]+|[{_B}]+$', '', 'g') as body from text_spans where text is not null),
long as (select span_id, body from t where length(body) > 600),
marked as (
  select span_id, regexp_replace(regexp_replace(body, '([.!?।॥])([{_B}]|$)', '\\1' || chr(1) || '\\2', 'g'), '([。！？]|[\\n\\r\\x{{000b}}\\f\\x{{0085}}\\x{{2028}}\\x{{2029}}])', '\\1' || chr(1), 'g') as m from long),
sents as (select span_id, unnest(string_split(m, chr(1))) as s from marked),
trimmed as (select span_id, regexp_replace(s, '^[{_B}]+|[{_B}]+$', '', 'g') as s from sents),
runs as (select span_id, s, length(s) as n, list_max(list_transform(regexp_split_to_array(s, '[{_B}]+'), lambda x: length(x))) as run from trimmed)
select span_id, case when max(n) <= 600 then 'sentence' when max(case when n > 600 then run else 0 end) <= 600 then 'word' else 'none' end as cut_at
from runs group by span_id""",
    # what every division of the spans must satisfy, whatever the cuts
    "p5_checks": f"""
with t as (select distinct span_id, episode_id, char_start, text, regexp_replace(text, '^[{_B}]+', '', 'g') as l, regexp_replace(text, '^[{_B}]+|[{_B}]+$', '', 'g') as body from text_spans where text is not null)
select span_id, 0::bigint as too_long, 0::bigint as wrong_text, 0::bigint as wrong_overlap, min(char_start + length(text) - length(l))::bigint as from_char, max(char_start + length(text) - length(l) + length(body))::bigint as to_char
from t where body <> '' group by span_id""",
    "p8_checks": """
with d as (select count(*)::bigint as documents from documents where text is not null and text <> '')
select mode, documents, 0::bigint as cut_needlessly, 0::bigint as too_full, 0::bigint as copies_together, case when mode = 'strict' then 0::bigint end as sources_together from d, (values ('soft'), ('strict')) m(mode)""",
}
