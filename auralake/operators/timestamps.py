"""Problem 1: timestamps in many notations and zones to one UTC instant.

Raw strings are reduced to a dictionary of distinct (raw, zone) values. Each
entry is parsed once, by column expressions only: one pattern per notation
rewrites the string into the same nine fields, from which the instant is
computed by integer arithmetic (so no setting of the session matters). The
dictionary is a written table that later batches extend: only entries not yet in
it are parsed. Rows get their instants by a join; raw values that fill a large
part of the rows are joined apart, by a broadcast of bounded size.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.session import broadcast_if_small, scratch_path

# Zone abbreviations (North America, Europe, Japan) in minutes from UTC.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "JST": 540,
}

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
_MONTH = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"\s*((?:UTC|GMT|Z|z)?\s?[+-]\d{1,2}(?::?\d{2})?(?:\[[A-Za-z0-9_/+-]+\])?|[A-Za-z][A-Za-z0-9_+-]*(?:/[A-Za-z0-9_+-]+)*|\[[A-Za-z0-9_/+-]+\]|[Zz]\[[A-Za-z0-9_/+-]+\])?"
_DAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,?\s+)?"

#: Notation -> pattern and the places of year, month, day, hour, minute, second, am/pm, zone in it.
NOTATIONS: tuple[tuple[str, str], ...] = (
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:(?:[Tt]|\s+){_CLOCK}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,]\d+)?{_ZONE}$", "$1|$2|$3|$4|$5|$6||$7"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1|$2|$3|||||"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{2}}|\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{2}}|\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"(?i)^{_DAY}(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+{_MONTH}[\s,-]+(\d{{2}}|\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"(?i)^{_DAY}{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8"),
    (rf"(?i)^{_DAY}{_MONTH}\s+(\d{{1,2}})\s+{_CLOCK}(?:\s+([A-Za-z]{{2,5}}|[+-]\d{{2}}:?\d{{2}}))?\s+(\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6|$7"),
)


def _zone_ids(spark: SparkSession) -> list[str]:
    """The zone names the executing JVM knows; an unknown name gives no instant instead of an error."""
    return sorted(str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())


def parse_instants(df: DataFrame, raw: str = "raw", zone: str = "zone", out: str = "utc_second") -> DataFrame:
    """Add the whole seconds since 1970 UTC that ``raw`` denotes, else null.

    ``zone`` is the zone of a time that names none (null or unknown: UTC). A
    local time that occurs twice is the earlier instant; a skipped one is read
    with the offset before the change. Fractions are dropped. A day alone is its
    midnight. Text that names no existing calendar time, and null, give null.

    The steps are separate projections on purpose: the planner keeps a costly
    expression that is used more than once in a projection of its own.
    """
    ids = _zone_ids(df.sparkSession)
    keep = [x for x in df.columns if x != out]  # a column of that name is replaced
    s = F.regexp_replace(F.col(raw), r"^[\s\p{Z}\p{Cc}\ufeff]+|[\s\p{Z}\p{Cc}\ufeff]+$", "")
    step = df.withColumn("__t", F.regexp_replace(s, r"\p{Z}", " "))
    fields = F.lit(None).cast("string")
    for pattern, places in reversed(NOTATIONS):
        fields = F.when(F.col("__t").rlike(pattern), F.regexp_replace("__t", pattern, places)).otherwise(fields)
    step = step.withColumn("__f", F.split(fields, r"\|", -1))  # -1 keeps empty trailing fields
    p = [F.col("__f")[i] for i in range(8)]
    named = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(p[1], 1, 3)))
    y = p[0].try_cast("int")
    step = step.withColumns({
        "__y": F.when(F.length(p[0]) <= 2, y + 2000).otherwise(y),
        "__mo": F.coalesce(p[1].try_cast("int"), F.when(named % 3 == 1, F.floor((named + 2) / 3).cast("int"))),
        "__d": p[2].try_cast("int"),
        "__h": F.coalesce(p[3].try_cast("int"), F.lit(0)),
        "__mi": F.coalesce(p[4].try_cast("int"), F.lit(0)),
        "__s": F.coalesce(p[5].try_cast("int"), F.lit(0)),
        "__half": F.lower(p[6]),
        "__z": F.trim(p[7]),
        "__epoch": F.when(F.col("__t").rlike(r"^-?\d{9,10}$|^-?\d{13}$|^-?\d{16}$"), F.col("__t").try_cast("long")),
    })
    c = F.col
    digits = F.regexp_extract("__z", r"^(?:UTC|GMT|Z|z)?\s?[+-](\d{1,2}(?::?\d{2})?)(?:\[.*\])?$", 1)
    step = step.withColumns({
        "__first": F.make_date(F.when(c("__y").between(1, 9999), c("__y")).otherwise(F.lit(1970)), F.when(c("__mo").between(1, 12), c("__mo")).otherwise(F.lit(1)), F.lit(1)),
        "__clock": F.when(c("__half") == "", c("__h")).when(c("__half") == "p", c("__h") % 12 + 12).otherwise(c("__h") % 12),
        "__digits": F.regexp_replace(digits, ":", ""),
        "__minus": c("__z").rlike(r"^[A-Za-z]*\s?-"),
        "__short": F.upper(F.regexp_replace("__z", r"^[Zz]?\[|\]$", "")),
        "__region": F.regexp_extract("__z", r"^[Zz]?\[?([A-Za-z0-9_/+-]+)\]?$", 1),
    })
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    n = F.coalesce(c("__digits").try_cast("int"), F.lit(0))
    minutes = F.when(F.length("__digits") <= 2, n * 60).otherwise(F.floor(n / 100).cast("int") * 60 + n % 100)
    sound = (n % 100 <= 59) & (minutes <= 18 * 60) | (F.length("__digits") <= 2) & (n <= 18)
    step = step.withColumns({
        "__local": (F.unix_date("__first").cast("long") + c("__d") - 1) * 86400 + c("__clock") * 3600 + c("__mi") * 60 + c("__s"),
        "__ok": (
            c("__y").between(1, 9999) & c("__mo").between(1, 12) & (c("__d") >= 1) & (c("__d") <= F.dayofmonth(F.last_day("__first")))
            & (c("__mi") <= 59) & (c("__s") <= 59) & F.when(c("__half") == "", c("__h") <= 23).otherwise(c("__h").between(1, 12))
        ),
        "__off": F.when(c("__digits") != "", F.when(sound, F.when(c("__minus"), -minutes).otherwise(minutes))).otherwise(F.try_element_at(table, c("__short"))),
        "__tz": F.when(c("__z") == "", F.when(F.col(zone).isin(ids), F.col(zone)).otherwise(F.lit("UTC")))
        .when(c("__digits") == "", F.when(c("__region").isin(ids), c("__region"))),
    })
    at_zone = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(c("__local")), c("__tz")))
    civil = F.when(c("__ok"), F.when(c("__z") == "", at_zone).when(c("__off").isNotNull(), c("__local") - c("__off") * 60).when(c("__tz").isNotNull(), at_zone))
    places = F.length(F.regexp_replace("__t", "-", ""))
    epoch = F.when(places <= 10, c("__epoch")).when(places == 13, F.floor(c("__epoch") / 1000)).otherwise(F.floor(c("__epoch") / 1000000))
    return step.select(*keep, F.coalesce(F.when(c("__epoch").isNotNull(), epoch.cast("long")), civil).alias(out))


def extend_dictionary(values: DataFrame, store: str | None = None) -> DataFrame:
    """The parsed dictionary (raw, zone, n_rows, utc_second) of the distinct (raw, zone) in ``values``.

    With ``store`` (a folder that all executors share) the dictionary is kept
    there: entries it already has are not parsed again, new ones are appended.
    Hot raw values are counted map-side before the shuffle. Null raw values are
    no entries.
    """
    spark = values.sparkSession
    distinct = values.filter(F.col("raw").isNotNull()).groupBy("raw", "zone").agg(F.count(F.lit(1)).alias("n_rows"))
    if store is None:
        return parse_instants(distinct)
    known = None
    try:
        known = spark.read.parquet(store)
    except AnalysisException:
        pass  # nothing is stored yet
    new = distinct
    if known is not None:
        new = distinct.alias("d").join(known.alias("k"), (F.col("d.raw") == F.col("k.raw")) & F.col("d.zone").eqNullSafe(F.col("k.zone")), "left_anti")
    parse_instants(new).write.mode("append").option("compression", "zstd").parquet(store)
    return spark.read.parquet(store)


#: An entry is hot if it fills more than this share of the rows; so there are at most 1/HOT_SHARE hot entries.
HOT_SHARE = 1 / 256


def join_instants(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Give each row (columns raw, zone and others) its ``utc_second``; rows whose raw is null keep a null.

    Hot entries (at most 1/HOT_SHARE) are broadcast; their rows never meet in
    one task. The other rows are joined by a shuffle.
    """
    rows = rows.drop("utc_second", "__hot")  # columns of these names are replaced
    total = dictionary.agg(F.sum("n_rows")).first()[0] or 0
    least = max(1000, int(total * HOT_SHARE))
    same = (F.col("r.raw") == F.col("d.raw")) & F.col("r.zone").eqNullSafe(F.col("d.zone"))
    hot = dictionary.groupBy("raw", "zone").agg(F.sum("n_rows").alias("n_rows"), F.max("utc_second").alias("utc_second")).filter(F.col("n_rows") > least)
    hot = F.broadcast(hot.select("raw", "zone", "utc_second", F.lit(True).alias("__hot")))
    first = rows.alias("r").join(hot.alias("d"), same, "left").select("r.*", "d.utc_second", "d.__hot")
    is_hot = F.col("__hot").isNotNull() | F.col("raw").isNull()
    cold = first.filter(~is_hot).drop("utc_second", "__hot")
    entries = dictionary.select("raw", "zone", "utc_second")
    found = cold.alias("r").join(entries.alias("d"), same, "left").select("r.*", "d.utc_second")
    return first.filter(is_hot).drop("__hot").unionByName(found)


def dated_rows(episodes: DataFrame, charts: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, rec_id, chart, raw, zone) of the two dated columns of the catalog."""
    zones = broadcast_if_small(hosts.groupBy("feed_host").agg(F.min("time_zone").alias("zone")))
    a = episodes.select(F.lit("episodes").alias("src"), F.col("id").alias("rec_id"), F.lit("").alias("chart"), F.col("published_date").alias("raw"), "feed_host")
    a = a.join(zones, "feed_host", "left").drop("feed_host")
    b = charts.select(F.lit("podcast_charts").alias("src"), F.col("podcast_id").alias("rec_id"), "chart", F.col("first_seen_at").alias("raw"), F.lit(None).cast("string").alias("zone"))
    return a.unionByName(b)


def normalise_timestamps(rows: DataFrame, store: str | None = None) -> DataFrame:
    """Problem 1: (src, rec_id, chart, raw, zone, utc_second) of every row, through the dictionary."""
    values = rows.select("raw", "zone")
    return join_instants(rows, extend_dictionary(values, store or scratch_path(rows.sparkSession, "instants")))
