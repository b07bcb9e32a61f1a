"""Derived inputs: the given tables seen as transcripts, frames, comments and so on, in Spark and in SQL.

Every view covers its whole table and every word of every text. Times are integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.catalog.base import table
from cuemill.operators import scans
from cuemill.session import deal

# Common short words of the four languages stand in for fillers, so retained segments follow the text.
FILLERS = "the|of|and|de|la|der|die|und|le|les|que|el"
FILLER_SQL = f"regexp_matches(lower(text), '^[^a-z]*({FILLERS})[^a-z]*$')"
WORDS_PER_UNIT = 12
WORDS_PER_UTTERANCE = 30
EVENT_BLOCK_US = 6 * 3600 * 1_000_000
DEAL_BYTES = 2_000_000


def micros(c) -> F.Column:
    """Microseconds of a zone-less timestamp, whatever the session zone is."""
    span = F.col(c).cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (span.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def deals(spark: SparkSession, sf: str) -> int:
    """Number of partitions the word view is dealt to: 2 MB of text each, so that its words are sorted in memory."""
    size = table(spark, sf, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, size // DEAL_BYTES + 1)


def dealt_texts(spark: SparkSession, sf: str) -> DataFrame:
    return deal(table(spark, sf, "documents").select(F.col("doc_id").alias("media_id"), "text"), "media_id", deals(spark, sf))


def word_ids(pos) -> F.Column:
    number = (pos + 1).cast("string")
    return F.concat(F.lit("word-"), F.lpad(number, F.greatest(F.lit(6), F.length(number)), F.lit("0")))


def starts(pos) -> F.Column:
    return pos.cast("long") * 600 + (pos * 53 + F.col("media_id") * 17) % 120


def ends(start, text) -> F.Column:
    return start + 80 + (F.length(text) * 37) % 400


def unit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The units of the word view, cut from the texts without making words and grouping them: media_id, unit_id, lo, hi (its first
    and last pos), end_ms (the latest) and texts in order."""
    cut = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / WORDS_PER_UNIT).cast("int")), lambda i: F.slice(t, i * WORDS_PER_UNIT + 1, WORDS_PER_UNIT))
    # Inside an array of one, so that a text is split once and not for each unit.
    toks = F.array_remove(F.split("text", r"[ \n\r\t]+"), "")
    units = F.transform(F.array(toks), lambda t: F.when(F.size(t) > 0, cut(t)))
    u = dealt_texts(spark, sf).select("media_id", F.posexplode(units[0]).alias("unit", "texts"))
    lo = F.col("unit") * WORDS_PER_UNIT
    hi = lo + F.size("texts") - 1
    # Words begin 600 ms apart, give or take 120, and last less than 480: the last two end after all others.
    end = lambda back: ends(starts(hi - back), F.get("texts", F.size("texts") - 1 - back))
    return u.select("media_id", F.col("unit").cast("long").alias("unit_id"), lo.alias("lo"), hi.alias("hi"), F.greatest(end(0), end(1)).alias("end_ms"), "texts")


def words(spark: SparkSession, sf: str) -> DataFrame:
    """documents as word-timed transcripts: media_id, pos, word_id, text, start_ms, end_ms, unit_id, utterance_id.
    Documents are shuffled by media item before they become words, which are many times larger; their order, groups and
    joins by media item find them in place."""
    toks = F.filter(F.split("text", r"[ \n\r\t]+"), lambda x: x != "")
    w = dealt_texts(spark, sf).select("media_id", F.posexplode(toks).alias("pos", "text"))
    start = starts(F.col("pos"))
    return w.select(
        "media_id",
        "pos",
        word_ids(F.col("pos")).alias("word_id"),
        "text",
        start.alias("start_ms"),
        ends(start, F.col("text")).alias("end_ms"),
        F.floor(F.col("pos") / WORDS_PER_UNIT).alias("unit_id"),
        F.floor(F.col("pos") / WORDS_PER_UTTERANCE).alias("utterance_id"),
    )


WORDS = f"""
toks AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n\\r\\t]+'), lambda x: x <> '') AS t FROM documents),
words0 AS (SELECT doc_id AS media_id, unnest(t) AS text, (generate_subscripts(t, 1) - 1)::INT AS pos FROM toks),
words1 AS (SELECT *, pos::BIGINT * 600 + (pos * 53 + media_id * 17) % 120 AS start_ms FROM words0),
words AS (SELECT media_id, pos, 'word-' || format('{{:06d}}', pos + 1) AS word_id, text, start_ms,
  start_ms + 80 + (length(text) * 37) % 400 AS end_ms, (pos // {WORDS_PER_UNIT})::BIGINT AS unit_id,
  (pos // {WORDS_PER_UTTERANCE})::BIGINT AS utterance_id FROM words1)
"""


def is_filler_word(c="text") -> F.Column:
    return F.lower(c).rlike(f"^[^a-z]*({FILLERS})[^a-z]*$")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """events as a frame series per user: media_id, frame (dense ordinal by time), value, ts_us."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("media_id"), micros("ts").alias("ts_us"), "event_id", "value"
    )
    n = scans.ordinals(e, "media_id", ["ts_us", "event_id"], scans.by_span("ts_us", EVENT_BLOCK_US), "frame")
    return n.select("media_id", "frame", "value", "ts_us", "event_id")


FRAMES = """
frames AS (SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
  value, epoch_us(ts) AS ts_us, event_id FROM events)
"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Retained runs of the word view: fillers are the deleted words."""
    from cuemill.operators import segments as seg

    return seg.retained_segments(words(spark, sf).withColumn("deleted", is_filler_word()))


SEGMENTS = f"""
w_isl AS (SELECT *, {FILLER_SQL} AS deleted,
  sum(CASE WHEN {FILLER_SQL} THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY pos) AS isl FROM words),
segs0 AS (SELECT media_id, isl, min(pos) AS first_pos, max(pos) AS last_pos, min_by(word_id, pos) AS first_word_id,
  max_by(word_id, pos) AS last_word_id, min_by(start_ms, pos) AS source_start_ms, max_by(end_ms, pos) AS source_end_ms,
  count(*) AS n_words FROM w_isl WHERE NOT deleted GROUP BY 1, 2),
segments AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY first_pos) AS seg_no,
  'keep-' || format('{{:03d}}', row_number() OVER (PARTITION BY media_id ORDER BY first_pos)) AS segment_id FROM segs0)
"""


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = """
dl AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, (generate_subscripts(ls, 1) - 1)::INT AS line_no FROM dl)
"""
