"""Retained segments and the move of words onto the cut timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import rules, text
from cuemill.operators import scans
from cuemill.operators.joins import bucketed_range_join
from cuemill.operators.words import POS_BUCKET
from cuemill.session import hashed, stage, whole

TIME_BUCKET_MS = 10_000


def retained_segments(words: DataFrame, prefix: str = "keep") -> DataFrame:
    """Runs of neighbouring words not ``deleted``: segment_id, seg_no, first and last word, source times."""
    runs = scans.runs(words, "media_id", "pos", ~F.col("deleted"), "seg_no")
    s = runs.groupBy("media_id", "seg_no").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min_by("word_id", "pos").alias("first_word_id"),
        F.max_by("word_id", "pos").alias("last_word_id"), F.min_by("start_ms", "pos").alias("source_start_ms"),
        F.max_by("end_ms", "pos").alias("source_end_ms"), F.count(F.lit(1)).alias("n_words"))
    return s.withColumn("segment_id", F.format_string(f"{prefix}-%03d", "seg_no"))


def words_in_segments(words: DataFrame, segments: DataFrame, offset_ms: Column | int = 0, how: str = "inner") -> DataFrame:
    """Words lying inside a segment (0.5 ms either side, so exact in whole milliseconds), by time buckets."""
    off = offset_ms if isinstance(offset_ms, Column) else F.lit(offset_ms)
    w = words.withColumn("media_start_ms", F.col("start_ms") + off).withColumn("media_end_ms", F.col("end_ms") + off)
    inside = (F.col("media_start_ms") >= F.col("source_start_ms")) & (F.col("media_end_ms") <= F.col("source_end_ms"))
    keep = [c for c in segments.columns if c not in words.columns or c == "media_id"]
    return bucketed_range_join(w, segments.select(*keep), "media_id", F.col("media_start_ms"), F.col("source_start_ms"),
                               F.col("source_end_ms"), inside, TIME_BUCKET_MS, how)


def cuts_inside_words(segments: DataFrame, words: DataFrame, offset_ms: int = 0) -> DataFrame:
    """Segment borders that fall strictly inside a word. Protected entries are left out when the segments carry
    entry_strategy, speech_onset_ms, first_meaningful_word_id and discarded_filler_word_id."""
    edges = segments.select(
        *segments.columns, F.explode(F.array(
            F.struct(F.lit("start").alias("boundary"), F.col("source_start_ms").alias("at_ms")),
            F.struct(F.lit("end").alias("boundary"), F.col("source_end_ms").alias("at_ms")))).alias("e")).select(*segments.columns, "e.*")
    w = words.select("media_id", "word_id", "text", (F.col("start_ms") + offset_ms).alias("word_start_ms"), (F.col("end_ms") + offset_ms).alias("word_end_ms"))
    inside = (F.col("word_start_ms") < F.col("at_ms")) & (F.col("at_ms") < F.col("word_end_ms"))
    hits = bucketed_range_join(edges, w, "media_id", F.col("at_ms"), F.col("word_start_ms"), F.col("word_end_ms"), inside, TIME_BUCKET_MS)
    if "entry_strategy" in segments.columns:
        start = F.col("boundary") == "start"
        onset_safe = start & (F.col("entry_strategy") == rules.ONSET_ENTRY) & (
            F.col("at_ms") <= F.col("speech_onset_ms") - rules.START_MARGIN_MS[0])
        splice_safe = start & (F.col("entry_strategy") == rules.SPLICE_ENTRY) & (
            (F.col("word_id") == F.col("first_meaningful_word_id")) | (F.col("word_id") == F.col("discarded_filler_word_id")))
        hits = hits.filter(~F.coalesce(onset_safe, F.lit(False)) & ~F.coalesce(splice_safe, F.lit(False)))
    return hits


def output_offsets(segments: DataFrame, key: str = "media_id", order: str = "seg_no", duration: Column | None = None) -> DataFrame:
    """Output start and end of each segment: the running sum of the durations before it (actual, else planned)."""
    planned = F.col("source_end_ms") - F.col("source_start_ms")
    d = segments.withColumn("duration_ms", duration if duration is not None else planned)
    d = scans.scan(d, key, order, None, output_start_ms=scans.sum_before("duration_ms"))
    return d.withColumn("output_end_ms", F.col("output_start_ms") + F.col("duration_ms"))


def add_partial_entry(placed: DataFrame, segments: DataFrame, words: DataFrame) -> DataFrame:
    """Add each segment's first meaningful word when its onset entry cuts it, starting at the onset.
    ``placed`` is the result of ``words_in_segments``; segments carry entry_strategy, first_meaningful_word_id, speech_onset_ms."""
    partial = segments.filter(F.col("entry_strategy").isin(*rules.PARTIAL_ENTRY))
    first = partial.join(words.withColumnRenamed("word_id", "first_meaningful_word_id"), ["media_id", "first_meaningful_word_id"])
    first = first.withColumn("word_id", F.col("first_meaningful_word_id")).withColumn("media_start_ms", F.col("start_ms")).withColumn("media_end_ms", F.col("end_ms"))
    missing = first.join(placed.select("media_id", "seg_no", "word_id"), ["media_id", "seg_no", "word_id"], "left_anti")
    both = placed.unionByName(missing.select(*placed.columns))
    is_first = (F.col("word_id") == F.col("first_meaningful_word_id")) & F.col("entry_strategy").isin(*rules.PARTIAL_ENTRY)
    onset = F.greatest(F.col("source_start_ms"), F.coalesce("speech_onset_ms", "start_ms"))
    moved = both.withColumn("__first", F.coalesce(is_first, F.lit(False)))
    moved = moved.withColumn("media_start_ms", F.when(F.col("__first"), onset).otherwise(F.col("media_start_ms")))
    return moved.withColumn(
        "media_end_ms", F.when(F.col("__first"), F.greatest(F.col("media_end_ms"), F.col("media_start_ms") + rules.MIN_WORD_MS)).otherwise(F.col("media_end_ms"))).drop("__first")


def floor_durations(rows: DataFrame, keys, order: str, a: Column, b: Column, seed: Column, limit: Column | None = None,
                    least: int = rules.MIN_WORD_MS) -> DataFrame:
    """Start and end of ordered items of at least ``least`` each: start = max(previous end, a),
    end = min(limit, max(start + least, b)). The recurrence has a closed form, a running maximum of
    max(a + least, b) - least * i, so it is computed by blocks and not row after row. Counts and maxima of a block add up with those of the blocks before."""
    r = rows.withColumn("__a", a).withColumn("__b", b).withColumn("__seed", seed)
    term = F.greatest(F.col("__a") + least, F.col("__b")) - F.col("__i") * least

    def local(d, w):
        d = d.withColumn("__i", F.row_number().over(w).cast("long")).withColumn("__term", term)
        return d.withColumn("__before", F.max("__term").over(w.rowsBetween(Window.unboundedPreceding, -1)))

    def carry(blocks, w):
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn("__shift", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
        return blocks.withColumn("__top", F.max(F.col("__most") - F.col("__shift") * least).over(before)).drop("__rows", "__most")

    def merge(d):
        # Inside a block items are counted from its own start: move the count and the terms by the rows before it.
        i, down = F.col("__i") + F.col("__shift"), F.col("__shift") * least
        top = limit if limit is not None else F.lit(None).cast("long")
        so_far = F.greatest("__seed", "__top", F.col("__before") - down)
        start = F.greatest(F.when(i == 1, F.col("__seed")).otherwise(F.least(top, so_far + (i - 1) * least)), F.col("__a"))
        end = F.least(top, F.greatest(so_far, F.col("__term") - down) + i * least)
        return d.withColumn("output_word_start", start).withColumn("output_word_end", end)

    summary = [F.count(F.lit(1)).alias("__rows"), F.max("__term").alias("__most")]
    alone = lambda w: {"__shift": F.lit(0).cast("long"), "__top": F.lit(None).cast("long")}
    out = scans.blocked(r, keys, order, None, local, summary, carry, merge, alone)
    return out.drop("__a", "__b", "__seed", "__i", "__term", "__before", "__shift", "__top")


def remap_words(words: DataFrame, segments: DataFrame, offset_ms: int = 0) -> DataFrame:
    """Words on the output timeline of the cut: segments need seg_no, source and output times."""
    placed = words_in_segments(words, segments, offset_ms)
    if "entry_strategy" in segments.columns:
        placed = add_partial_entry(placed, segments, words)
    shift = F.col("output_start_ms") - F.col("source_start_ms")
    m = floor_durations(placed, ["media_id", "seg_no"], "pos", F.col("media_start_ms") + shift, F.col("media_end_ms") + shift,
                        F.col("output_start_ms"), F.col("output_end_ms"))
    return m.withColumnRenamed("output_word_start", "mapped_start_ms").withColumnRenamed("output_word_end", "mapped_end_ms")


def compact_retained(words: DataFrame) -> DataFrame:
    """Words kept by an editorial plan on the timeline that closes the deletions (no segment end limit)."""
    segs = stage(output_offsets(retained_segments(words)), "segments")
    kept = words.filter(~F.col("deleted"))
    inside = (F.col("pos") >= F.col("first_pos")) & (F.col("pos") <= F.col("last_pos"))
    placed = bucketed_range_join(kept, segs.select("media_id", "seg_no", "first_pos", "last_pos", "source_start_ms", "output_start_ms"), "media_id",
                                 F.col("pos"), F.col("first_pos"), F.col("last_pos"), inside, POS_BUCKET)
    shift = F.col("output_start_ms") - F.col("source_start_ms")
    m = floor_durations(placed, ["media_id", "seg_no"], "pos", F.col("start_ms") + shift, F.col("end_ms") + shift, F.col("output_start_ms"))
    return m.withColumnRenamed("output_word_start", "planned_start_ms").withColumnRenamed("output_word_end", "planned_end_ms").drop("first_pos", "last_pos")


def map_anchors(anchors: DataFrame, mapped: DataFrame, total_ms: DataFrame | None = None) -> DataFrame:
    """Anchors (media_id, anchor_id, word_ids, start_offset_ms, duration_ms) to output times from their words.
    An anchor with no mapped word is dropped; some missing ids are counted."""
    ids = anchors.select("media_id", "anchor_id", F.explode("word_ids").alias("word_id"))
    m = mapped.select("media_id", "word_id", F.col("mapped_start_ms").alias("__s"), F.col("mapped_end_ms").alias("__e"))
    measures = [F.min("__s").alias("__s"), F.max("__e").alias("__e"), F.count_if(F.col("__s").isNull()).alias("missing")]
    if total_ms is None and whole(ids, ["media_id"]) and whole(m, ["media_id"]):
        # Words of an item are in one place: ids and mapped words are stacked, so that these, made from all words, are read once.
        word, item = Window.partitionBy("media_id", "word_id"), Window.partitionBy("media_id")
        rows = ids.withColumn("__asks", F.lit(True)).unionByName(m, allowMissingColumns=True)
        named = F.col("word_id").isNotNull() | F.col("__asks").isNull()
        met = rows.withColumns({"__s": F.when(named, F.min("__s").over(word)), "__e": F.when(named, F.max("__e").over(word))})
        span = met.groupBy("media_id", "anchor_id", "__asks").agg(*measures).withColumn("__total", F.max("__e").over(item)).filter("__asks").drop("__asks")
        a = anchors.drop("word_ids").join(hashed(span, "media_id"), ["media_id", "anchor_id"], "left")
    else:
        span = ids.join(m, ["media_id", "word_id"], "left").groupBy("media_id", "anchor_id").agg(*measures)
        a = anchors.drop("word_ids").join(span, ["media_id", "anchor_id"], "left")
        end = mapped.groupBy("media_id").agg(F.max("mapped_end_ms").alias("__total")) if total_ms is None else total_ms.select("media_id", F.col("total_ms").alias("__total"))
        a = a.join(end, "media_id", "left")
    start = F.col("__s") + F.coalesce("start_offset_ms", F.lit(0))
    stop = F.when(F.col("duration_ms").isNotNull(), start + F.col("duration_ms")).otherwise(F.col("__e"))
    return a.select(
        "media_id", "anchor_id", F.when(F.col("__s").isNotNull(), "mapped").otherwise("dropped").alias("status"),
        F.when(start.isNotNull(), F.greatest(F.lit(0).cast("long"), start)).alias("output_start_ms"),
        F.when(stop.isNotNull(), F.least(F.col("__total"), stop)).alias("output_end_ms"), F.coalesce("missing", F.lit(0).cast("long")).alias("missing"))


def entry_context(segments: DataFrame, words: DataFrame, filler: str = text.char_class(rules.FILLER_CHARS), listed: DataFrame | None = None) -> DataFrame:
    """How each segment begins: its first word after leading fillers, the word before that, and the context
    (opening, after-filler or normal) with the continuous-speech flag. Times in ms, gap rule 0.9 s. A filler before it was
    discarded only if it is none of the segment's own words: those of ``listed`` (media_id, seg_no, word_id), without which
    a segment's words are all from its first to its last."""
    w = scans.previous(words.withColumn("__filler", text.is_filler("text", filler)), "media_id", "pos",
                       prev_end_ms="end_ms", prev_filler="__filler", prev_word_id="word_id")
    w = w.select("media_id", "pos", "word_id", "start_ms", "__filler", "prev_end_ms", "prev_filler", "prev_word_id")
    s = segments.select("media_id", "seg_no", "segment_id", "first_pos", "last_pos")
    inside = (F.col("pos") >= F.col("first_pos")) & (F.col("pos") <= F.col("last_pos"))
    j = bucketed_range_join(w, s, "media_id", F.col("pos"), F.col("first_pos"), F.col("last_pos"), inside, POS_BUCKET)
    rank = F.when(~F.col("__filler") | (F.col("pos") == F.col("last_pos")), F.col("pos"))
    row = F.struct("word_id", "pos", "start_ms", "prev_end_ms", "prev_filler", "prev_word_id", "first_pos")
    e = j.groupBy("media_id", "seg_no", "segment_id").agg(F.min_by(row, rank).alias("f")).select("media_id", "seg_no", "segment_id", "f.*")
    gap = F.col("start_ms") - F.col("prev_end_ms")
    if listed is None:
        own = F.col("pos") > F.col("first_pos")
    else:
        e = e.join(listed.select("media_id", "seg_no", F.col("word_id").alias("prev_word_id"), F.lit(True).alias("__own")).distinct(), ["media_id", "seg_no", "prev_word_id"], "left")
        own = F.coalesce("__own", F.lit(False))
    discarded = F.coalesce(F.col("prev_filler") & ~own & (gap <= rules.FILLER_REACH_US // 1000), F.lit(False))
    lo, hi = (x // 1000 for x in rules.SPLICE_GAP_US)
    return e.select(
        "media_id", "seg_no", "segment_id", F.col("word_id").alias("first_meaningful_word_id"), (F.col("pos") - F.col("first_pos")).alias("leading_fillers"),
        F.col("start_ms").alias("first_start_ms"), "prev_end_ms",
        F.when(discarded, F.col("prev_word_id")).alias("discarded_filler_word_id"),
        F.when(F.col("seg_no") == 1, "opening").when(discarded, "after-filler").otherwise("normal").alias("entry_context"),
        (discarded & (gap >= lo) & (gap <= hi)).alias("continuous"))
