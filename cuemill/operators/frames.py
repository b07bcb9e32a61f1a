"""Acoustic frame series: levels, thresholds, smoothing, speech regions and nearest-boundary look-ups.

``frames`` tables have media_id and ``frame``, an ordinal without gaps. Times are microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import rules
from cuemill.operators import joins, scans
from cuemill.session import stage

FRAME_BUCKET = 4096
SAMPLE_CELL = 256


def frame_levels(samples: DataFrame, frame_size: int = 160) -> DataFrame:
    """Samples (media_id, i, v) to dBFS per frame: root mean square, floor -96. Sums combine before the shuffle."""
    v = F.col("v").cast("double")
    g = samples.groupBy("media_id", F.floor(F.col("i") / frame_size).alias("frame")).agg(F.sum(v * v).alias("__s"), F.count(F.lit(1)).alias("__n"))
    power = F.col("__s") / F.col("__n")
    level = F.when(power <= 1.0, F.lit(rules.FRAME_DB_FLOOR)).otherwise(F.log10(F.sqrt(power) / 32768.0) * 20.0)
    return g.select("media_id", "frame", level.alias("level_db"))


def rank_value(rows: DataFrame, value: str, share: float, key: str = "media_id", step: float = 0.01) -> DataFrame:
    """The value at index floor(n * share) of each key's sorted values, exactly. Equal values are counted together and
    the counts are run up over narrow value blocks, so no key is sorted in one task."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__all"))
    ranked = scans.scan(counts, key, value, F.floor(F.col(value) / F.lit(step)), __before=scans.sum_before("__n"))
    at = F.least(F.col("__all") - 1, F.greatest(F.lit(0), F.floor(F.col("__all") * F.lit(share))))
    hit = ranked.join(total, key).filter((F.col("__before") <= at) & (at < F.col("__before") + F.col("__n")))
    return hit.select(key, F.col(value).alias("rank_value"), F.col("__all").alias("n"))


def noise_threshold(frames: DataFrame, level: str = "level_db") -> DataFrame:
    """Noise floor (20 % rank) and activity threshold of each item."""
    r = rank_value(frames, level, rules.NOISE_RANK)
    return r.select("media_id", F.col("rank_value").alias("noise_floor"),
                    F.greatest(F.lit(rules.NOISE_MIN_DB), F.least(F.lit(rules.NOISE_MAX_DB), F.col("rank_value") + rules.NOISE_MARGIN_DB)).alias("threshold"))


def noise_quantile(frames: DataFrame, level: str = "level_db", share: float = 0.20, accuracy: int = 10_000) -> DataFrame:
    """Cheaper, approximate form of the floor for very long items, for reports only."""
    return frames.groupBy("media_id").agg(F.percentile_approx(level, F.lit(share), F.lit(accuracy)).alias("noise_floor"))


def activity(frames: DataFrame, thresholds: DataFrame, level: str = "level_db") -> DataFrame:
    return frames.join(thresholds.select("media_id", "threshold"), "media_id").withColumn("active", F.col(level) >= F.col("threshold"))


def smooth(frames: DataFrame, flag: str = "active", out: str = "smoothed") -> DataFrame:
    """Close single-frame holes, then drop single-frame spikes; first and last frame stay as they are."""
    f = scans.neighbours(frames, "media_id", "frame", [flag], back=2, ahead=2)
    prev, prev2 = scans.at_end("__before")[flag], scans.at_end("__before", 2)[flag]
    nxt, nxt2 = F.get("__after", F.lit(0))[flag], F.get("__after", F.lit(1))[flag]
    closed = lambda own, before, after: own | F.coalesce(before & after, F.lit(False))
    lone = ~closed(prev, prev2, F.col(flag)) & ~closed(nxt, F.col(flag), nxt2)
    smoothed = closed(F.col(flag), prev, nxt) & ~F.coalesce(lone, F.lit(False))
    return f.withColumn(out, smoothed).drop("__before", "__after")


def speech_regions(frames: DataFrame, value: str = "p_speech", enter: float = rules.ENTER_THRESHOLD, leave: float = rules.EXIT_THRESHOLD,
                   run: int = rules.EXIT_RUN) -> DataFrame:
    """Hysteresis: a region opens at a frame of at least ``enter`` and closes once ``run`` frames in a row lie below
    ``leave``, ending at the first of them. Needs enter >= leave. Rows: start_frame, end_frame (exclusive), peak, closed.

    A frame is an opening event, a closing event, or neither; the last event decides the state, and all frames of one
    region share the same last closing frame."""
    f, low = frames.select("media_id", "frame", value), F.col(value) < leave
    if run > 1:
        f = scans.neighbours(f, "media_id", "frame", [value], back=run - 1)
        low = low & (F.size("__before") == run - 1) & F.forall("__before", lambda x: x[value] < leave)
    f = f.withColumn("__event", F.when(F.col(value) >= enter, 1).when(low, 0)).drop("__before")
    f = scans.scan(f, "media_id", "frame", None, __on=scans.last_upto(F.when(F.col("__event") == 1, F.col("frame"))),
                   __off=scans.last_upto(F.when(F.col("__event") == 0, F.col("frame"))))
    live = f.filter(F.col("__on") > F.coalesce("__off", F.lit(-1)))
    r = live.groupBy("media_id", F.coalesce("__off", F.lit(-1)).alias("__after")).agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("__last"), F.max(value).alias("peak"))
    last = frames.groupBy("media_id").agg(F.max("frame").alias("__end"))
    r = r.join(last, "media_id")
    closed = F.col("__last") < F.col("__end")
    return r.select("media_id", "start_frame", F.when(closed, F.col("__last") + 2 - run).otherwise(F.col("__end") + 1).alias("end_frame"), "peak", closed.alias("closed"))


def region_times(regions: DataFrame, media: DataFrame, frame_us: int = 32_000) -> DataFrame:
    """Frames to media time: ``media`` has offset_us and duration_us; an open region ends with the media."""
    r = regions.join(media.select("media_id", "offset_us", "duration_us"), "media_id")
    end = F.when(F.col("closed"), F.col("end_frame") * frame_us).otherwise(F.col("duration_us"))
    return r.select("media_id", (F.col("offset_us") + F.col("start_frame") * frame_us).alias("region_start_us"), (F.col("offset_us") + end).alias("region_end_us"), "peak")


def quiet_runs(frames: DataFrame, flag: str = "smoothed") -> DataFrame:
    """Runs of quiet frames: first and last frame of each."""
    q = scans.runs(frames.select("media_id", "frame", flag), "media_id", "frame", ~F.col(flag), "quiet_no")
    return q.groupBy("media_id", "quiet_no").agg(F.min("frame").alias("quiet_first"), F.max("frame").alias("quiet_last"))


def first_quiet_run(asked: DataFrame, frames: DataFrame, flag: str = "smoothed", least: int = rules.QUIET_RUN_FRAMES, key: str = "query_id") -> DataFrame:
    """Per window (media_id, query_id, from_frame, to_frame): first frame of the earliest quiet run of ``least`` frames
    inside it; null when there is none."""
    runs = joins.with_buckets(quiet_runs(frames, flag), F.col("quiet_first"), F.col("quiet_last"), FRAME_BUCKET)
    q = joins.with_buckets(asked, F.col("from_frame"), F.col("to_frame"), FRAME_BUCKET)
    start = F.greatest("quiet_first", "from_frame")
    hit = q.join(runs, ["media_id", "__bucket"]).filter(F.least("quiet_last", "to_frame") - start + 1 >= least)
    best = hit.groupBy("media_id", key).agg(F.min(start).alias("quiet_frame"))
    return asked.join(best, ["media_id", key], "left")


def nearest_in_window(asked: DataFrame, facts: DataFrame, fact_at: str, width: int, key: str = "query_id") -> DataFrame:
    """Per window (lo, hi, target) the fact nearest to the target inside it; ties go to the earlier. Two as-of scans
    from the target moved into the window, so wide windows cost no more than narrow ones."""
    a = asked.withColumn("__at", F.least("hi", F.greatest("lo", "target")))
    both = joins.asof(a, facts.withColumn("__tie", F.lit(0).cast("long")), "media_id", "__at", fact_at, "__tie", width, key, next_too=True)
    prev, nxt = F.col("prev")[fact_at], F.col("next")[fact_at]
    prev, nxt = F.when(prev >= F.col("lo"), prev), F.when(nxt <= F.col("hi"), nxt)
    closer = F.abs(nxt - F.col("target")) < F.abs(prev - F.col("target"))
    return both.withColumn("nearest", F.when(prev.isNull() | F.coalesce(closer, F.lit(False)), nxt).otherwise(prev)).drop("prev", "next", "__at")


def nearest_quiet(asked: DataFrame, frames: DataFrame, flag: str = "smoothed", frame_us: int = rules.FRAME_US) -> DataFrame:
    """Grid point nearest to the target in [lo, hi] (microseconds) whose frame and the one before are quiet."""
    f = scans.previous(frames.select("media_id", "frame", flag), "media_id", "frame", __prev=flag)
    quiet = f.filter(~F.col(flag) & ~F.coalesce("__prev", F.lit(False)))
    facts = quiet.select("media_id", (F.col("frame") * frame_us).alias("grid_us"))
    grid = lambda c: F.floor(F.col(c) / frame_us) * frame_us
    return nearest_in_window(asked.filter("hi >= lo").withColumn("lo", grid("lo")).withColumn("hi", grid("hi")), facts, "grid_us", FRAME_BUCKET * frame_us)


def zero_crossings(samples: DataFrame) -> DataFrame:
    f = scans.previous(samples.select("media_id", "i", "v"), "media_id", "i", __prev="v")
    prev = F.col("__prev")
    hit = (F.col("v") == 0) | (prev == 0) | ((prev < 0) & (F.col("v") > 0)) | ((prev > 0) & (F.col("v") < 0))
    return f.filter(hit & prev.isNotNull()).select("media_id", "i")


def nearest_zero_cross(asked: DataFrame, samples: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Sample of the sign change nearest to the target in [lo, hi]; equal distances go to the one before it; with no
    crossing the target itself, moved into the window."""
    near = nearest_in_window(asked, zero_crossings(samples), "i", width)
    return near.withColumn("nearest", F.coalesce("nearest", F.least("hi", F.greatest("lo", "target"))))


def onset_window(context: Column, start: Column, predecessor_end: Column) -> tuple[Column, Column]:
    w = rules.ONSET_WINDOWS_US
    lower = (
        F.when(context == "opening", F.greatest(F.lit(0).cast("long"), start + w["opening"][0]))
        .when(context == "after-filler", F.greatest(predecessor_end + rules.ONSET_AFTER_PREDECESSOR_US, start + w["after-filler"][0]))
        .otherwise(start + w["normal"][0]))
    lower = F.when((context == "after-filler") & predecessor_end.isNull(), F.lit(None).cast("long")).otherwise(lower)
    upper = start + F.when(context == "opening", w["opening"][1]).when(context == "after-filler", w["after-filler"][1]).otherwise(w["normal"][1])
    return lower, upper


def match_onset(entries: DataFrame, regions: DataFrame, key: str = "entry_id") -> DataFrame:
    """Speech region whose start is the credible onset of each entry (entry_context, first_start_us, predecessor_end_us):
    in the window of its context, reaching the first word, nearest and then earliest."""
    start = F.col("first_start_us")
    lower, upper = onset_window(F.col("entry_context"), start, F.col("predecessor_end_us"))
    e = entries.withColumn("__lo", lower).withColumn("__hi", upper)
    inside = (F.col("region_start_us") >= F.col("__lo")) & (F.col("region_start_us") <= F.col("__hi")) & (
        F.col("region_end_us") >= start - rules.ONSET_REACH_US)
    ranges = e.filter("__lo IS NOT NULL AND __hi >= __lo").select("media_id", key, "first_start_us", "__lo", "__hi")
    hit = joins.bucketed_range_join(regions, ranges, "media_id", F.col("region_start_us"), F.col("__lo"), F.col("__hi"), inside, 1_000_000)
    best = hit.groupBy("media_id", key).agg(F.min_by(
        F.struct(F.col("region_start_us").alias("onset_us"), F.col("peak").alias("onset_peak")),
        F.struct(F.abs(F.col("region_start_us") - start), F.col("region_start_us"))).alias("o")).select("media_id", key, "o.*")
    return entries.join(best, ["media_id", key], "left")


def activity_ratio(silences: DataFrame, media: DataFrame) -> DataFrame:
    """Silent and active time of each item: silence is capped at the media length."""
    s = silences.groupBy("media_id").agg(F.sum("silence_us").alias("__s"))
    j = media.select("media_id", "duration_us").join(s, "media_id", "left")
    silent = F.least(F.col("duration_us"), F.coalesce("__s", F.lit(0).cast("long")))
    j = j.withColumn("silence_us", silent).withColumn("active_us", F.greatest(F.lit(0).cast("long"), F.col("duration_us") - F.col("silence_us")))
    return j.withColumn("active_ratio", F.coalesce(F.try_divide("active_us", "duration_us"), F.lit(0.0))).drop("__s")


def quiet_facts(frames: DataFrame, flag: str, run: int) -> DataFrame:
    """Ranges of frames, cut at multiples of ``FRAME_BUCKET``: from ``opens`` to ``opens_to`` ``run`` quiet frames begin at each, from
    ``settled`` to ``settled_to`` each and the one before it are quiet. A range may be empty."""
    f, w = scans.neighbourhood(frames.select("media_id", "frame", flag), "media_id", "frame", back=1, ahead=max(run - 1, 1), rows=FRAME_BUCKET)
    f = f.withColumn("before", F.lag(flag).over(w)).withColumn("island", F.sum(F.when(~F.col(flag) & F.coalesce("before", F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # The first frame of an item has none before it; copies of frames next door have none here either.
    alone = F.max(F.when(F.col("__own") & F.col("before").isNull(), F.col("frame")))
    g = f.filter(~F.col(flag)).groupBy("media_id", scans.BLK, "island").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), alone.alias("alone"))
    start, end = F.col(scans.BLK) * FRAME_BUCKET, (F.col(scans.BLK) + 1) * FRAME_BUCKET - 1
    return g.select("media_id", F.greatest("first", start).alias("opens"), F.least(F.col("last") - (run - 1), end).alias("opens_to"),
                    F.greatest(F.coalesce("alone", F.col("first") + 1), start).alias("settled"), F.least("last", end).alias("settled_to"))


def samples_near(samples: DataFrame, asked: DataFrame, lo, hi) -> DataFrame:
    """Samples from the one before ``lo`` to ``hi`` of each asked window, and some beside them. The cells of the windows are written
    first: where they are few, Spark sees so and the samples stay where they are made."""
    cells = joins.with_buckets(asked.select("media_id", lo.alias("lo"), hi.alias("hi")), F.col("lo") - 1, F.col("hi"), SAMPLE_CELL).select("media_id", "__bucket").distinct()
    cells = stage(cells, "sample-cells")
    return samples.withColumn("__bucket", F.floor(F.col("i") / SAMPLE_CELL)).join(cells, ["media_id", "__bucket"], "left_semi").drop("__bucket")


def crossing_facts(samples: DataFrame) -> DataFrame:
    """Samples (media_id, at) at which the sign changes, or that are or follow a zero. A sample whose neighbour before it is not
    there is none."""
    f, w = scans.neighbourhood(samples.select("media_id", "i", "v"), "media_id", "i", back=1)
    prev, v = F.col("prev"), F.col("v")
    f = scans.own_rows(f.withColumn("prev", F.when(F.lag("i").over(w) == F.col("i") - 1, F.lag("v").over(w))))
    return f.filter(prev.isNotNull() & ((v == 0) | (prev == 0) | ((prev < 0) & (v > 0)) | ((prev > 0) & (v < 0)))).select("media_id", F.col("i").alias("at"))


def refine_boundaries(segments: DataFrame, frames: DataFrame, regions: DataFrame, samples: DataFrame, sample_rate: int = 16_000, flag: str = "smoothed") -> DataFrame:
    """Refined start and end of every segment, with strategy, headroom, tail room and fades.

    ``segments``: media_id, seg_no (1, 2, ...), source_start_us, source_end_us, last_end_us, next_word_start_us, entry_context, first_start_us,
    predecessor_end_us, discarded, continuous, window_start_us, window_end_us; audio offset 0. ``regions`` are in order: one that starts
    later does not end earlier.

    Quiet frames are written once as ranges and looked up as such. A start depends on the end before it, but no end depends on a start. So a first sweep over frames and segments finds all
    ends, each is handed to the next segment, and a second sweep over frames, samples, regions and segments finds all starts.
    Segments are written in between, so that only samples near a splice, mostly a small share of them, are ordered; no source is
    read again for another look-up of the same sweep.
    """
    r = rules
    zero = F.lit(0).cast("long")
    quiet = stage(quiet_facts(frames, flag, r.QUIET_RUN_FRAMES), "quiet")
    s = joins.beside_rows(segments, "media_id", "seg_no", next_start_us=("source_start_us", 1))
    tail = F.least(F.col("window_end_us"), F.col("source_end_us") + r.MAX_TAIL_US, F.coalesce("next_start_us", "window_end_us") - 10_000)
    nw = F.col("next_word_start_us")
    s = s.withColumn("upper_tail_us", F.when(nw.isNotNull() & (nw >= F.col("last_end_us")), F.least(tail, nw)).otherwise(tail))
    index = lambda c: F.greatest(zero, F.floor(c / r.FRAME_US))
    opens = quiet.filter("opens <= opens_to").select("media_id", F.col("opens").alias("at"), F.col("opens_to").alias("to"))
    begin = index(F.greatest(zero, F.col("last_end_us") - 20_000))
    s = joins.sweep(s, "media_id", "seg_no", {"tail": (F.lit(True), begin, begin, index(F.col("upper_tail_us")) - r.QUIET_RUN_FRAMES + 1)}, {"tail": (opens, FRAME_BUCKET)})
    quiet_us = F.coalesce(F.when(F.col("tail_before.at") == begin, begin), F.col("tail_after.at")) * r.FRAME_US
    found = quiet_us.isNotNull()
    s = s.withColumn("speech_offset_us", F.when(found, F.greatest(F.col("last_end_us"), quiet_us)).otherwise(F.col("last_end_us")))
    end = F.when(found, F.least(F.col("upper_tail_us"), F.col("speech_offset_us") + r.TARGET_TAIL_US)).otherwise(
        F.least(F.col("upper_tail_us"), F.greatest(F.col("source_end_us"), F.col("last_end_us") + r.MIN_TAIL_US)))
    s = s.withColumn("tail_clear", found & (end - F.col("speech_offset_us") >= r.MIN_TAIL_US - r.EPS_US))
    s = s.withColumn("refined_end_us", F.greatest(end, F.col("last_end_us") + F.least(F.lit(r.MIN_TAIL_US).cast("long"), F.greatest(zero, F.col("upper_tail_us") - F.col("last_end_us")))))
    s = s.drop("tail_before", "tail_after", "upper_tail_us", "next_start_us", "next_word_start_us", "window_end_us")
    s = joins.beside_rows(s, "media_id", "seg_no", prev_end_us=("refined_end_us", -1))

    pred, first, cont, base = F.col("predecessor_end_us"), F.col("first_start_us"), F.col("continuous"), F.col("base_us")
    by_context = lambda d: F.when(F.col("entry_context") == "opening", d["opening"]).when(F.col("entry_context") == "after-filler", d["after-filler"]).otherwise(d["normal"])
    s = s.withColumn("base_us", F.greatest(F.col("window_start_us"), F.when(F.col("seg_no") == 1, F.col("window_start_us")).otherwise(F.col("prev_end_us") + 10_000)))
    s = s.withColumn("min_start_us", F.greatest(base, F.when(~cont, pred + F.when(F.col("discarded"), 15_000).otherwise(5_000))))
    s = s.join(samples.groupBy("media_id").agg(F.max("i").alias("max_i")), "media_id", "left")
    lo, hi = F.greatest(base, pred - r.SPLICE_PREROLL_US), F.least(F.col("source_end_us") - 250_000, first + r.SPLICE_POSTROLL_US)
    sample = lambda c: c * sample_rate / 1_000_000
    s = s.withColumns({
        "z_lo": F.greatest(F.lit(1).cast("long"), F.floor(sample(F.when(hi < lo, first).otherwise(lo)))), "z_hi": F.least("max_i", F.ceil(sample(F.when(hi < lo, first).otherwise(hi)))),
        "z_at": F.least(F.col("max_i"), F.greatest(F.lit(1).cast("long"), F.bround(sample(first), 0).cast("long"))),
        "q_lo": F.greatest(F.col("min_start_us"), first - by_context(r.HEADROOM_LIMIT_US)), "q_hi": F.least(first - r.MIN_HEADROOM_US, F.col("source_end_us") - 250_000)})
    s = s.withColumn("q_at", F.greatest(F.col("q_lo"), first - by_context(r.HEADROOM_US)))
    o_lo, o_hi = onset_window(F.col("entry_context"), first, pred)
    grid = lambda c: F.floor(F.col(c) / r.FRAME_US) * r.FRAME_US
    s = stage(s, "half-refined")
    spliced = samples_near(samples, s.filter(cont & (F.col("z_hi") >= F.col("z_lo"))), F.col("z_lo"), F.col("z_hi"))
    settled = quiet.filter("settled <= settled_to").select("media_id", (F.col("settled") * r.FRAME_US).alias("at"), (F.col("settled_to") * r.FRAME_US).alias("to"))
    speech = regions.select("media_id", F.col("region_start_us").alias("at"), F.col("region_end_us").alias("end_us"), F.col("peak").cast("double").alias("peak"))
    s = joins.sweep(
        s, "media_id", "seg_no",
        {"splice": (cont, F.col("z_at"), F.col("z_lo"), F.col("z_hi")),
         "onset": (~cont & o_lo.isNotNull(), first, o_lo, o_hi),
         "quiet": (~cont & (F.col("q_hi") >= F.col("q_lo")), F.col("q_at"), grid("q_lo"), grid("q_hi"))},
        {"splice": (crossing_facts(spliced), 1 << 14), "onset": (speech, 1 << 21), "quiet": (settled, FRAME_BUCKET * r.FRAME_US)}, {"quiet": r.FRAME_US})
    reaches = F.col("onset_before.end_us") >= first - r.ONSET_REACH_US
    s = s.withColumn("onset_before", F.when(reaches, F.col("onset_before"))).withColumn("onset", joins.nearer("onset", first))
    crossing = F.coalesce(joins.nearer("splice", F.col("z_at"))["at"], F.least("z_hi", F.greatest("z_lo", "z_at")))
    s = s.withColumns({
        "onset_us": F.col("onset.at"), "onset_peak": F.col("onset.peak"), "__quiet": joins.nearer("quiet", F.col("q_at"))["at"],
        "__splice": F.when(cont, F.bround(crossing * 1_000_000 / sample_rate, 0).cast("long")), "__qlo": F.col("q_lo"), "__qhi": F.col("q_hi")})

    has_onset = F.col("onset_us").isNotNull()
    start = (
        F.when(cont, F.col("__splice")).when(has_onset, F.greatest(F.col("min_start_us"), F.col("onset_us") - by_context(r.HEADROOM_US)))
        .otherwise(F.coalesce("__quiet", F.greatest(F.col("__qlo"), F.least(F.col("__qhi"), first - r.MIN_HEADROOM_US)))))
    s = s.withColumn("refined_start_us", start).withColumn("speech_onset_us", F.when(~cont & has_onset, F.col("onset_us")).otherwise(first))
    s = s.withColumn("headroom_us", F.greatest(zero, F.col("speech_onset_us") - F.col("refined_start_us")))
    clean = (
        F.when(cont, (F.col("refined_start_us") >= pred - r.SPLICE_PREROLL_US - r.EPS_US) & (F.col("refined_start_us") <= first + r.SPLICE_POSTROLL_US + r.EPS_US))
        .when(has_onset, F.col("headroom_us") >= r.MIN_HEADROOM_US - r.EPS_US).otherwise(F.col("__quiet").isNotNull()))
    s = s.withColumn("__clean", clean)
    leak = F.coalesce(F.col("discarded") & ~cont & (F.col("refined_start_us") <= pred + r.EPS_US), F.lit(False))
    s = s.withColumn("entry_clean", F.col("__clean") & ~leak).withColumn("tailroom_us", F.greatest(zero, F.col("refined_end_us") - F.col("speech_offset_us")))
    errors = F.array_compact(F.array(
        F.when(~F.col("__clean"), F.when(cont, "unsafe_continuous_splice_boundary").otherwise("no_quiet_entry_boundary")),
        F.when(leak, F.lit("discarded_filler_tail_may_leak")), F.when(~F.col("tail_clear"), F.lit("no_confirmed_quiet_tail")),
        F.when(F.col("refined_end_us") <= F.col("refined_start_us"), F.lit("invalid_refined_bounds"))))
    return s.select(
        "media_id", "seg_no", "refined_start_us", "refined_end_us", "entry_context",
        F.when(cont, r.SPLICE_ENTRY).when(has_onset, r.ONSET_ENTRY).otherwise("energy-trough-near-asr").alias("entry_strategy"),
        "entry_clean", "tail_clear", "speech_onset_us", F.when(~cont, F.col("onset_peak")).alias("onset_peak"), "headroom_us", "speech_offset_us", "tailroom_us",
        F.when(F.col("entry_clean") & cont, r.SPLICE_FADE_MS).when(F.col("entry_clean") & (F.col("headroom_us") >= 40_000), r.FADE_MS).otherwise(0).alias("fade_in_ms"),
        F.when(F.col("tail_clear") & (F.col("tailroom_us") >= 20_000), r.FADE_MS).otherwise(0).alias("fade_out_ms"), errors.alias("errors"))
