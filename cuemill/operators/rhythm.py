"""Speech rhythm: pauses, rate, pause edits, the piecewise time map and its use. Integer ms and microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.functions import numbers, rules, text
from cuemill.operators import joins, scans
from cuemill.operators.segments import floor_durations
from cuemill.operators.words import joined_text
from cuemill.session import before_scan, hashed, stage

PIECE_BUCKET_US = 600_000_000


def pauses(words: DataFrame, unit: str | None = "unit_id") -> DataFrame:
    """Gaps between neighbouring words (of one unit when given)."""
    w = scans.previous(words, "media_id", "pos", after_word_id="word_id", gap_start_ms="end_ms", **({"__unit": unit} if unit else {}))
    w = w.withColumn("pause_ms", F.col("start_ms") - F.col("gap_start_ms")).filter("pause_ms > 0")
    if unit:
        w = w.filter(F.col("__unit") == F.col(unit)).drop("__unit")
    return w.select("media_id", *([unit] if unit else []), "pos", "after_word_id", F.col("word_id").alias("before_word_id"), "gap_start_ms",
                    F.col("start_ms").alias("gap_end_ms"), "pause_ms")


def rhythm(words: DataFrame, unit: str = "unit_id", protected: str = rules.PROTECTED_TEXT, with_text: bool = True, with_edits: bool = False) -> DataFrame:
    """Rhythm decision per unit: span, active and pause time, speech units, rates, protection, speed tier,
    pause edits, diagnosis, action, projected length and its class. ``with_edits`` adds ``edits``, the removals of ``pause_edits``
    in the unit (remove_start_us, remove_end_us), and ``last_ms``, the latest end of its words."""
    w = scans.previous(words, "media_id", "pos", __pe="end_ms", __pu=unit)
    gap = F.when(F.col("__pu") == F.col(unit), F.greatest(F.lit(0).cast("long"), F.col("start_ms") - F.col("__pe")))
    w = w.withColumn("__gap", gap)
    # The removal of a pause depends on the unit's speed, which is one of four tiers: sum it for each tier at once.
    tiers = sorted({100, *[p for _, p in rules.SPEED_TIERS]})
    cut_us = {p: F.col("__gap") * 1000 - 10 * rules.PAUSE_TARGET_MS * p for p in tiers}
    is_cut = {p: (F.col("__gap") > rules.PAUSE_LIMIT_MS) & (cut_us[p] > rules.PAUSE_MIN_REMOVAL_MS * 1000) for p in tiers}
    long_gap = F.when(F.col("__gap") > rules.PAUSE_LIMIT_MS, F.struct((F.col("__pe") * 1000).alias("a"), (F.col("start_ms") * 1000).alias("b")))
    g = w.groupBy("media_id", unit).agg(
        F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"), F.min_by("word_id", "pos").alias("start_word_id"),
        F.max_by("word_id", "pos").alias("end_word_id"), F.sum(F.greatest(F.lit(rules.MIN_WORD_MS).cast("long"), F.col("end_ms") - F.col("start_ms"))).alias("active_ms"),
        F.coalesce(F.sum("__gap"), F.lit(0).cast("long")).alias("pause_ms"), joined_text().alias("text"),
        *[F.count_if(is_cut[p]).alias(f"__n{p}") for p in tiers], *[F.coalesce(F.sum(F.when(is_cut[p], cut_us[p])), F.lit(0).cast("long")).alias(f"__r{p}") for p in tiers],
        *([F.max("end_ms").alias("last_ms"), F.collect_list(long_gap).alias("__long")] if with_edits else []))
    g = g.withColumn("span_ms", F.greatest(F.lit(rules.MIN_WORD_MS).cast("long"), F.col("end_ms") - F.col("start_ms")))
    g = g.withColumn("speech_units", F.greatest(F.lit(1).cast("long"), text.syllable_units("text")))
    reasons = F.array_compact(F.array(
        F.when(F.col("text").rlike(protected), F.lit("mixed-language-or-number")),
        F.when(F.col("speech_units") < rules.MIN_SYLLABLES, F.lit("too-few-syllables")),
        F.when(F.col("span_ms") < rules.MIN_SPAN_MS, F.lit("too-short-for-local-speed-change"))))
    g = g.withColumn("protected_reasons", reasons)
    speed = F.when(F.size("protected_reasons") > 0, F.lit(100)).otherwise(numbers.speed_percent("speech_units", "active_ms"))
    g = g.withColumn("speed_pct", speed.cast("int"))

    def pick(prefix):
        out = None
        for p in tiers:
            c = F.col(f"__{prefix}{p}")
            out = F.when(F.col("speed_pct") == p, c) if out is None else out.when(F.col("speed_pct") == p, c)
        return out

    g = g.withColumn("n_pause_edits", pick("n")).withColumn("removed_us", pick("r"))
    if with_edits:
        half = F.col("speed_pct") * (5 * rules.PAUSE_TARGET_MS)
        cut = F.transform("__long", lambda x: F.struct((x["a"] + half).alias("remove_start_us"), (x["b"] - half).alias("remove_end_us")))
        g = g.withColumn("edits", F.filter(cut, lambda x: x["remove_end_us"] - x["remove_start_us"] > rules.PAUSE_MIN_REMOVAL_MS * 1000))
    left_us = F.col("span_ms") * 1000 - F.col("removed_us")
    fast, cuts = F.col("speed_pct") > 100, F.col("n_pause_edits") > 0
    limit = lambda ms: left_us * 100 <= F.lit(ms * 1000).cast("long") * F.col("speed_pct")
    return g.select(
        "media_id", unit, "start_word_id", "end_word_id", *(["text"] if with_text else []), "start_ms", "end_ms", "span_ms", "active_ms", "pause_ms", "speech_units",
        (F.col("speech_units") * F.lit(1000.0) / F.col("active_ms")).alias("articulation_rate"),
        (F.col("speech_units") * F.lit(1000.0) / F.col("span_ms")).alias("speech_rate"),
        F.least(F.lit(1.0), F.col("pause_ms") / F.col("span_ms")).alias("pause_ratio"), "protected_reasons", "speed_pct", "n_pause_edits", "removed_us",
        (left_us * F.lit(100.0) / F.col("speed_pct")).alias("projected_us"),
        F.when(fast & cuts, "pause-and-articulation-slow").when(fast, "articulation-slow").when(cuts, "excessive-pause").otherwise("natural-rhythm").alias("diagnosis"),
        F.when(fast & cuts, "compress-pauses-and-speed").when(fast, "speed-local-speech").when(cuts, "compress-pauses-only").otherwise("keep").alias("action"),
        F.when(limit(rules.PREFERRED_CUE_MS), "preferred").when(limit(rules.ADAPTIVE_CUE_MS), "adaptive").otherwise("too-long").alias("duration_class"), *(["edits", "last_ms"] if with_edits else []))


def pause_edits(words: DataFrame, decisions: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Removals in over-long pauses: the middle goes, a short pause (longer by the unit's speed) stays."""
    p = pauses(words, unit).filter(F.col("pause_ms") > rules.PAUSE_LIMIT_MS).join(hashed(decisions.select("media_id", unit, "speed_pct"), "media_id"), ["media_id", unit])
    half = F.col("speed_pct") * (5 * rules.PAUSE_TARGET_MS)
    p = p.withColumn("remove_start_us", F.col("gap_start_ms") * 1000 + half).withColumn("remove_end_us", F.col("gap_end_ms") * 1000 - half)
    p = p.withColumn("removed_us", F.col("remove_end_us") - F.col("remove_start_us"))
    return p.filter(F.col("removed_us") > rules.PAUSE_MIN_REMOVAL_MS * 1000).select(
        "media_id", unit, "pos", "after_word_id", "before_word_id", "pause_ms", "remove_start_us", "remove_end_us", "removed_us")


def rhythm_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("units"), F.sum("n_pause_edits").alias("pause_compressions"), F.count_if(F.col("speed_pct") > 100).alias("sped_units"),
        F.max("speed_pct").alias("max_speed_pct"), F.sum("span_ms").alias("input_ms"), F.sum("removed_us").alias("removed_us"))


def overlapping_edits(edits: DataFrame) -> DataFrame:
    """Removals that begin before the one before them ends."""
    e = scans.scan(edits, "media_id", ["remove_start_us", "pos"], scans.by_span("remove_start_us", PIECE_BUCKET_US), __pe=scans.lag("remove_end_us"))
    return e.filter(F.col("remove_start_us") < F.col("__pe") - rules.EPS_US).drop("__pe")


def build_pieces(decisions: DataFrame, edits: DataFrame, durations: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Piecewise time map: cut [0, duration] at every region and removal end, drop removed parts, give each part its
    region's speed, merge equal neighbours, and run the output clock. ``durations``: media_id, duration_us. All three are read
    more than once; tables of whole items are best staged before, as in ``word_pieces``."""
    eps = rules.EPS_US
    decisions = before_scan(decisions.select("media_id", unit, "start_ms", "end_ms", "speed_pct"), "media_id", "decisions")
    edits = before_scan(edits.select("media_id", "remove_start_us", "remove_end_us"), "media_id", "edits")
    regions = decisions.select("media_id", (F.col("start_ms") * 1000).alias("r_start"), (F.col("end_ms") * 1000).alias("r_end"), F.col("speed_pct").alias("r_pct"), F.col(unit).alias("r_unit"))
    removals = edits.select("media_id", F.col("remove_start_us").alias("x_start"), F.col("remove_end_us").alias("x_end"))
    ends = regions.select("media_id", F.explode(F.array("r_start", "r_end")).alias("at_us")).unionByName(
        removals.select("media_id", F.explode(F.array("x_start", "x_end")).alias("at_us")))
    zero = F.lit(0).cast("long")
    points = ends.join(hashed(durations, "media_id"), "media_id").select("media_id", F.greatest(zero, F.least("duration_us", "at_us")).alias("at_us")).unionByName(
        durations.select("media_id", F.explode(F.array(zero, F.col("duration_us"))).alias("at_us"))).distinct()
    by = scans.by_span("at_us", PIECE_BUCKET_US)
    parts = scans.scan(points, "media_id", "at_us", by, to_us=scans.lead("at_us")).filter(F.col("to_us") - F.col("at_us") > eps)
    mid2 = F.col("at_us") + F.col("to_us")
    bucket = 10_000_000
    kept = joins.bucketed_range_join(
        parts, removals, "media_id", mid2 / 2, F.col("x_start") - eps, F.col("x_end") + eps,
        (mid2 >= 2 * (F.col("x_start") - eps)) & (mid2 <= 2 * (F.col("x_end") + eps)), bucket, "left_anti")
    placed = joins.bucketed_range_join(
        kept, regions, "media_id", mid2 / 2, F.col("r_start") - eps, F.col("r_end") + eps,
        (mid2 >= 2 * (F.col("r_start") - eps)) & (mid2 <= 2 * (F.col("r_end") + eps)), bucket, "left")
    rated = placed.groupBy("media_id", "at_us", "to_us").agg(F.min_by(F.struct("r_pct", "r_unit"), F.col("r_unit")).alias("r")).select(
        "media_id", "at_us", "to_us", F.coalesce("r.r_pct", F.lit(100)).alias("speed_pct"), F.col("r.r_unit").alias(unit))

    def same(cur, prev):
        return (cur("at_us") - prev("to_us") <= eps) & (cur("speed_pct") == prev("speed_pct")) & cur(unit).eqNullSafe(prev(unit))

    numbered = scans.change_runs(before_scan(rated, "media_id", "parts"), "media_id", "at_us", by, ["at_us", "to_us", "speed_pct", unit], same, "piece_no")
    p = numbered.groupBy("media_id", "piece_no").agg(
        F.min("at_us").alias("source_start_us"), F.max("to_us").alias("source_end_us"), F.min("speed_pct").alias("speed_pct"), F.min(unit).alias(unit))
    length = F.col("source_end_us") - F.col("source_start_us")
    p = p.withColumn("__out", F.floor((length * 200 + F.col("speed_pct")) / (2 * F.col("speed_pct"))).cast("long"))
    p = scans.scan(before_scan(p, "media_id", "pieces"), "media_id", "piece_no", None, output_start_us=scans.sum_before("__out"))
    return p.withColumn("output_end_us", F.col("output_start_us") + F.col("__out")).withColumn("piece_no", F.col("piece_no").cast("long")).drop("__out").select(
        "media_id", "piece_no", "source_start_us", "source_end_us", "speed_pct", unit, "output_start_us", "output_end_us")


def word_pieces(words: DataFrame, unit: str = "unit_id", protected: str = rules.PROTECTED_TEXT, tail_us: int = 0) -> DataFrame:
    """The pieces of each item, which ends ``tail_us`` after its last word. Words are read once: decisions, removals and lengths
    come from one small table of a row per unit."""
    d = rhythm(words, unit, protected, with_text=False, with_edits=True)
    d = stage(d.select("media_id", unit, "start_ms", "end_ms", "speed_pct", "edits", "last_ms"), "decisions")
    total = d.groupBy("media_id").agg((F.max("last_ms") * 1000 + tail_us).alias("duration_us"))
    return build_pieces(d, d.select("media_id", F.inline("edits")), total, unit)


def map_time(points: DataFrame, pieces: DataFrame, at: str = "at_us", point_id: str = "point_id", out: str = "mapped_us") -> DataFrame:
    """Source time to output time. The first piece that holds the time (0.5 ms either side) maps it; in a removed gap
    the piece before gives its end; before everything it is 0. As-of scan over pieces, with the two pieces before
    each carried along because a time at a border may belong to one of them."""
    eps = rules.EPS_US
    cols = ["source_start_us", "source_end_us", "speed_pct", "output_start_us", "output_end_us"]
    spread, w = scans.neighbourhood(pieces.select("media_id", "piece_no", *cols), "media_id", "piece_no", back=2)
    body = F.struct(*cols)
    p = scans.own_rows(spread.withColumn("__q", F.lag(body, 1).over(w)).withColumn("__q2", F.lag(body, 2).over(w)))
    p = p.withColumn("__from", F.col("source_start_us") - eps)
    hit = joins.asof(points, p, "media_id", at, "__from", "piece_no", PIECE_BUCKET_US, point_id)
    v = F.col(at)

    def through(s):
        clamped = F.least(s["source_end_us"], F.greatest(s["source_start_us"], v))
        length = clamped - s["source_start_us"]
        return s["output_start_us"] + F.floor((length * 200 + s["speed_pct"]) / (2 * s["speed_pct"])).cast("long")

    def holds(s):
        return F.coalesce((s["source_start_us"] - eps <= v) & (v <= s["source_end_us"] + eps), F.lit(False))

    cur = F.col("prev")
    mapped = (
        F.when(cur.isNull(), F.lit(0).cast("long")).when(holds(cur["__q2"]), through(cur["__q2"])).when(holds(cur["__q"]), through(cur["__q"]))
        .when(holds(cur), through(cur)).otherwise(cur["output_end_us"]))
    return hit.withColumn(out, mapped).drop("prev")


def rhythm_words(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """Words after the rhythm pass: both ends mapped, order kept, 20 ms at least. Times in microseconds."""
    ends = words.select("media_id", "pos", F.explode(F.array(
        F.struct((F.col("pos") * 2).cast("long").alias("point_id"), (F.col("start_ms") * 1000).alias("at_us")),
        F.struct((F.col("pos") * 2 + 1).cast("long").alias("point_id"), (F.col("end_ms") * 1000).alias("at_us")))).alias("e")).select("media_id", "pos", "e.*")
    m = map_time(ends, before_scan(pieces, "media_id", "pieces")).groupBy("media_id", "pos").agg(
        F.min(F.when(F.col("point_id") % 2 == 0, F.col("mapped_us"))).alias("a"), F.min(F.when(F.col("point_id") % 2 == 1, F.col("mapped_us"))).alias("b"))
    w = words.join(hashed(m, "media_id"), ["media_id", "pos"])
    w = floor_durations(before_scan(w, "media_id", "mapped"), "media_id", "pos", F.col("a"), F.col("b"), F.lit(0).cast("long"), least=rules.MIN_WORD_MS * 1000)
    return w.withColumnRenamed("output_word_start", "rhythm_start_us").withColumnRenamed("output_word_end", "rhythm_end_us").drop("a", "b")


def audit_pieces(pieces: DataFrame) -> DataFrame:
    """First bad piece per item: speed outside 1.00..1.15, empty, or not starting where the one before ended (3 ms)."""
    p = scans.scan(pieces, "media_id", "piece_no", None, __pe=scans.lag("output_end_us"))
    off = F.abs(F.col("output_start_us") - F.coalesce("__pe", F.lit(0).cast("long"))) > 3000
    bad = (F.col("speed_pct") < 100) | (F.col("speed_pct") > 115) | (F.col("source_end_us") <= F.col("source_start_us")) | (
        F.col("output_end_us") <= F.col("output_start_us")) | off
    return p.filter(bad).groupBy("media_id").agg(F.min("piece_no").alias("piece_no"))
