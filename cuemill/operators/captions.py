"""Caption units and cues: edges, limits, trimming and their audits. Times in ms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions import rules, text
from cuemill.operators import scans
from cuemill.operators.findings import findings


def unit_edges(words: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Flags for the first and last word of each unit, by the unit's outer positions."""
    e = words.groupBy("media_id", unit).agg(F.min("pos").alias("__lo"), F.max("pos").alias("__hi"))
    w = words.join(e, ["media_id", unit])
    return w.withColumn("unit_start", F.col("pos") == F.col("__lo")).withColumn("unit_end", F.col("pos") == F.col("__hi")).drop("__lo", "__hi")


def audit_unit_borders(words: DataFrame, unit: str = "unit_id", bad_starts=tuple(rules.UNIT_BAD_STARTS), bad_ends=tuple(rules.UNIT_BAD_ENDS)) -> DataFrame:
    """Units that begin or end with a word that must not stand there."""
    u = words.groupBy("media_id", unit).agg(F.min_by("text", "pos").alias("first"), F.max_by("text", "pos").alias("last"))
    return findings(u, [
        ("forbidden_start", "error", text.normalized_token("first").isin(*bad_starts), {"text": "first"}),
        ("forbidden_end", "error", text.normalized_token("last").isin(*bad_ends), {"text": "last"})], unit)


def audit_units(units: DataFrame, max_width: float = rules.MAX_UNIT_WIDTH, preferred_ms: int = rules.PREFERRED_CUE_MS, longest_ms: int = rules.ADAPTIVE_CUE_MS,
                reasons=tuple(rules.BOUNDARY_REASONS)) -> DataFrame:
    """Findings of caption units: media_id, unit_id, text, approved, boundary_reason, start_pos, end_pos (null when the word
    is not retained), planned_ms and projected_ms of the rhythm analysis."""
    known = F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull()
    ordered = known & (F.col("end_pos") >= F.col("start_pos"))
    width = text.display_width("text")
    too_long = F.col("projected_ms") > longest_ms
    repeated = units.groupBy("media_id", "unit_id").agg(F.count(F.lit(1)).alias("__copies"))
    return findings(units.join(repeated, ["media_id", "unit_id"]), [
        ("duplicate_caption_unit_id", "error", F.col("__copies") > 1, {}),
        ("caption_unit_not_approved", "error", ~F.coalesce("approved", F.lit(False)), {}),
        ("invalid_boundary_reason", "error", ~F.coalesce(F.col("boundary_reason").isin(*reasons), F.lit(False)), {"actual": "boundary_reason"}),
        ("caption_unit_endpoint_not_retained", "error", ~known, {}),
        ("caption_unit_reversed", "error", known & (F.col("end_pos") < F.col("start_pos")), {}),
        ("caption_unit_too_wide", "error", ordered & (width > max_width), {"width": width}),
        ("caption_unit_too_long", "error", ordered & too_long, {"projected_ms": "projected_ms"}),
        ("caption_unit_uses_adaptive_duration", "warning", ordered & ~too_long & (F.col("planned_ms") > preferred_ms), {"planned_ms": "planned_ms"})], "unit_id")


def sentence_consistency(units: DataFrame, key: str = "media_id", sentence: str = "sentence_id", full: str = "full_sentence_text") -> DataFrame:
    """Sentences whose units do not agree on the full text. Minimum and maximum suffice: no distinct set is kept."""
    named = units.filter((F.coalesce(F.col(sentence).cast("string"), F.lit("")) != "") & (F.coalesce(F.col(full), F.lit("")) != ""))
    return named.groupBy(key, sentence).agg(F.min(full).alias("__a"), F.max(full).alias("__b"), F.count(F.lit(1)).alias("units")).filter("__a <> __b").drop("__a", "__b")


def caption_cues(words: DataFrame, unit: str = "unit_id", phrases=(), strip: bool = True) -> DataFrame:
    """One cue per unit from words with ``token``: text, start and spoken end, numbered by unit order."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
    c = words.groupBy("media_id", unit).agg(F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("spoken_end_ms"), listed.alias("__t"))
    t = text.apply_phrases(text.join_tokens("__t"), phrases)
    return c.select("media_id", F.col(unit).alias("cue_no"), "start_ms", "spoken_end_ms", (text.strip_punct(t) if strip else t).alias("text"))


def trim_cues(cues: DataFrame, least_ms: int = 600, floor_ms: int = 200, gap_ms: int = 10) -> DataFrame:
    """Cue ends: at least ``least_ms`` long, within the media, and short of the next cue (never below ``floor_ms``).
    Needs cue_no, start_ms, spoken_end_ms and duration_ms."""
    end = F.least(F.greatest(F.col("spoken_end_ms"), F.col("start_ms") + least_ms), F.col("duration_ms"))
    c = scans.scan(cues.withColumn("end_ms", end), "media_id", "cue_no", None, __next=scans.lead("start_ms"))
    trimmed = F.when(F.col("end_ms") > F.col("__next"), F.greatest(F.col("start_ms") + floor_ms, F.col("__next") - gap_ms)).otherwise(F.col("end_ms"))
    return c.withColumn("end_ms", trimmed).drop("__next")


def audit_captions(cues: DataFrame, tolerance_ms: int = 1) -> DataFrame:
    """Cues out of bounds, over the end of the one before, on several lines or with punctuation on display."""
    c = scans.scan(cues, "media_id", "cue_no", None, __prev=scans.lag("end_ms"))
    shown = F.regexp_replace("text", r"(?<=\p{Nd})\.(?=\p{Nd})", "")
    return findings(c, [
        ("caption_out_of_bounds", "error", (F.col("start_ms") < -tolerance_ms) | (F.col("end_ms") > F.col("duration_ms") + tolerance_ms) | (F.col("end_ms") <= F.col("start_ms")), {}),
        ("caption_overlap", "error", F.col("start_ms") < F.coalesce("__prev", F.lit(0)) - tolerance_ms, {"previous_end": "__prev"}),
        ("caption_not_single_line", "error", F.contains("text", F.lit("\\N")) | F.contains("text", F.lit("\n")), {}),
        ("caption_display_punctuation", "error", shown.rlike(text.char_class(rules.DISPLAY_PUNCTUATION)), {})], "cue_no")


def audit_triggers(states: DataFrame, chapter: str = "chapter_id", pos: str = "pos", slack_ms: int = 30) -> DataFrame:
    """Reveals that come before an earlier one of their chapter, beyond the slack."""
    s = scans.scan(states, ["media_id", chapter], pos, scans.by_rows(pos), __top=scans.max_before("trigger_ms"))
    return s.filter(F.col("trigger_ms") + slack_ms < F.coalesce("__top", F.lit(-1))).drop("__top")
