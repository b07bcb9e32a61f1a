"""Whole flows: the three pipelines of the domain as compositions of operators. Lazy but for staged tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.functions import rules, text
from cuemill.operators import articles, audits, captions, findings, rhythm, segments, videos, words
from cuemill.session import stage


@dataclass(frozen=True)
class SpeechEdit:
    """Tables of one speech edit: mapped words, segments, rhythm decisions, pieces, cues and all findings."""

    segments: DataFrame
    mapped: DataFrame
    decisions: DataFrame
    pieces: DataFrame
    cues: DataFrame
    findings: DataFrame


def speech_edit(raw_words: DataFrame, corrections: DataFrame, deletions: DataFrame, media: DataFrame,
                filler: str = text.char_class(rules.FILLER_CHARS)) -> SpeechEdit:
    """Correct, cut, remap, set the rhythm, caption and audit. ``deletions`` are ranges of word ids; ``media`` has duration_ms."""
    fixed = stage(words.apply_corrections(raw_words, corrections), "corrected")
    gone = words.expand_id_range(deletions, fixed).select("media_id", "word_id").distinct().withColumn("__gone", F.lit(True))
    marked = stage(fixed.join(gone, ["media_id", "word_id"], "left").withColumn("deleted", F.coalesce("__gone", F.lit(False))).drop("__gone"), "marked")
    segs = stage(segments.output_offsets(segments.retained_segments(marked)), "segments")
    mapped = stage(segments.remap_words(marked.filter(~F.col("deleted")), segs), "mapped")
    # The cut timeline is a new list: number its words from 0.
    cut = mapped.withColumn("start_ms", F.col("mapped_start_ms")).withColumn("end_ms", F.col("mapped_end_ms"))
    cut = _renumbered(cut)
    decisions = stage(rhythm.rhythm(cut), "decisions")
    edits = rhythm.pause_edits(cut, decisions)
    total = segs.groupBy("media_id").agg((F.max("output_end_ms") * 1000).alias("duration_us"))
    pieces = stage(rhythm.build_pieces(decisions, edits, total), "pieces")
    final = rhythm.rhythm_words(cut, pieces)
    final = words.collapse_spans(final).withColumn("start_ms", F.floor(F.col("rhythm_start_us") / 1000)).withColumn("end_ms", F.floor(F.col("rhythm_end_us") / 1000))
    length = pieces.groupBy("media_id").agg(F.floor(F.max("output_end_us") / 1000).alias("duration_ms"))
    cues = stage(captions.trim_cues(captions.caption_cues(final).join(length, "media_id")), "cues")
    placed = mapped.select("media_id", "word_id", "text")
    left = audits.retained_fillers(placed, filler).select("media_id", "rule", F.lit("error").alias("severity"), F.col("word_id").alias("subject_id"), F.lit(None).cast("map<string,string>").alias("detail"))
    found = (
        words.correction_findings(raw_words, corrections).unionByName(audits.audit_word_order(fixed, media)).unionByName(left)
        .unionByName(captions.audit_unit_borders(cut)).unionByName(captions.audit_captions(cues)))
    return SpeechEdit(segs, mapped, decisions, pieces, cues, found)


def _renumbered(w: DataFrame) -> DataFrame:
    from cuemill.operators import scans

    return scans.ordinals(w.withColumnRenamed("pos", "source_pos"), "media_id", "source_pos", scans.by_rows("source_pos"))


def breakdown(video_table: DataFrame, utterances: DataFrame, comments: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One breakdown row per video, and its structure timeline with the nearest key frame of each row."""
    rows = stage(videos.structure_timeline(utterances).withColumn("start_ms", F.floor("start_ms")), "timeline")
    return videos.video_breakdown(video_table, utterances, comments, frames), videos.nearest_frame(rows, frames)


def article_report(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Meta and gate per page, its links, and its images."""
    meta = articles.html_meta(pages).join(articles.html_gate(pages), "page_id")
    return meta, articles.extract_links(pages), articles.html_images(pages)


def speech_edit_verdict(edit: SpeechEdit, media: DataFrame) -> DataFrame:
    return findings.verdict(edit.findings, media)
