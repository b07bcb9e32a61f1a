"""Word tables: from raw utterances to corrected, retained words.

Tables carry ``media_id`` and an integer ``pos`` for list order; times are integer milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import text
from cuemill.operators import scans
from cuemill.operators.findings import findings
from cuemill.operators.joins import bucketed_range_join
from cuemill.session import hashed, once, stage

POS_BUCKET = 64


def explode_words(utts: DataFrame) -> DataFrame:
    """Utterances (media_id, utt_pos, words[{text, start_time, end_time}] in ms) to word rows.
    Blank tokens drop out; ``timing_ok`` marks finite, non-negative, rising times."""
    w = utts.select("media_id", "utt_pos", F.posexplode("words").alias("word_pos", "w"))
    w = w.filter(text.clean_ends("w.text") != "")
    start, end = F.col("w.start_time").cast("double"), F.col("w.end_time").cast("double")
    finite = start.isNotNull() & end.isNotNull() & ~F.isnan(start) & ~F.isnan(end) & (F.abs(start) < float("inf")) & (F.abs(end) < float("inf"))
    return w.select(
        "media_id", "utt_pos", "word_pos", F.col("w.text").alias("text"), start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"),
        (start / 1000).alias("start"), (end / 1000).alias("end"), F.coalesce(finite & (start >= 0) & (end > start), F.lit(False)).alias("timing_ok"))


def assign_word_ids(words: DataFrame) -> DataFrame:
    """Number the words of each item in document order: pos, ``word-%06d`` and ``utt-%04d``."""
    w = scans.ordinals(words, "media_id", ["utt_pos", "word_pos"], scans.by_rows("utt_pos", 4096))
    return w.withColumn("word_id", F.format_string("word-%06d", F.col("pos") + 1)).withColumn(
        "utterance_id", F.format_string("utt-%04d", F.col("utt_pos") + 1))


def stitch_chunks(chunks: DataFrame, chunk_ms: int) -> DataFrame:
    """Chunk transcripts (media_id, chunk, ok, utterances) to one utterance table per item, times moved by the
    chunk's place. An item with a failed chunk gives no rows. Chunks stay rows: nothing is gathered."""
    good = chunks.groupBy("media_id").agg(F.bool_and("ok").alias("__ok")).filter("__ok").select("media_id")
    u = chunks.join(good, "media_id").select("media_id", "chunk", F.posexplode("utterances").alias("i", "u"))
    shift = F.col("chunk") * chunk_ms
    move = lambda w: F.struct(
        w["text"].alias("text"), (w["start_time"] + shift).alias("start_time"), (w["end_time"] + shift).alias("end_time"))
    u = scans.ordinals(u, "media_id", ["chunk", "i"], scans.by_rows("chunk", 1024), "utt_pos")
    return u.select(
        "media_id", "utt_pos", F.col("u.text").alias("text"), (F.col("u.start_time") + shift).alias("start_time"),
        (F.col("u.end_time") + shift).alias("end_time"), F.transform("u.words", move).alias("words"))


def token_counts(utts: DataFrame) -> DataFrame:
    """Utterances, meaningful words and separator tokens per item."""
    blank = lambda w: text.clean_ends(w["text"]) == ""
    per = utts.select("media_id", F.size(F.filter("words", lambda w: ~blank(w))).alias("m"), F.size(F.filter("words", blank)).alias("s"))
    return per.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("utterances"), F.sum("m").alias("meaningful_words"), F.sum("s").alias("separator_tokens"))


def joined_text(pos: str = "pos", column="text", sep: str = "") -> Column:
    """Aggregate: the group's texts in order as one string. The string is the result, so it has to fit a row."""
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), column.alias("t")))), lambda x: x["t"]), sep)


def rebuild_text(words: DataFrame, by=("media_id",), sep: str = "") -> DataFrame:
    """Text of every utterance or document from its words, in order."""
    return words.groupBy(*by).agg(joined_text(sep=sep).alias("text"))


def join_words(words: DataFrame, by=("media_id", "unit_id")) -> DataFrame:
    """Text of every unit, spaced at Latin word borders."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return words.groupBy(*by).agg(listed.alias("__t")).withColumn("text", text.join_tokens("__t")).drop("__t")


def range_positions(ranges: DataFrame, words: DataFrame) -> DataFrame:
    """Add start_pos, end_pos and ``problem`` (unknown_endpoint or reversed) to ranges of word ids."""
    at = words.select("media_id", F.col("word_id").alias("__id"), F.col("pos").alias("__pos"))
    a = at.select("media_id", F.col("__id").alias("start_word_id"), F.col("__pos").alias("start_pos"))
    b = at.select("media_id", F.col("__id").alias("end_word_id"), F.col("__pos").alias("end_pos"))
    r = hashed(ranges, "media_id").join(a, ["media_id", "start_word_id"], "left")
    r = hashed(r, "media_id").join(b, ["media_id", "end_word_id"], "left")
    return r.withColumn(
        "problem", F.when(F.col("start_pos").isNull() | F.col("end_pos").isNull(), "unknown_endpoint").when(F.col("end_pos") < F.col("start_pos"), "reversed"))


def expand_id_range(ranges: DataFrame, words: DataFrame, range_id: str = "range_id") -> DataFrame:
    """Ordered words of each valid range, matched by position buckets."""
    r = range_positions(ranges, words).filter(F.col("problem").isNull()).select("media_id", range_id, "start_pos", "end_pos")
    # Read twice, for the levels of its cells and for the join; a few numbers a range.
    r = stage(r, "ranges")
    inside = (F.col("pos") >= F.col("start_pos")) & (F.col("pos") <= F.col("end_pos"))
    hit = bucketed_range_join(words, r, "media_id", F.col("pos"), F.col("start_pos"), F.col("end_pos"), inside, POS_BUCKET, long_ranges=True)
    return hit.drop("start_pos", "end_pos")


def drop_deleted(words: DataFrame, deleted: DataFrame) -> DataFrame:
    """Words not named by any deletion."""
    return words.join(deleted.select("media_id", "word_id"), ["media_id", "word_id"], "left_anti")


def overlapping_deletions(deleted: DataFrame) -> DataFrame:
    """Words named by more than one deletion."""
    return deleted.groupBy("media_id", "word_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unknown_ids(refs: DataFrame, known: DataFrame, on) -> DataFrame:
    return refs.join(known, on, "left_anti")


def id_diff(expected: DataFrame, actual: DataFrame, key: str, group=()) -> DataFrame:
    """Ids missing, unexpected or repeated. Both sides are counted per id before they meet."""
    on = [*group, key]
    e = expected.groupBy(*on).agg(F.count(F.lit(1)).alias("n_expected"))
    a = actual.groupBy(*on).agg(F.count(F.lit(1)).alias("n_actual"))
    j = e.join(a, on, "full_outer").fillna(0, ["n_expected", "n_actual"])
    status = F.when(F.col("n_actual") == 0, "missing").when(F.col("n_expected") == 0, "unexpected").when(F.col("n_actual") > 1, "duplicate")
    return j.withColumn("status", status).filter(F.col("status").isNotNull())


def coverage(children: DataFrame, parents: DataFrame, key: str = "word_id") -> DataFrame:
    """Do the children, in order, name exactly the parents, in order? Both need media_id and a dense ``pos``.
    Compared place by place instead of as two long lists."""
    c = children.select("media_id", F.col("pos").cast("long").alias("pos"), F.col(key).alias("__c"))
    p = parents.select("media_id", F.col("pos").cast("long").alias("pos"), F.col(key).alias("__p"))
    placed = c.join(p, ["media_id", "pos"], "full_outer").groupBy("media_id").agg(
        F.bool_and(F.coalesce(F.col("__c") == F.col("__p"), F.lit(False))).alias("order_matches"))
    d = id_diff(parents, children, key, ("media_id",)).groupBy("media_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("missing", "unexpected", "duplicate")])
    return placed.join(d, "media_id", "left").fillna(0, ["missing", "unexpected", "duplicate"])


# --- corrections --------------------------------------------------------------------------------------


def correction_spans(words: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row per corrected word with its span facts and ``problem``, the first rule its correction breaks."""
    corrections = once(corrections, "media_id", "corrections")
    c = corrections.select("*", F.posexplode("word_ids").alias("span_index", "word_id"))
    w = words.select("media_id", "word_id", F.col("pos").alias("__pos"), F.col("text").alias("__text"), F.col("utterance_id").alias("__utt"))
    narrow = c.select("media_id", "correction_id", "span_index", "word_id")
    j = hashed(narrow, "media_id").join(w, ["media_id", "word_id"], "left")
    named = Window.partitionBy("media_id", "word_id")
    by_two = F.min("correction_id").over(named) < F.max("correction_id").over(named)
    j = j.withColumn("by_two", F.col("word_id").isNotNull() & by_two)
    facts = j.groupBy("media_id", "correction_id").agg(
        F.count(F.lit(1)).alias("span_size"), F.count("__pos").alias("n_known"), F.min("__pos").alias("first_pos"), F.max("__pos").alias("last_pos"),
        F.size(F.collect_set("word_id")).alias("n_ids"), (F.min("__utt") < F.max("__utt")).alias("crosses"),
        (F.max(F.col("__pos") - F.col("span_index")) == F.min(F.col("__pos") - F.col("span_index"))).alias("in_order"),
        F.bool_or("by_two").alias("clash"), joined_text("span_index", F.coalesce("__text", F.lit(""))).alias("asr_original"))
    d = corrections.join(hashed(facts, "media_id"), ["media_id", "correction_id"])
    size = F.col("span_size")
    parts = F.coalesce("corrected_parts", F.when(size == 1, F.array("corrected")))
    problem = (
        F.when(size > 8, "too_many_words").when(F.col("n_known") < size, "unknown_word").when(F.col("n_ids") < size, "repeated_word")
        .when(~F.col("in_order"), "not_contiguous").when(F.col("crosses"), "crosses_utterances").when(F.col("clash"), "corrected_twice")
        .when(F.col("original") != F.col("asr_original"), "original_differs")
        .when((F.trim("corrected") == "") | F.contains("corrected", F.lit("\n")) | (F.length("corrected") > 64), "not_a_short_token")
        .when(parts.isNull() | (F.size(parts) != size) | (F.array_join(parts, "") != F.col("corrected")), "parts_differ")
        .when(F.col("kind") != "asr_error", "wrong_kind").when(F.col("evidence") != "audio-and-context", "wrong_evidence")
        .when(F.col("confidence") != "high", "not_high_confidence").when(~F.coalesce("approved", F.lit(False)), "not_approved")
        .when(F.col("corrected") == F.col("original"), "no_change"))
    d = d.select("media_id", "correction_id", "word_ids", "corrected", parts.alias("__parts"), "span_size", problem.alias("problem"))
    return d.select("media_id", "correction_id", "span_size", "problem", F.col("corrected").alias("span_text"), "__parts",
                    F.posexplode("word_ids").alias("span_index", "word_id")).withColumn("part", F.get("__parts", F.col("span_index"))).drop("__parts")


def apply_corrections(words: DataFrame, corrections: DataFrame) -> DataFrame:
    """Words with sound corrections applied part by part; ids and times stay, the heard text moves to ``asr_text``."""
    spans = correction_spans(words, corrections).filter(F.col("problem").isNull()).select(
        "media_id", "word_id", F.col("correction_id").alias("span_id"), "span_index", "span_size", "span_text", "part")
    spans = once(spans, "media_id", "spans")
    j = words.join(hashed(spans, "media_id"), ["media_id", "word_id"], "left")
    return j.withColumn("asr_text", F.when(F.col("part").isNotNull(), F.col("text"))).withColumn("text", F.coalesce("part", "text")).drop("part").select(
        *words.columns, "asr_text", "span_id", "span_index", "span_size", "span_text")


def correction_findings(words: DataFrame, corrections: DataFrame) -> DataFrame:
    bad = correction_spans(words, corrections).filter(F.col("problem").isNotNull() & (F.col("span_index") == 0))
    return bad.select("media_id", F.col("problem").alias("rule"), F.lit("error").alias("severity"), F.col("correction_id").cast("string").alias("subject_id"),
                      F.lit(None).cast("map<string,string>").alias("detail"))


def collapse_spans(words: DataFrame) -> DataFrame:
    """Caption tokens: a corrected span shows its whole text at its first word and nothing at the others."""
    token = F.when(F.col("span_id").isNull(), F.col("text")).when(F.col("span_index") == 0, F.col("span_text")).otherwise(F.lit(""))
    return words.withColumn("token", token)


def span_completeness(words: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Spans not held whole, in order and with one size and text inside a single unit."""
    s = words.filter(F.col("span_id").isNotNull()).groupBy("media_id", unit, "span_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("span_index").alias("n_distinct"), F.min("span_index").alias("lo"), F.max("span_index").alias("hi"),
        F.min("span_size").alias("size"), F.max("span_size").alias("size_max"), F.min("span_text").alias("t0"), F.max("span_text").alias("t1"),
        F.min(F.col("pos") - F.col("span_index")).alias("o0"), F.max(F.col("pos") - F.col("span_index")).alias("o1"))
    consistent = (F.col("size") == F.col("size_max")) & (F.col("t0") == F.col("t1"))
    whole = (F.col("n") == F.col("size")) & (F.col("n_distinct") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("size") - 1) & (F.col("o0") == F.col("o1"))
    return s.withColumn("problem", F.when(~consistent, "inconsistent_metadata").when(~whole, "split_across_units")).filter(F.col("problem").isNotNull()).select(
        "media_id", unit, "span_id", "problem")


def review_text(words: DataFrame, by=("media_id",)) -> DataFrame:
    """Marked text for a reader: corrections bold with the heard text, deletions underlined, breaks after cues and
    sentences. Needs deleted, cue_end, sentence_end, and the span columns of ``apply_corrections``."""
    heard = F.coalesce("asr_text", "text")
    spans = words.filter(F.col("span_id").isNotNull()).groupBy("media_id", "span_id").agg(
        joined_text("pos", heard).alias("__heard"), F.max_by("sentence_end", "pos").alias("__se"), F.max_by("cue_end", "pos").alias("__ce"))
    w = words.join(hashed(spans, "media_id"), ["media_id", "span_id"], "left")
    in_span = F.col("span_id").isNotNull()
    mark = F.when(in_span & (F.col("span_index") > 0), "").when(
        in_span, F.concat(F.lit("**"), "span_text", F.lit("**（原转写："), "__heard", F.lit("；原因：ASR 误听，音频与上下文明确）"))).when(
        F.col("deleted"), F.concat(F.lit("<u>"), "text", F.lit("</u>"))).otherwise(F.col("text"))
    sentence = F.when(in_span, F.col("__se")).otherwise(F.col("sentence_end"))
    cue = F.when(in_span, F.col("__ce")).otherwise(F.col("cue_end"))
    last = F.when(in_span & (F.col("span_index") > 0), "").when(sentence, F.lit("\n\n")).when(cue, F.lit("  \n")).otherwise("")
    return w.groupBy(*by).agg(joined_text("pos", F.concat(mark, last)).alias("review"))


def exclude_approved(words: DataFrame, decisions: DataFrame, pattern: str) -> DataFrame:
    """Words with an embedded filler that no approved, reasoned ``semantic_word`` decision covers."""
    ok = decisions.filter((F.col("decision") == "semantic_word") & F.col("approved") & (text.clean_ends("reason") != ""))
    hit = words.filter(text.has_embedded_filler("text", pattern))
    return hit.join(ok.select("media_id", "word_id"), ["media_id", "word_id"], "left_anti")


def timing_findings(words: DataFrame) -> DataFrame:
    return findings(words, [("raw_word_invalid_timing", "error", ~F.col("timing_ok"), {"text": "text"})],
                    F.format_string("%d:%d", "utt_pos", "word_pos"))
