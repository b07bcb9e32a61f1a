"""Audits over whole tables. Each gives rows of the findings schema or of plain differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import rules, text
from cuemill.operators import joins, scans
from cuemill.operators.findings import findings
from cuemill.session import hashed, once, whole


def audit_word_order(words: DataFrame, media: DataFrame) -> DataFrame:
    """Bad ranges, steps back, overlaps, words past the media end, repeated or missing ids. ``media``: media_id, duration_ms.
    Words without usable times are reported and do not take part in the order checks."""
    timed = words.filter(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    w = scans.scan(timed, "media_id", "pos", None, __ps=scans.lag("start_ms"), __pe=scans.max_before("end_ms"))
    w = w.join(media.select("media_id", "duration_ms"), "media_id", "left")
    start, end = F.col("start_ms"), F.col("end_ms")
    order = findings(w, [
        ("normalized_word_invalid_range", "error", (start < 0) | (end <= start), {}),
        ("normalized_word_not_monotonic", "error", start < F.coalesce("__ps", F.lit(-1000)), {}),
        ("normalized_word_illegal_overlap", "error", (F.col("__pe") >= 0) & (start < F.col("__pe") - rules.OVERLAP_TOLERANCE_MS), {"overlap_ms": F.col("__pe") - start}),
        ("normalized_word_outside_media", "error", (F.col("duration_ms") > 0) & (end > F.col("duration_ms") + rules.MEDIA_TOLERANCE_MS), {})], "pos")
    untimed = findings(words, [("normalized_word_invalid_timing", "error", start.isNull() | end.isNull(), {})], "pos")
    named = words.select("media_id", "pos", F.coalesce("word_id", F.lit("")).alias("__id"))
    copies = named.groupBy("media_id", "__id").agg(F.count(F.lit(1)).alias("__n"), F.min("pos").alias("__first")).filter("__n > 1 OR __id = ''")
    again = named.join(copies, ["media_id", "__id"]).filter("pos > __first OR __id = ''")
    return order.unionByName(untimed).unionByName(findings(again, [("normalized_word_id_invalid", "error", F.lit(True), {})], "pos"))


def audit_utterances(utterances: DataFrame, words: DataFrame) -> DataFrame:
    """Utterances naming unknown words, or whose text is not that of their words. ``utterances``: media_id, utterance_id,
    text, word_ids."""
    ids = utterances.select("media_id", "utterance_id", F.posexplode("word_ids").alias("i", "word_id"))
    j = ids.join(words.select("media_id", "word_id", F.col("text").alias("__w")), ["media_id", "word_id"], "left")
    g = j.groupBy("media_id", "utterance_id").agg(
        F.count_if(F.col("__w").isNull()).alias("unknown"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "__w"))), lambda x: x["__w"]), "").alias("__joined"))
    u = utterances.select("media_id", "utterance_id", "text").join(g, ["media_id", "utterance_id"])
    differs = text.comparable_text("__joined") != text.comparable_text("text")
    return findings(u, [
        ("normalized_utterance_unknown_words", "error", F.col("unknown") > 0, {"words": "unknown"}),
        ("utterance_text_word_mismatch", "error", (F.col("unknown") == 0) & differs, {})], "utterance_id")


def large_gaps(words: DataFrame, media: DataFrame, limit_ms: int = 10_000) -> DataFrame:
    """Warn of long stretches without words at either end of the media."""
    g = words.groupBy("media_id").agg(F.min_by("start_ms", "pos").alias("__s"), F.max_by("end_ms", "pos").alias("__e"))
    g = g.join(media.select("media_id", "duration_ms"), "media_id").filter("duration_ms > 0")
    return findings(g, [
        ("large_leading_untranscribed_span", "warning", F.col("__s") > limit_ms, {"ms": "__s"}),
        ("large_trailing_untranscribed_span", "warning", F.col("duration_ms") - F.col("__e") > limit_ms, {"ms": F.col("duration_ms") - F.col("__e")})], F.lit(""))


def audit_cut_plan(segments: DataFrame) -> DataFrame:
    """Segment checks that need no other table: window, length, order, ids, margins, fades and headroom.
    Columns: media_id, seg_no, segment_id, source_start_ms, source_end_ms, window_start_ms, window_end_ms, first_start_ms,
    last_end_ms, and the boundary analysis (entry_context, entry_strategy, entry_clean, tail_clear, speech_onset_ms,
    headroom_ms, tailroom_ms, fade_in_ms, fade_out_ms)."""
    s = scans.scan(segments, "media_id", "seg_no", None, __pe=scans.lag("source_end_ms"))
    if whole(segments, ["media_id"]):
        named = Window.partitionBy("media_id", "segment_id")
        s = s.withColumn("__first", F.min("seg_no").over(named)).filter("media_id IS NOT NULL AND segment_id IS NOT NULL")
    else:
        s = s.join(segments.groupBy("media_id", "segment_id").agg(F.min("seg_no").alias("__first")), ["media_id", "segment_id"])
    start, end, splice = F.col("source_start_ms"), F.col("source_end_ms"), F.col("entry_strategy") == rules.SPLICE_ENTRY
    lead = F.coalesce("speech_onset_ms", "first_start_ms") - start
    tail = end - F.col("last_end_ms")
    lead_lo = F.when(splice, rules.SPLICE_MARGIN_MS[0]).otherwise(rules.START_MARGIN_MS[0])
    lead_hi = F.when(splice, rules.SPLICE_MARGIN_MS[1]).otherwise(rules.START_MARGIN_MS[1])
    fade_limit = F.when(splice, 6).otherwise(F.least(F.lit(12), F.col("headroom_ms")))
    m = rules.MAX_HEADROOM_MS
    head_max = F.when(F.col("entry_context") == "opening", m["opening"]).when(F.col("entry_context") == "after-filler", m["after-filler"]).when(F.col("entry_context") == "normal", m["normal"]).otherwise(0)
    head_min = F.when(splice, 0).otherwise(rules.START_MARGIN_MS[0])
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return findings(s, [
        ("duplicate_segment_id", "error", F.col("seg_no") > F.col("__first"), {}),
        ("outside_source_window", "error", (start < F.col("window_start_ms")) | (end > F.col("window_end_ms")), {}),
        ("segment_too_short", "error", end - start < rules.MIN_SEGMENT_MS, {"duration_ms": end - start}),
        ("overlap_or_unsorted", "error", start < F.coalesce("__pe", "window_start_ms"), {"previous_end_ms": "__pe"}),
        ("start_margin_out_of_range", "error", (lead < lead_lo) | (lead > lead_hi), {"margin_ms": lead}),
        ("end_margin_out_of_range", "error", (tail < rules.END_MARGIN_MS[0]) | (tail > rules.END_MARGIN_MS[1]), {"margin_ms": tail}),
        ("unclean_segment_entry", "error", no(F.col("entry_clean")), {}),
        ("unprotected_segment_tail", "error", no(F.col("tail_clear")), {}),
        ("entry_context_missing", "error", no(F.col("entry_context").isin(*m)), {}),
        ("entry_strategy_invalid", "error", no(F.col("entry_strategy").isin(*rules.ENTRY_STRATEGIES)), {}),
        ("unsafe_fade_in", "error", (F.col("fade_in_ms") < 0) | (F.col("fade_in_ms") > fade_limit), {}),
        ("unsafe_fade_out", "error", (F.col("fade_out_ms") < 0) | (F.col("fade_out_ms") > F.least(F.lit(12), F.col("tailroom_ms"))), {}),
        ("dynamic_headroom_out_of_range", "error", (F.col("headroom_ms") < head_min) | (F.col("headroom_ms") > head_max), {})], "segment_id")


def retained_fillers(placed: DataFrame, filler: str) -> DataFrame:
    """Fillers still inside segments, whole or embedded. ``placed`` is the result of ``words_in_segments``."""
    kind = F.when(text.is_filler("text", filler), "retained_hard_fillers").when(text.has_filler("text", filler), "ambiguous_embedded_hard_fillers")
    return placed.withColumn("rule", kind).filter(F.col("rule").isNotNull())


def planned_duration(segments: DataFrame) -> DataFrame:
    return segments.groupBy("media_id").agg(F.sum(F.greatest(F.lit(0).cast("long"), F.col("source_end_ms") - F.col("source_start_ms"))).alias("planned_ms"))


def compare_positional(a: DataFrame, b: DataFrame, key: str, pos: str, numbers: dict[str, int], equal=()) -> DataFrame:
    """Compare two lists place by place: missing partner, number apart by more than its tolerance, or other value."""
    left = a.select(key, pos, *[F.col(c).alias(f"__a_{c}") for c in [*numbers, *equal]], F.lit(True).alias("__a"))
    right = b.select(key, pos, *[F.col(c).alias(f"__b_{c}") for c in [*numbers, *equal]], F.lit(True).alias("__b"))
    j = left.join(right, [key, pos], "full_outer")
    differs = F.lit(False)
    for c, tolerance in numbers.items():
        differs = differs | (F.abs(F.col(f"__a_{c}") - F.col(f"__b_{c}")) > tolerance)
    for c in equal:
        differs = differs | ~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}"))
    problem = F.when(F.col("__a").isNull(), "only_in_second").when(F.col("__b").isNull(), "only_in_first").when(differs, "differs")
    return j.select(key, pos, problem.alias("problem")).filter(F.col("problem").isNotNull())


def review_status(items: DataFrame, approvals: DataFrame, key: str = "media_id") -> DataFrame:
    """Review items without approval and approvals without an item."""
    i = items.select(key, "review_id").distinct().withColumn("__i", F.lit(True))
    a = approvals.filter("approved").select(key, "review_id").distinct().withColumn("__a", F.lit(True))
    j = i.join(a, [key, "review_id"], "full_outer")
    return j.withColumn("status", F.when(F.col("__a").isNull(), "unresolved").when(F.col("__i").isNull(), "unknown_approval")).filter(
        F.col("status").isNotNull()).drop("__i", "__a")


def check_bindings(recorded: DataFrame, files: DataFrame, on=("run_id", "name")) -> DataFrame:
    """Recorded input hashes that are missing from, or differ from, the files."""
    r = recorded.select(*on, F.col("sha256").alias("recorded"))
    f = files.select(*on, F.col("sha256").alias("actual"))
    j = r.join(f, list(on), "left")
    return j.withColumn("status", F.when(F.col("actual").isNull(), "file_missing").when(~F.col("recorded").eqNullSafe(F.col("actual")), "hash_differs")).filter(F.col("status").isNotNull())


def acceptance(checks: DataFrame, expected: dict[str, str], key: str = "media_id") -> DataFrame:
    """Each expected check (id: required status) present once, with that status and evidence; nothing else present."""
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("check_id"), F.lit(s).alias("required_status")) for c, s in expected.items()]))
    wanted = checks.select(key).distinct().select(key, listed.alias("w")).select(key, "w.*")
    got = checks.groupBy(key, "check_id").agg(F.count(F.lit(1)).alias("__n"), F.min("status").alias("__lo"), F.max("status").alias("__hi"),
                                              F.bool_and(text.clean_ends("evidence") != "").alias("__ev"))
    j = wanted.withColumn("__w", F.lit(True)).join(got, [key, "check_id"], "full_outer")
    status = F.col("required_status")
    return j.select(key, "check_id", F.explode(F.array_compact(F.array(
        F.when(F.col("__n") > 1, F.lit("duplicate")), F.when(F.col("__w").isNull(), F.lit("unknown")), F.when(F.col("__n").isNull(), F.lit("missing")),
        F.when(F.col("__w") & F.col("__n").isNotNull() & ((F.col("__lo") != status) | (F.col("__hi") != status)), F.lit("wrong_status")),
        F.when(F.col("__w") & ~F.col("__ev"), F.lit("no_evidence"))))).alias("problem"))


def audit_overlays(overlays: DataFrame, media: DataFrame) -> DataFrame:
    """Overlay times against the media: finite numbers, a length within it (default 5 s), start and end inside.
    start, end and duration are text or numbers; ``media``: media_id, duration (seconds)."""
    j = overlays.join(media.select("media_id", F.col("duration").cast("double").alias("__d")), "media_id")
    num = lambda c: F.col(c).try_cast("double")
    finite = lambda c: num(c).isNotNull() & ~F.isnan(num(c)) & (F.abs(num(c)) < float("inf"))
    has_d, has_e = F.col("duration").isNotNull(), F.col("end").isNotNull()
    length = F.when(has_d, num("duration")).when(~has_e, F.lit(5.0)).otherwise(F.lit(0.0))
    stop = F.when(has_e, num("end")).otherwise(num("start") + length)
    bad_number = ~finite("start") | (has_e & ~finite("end")) | (has_d & ~finite("duration"))
    rule = (
        F.when(bad_number, "not_a_finite_number")
        .when(has_d & ((num("duration") <= 0) | (num("duration") > F.col("__d"))), "duration_out_of_range")
        .when((num("start") < 0) | (num("start") > F.col("__d")), "start_out_of_range")
        .when((stop <= num("start")) | (stop > F.col("__d")), "end_out_of_range"))
    return j.withColumn("rule", rule).filter(F.col("rule").isNotNull()).select("media_id", "overlay_id", "rule")


def missing_fields(df: DataFrame, required, key) -> DataFrame:
    """Required fields that are null or blank, per record, in the given order."""
    key = [key] if isinstance(key, str) else list(key)
    blank = lambda c: F.col(c).isNull() | (text.clean_ends(F.col(c).cast("string")) == "")
    return df.select(*key, F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in required])).alias("missing")).withColumn("complete", F.size("missing") == 0)


def coverage_ratio(intervals: DataFrame, media: DataFrame, width: int, key: str = "media_id", overlap: int = 50, gap: int = 12_000) -> DataFrame:
    """Share of each item covered by its intervals (start, end, interval_id), overlaps and long gaps counted.
    The reach so far is a running maximum by time blocks of ``width``."""
    i = scans.scan(intervals, key, ["start", "end", "interval_id"], scans.by_span("start", width), __reach=scans.max_before("end"))
    reach = F.coalesce("__reach", F.lit(0).cast("long"))
    g = i.groupBy(key).agg(
        F.sum(F.greatest(F.lit(0).cast("long"), F.col("end") - F.greatest(F.col("start"), reach))).alias("covered"),
        F.count_if(F.col("start") < reach - overlap).alias("overlaps"), F.count_if((reach != 0) & (F.col("start") - reach > gap)).alias("long_gaps"))
    j = media.select(key, "duration").join(g, key, "left").fillna(0, ["covered", "overlaps", "long_gaps"])
    return j.withColumn("ratio", F.coalesce(F.try_divide(F.col("covered").cast("double"), F.col("duration").cast("double")), F.lit(0.0)))


def chapter_bounds(chapters: DataFrame, media: DataFrame, key: str = "media_id", fullscreen: Column | None = None) -> DataFrame:
    """Chapter and full-screen counts against the limits of the length (``duration_ms``)."""
    c = chapters.groupBy(key).agg(F.count(F.lit(1)).alias("chapters"), F.count_if(fullscreen if fullscreen is not None else F.lit(False)).alias("fullscreens"))
    j = media.select(key, "duration_ms").join(c, key, "left").fillna(0, ["chapters", "fullscreens"])
    d = F.col("duration_ms")
    j = j.withColumn("least", F.when(d < 45_000, 1).otherwise(2)).withColumn("most", F.greatest(F.lit(3), F.least(F.lit(7), F.floor(d / 20_000) + 2)))
    j = j.withColumn("most_fullscreens", F.greatest(F.lit(1), F.floor(d / 150_000) + 1))
    return j.withColumn("ok", F.col("chapters").between(F.col("least"), F.col("most")) & (F.col("fullscreens") <= F.col("most_fullscreens")))


def cleanup_report(files: DataFrame, classes) -> DataFrame:
    """Files and bytes per cleanup class (class, path pattern); the first pattern that fits counts."""
    label = text.first_label("path", classes, "")
    return files.withColumn("class", label).filter("class <> ''").groupBy("class").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def audit_reveals(events: DataFrame, units: DataFrame, words: DataFrame) -> DataFrame:
    """Reveal events against visual units and the words they name.

    ``events``: media_id, event_no, segment_id, visual_id, unit, role, spoken_excerpt, timing_reason, spoiler_ok and the six
    word ids; ``units``: media_id, segment_id, visual_id, unit, trigger_word_ids, chapter_start_ms, chapter_end_ms;
    ``words``: media_id, word_id, pos, text, start_ms, end_ms. All word ids are looked up in one join, whose numbers are staged;
    the evidence text comes from a position-bucketed range join."""
    roles = ["evidence_start_word_id", "evidence_end_word_id", "earliest_allowed_word_id", "trigger_word_id", "fully_visible_by_word_id", "hold_until_word_id"]
    key = ["media_id", "segment_id", "visual_id"]
    u = hashed(units.withColumnRenamed("unit", "unit_kind"), "media_id")
    e = events.dropna(subset=key)
    # Words are looked up for all events of known visuals: telling the first ones would take a sort.
    known = e.join(u, key)
    e = e.withColumn("__first", F.min("event_no").over(Window.partitionBy(*key))).join(u, key, "left")
    seen = F.col("unit_kind").isNotNull()
    first = F.col("event_no") == F.col("__first")

    # All word ids of an event in one list: its six, then those of its visual. Numbers alone are kept of the words found, so that
    # they are added up in place; the place of the expected trigger in its list is the rest of a number that orders by time.
    w = words.select("media_id", "word_id", F.col("pos").alias("__pos"), F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e"))
    own = F.array(*[F.struct(F.lit(i).alias("no"), F.col(r).alias("word_id")) for i, r in enumerate(roles)])
    listed = F.transform(F.coalesce("trigger_word_ids", F.array().cast("array<string>")), lambda x, i: F.struct((i + len(roles)).alias("no"), x.alias("word_id")))
    asked = known.select("media_id", "event_no", F.explode(F.concat(own, listed)).alias("x")).select("media_id", "event_no", "x.*")
    of = lambda r, c: F.max(F.when(F.col("no") == roles.index(r), F.col(c)))
    places = F.lit(1 << 31).cast("decimal(11,0)")  # more than a list has
    order = F.when(F.col("no") >= len(roles), F.col("__s").cast("decimal(20,0)") * places + (F.col("no") - len(roles)))
    at = asked.join(hashed(w, "media_id"), ["media_id", "word_id"], "left").groupBy("media_id", "event_no").agg(
        F.count_if(F.col("__pos").isNull() & (F.col("no") < len(roles))).alias("__unmapped"), *[of(r, "__pos").alias(f"p{i}") for i, r in enumerate(roles)],
        of("trigger_word_id", "__s").alias("trigger_ms"), of("fully_visible_by_word_id", "__e").alias("visible_ms"), of("hold_until_word_id", "__e").alias("hold_ms"),
        F.pmod(F.min(order), places).cast("int").alias("__expected"))
    at = once(at, "media_id", "reveal-words")
    ranged = at.filter((F.col("__unmapped") == 0) & (F.col("p0") <= F.col("p1"))).select("media_id", "event_no", "p0", "p1")
    spoken = joins.bucketed_range_join(
        words.select("media_id", "pos", "text"), ranged, "media_id", F.col("pos"), F.col("p0"), F.col("p1"), (F.col("pos") >= F.col("p0")) & (F.col("pos") <= F.col("p1")), 64)
    spoken = spoken.groupBy("media_id", "event_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("evidence"))
    e = e.join(hashed(at, "media_id"), ["media_id", "event_no"], "left").join(hashed(spoken, "media_id"), ["media_id", "event_no"], "left")
    expected = F.get("trigger_word_ids", F.col("__expected"))
    mapped = seen & first & (F.col("__unmapped") == 0)
    sound = mapped & (F.col("p0") <= F.col("p1"))
    pick = lambda d: F.when(F.col("unit_kind") == "state", d["state"]).when(F.col("unit_kind") == "item", d["item"]).otherwise(d["formula-part"])
    shown = F.col("trigger_ms") + pick(rules.ENTRY_MS)
    folded = text.comparable_text("spoken_excerpt", "fold")
    found = findings(e, [
        ("semantic_reveal_unknown_visual", "error", ~seen, {}),
        ("semantic_reveal_duplicate_visual", "error", seen & (F.col("event_no") > F.col("__first")), {}),
        ("semantic_reveal_unit_mismatch", "error", first & (F.col("unit_kind") != F.col("unit")), {}),
        ("semantic_reveal_word_unmapped", "error", seen & first & (F.col("__unmapped") > 0), {}),
        ("semantic_evidence_range_reversed", "error", mapped & (F.col("p0") > F.col("p1")), {}),
        ("semantic_spoken_excerpt_not_exact", "error", sound & ((folded == "") | (folded != text.comparable_text("evidence", "fold"))), {}),
        ("semantic_trigger_differs_from_render", "error", sound & ~F.col("trigger_word_id").eqNullSafe(expected), {}),
        ("semantic_reveal_order_invalid", "error", sound & ~((F.col("p2") <= F.col("p3")) & (F.col("p3") <= F.col("p4")) & (F.col("p4") <= F.col("p5"))), {}),
        ("semantic_trigger_outside_spoken_evidence", "error", sound & ~F.col("p3").between(F.col("p0"), F.col("p1")), {}),
        ("semantic_fully_visible_too_early", "error", sound & (F.col("visible_ms") + 20 < shown), {}),
        ("semantic_reveal_readability_too_short", "error", sound & (F.col("hold_ms") - shown + 20 < pick(rules.READABLE_HOLD_MS)), {}),
        ("semantic_hold_ends_before_persistent_chapter", "error", sound & (F.col("hold_ms") + 500 < F.col("chapter_end_ms")), {}),
        ("semantic_timing_reason_missing", "error", sound & (F.length(text.clean_ends("timing_reason")) < 8), {}),
        ("semantic_spoiler_check_not_approved", "error", sound & ~F.coalesce("spoiler_ok", F.lit(False)), {})], "event_no")
    uncovered = units.join(hashed(events.select(*key), "media_id"), key, "left_anti")
    lost = findings(uncovered, [("semantic_reveal_visual_uncovered", "error", F.lit(True), {"segment_id": "segment_id"})], "visual_id")
    return found.unionByName(lost)


def next_action(stages: DataFrame, order=tuple(rules.STAGES), actions=None, key: str = "run_id") -> DataFrame:
    """Next step of each run: the first stage, in fixed order, that has not succeeded."""
    actions = rules.STAGE_ACTIONS if actions is None else actions
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage"))
    open_stage = F.when((F.col("status") != "succeeded") & (rank > 0), rank)
    g = stages.groupBy(key).agg(F.min_by(F.struct("stage", "status"), open_stage).alias("o"))
    label = F.when(F.col("o").isNull(), F.lit("inspect_run_state"))
    for s, a in actions.items():
        label = label.when(F.col("o.stage") == s, F.lit(a))
    label = label.when(F.col("o.status") == "failed", F.concat(F.lit("fix_"), "o.stage", F.lit("_failure")))
    label = label.when(F.col("o.status") == "blocked", F.concat(F.lit("resolve_"), "o.stage", F.lit("_blocker")))
    return g.select(key, F.col("o.stage").alias("stage"), label.otherwise(F.concat(F.lit("run_or_resume_"), "o.stage")).alias("action"))
