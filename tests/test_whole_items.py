"""Tables dealt by item: the same results as block by block, and word tables are not shuffled again."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cuemill.catalog import load, views
from cuemill.operators import audits, scans, segments
from cuemill.session import deal, shared_folder, stage, whole

SF = "/root/testdata/sf0.001"


@pytest.fixture
def items(spark):
    rnd = random.Random(5)
    rows = []
    for m in range(6):
        p = -3
        for _ in range(rnd.randint(1, 60)):
            p += rnd.randint(1, 4)
            rows.append((m, p, rnd.choice([None, *range(9)]), rnd.random() < 0.4))
    return spark.createDataFrame(rows, "media_id long, pos int, v long, keep boolean")


def both(df, do):
    rows = [sorted(map(repr, do(d).collect())) for d in (df, deal(df, "media_id", 3))]
    return rows[0] == rows[1] and len(rows[0]) > 0


def test_scans_of_whole_items(items, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK_ROWS", 8)
    for kind in ("sum_before", "sum_upto", "max_before", "max_upto", "lag", "lead", "last_before", "last_upto", "next_after", "next_from"):
        make = getattr(scans, kind)
        assert both(items, lambda d: scans.scan(d, "media_id", "pos", None, x=make("v"))), kind
    assert both(items, lambda d: scans.previous(d, "media_id", "pos", pv="v", pk="keep"))
    assert both(items, lambda d: scans.neighbours(d, "media_id", "pos", ["v"], back=2, ahead=3))
    assert both(items, lambda d: scans.runs(d, "media_id", "pos", F.col("keep")))
    same = lambda cur, prev: cur("v") == prev("v")
    assert both(items, lambda d: scans.change_runs(d, "media_id", "pos", None, ["v"], same))
    a, b = F.coalesce("v", F.lit(0)) * 10, F.coalesce("v", F.lit(0)) * 10 + 5
    for limit in (None, F.lit(200)):
        assert both(items, lambda d: segments.floor_durations(d, "media_id", "pos", a, b, F.lit(7).cast("long"), limit))


def test_a_staged_table_is_dealt_again(items):
    back = stage(deal(items, "media_id", 3))
    assert whole(back, ["media_id"]) and back.rdd.getNumPartitions() == 3
    assert not whole(stage(items), ["media_id"])


@pytest.mark.parametrize("name", "pause_edits rhythm add_partial_entry audit_units entry_context words_in_segments".split())
def test_words_are_not_shuffled(spark, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = load()[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = [x for x in plan.splitlines() if "Exchange" in x]
    assert moved and all("REPARTITION_BY_NUM" in x for x in moved)


@pytest.mark.parametrize("name, times", [("expand_id_range", 1), ("collapse_spans", 1), ("span_completeness", 1), ("apply_corrections", 1), ("review_text", 2),
                                         ("audit_cut_plan", 2), ("audit_verdict", 2), ("pause_edits", 2), ("retained_fillers", 2)])
def test_words_are_made_few_times(spark, name, times):
    """A plan that reads the words at each use splits all texts again; joins in place don't sort them."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = load()[name].run(spark, SF)._jdf.queryExecution()
        made, joins = plan.optimizedPlan().toString().count("Generate posexplode(filter"), plan.executedPlan().toString().count("SortMergeJoin")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert made == times
    assert joins == 0 or name not in ("expand_id_range", "audit_cut_plan", "pause_edits", "retained_fillers")


@pytest.mark.parametrize("name, times", [("rhythm_pieces", 1), ("audit_pieces", 1), ("map_time", 1), ("rhythm_words", 1), ("remap_words", 0), ("map_anchors", 0)])
def test_few_tables_are_staged(spark, name, times):
    """Each staged table is written, read and shuffled again: only decisions are, which pieces need several times."""
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    load()[name].run(spark, SF)
    assert len(set(os.listdir(folder)) - before) == times


def test_anchors_of_whole_items(spark):
    anchors = spark.createDataFrame([(1, 0, ["a", "b", "a"], 5, None), (1, 1, ["x", None], None, 7), (2, 0, ["a"], None, None), (3, 0, [], 1, 1), (4, 0, ["a"], 0, 9)],
                                    "media_id long, anchor_id long, word_ids array<string>, start_offset_ms long, duration_ms long")
    mapped = spark.createDataFrame([(1, "a", 10, 20), (1, "b", 30, 45), (1, "c", 50, 90), (2, "b", 1, 2), (4, "a", 3, 4), (4, "a", 2, 9), (1, None, 0, 99)],
                                   "media_id long, word_id string, mapped_start_ms long, mapped_end_ms long")
    plain, whole_ = (sorted(map(repr, segments.map_anchors(d(anchors), d(mapped)).collect())) for d in (lambda x: x, lambda x: deal(x, "media_id", 3)))
    assert plain == whole_ and len(plain) == 5


def test_reveals_make_words_once_and_units_without_them(spark):
    """Words are made once in the plan and once in the table staged before it; units are cut from the texts."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = load()["audit_reveals"].run(spark, SF)._jdf.queryExecution()
        made, joins = plan.optimizedPlan().toString().count("Generate posexplode(filter"), plan.executedPlan().toString().count("SortMergeJoin")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert made == 1 and joins == 0


def test_unit_rows_are_those_of_the_words(spark, tmp_path):
    texts = [(1, " ".join("abcdefg"[: i % 7 + 1] * (1 + i % 40) for i in range(25))), (2, "one"), (3, ""), (4, None), (5, " \n a\t\tb "), (6, " ".join("x" for _ in range(24))), (0, " ".join("é漢" * (i % 9) + "z" for i in range(13)))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = views.unit_rows(spark, str(tmp_path)).select("media_id", "unit_id", "lo", "hi", "end_ms", F.array_join("texts", " ").alias("said"))
    want = views.words(spark, str(tmp_path)).groupBy("media_id", "unit_id").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max("end_ms").alias("end_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("said"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 3 + 1 + 1 + 2 + 2


def test_reveals_of_whole_items(spark):
    words = spark.createDataFrame([(m, f"w{i}", i, t, i * 1000, i * 1000 + 500) for m in (1, 2) for i, t in enumerate(["One,", "two", "three", "four", "five"])],
                                  "media_id long, word_id string, pos int, text string, start_ms long, end_ms long")
    units = spark.createDataFrame([(1, "s", "a", "state", ["w3", "w2", "w9"], 0, 0), (1, "s", "b", "item", [], 0, 0), (1, "s", "c", "item", None, 0, 0), (1, "s", "d", "state", ["w1"], 0, 9000), (2, "s", "a", "item", ["w0"], 0, 0)],
                                  "media_id long, segment_id string, visual_id string, unit string, trigger_word_ids array<string>, chapter_start_ms long, chapter_end_ms long")
    ask = lambda m, n, v, unit, said, *ids: (m, n, "s", v, unit, "claim", said, "spoken here", n != 6, *ids)
    events = spark.createDataFrame([
        ask(1, 1, "a", "state", "two THREE!", "w1", "w2", "w1", "w2", "w3", "w4"), ask(1, 2, "a", "state", "x", "w1", "w2", "w1", "w2", "w2", "w4"), ask(1, 3, "b", "state", "one", "w0", "w0", "w0", "w0", "w4", "w4"),
        ask(1, 4, "none", "item", "one", "w0", "w0", "w0", "w0", "w0", "w0"), ask(1, 5, "d", "state", "one", "w0", "w7", None, "w0", "w0", "w0"), ask(2, 6, "a", "item", "two", "w2", "w1", "w0", "w0", "w1", "w4")],
        "media_id long, event_no long, segment_id string, visual_id string, unit string, role string, spoken_excerpt string, timing_reason string, spoiler_ok boolean, evidence_start_word_id string, "
        "evidence_end_word_id string, earliest_allowed_word_id string, trigger_word_id string, fully_visible_by_word_id string, hold_until_word_id string")
    plain, dealt = (sorted(((r.media_id, r.subject_id, r.rule.removeprefix("semantic_")) for r in audits.audit_reveals(d(events), d(units), d(words)).collect())) for d in (lambda x: x, lambda x: deal(x, "media_id", 3)))
    assert plain == dealt == [
        (1, "2", "reveal_duplicate_visual"), (1, "3", "reveal_unit_mismatch"), (1, "3", "trigger_differs_from_render"), (1, "4", "reveal_unknown_visual"), (1, "5", "reveal_word_unmapped"),
        (1, "c", "reveal_visual_uncovered"), (2, "6", "evidence_range_reversed")]
