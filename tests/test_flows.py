"""A small speech edit from raw words to cues."""

from pyspark.sql import functions as F

from cuemill.plans import flows


def test_speech_edit(spark):
    said = "嗯今天我们来讲一个很重要的方法大家一定要记住它"
    rows = [("m", i, f"word-{i + 1:06d}", c, i * 300 + (2000 if i >= 12 else 0), i * 300 + 200 + (2000 if i >= 12 else 0), i // 12, "utt-0001") for i, c in enumerate(said)]
    w = spark.createDataFrame(rows, "media_id string, pos int, word_id string, text string, start_ms long, end_ms long, unit_id long, utterance_id string")
    corr = spark.createDataFrame([("m", "c1", ["word-000012"], said[11], "紧", None, "asr_error", "audio-and-context", "high", True)],
                                 "media_id string, correction_id string, word_ids array<string>, original string, corrected string, corrected_parts array<string>, kind string, evidence string, confidence string, approved boolean")
    dele = spark.createDataFrame([("m", 1, "word-000001", "word-000001")], "media_id string, range_id int, start_word_id string, end_word_id string")
    media = spark.createDataFrame([("m", 12_000)], "media_id string, duration_ms long")
    e = flows.speech_edit(w, corr, dele, media)
    assert [(r.first_word_id, r.n_words) for r in e.segments.collect()] == [("word-000002", len(said) - 1)]
    cues = e.cues.orderBy("cue_no").collect()
    assert "".join(c.text for c in cues) == said[1:11] + "紧" + said[12:]
    assert all(a.end_ms <= b.start_ms for a, b in zip(cues, cues[1:]))
    assert e.mapped.agg(F.min("mapped_start_ms")).first()[0] == 0
    assert {r.rule for r in e.findings.filter("severity = 'error'").collect()} <= {"forbidden_start", "forbidden_end"}
    assert flows.speech_edit_verdict(e, media).count() == 1
