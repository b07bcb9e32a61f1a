"""Readers, writers and streams on small files."""

import json

from pyspark.sql import functions as F

from cuemill.operators import findings, words
from cuemill.operators.frames import speech_regions
from cuemill.sources import readers, writers
from cuemill.streaming import streams


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False), encoding="utf-8")


def test_asr_paths_words_and_ids(spark, tmp_path):
    u = [{"text": "你好", "start_time": 100, "end_time": 500, "words": [{"text": "你", "start_time": 100, "end_time": 300}, {"text": " ", "start_time": 0, "end_time": 0}, {"text": "好", "start_time": 300, "end_time": 300}]}]
    for name, doc in {"a": {"utterances": u}, "b": {"result": {"utterances": u}}, "c": {"raw": {"result": {"utterances": u}}}, "d": {"text": "none"}}.items():
        put(tmp_path / f"{name}.json", doc)
    w = words.assign_word_ids(words.explode_words(readers.read_asr(spark, str(tmp_path))))
    got = sorted((r.media_id, r.word_id, r.utterance_id, r.text, r.start_ms, r.timing_ok) for r in w.collect())
    assert got == [(m, f"word-00000{i + 1}", "utt-0001", t, s, ok) for m in "abc" for i, (t, s, ok) in enumerate([("你", 100, True), ("好", 300, False)])]
    found = words.timing_findings(w)
    v = {r.media_id: (r.errors, r.ok) for r in findings.verdict(found, w).collect()}
    assert v == {m: (1, False) for m in "abc"}
    writers.write_report(found, str(tmp_path / "report"), readers.fingerprint(spark, str(tmp_path), "*.json"))
    assert spark.read.json(str(tmp_path / "report" / "findings")).count() == 3
    assert spark.read.parquet(str(tmp_path / "report" / "inputs")).count() == 4


def test_whisper_and_videos(spark, tmp_path):
    put(tmp_path / "w" / "x.json", {"segments": [{"text": " hi ", "start": 0.5, "end": 1.25, "words": [{"word": " hi", "start": 0.5, "end": 1.0}]}, {"text": " ", "start": 2, "end": 3}]})
    r = readers.read_whisper(spark, str(tmp_path / "w")).collect()
    assert [(x.media_id, x.text, x.start_time, x.words[0].text, x.words[0].end_time) for x in r] == [("x", "hi", 500.0, "hi", 1000.0)]
    put(tmp_path / "v" / "p.json", {"url": "u", "title": "t", "metrics": {"likes": 56000}, "comments": [{"text": "好的", "likes": 0}, {"text": "a", "likes": 99}]})
    put(tmp_path / "v" / "q.json", {"input": "/in/clip one.mp4"})
    v = {x.media_id: x for x in readers.read_videos(spark, str(tmp_path / "v")).collect()}
    assert (v["p"].metrics.likes, v["p"].metrics.shares, v["q"].title, v["q"].metrics.likes, v["q"].url) == (56000, 0, "clip one", 0, "")
    c = readers.comment_rows(readers.read_videos(spark, str(tmp_path / "v"))).collect()
    assert sorted((x.media_id, x.pos, x.likes) for x in c if x.pos is not None) == [("p", 0, 0), ("p", 1, 99)] and len(c) == 3


def test_torn_event_line_is_left_out(spark, tmp_path):
    put(tmp_path / "log.jsonl", '{"run_id":"r","at":"2024-01-01T00:00:00Z","stage":"cut","status":"running"}\n{"run_id":"r","at":"2024-01-01T00:01:00Z","stage":"cut","status":"succeeded","exit_code":0}\n{"run_id":"r","at":"2024')
    e = readers.read_events(spark, str(tmp_path))
    assert e.count() == 2
    r = streams.latest_stage(e).first()
    assert (r.status, r.exit_code, r.n_events, (r.finished_at - r.started_at).seconds) == ("succeeded", 0, 2, 60)


def test_stage_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    for i in range(3):
        rows = [{"run_id": f"r{k}", "at": f"2024-01-01T00:0{i}:{k:02d}Z", "stage": "cut", "status": ["running", "failed", "succeeded"][i], "exit_code": i} for k in range(5)]
        put(src / f"{i}.jsonl", "\n".join(map(json.dumps, rows)))
    q = streams.latest_stage(readers.stream_events(spark, str(src))).writeStream.format("memory").queryName("latest").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("latest").collect()))
    assert got == sorted(map(tuple, streams.latest_stage(readers.read_events(spark, str(src))).collect())) and got[0][2] == "succeeded"


def test_region_stream_equals_batch_when_frames_come_out_of_order(spark, tmp_path):
    vs = [0.1, 0.6, 0.7, 0.3, 0.6, 0.2, 0.1, 0.9, 0.4, 0.3, 0.2, 0.8]
    f = spark.createDataFrame([(1, i, v) for i, v in enumerate(vs)], "media_id long, frame long, p_speech double")
    for part in ("frame % 3 = 2", "frame % 3 = 0", "frame % 3 = 1"):
        f.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    live = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f"))
    got = sorted(map(tuple, streams.drain(streams.speech_regions_stream(live)).collect()))
    want = sorted((r.media_id, r.start_frame, r.end_frame, r.peak) for r in speech_regions(f).filter("closed").collect())
    assert got == want and len(want) == 2


def test_region_stream_starts_anywhere_and_passes_a_gap(spark, tmp_path):
    vs = [0.1, 0.6, 0.7, 0.3, 0.6, 0.2, 0.1, 0.9, 0.8, 0.9, 0.3, 0.2, 0.1, 0.8]
    rows = [(1, i + 7, v) for i, v in enumerate(vs)] + [(2, i, v) for i, v in enumerate(vs) if i != 8]
    f = spark.createDataFrame(rows, "media_id long, frame long, p_speech double")
    f.coalesce(1).write.parquet(str(tmp_path / "f"))
    live = spark.readStream.schema(f.schema).parquet(str(tmp_path / "f"))
    got = sorted(map(tuple, streams.drain(streams.speech_regions_stream(live, first=None, hold=0)).collect()))
    want = sorted((r.media_id, r.start_frame, r.end_frame, r.peak) for r in speech_regions(f).filter("closed").collect())
    assert got == want and {r[0] for r in want} == {1, 2}


def test_text_files_round_trip(spark, tmp_path):
    cues = spark.createDataFrame([(1, i, i * 1000, i * 1000 + 500, t) for i, t in enumerate(["a {b}", "c\nd", "e"])], "media_id long, cue_no long, start_ms long, end_ms long, text string")
    writers.write_ass_events(cues, str(tmp_path / "ass"))
    lines = spark.read.text(str(tmp_path / "ass"), wholetext=True).withColumnRenamed("value", "text").withColumn("media_id", F.lit(1))
    assert sorted((r.start_ms, r.end_ms, r.text) for r in readers.ass_rows(lines).collect()) == [(0, 500, "a {b}"), (1000, 1500, "c d"), (2000, 2500, "e")]
    writers.write_stamped_text(cues.withColumnRenamed("cue_no", "pos"), str(tmp_path / "st"))
    s = readers.read_stamped_text(spark, str(tmp_path / "st" / "media_id=1"))
    assert sorted((r.start, r.end, r.text) for r in s.collect()) == [(0.0, 0.5, "a {b}"), (1.0, 1.5, "c d"), (2.0, 2.5, "e")]
    put(tmp_path / "md" / "n.md", "---\ntitle: 'T'\n---\n# H\n\nBody text.")
    m = readers.read_markdown(spark, str(tmp_path / "md")).first()
    assert (m.doc_id, m.title, m.summary, m.frontmatter) == ("n", "T", "Body text.", {"title": "T"})
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.bin").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 20)
    r = readers.sniff_images(spark.read.format("binaryFile").load(str(tmp_path / "img"))).first()
    assert (r.image_type, r.needs_conversion) == ("image/png", False)


def test_files_beyond_the_limit_of_whole_reads_are_fingerprinted(spark, tmp_path, monkeypatch):
    """``binaryFile`` refuses files above a limit (2 GB by default); line ends, a byte order mark and suffixes change no digest."""
    import gzip
    import hashlib
    import os
    import random

    noise = random.Random(3).randbytes
    files = {
        "plain.bin": noise(60_000), "feed at end.bin": noise(30_000) + b"\n", "mark%20.bin": b"\xef\xbb\xbf" + noise(30_000) + b"x", "mark and feed.bin": b"\xef\xbb\xbf" + noise(30_000) + b"\n",
        "returns.bin": b"\r\n" * 9_000 + b"\r", "feeds.bin": b"\n" * 12_000, "no feed.bin": b"\0" * 500_000, "utf16.bin": "é漢\xff".encode("utf-16") * 2_000, "tiny.bin": b"x",
    }
    packed = {"packed.bin.gz": gzip.compress(noise(4_000))}
    for name, content in (files | packed).items():
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(readers, "WHOLE_FILE_BYTES", 3_000, raising=False)
    splits = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "5000")
    try:
        for glob, want in (("*.bin", files), (None, files | packed)):
            got = {os.path.basename(r.path): (r.size_bytes, r.sha256) for r in readers.fingerprint(spark, str(tmp_path), glob).collect()}
            assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in want.items()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == splits
