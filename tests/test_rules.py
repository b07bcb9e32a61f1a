"""Single rules on literal inputs with known results."""

import random

import pytest
from pyspark.sql import functions as F

from cuemill.functions import numbers, text, urls
from cuemill.operators import frames as fr
from cuemill.operators import layout, rhythm, videos, words


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column.alias("x")).first().x


def spoken(spark, items, unit=0):
    rows = [("m", i, f"w{i}", t, s, e, unit) for i, (t, s, e) in enumerate(items)]
    return spark.createDataFrame(rows, "media_id string, pos int, word_id string, text string, start_ms long, end_ms long, unit_id long")


def test_long_pause_is_cut(spark):
    chars = "第二个如果输入错误"
    starts = [0, 200, 400, 1300, 1500, 1700, 1900, 2100, 2300]
    w = spoken(spark, [(c, s, s + 200) for c, s in zip(chars, starts)])
    d = rhythm.rhythm(w)
    r = d.first()
    assert (r.diagnosis, r.speed_pct, r.n_pause_edits) == ("excessive-pause", 100, 1)
    assert r.projected_us < r.span_ms * 1000
    e = rhythm.pause_edits(w, d).first()
    assert (e.remove_start_us, e.remove_end_us) == (720_000, 1_180_000)


def test_slow_speech_is_sped_up_unless_protected(spark):
    chars = list("这是一个比较缓慢完整表达")
    slow = [(c, i * 600, i * 600 + 450) for i, c in enumerate(chars)]
    r = rhythm.rhythm(spoken(spark, slow)).first()
    assert r.action == "speed-local-speech" and 100 < r.speed_pct <= 115
    slow[3] = ("Claude", *slow[3][1:])
    r = rhythm.rhythm(spoken(spark, slow)).first()
    assert r.speed_pct == 100 and "mixed-language-or-number" in r.protected_reasons


def test_speech_region_times(spark):
    f = spark.createDataFrame([(1, i, p) for i, p in enumerate([0.02, 0.04, 0.92, 0.98, 0.20, 0.10])], "media_id int, frame long, p_speech double")
    m = spark.createDataFrame([(1, 176_667, 192_000)], "media_id int, offset_us long, duration_us long")
    r = fr.region_times(fr.speech_regions(f), m).first()
    assert (r.region_start_us, r.region_end_us) == (240_667, 304_667)


@pytest.mark.parametrize("context,start,pred,region,want", [
    ("opening", 456_000, None, (593_000, 4_900_000), 593_000), ("after-filler", 5_417_000, 5_297_000, (5_265_000, 6_000_000), None),
    ("after-filler", 24_917_000, 24_317_000, (25_105_000, 26_000_000), 25_105_000), ("after-filler", 100_000, None, (100_000, 200_000), None)])
def test_onset_windows(spark, context, start, pred, region, want):
    e = spark.createDataFrame([(1, 1, context, start, pred)], "media_id int, entry_id int, entry_context string, first_start_us long, predecessor_end_us long")
    r = spark.createDataFrame([(1, *region, 0.9)], "media_id int, region_start_us long, region_end_us long, peak double")
    assert fr.match_onset(e, r).first().onset_us == want


def test_zero_crossing(spark):
    v = [100] * 160
    v[79], v[80], v[81] = 20, -20, -40
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "media_id int, i long, v int")
    asked = spark.createDataFrame([(1, 0, 64, 96, 80), (1, 1, 10, 20, 15), (1, 2, 10, 20, 50)], "media_id int, query_id long, lo long, hi long, target long")
    assert {r.query_id: r.nearest for r in fr.nearest_zero_cross(asked, s).collect()} == {0: 80, 1: 15, 2: 20}


@pytest.mark.parametrize("token,whole,embedded", [
    ("嗯", True, False), ("啊啊", True, False), ("，嗯。", True, False), ("额呃", True, False), ("然后", False, False), ("那个", False, False), ("嗯对", False, True), ("呃我觉得", False, True), ("", False, False)])
def test_fillers(spark, token, whole, embedded):
    assert one(spark, F.struct(text.is_filler(F.lit(token)), text.has_embedded_filler(F.lit(token)))) == (whole, embedded)


def test_counts_and_ages(spark):
    for raw, n in {"1.2万": 12000, "3k": 3000, "1,234": 1234, "": 0, "赞": 0, "2.5": 3}.items():
        assert one(spark, numbers.parse_count(F.lit(raw))) == n
    day = F.lit("2024-03-01").cast("date")
    for raw, n in {"3天前": 3, "2周前": 14, "1月前": 30, "1年前": None, "刚刚": 0, "昨天": 1, "2024-02-28": 2, "2024/2/28": 2, "x": None}.items():
        assert one(spark, numbers.age_days(F.lit(raw), day)) == n


def test_short_counts_round_like_the_binary_quotient(spark):
    for n in [0, 9999, 10000, 10500, 11500, 12500, 13500, 14500, 99950, 123456, 1005000, *random.Random(3).sample(range(10_000, 2_000_000), 30)]:
        want = f"{n / 10000:.1f}".rstrip("0").rstrip(".") + "万" if n >= 10000 else str(n)
        assert one(spark, numbers.format_count(F.lit(n))) == want
    assert [one(spark, numbers.format_count(F.lit(n), "card")) for n in (999, 1234, 12000, 12345, 155000)] == ["999", "1,234", "1.2万", "1.2万", "16万"]


def test_text_columns(spark):
    assert one(spark, text.clip_text(F.lit("a b  c"), 3)) == "a b..."
    assert one(spark, text.strip_punct(F.lit("v5.6，好。1.2.3."))) == "v5.6好1.2.3"
    assert [one(spark, text.ends_sentence(F.lit(t))) for t in ("好。", "5.", "5.6", "end. ", "")] == [True, False, False, True, False]
    assert one(spark, text.join_tokens(F.array(*[F.lit(t) for t in ("用", "AI", "", "工具", "v2", "ok")]))) == "用 AI 工具 v2 ok"
    assert one(spark, text.split_sentences(F.lit("你好。 真的？！好"))) == ["你好。", "真的？", "！", "好"]
    assert one(spark, text.typeset(F.lit("约20页，用AI做１０GB"))) == "约 20 页，用 AI 做 10 GB"
    assert one(spark, urls.canonical_url(F.lit("HTTPS://V.Douyin.com/a/;p?x=1#f"), ["douyin.com"])) == "https://v.douyin.com/a"
    assert one(spark, layout.relation_rows("l", "n"), l="multi-item", n=5) == [3, 2]


def test_correction_rules(spark):
    w = spark.createDataFrame([("m", i, f"w{i}", t, "u1") for i, t in enumerate("镜头好看")], "media_id string, pos int, word_id string, text string, utterance_id string")
    base = ("asr_error", "audio-and-context", "high", True)
    rows = [("m", "a", ["w0", "w1"], "镜头", "Agent", ["Age", "nt"], *base), ("m", "b", ["w3"], "好", "号", None, *base), ("m", "c", ["w2"], "好", "耗", None, "asr_error", "audio-and-context", "low", True)]
    c = spark.createDataFrame(rows, "media_id string, correction_id string, word_ids array<string>, original string, corrected string, corrected_parts array<string>, kind string, evidence string, confidence string, approved boolean")
    got = {r.word_id: (r.text, r.span_index) for r in words.apply_corrections(w, c).collect()}
    assert got == {"w0": ("Age", 0), "w1": ("nt", 1), "w2": ("好", None), "w3": ("看", None)}
    assert {r.subject_id: r.rule for r in words.correction_findings(w, c).collect()} == {"b": "original_differs", "c": "not_high_confidence"}
    fixed = words.collapse_spans(words.apply_corrections(w, c))
    assert [r.token for r in fixed.orderBy("pos").collect()] == ["Agent", "", "好", "看"]


def test_comment_choice(spark):
    rows = [("v", 0, "好的", 0), ("v", 1, "不错不错", 1013), ("v", 2, "赞", 99)]
    c = spark.createDataFrame(rows, "media_id string, pos int, text string, likes long")
    assert [r.likes for r in videos.top_comments(c).orderBy("rank").collect()] == [1013, 0]


def test_run_reuse_prefers_evidence(spark):
    runs = spark.createDataFrame([("old", 1, 10, ["url:a"]), ("rich", 40, 20, ["url:a", "id:7"]), ("other", 63, 1, ["url:z"])], "run_id string, score long, mtime long, source_keys array<string>")
    req = spark.createDataFrame([("r1", ["id:7"]), ("r2", ["url:a"]), ("r3", ["url:q"])], "request_id string, source_keys array<string>")
    assert {r.request_id: r.run_id for r in videos.match_runs(req, runs).collect()} == {"r1": "rich", "r2": "rich"}


def test_time_map_in_a_removed_gap(spark):
    w = spoken(spark, [("一二三四五", 0, 1000), ("六七八九十", 2000, 3000)])
    d = rhythm.rhythm(w)
    total = spark.createDataFrame([("m", 3_500_000)], "media_id string, duration_us long")
    p = rhythm.build_pieces(d, rhythm.pause_edits(w, d), total)
    assert [(r.source_start_us, r.source_end_us, r.output_start_us) for r in p.orderBy("piece_no").collect()] == [
        (0, 1_120_000, 0), (1_880_000, 3_000_000, 1_120_000), (3_000_000, 3_500_000, 2_240_000)]
    pts = spark.createDataFrame([("m", 0, 500_000), ("m", 1, 1_500_000), ("m", 2, 2_000_000), ("m", 3, 9_000_000)], "media_id string, point_id long, at_us long")
    assert {r.point_id: r.mapped_us for r in rhythm.map_time(pts, p).collect()} == {0: 500_000, 1: 1_120_000, 2: 1_240_000, 3: 2_740_000}


def test_forbidden_keys_at_any_depth(spark):
    import json

    from cuemill.operators import articles

    deep = {"color": 1}
    for i in range(12):
        deep = {f"l{i}": [0, deep]}
    rows = [(1, json.dumps(deep)), (2, '{"color": {"color": 2}}'), (3, "no json"), (4, None), (5, '[{"a": [{"color": 0}]}]')]
    got = {(r.id, r.path) for r in articles.forbidden_keys(spark.createDataFrame(rows, "id int, j string"), "j", ("color",)).collect()}
    path = "".join(f".l{i}[1]" for i in range(11, -1, -1))[1:] + ".color"
    assert got == {(1, path), (2, "color"), (2, "color.color"), (5, "[0].a[0].color")}


def test_first_sentence_is_found_without_trying_every_place(spark):
    import random
    import time

    from cuemill.functions import rules, text

    def plain(c):
        t = text.clean_text(c)
        hit = F.regexp_extract(t, f"(.{{1,80}}?{text.char_class(rules.SENTENCE_ENDS)})", 1)
        return F.when(t == "", F.lit(rules.MISSING_TEXT)).when(hit != "", F.trim(hit)).otherwise(F.substring(t, 1, 80))

    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["?", "。", " ", "\n", "\u0085", "\U0001f600", "a"]) if rnd.random() < share else "b" for _ in range(n)) for n in (0, 1, 2, 5, 90, 300) for share in (0.01, 0.1, 0.6) for _ in range(40)]
    d = spark.createDataFrame([(x,) for x in [*texts, None]], "t string")
    assert d.filter(~plain("t").eqNullSafe(text.first_sentence("t"))).count() == 0
    long = spark.createDataFrame([("word " * 400_000,)], "t string")
    spent = []
    for f in (plain, text.first_sentence):
        long.select(f("t")).collect()
        began = time.time()
        long.select(f("t")).collect()
        spent.append(time.time() - began)
    assert spent[1] * 2 < spent[0]
