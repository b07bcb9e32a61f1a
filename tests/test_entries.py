"""How segments begin: fillers before the first word, listed or not; judgments of a breakdown on literals."""

from cuemill.operators import segments, videos


def test_only_words_outside_the_segment_were_discarded(spark):
    said = [("嗯", 0, 100), ("好", 100, 300), ("嗯", 300, 400), ("呃", 400, 500), ("走", 505, 700), ("嗯", 2000, 2100), ("来", 3100, 3300)]
    w = spark.createDataFrame([("m", i, f"w{i}", t, a, b) for i, (t, a, b) in enumerate(said)], "media_id string, pos int, word_id string, text string, start_ms long, end_ms long")
    s = spark.createDataFrame([("m", 1, "a", 1, 1), ("m", 2, "b", 2, 4), ("m", 3, "c", 4, 4), ("m", 4, "d", 6, 6)], "media_id string, seg_no int, segment_id string, first_pos int, last_pos int")
    pick = lambda df: [(r.seg_no, r.first_meaningful_word_id, r.leading_fillers, r.discarded_filler_word_id, r.entry_context, r.continuous) for r in df.orderBy("seg_no").collect()]
    assert pick(segments.entry_context(s, w, "[嗯呃]")) == [
        (1, "w1", 0, "w0", "opening", True), (2, "w4", 2, None, "normal", False), (3, "w4", 0, "w3", "after-filler", True), (4, "w6", 0, None, "normal", False)]
    # Words in the middle count as well as the outer two; what is not listed was discarded.
    listed = spark.createDataFrame([("m", 2, "w2"), ("m", 2, "w4"), ("m", 3, "w3"), ("m", 3, "w3"), ("x", 1, "w0")], "media_id string, seg_no int, word_id string")
    assert pick(segments.entry_context(s, w, "[嗯呃]", listed)) == [
        (1, "w1", 0, "w0", "opening", True), (2, "w4", 2, "w3", "after-filler", True), (3, "w4", 0, None, "normal", False), (4, "w6", 0, None, "normal", False)]


def test_judgments(spark):
    rows = [
        (1, "怎么赚到第一个100万，三条对标", "第一个100万", "痛点", 0, 0, 1), (2, "心理问题和对标", "素材不足", None, 0, 0, 0), (3, "", "一句话", "", 5, 0, None), (4, None, None, None, None, None, None),
        (5, "讲一百万", "一" * 30, "二" * 25, 0, 0, 0)]
    d = spark.createDataFrame(rows, "id int, text string, hook string, pain string, likes long, n_comments int, n_frames long")
    got = {r.id: (r.one_line_judgment[:6], r.hook_retention[:4], r.migration_formula[:6], r.visual_rhythm) for r in videos.judgments(d).collect()}
    assert got == {
        1: ("先用“第一个", "结果问题", "结果问题 +", "已抽帧，可进一步读图判断"), 2: ("用“素材不足", "素材不足", "素材不足", "画面素材不足"),
        3: ("公开视频有互", "开头能快", "不是泛讲主题", "画面素材不足"), 4: ("素材不足，当", "开头能快", "不是泛讲主题", "画面素材不足"), 5: ("用“一一一一", "开头能快", "不是泛讲主题", "画面素材不足")}
    long = videos.judgments(d.where("id = 5")).first()
    assert long.one_line_judgment == "用“" + "一" * 28 + "...”先制造停留，再围绕" + "二" * 24 + "...推进。"
    assert long.migration_formula == "不是泛讲主题，先抛出“" + "一" * 24 + "...”，再给具体场景和方法。"
