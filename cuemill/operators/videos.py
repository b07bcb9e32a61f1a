"""Short-video metadata, search and detail pages, comments and the breakdown of a transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions import numbers, rules, text, urls
from cuemill.operators import joins, scans
from cuemill.operators.words import joined_text

# --- lines and comments -------------------------------------------------------------------------


def clean_lines(df: DataFrame, column: str = "text") -> DataFrame:
    """Explode a text column into its clean lines, marking page furniture as noise."""
    rest = [c for c in df.columns if c != column]
    lines = df.select(*rest, F.posexplode(text.body_lines(column)).alias("line_no", "line"))
    return lines.withColumn("noise", text.is_noise_line("line"))


def attach_previous(lines: DataFrame, keys, pos: str, mark: Column, text_value: Column, author_value: Column,
                    count_value: Column) -> DataFrame:
    """For each marked line: the nearest earlier text and author and the nearest later count.
    The value columns are null on lines that carry no such value."""
    out = scans.scan(
        lines.withColumn("__mark", mark), keys, pos,
        text=scans.last_before(text_value), author=scans.last_before(author_value), count_text=scans.next_after(count_value))
    return out.filter("__mark").drop("__mark")


def parse_comments(pages: DataFrame, page_id: str = "page_id", column: str = "text") -> DataFrame:
    """Comments of detail pages: date lines after the comment heading with their text, author and likes."""
    heading = F.instr(column, "全部评论")
    below = pages.filter(heading > 0).select(page_id, F.expr(f"substring({column}, instr({column}, '全部评论'))").alias("__t"))
    lines = below.select(page_id, F.posexplode(text.body_lines("__t")).alias("line_no", "line"))
    line = F.col("line")
    author = F.regexp_extract(line, rules.USER_LINK_LINE, 1)
    is_link = line.rlike(r"^\[.+\]\(//www\.douyin\.com/user/")
    bare = text.strip_md(line)
    named = F.regexp_extract(bare, "^[^:：]{1,32}[:：](.+)$", 1)
    wanted = ~text.is_noise_line(line) & ~line.rlike(rules.COUNT_LINE) & ~is_link
    found = attach_previous(
        lines, page_id, "line_no",
        mark=line.rlike(f"^(?:{rules.AGE_WORDS})(·.+)?$"),
        text_value=F.when(wanted, F.trim(F.when(named != "", named).otherwise(bare))),
        author_value=F.when(author != "", author),
        count_value=F.when(line.rlike(rules.COUNT_LINE), line))
    kept = found.filter((F.length("text") >= 2) & ~F.col("text").rlike("^0+$"))
    return kept.select(page_id, F.col("line_no").alias("pos"), F.coalesce("author", F.lit("")).alias("author"), "text",
                       F.col("line").alias("time"), numbers.parse_count("count_text").alias("likes"))


def liked_or_fallback(comments: DataFrame, key: str = "media_id", pos: str = "pos", k: int = 80, min_likes: int = 1,
                      interaction: Column | None = None, fallback: bool = True) -> DataFrame:
    """First ``k`` liked comments of each item; where there are none, the first ``k`` that invite an answer."""
    liked = scans.top_k(comments.filter(F.col("likes") >= min_likes), key, [pos], k).withColumn("signal", F.lit("有赞"))
    if not fallback:
        return liked
    asks = interaction if interaction is not None else text.is_interaction("text")
    rest = scans.top_k(comments.filter((F.col("likes") < min_likes) & asks), key, [pos], k).withColumn("signal", F.lit("互动"))
    return liked.unionByName(rest.join(liked.select(key).distinct(), key, "left_anti").select(*liked.columns))


def top_comments(comments: DataFrame, key: str = "media_id", pos: str = "pos", k: int = 20) -> DataFrame:
    """Best-liked comments of two or more characters; equal likes keep their order."""
    good = comments.filter(F.length(text.clean_ends("text")) >= 2).withColumn("likes", F.coalesce("likes", F.lit(0)))
    return scans.top_k(good, key, [F.col("likes").desc(), F.col(pos)], k)


def comment_summary(comments: DataFrame, key: str = "media_id", pos: str = "pos", question: Column | None = None) -> DataFrame:
    """First 5 liked, first 5 questions, first 8 of all, and what the comments say about demand.
    Each list is cut to its few rows before anything is gathered."""
    asks = question if question is not None else text.is_question("text")
    liked = scans.top_k(comments.filter(F.col("likes") > 0), key, [pos], 5).withColumn("kind", F.lit("liked"))
    questions = scans.top_k(comments.filter(asks), key, [pos], 5).withColumn("kind", F.lit("questions"))
    first = scans.top_k(comments, key, [pos], 8).withColumn("kind", F.lit("all"))
    rows = liked.unionByName(questions).unionByName(first)

    def listed(kind):
        picked = F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "text")))
        return F.transform(F.array_sort(picked), lambda x: x["text"])

    out = rows.groupBy(key).agg(listed("liked").alias("liked"), listed("questions").alias("questions"), listed("all").alias("first"))
    return out.withColumn("demand", F.when(F.size("questions") > 0, "questions").when(F.size("liked") > 0, "liked").otherwise("none"))


def comment_signals(comments: DataFrame, signal_rules, key: str = "media_id", pos: str = "pos") -> DataFrame:
    """Comments per rule class with the best-liked sample of each (equal likes: the earlier one)."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(label)) for label, p in signal_rules]))
    rows = comments.withColumn("signal", F.explode(hits))
    return rows.groupBy(key, "signal").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("text", F.struct(-F.col("likes"), F.col(pos))).alias("sample"),
        F.max("likes").alias("top_likes"))


# --- search and detail pages ---------------------------------------------------------------------

SEARCH_LINK = r"\]\((?:https:)?//www\.douyin\.com/video/(\d+)\)"
BLOCK_START = "-   ["


def parse_search(pages: DataFrame, page_id: str = "page_id", column: str = "text", link: str = SEARCH_LINK,
                 url_prefix: str = "https://www.douyin.com/video/") -> DataFrame:
    """Search-result text to one row per video link, read from the list block the link closes."""
    blocks = F.split(F.col(column), r"-   \[")
    b = pages.select(page_id, F.posexplode(blocks).alias("block_no", "block"))
    b = b.withColumn("block", F.when(F.col("block_no") > 0, F.concat(F.lit(BLOCK_START), "block")).otherwise(F.col("block")))
    b = b.filter(F.col("block").rlike(link)).select(
        page_id, "block_no", F.split("block", link).alias("gaps"),
        F.regexp_extract_all("block", F.lit(link), F.lit(0)).alias("links"),
        F.regexp_extract_all("block", F.lit(link), F.lit(1)).alias("ids"))
    b = b.select("*", F.posexplode("ids").alias("link_no", "id"))
    before = F.concat(
        F.array_join(F.zip_with(F.slice("gaps", F.lit(1), F.col("link_no")), F.slice("links", F.lit(1), F.col("link_no")),
                                lambda g, x: F.concat(g, x)), ""),
        F.get("gaps", F.col("link_no")))
    b = b.withColumn("lines", text.body_lines(before))
    author_line = f"^@.+?(?:{rules.AGE_WORDS})$"
    at = F.array_max(F.transform("lines", lambda x, i: F.when(x.rlike(author_line), i)))
    b = b.withColumn("at", F.coalesce(at, F.lit(-1)))
    found = F.when(F.col("at") >= 0, F.get("lines", F.col("at"))).otherwise("")
    age = F.regexp_extract(found, f"({rules.AGE_WORDS})$", 1)
    likely = F.filter("lines", lambda x: (F.length(x) > 6) & ~x.startswith("@") & ~x.rlike("^[0-9]") & ~F.contains(x, F.lit("http")))
    title = F.when(F.col("at") > 0, F.get("lines", F.col("at") - 1)).otherwise(F.element_at(F.concat(F.array(F.lit("")), likely), -1))
    metric = F.when(F.col("at") > 1, F.regexp_replace(F.get("lines", F.col("at") - 2), r"[^0-9]", ""))
    out = b.select(
        page_id, F.struct("block_no", "link_no").alias("at_link"), "id", F.concat(F.lit(url_prefix), "id").alias("url"),
        text.strip_md(title).alias("title"),
        F.trim(F.regexp_replace(F.regexp_replace(found, f"(?:{rules.AGE_WORDS})$", ""), "^@", "")).alias("author"),
        age.alias("relative_time"), F.coalesce(metric.try_cast("long"), F.lit(0).cast("long")).alias("search_metric"))
    return out.filter("title <> ''")


PUBLISHED = r"发布时间：([0-9]{4}-[0-9]{2}-[0-9]{2}\s+[0-9]{2}:[0-9]{2})"


def parse_detail(pages: DataFrame, page_id: str = "page_id", column: str = "text") -> DataFrame:
    """Detail-page text to title, author, publish time and the last four counts above the publish line."""
    t = F.col(column)
    has = t.rlike(PUBLISHED)
    mark = F.regexp_extract(t, PUBLISHED, 0)
    at = F.position(mark, t)
    before = F.when(has, F.substring(t, F.greatest(F.lit(1), at - 900), F.least(F.lit(900), at - 1))).otherwise(F.substring(t, 1, 1800))
    counts = F.filter(text.body_lines(before), lambda x: x.rlike(rules.COUNT_LINE))
    last4 = F.slice(counts, F.greatest(F.lit(1), F.size(counts) - 3), F.lit(4))
    first = lambda *cs: F.coalesce(*[F.when(c != "", c) for c in cs], F.lit(""))
    title = first(
        text.strip_md(F.regexp_extract(t, r"(?s)#\s+(.+?)\n\n(?:\d+(?:\.\d+)?万?\n\n){1,4}举报\n\n发布时间：", 1)),
        text.strip_md(F.regexp_extract(t, r"#\s+([^\n]{4,120})", 1)))
    author = first(
        text.strip_md(F.regexp_extract(t, r"\n\n([^\n]{1,60})\n\n\]\(//www\.douyin\.com/user/", 1)),
        text.strip_md(F.regexp_extract(t, r"@([^\n]{2,40})", 1)))
    value = lambda i: F.coalesce(numbers.parse_count(F.get(last4, F.lit(i))), F.lit(0).cast("long"))
    return pages.select(
        page_id, title.alias("title"), author.alias("author"), F.regexp_extract(t, PUBLISHED, 1).alias("published_at"),
        value(0).alias("likes"), value(1).alias("comments"), value(2).alias("collects"), value(3).alias("shares"),
        F.size(counts).alias("metric_lines"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Check captured pages: input_url, current_url, title, published_at, has_publish_time, metric_lines, has_end_marker."""
    vid = lambda c: F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"/video/(\d+)", 1)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checks = [
        (vid("current_url") == "", "not_a_detail_page"),
        ((vid("input_url") != "") & (vid("current_url") != "") & (vid("input_url") != vid("current_url")), "id_differs"),
        (blank("title"), "title_missing"),
        (blank("published_at") | ~F.col("has_publish_time"), "publish_time_missing"),
        ((F.col("metric_lines") < 4) | ~F.col("has_end_marker"), "metrics_not_stable"),
    ]
    errors = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in checks]))
    return pages.withColumn("video_id", vid("current_url")).withColumn("errors", errors).withColumn("ok", F.size("errors") == 0)


def author_matches(author, names) -> Column:
    """The author's name holds one of the account's names or keywords, whitespace and case aside."""
    return F.exists(F.col(names) if isinstance(names, str) else names, lambda n: (n != "") & text.contains_loose(author, n))


def match_account(items: DataFrame, accounts: DataFrame, key: str = "account_id") -> DataFrame:
    """Items whose author matches the account they were searched for: equi join on the account, then the name test."""
    return items.join(accounts, key).filter(author_matches("author", "names"))


# --- ranking and reuse -----------------------------------------------------------------------------


def rank_search(items: DataFrame, key: str = "query_id", pos: str = "pos", n: int = 10, match: Column | None = None) -> DataFrame:
    """Search results with an address and a matching author, best liked first, at most ``n`` per query."""
    good = items.filter((F.coalesce("url", F.lit("")) != "") & (match if match is not None else F.lit(True)))
    return scans.top_k(good, key, [F.col("likes").desc(), F.col(pos)], n)


def select_result(items: DataFrame, key: str = "query_id", pos: str = "pos", match: Column | None = None) -> DataFrame:
    """The result to open per query: best liked of the matching ones, else the first with an address."""
    usable = items.filter(F.coalesce("url", F.lit("")) != "")
    matched = F.when(match if match is not None else F.lit(True), 0).otherwise(1)
    by = F.struct(matched, F.when(matched == 0, -F.col("likes")).otherwise(F.lit(0)), F.col(pos))
    row = F.struct(*[c for c in items.columns if c != key])
    return usable.groupBy(key).agg(F.min_by(row, by).alias("r")).select(key, "r.*")


def recent_candidates(items: DataFrame, key: str, pos: str, n: int, lookback_days: int, match: Column | None = None,
                      include_unknown: bool = False) -> DataFrame:
    """First ``n`` candidates in arrival order that match and are young enough (``age_days``; null is unknown)."""
    age = F.col("age_days")
    young = F.coalesce(age <= lookback_days, F.lit(include_unknown))
    return scans.top_k(items.filter((match if match is not None else F.lit(True)) & young), key, [pos], n)


def evidence_score(files: DataFrame, weights=tuple(rules.EVIDENCE_WEIGHTS), run: str = "run_id") -> DataFrame:
    """Sum of the weights of the artefacts each run has, non-empty, each counted once."""
    present = [
        F.max(F.when((F.col("path") == path) & (F.col("size") > 0), F.lit(w)).otherwise(F.lit(0))) for path, w in weights
    ]
    total = present[0]
    for p in present[1:]:
        total = total + p
    return files.groupBy(run).agg(total.cast("long").alias("score"))


def source_keys(df: DataFrame, urls_cols, id_cols=(), drop_query_hosts=("douyin.com",), least: int = 15, most: int = 22) -> DataFrame:
    """Add ``source_keys``: canonical addresses and media ids, without blanks and repeats."""
    canon = [urls.canonical_url(c, drop_query_hosts) for c in urls_cols]
    ids = [urls.extract_media_id(c, least, most) for c in canon] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_cols]
    keys = [F.concat(F.lit("url:"), c) for c in canon] + [F.concat(F.lit("id:"), c) for c in ids]
    return df.withColumn("source_keys", F.array_distinct(F.filter(F.array(*keys), lambda x: ~x.isin("url:", "id:"))))


def best_run(runs: DataFrame, key: str) -> DataFrame:
    """Richest run per key; equal scores go to the oldest, then to the smaller run id."""
    order = F.struct(-F.col("score"), F.col("mtime"), F.col("run_id"))
    return runs.groupBy(key).agg(
        F.min_by(F.struct("run_id", "score", "mtime"), order).alias("r"), F.count(F.lit(1)).alias("n_runs")).select(key, "r.*", "n_runs")


def match_runs(requests: DataFrame, runs: DataFrame, request_id: str = "request_id") -> DataFrame:
    """The run to reuse per request: any shared canonical address or media id, then the best run.
    Runs are cut to the best one per key first, so a source with very many runs adds one row, not a product."""
    per_key = best_run(runs.select("run_id", "score", "mtime", F.explode("source_keys").alias("source_key")), "source_key").drop("n_runs")
    asked = requests.select(request_id, F.explode("source_keys").alias("source_key"))
    return best_run(asked.join(per_key, "source_key"), request_id).drop("n_runs")


def completeness(runs: DataFrame) -> DataFrame:
    """Failed stages of a run from what it has, in stage order, and the two verdicts."""
    checks = [
        (F.col("is_url") & ~(F.col("has_metadata") & F.col("has_screenshot")), "collect"),
        (~F.col("has_video"), "prepare_video"),
        (F.col("has_video") & ~F.col("has_transcript"), "transcribe"),
        (F.col("has_video") & ~F.col("has_frames"), "extract_frames"),
    ]
    out = runs.withColumn("failed_stages", F.array_compact(F.array(*[F.when(c, F.lit(s)) for c, s in checks])))
    out = out.withColumn("evidence_complete", F.size("failed_stages") == 0)
    return out.withColumn("ok", F.col("draft_ok") & F.col("evidence_complete"))


def union_candidates(*sources: tuple[str, DataFrame], key: str = "url", pos: str = "pos") -> DataFrame:
    """Candidates of several searches, each with its origin; a repeated key keeps its first appearance."""
    stacked = None
    for i, (origin, df) in enumerate(sources):
        part = df.withColumn("origin", F.lit(origin)).withColumn("origin_no", F.lit(i))
        stacked = part if stacked is None else stacked.unionByName(part)
    return scans.keep_first(stacked, key, ["origin_no", pos])


def select_tracks(media, audio, video) -> Column:
    """First video-only and first audio address from three overlapping lists; an audio name counts as audio anywhere."""
    c = lambda x: F.filter(F.coalesce(F.col(x), F.array().cast("array<string>")), lambda u: urls.is_url(u))
    is_audio = lambda u: F.contains(F.lower(u), F.lit("media-audio"))
    audios = F.concat(c(audio), F.filter(c(media), is_audio))
    videos = F.filter(F.concat(c(video), c(media)), lambda u: ~is_audio(u))
    pick = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(""))
    return F.struct(pick(videos).alias("video_url"), pick(audios).alias("audio_url"))


# --- breakdown ---------------------------------------------------------------------------------------


def content_skeleton(df: DataFrame) -> DataFrame:
    """Add ``skeleton`` to rows of text, title and n_comments: audience, scene, pain, contrast, method, proof, action."""
    t = F.coalesce(F.col("text"), F.lit(""))
    # Staged so that each costly pattern is evaluated once per row.
    d = df.withColumn("__title", text.clean_text("title")).withColumn("__first", text.first_sentence(t))
    d = d.withColumn("__head", F.concat("__title", F.lit(" "), "__first"))
    title, head = F.col("__title"), F.col("__head")
    has = lambda word: F.contains(t, F.lit(word))
    money = has("对标") & t.rlike("100万|一百万|赚钱|挣钱")
    standard = has("心理问题") & has("对标")
    contrast = F.when(standard, F.lit(rules.CONTRAST_SPECIAL))
    for p in rules.CONTRAST_PATTERNS:
        contrast = contrast.when(t.rlike(p), F.regexp_extract(t, p, 0))
    method = F.when(has("对标") & has("五个标准"), F.lit(rules.METHOD_SPECIAL))
    for word in rules.METHOD_KEYWORDS:
        method = method.when(has(word), text.clip_text(F.substring(t, F.instr(t, word), F.lit(120)), 90))
    return d.withColumn(
        "skeleton",
        F.struct(
            text.first_label(head, rules.AUDIENCE_RULES, rules.AUDIENCE_DEFAULT).alias("audience"),
            text.first_label(head, rules.SCENE_RULES, rules.MISSING_TEXT).alias("scene"),
            F.when(money, F.lit(rules.PAIN_MONEY)).when(standard, F.lit(rules.PAIN_STANDARD))
            .when(t == "", text.first_sentence(title)).otherwise(F.col("__first")).alias("pain"),
            contrast.otherwise(F.lit(rules.CONTRAST_DEFAULT)).alias("contrast"),
            method.otherwise(F.lit(rules.METHOD_DEFAULT)).alias("method"),
            F.when(F.col("n_comments") > 0, F.lit(rules.PROOF_COMMENTS))
            .when(t.rlike(r"(?i)\d|万|元|offer|案例|客户"), F.lit(rules.PROOF_NUMBERS)).otherwise(F.lit(rules.PROOF_DEFAULT)).alias("proof"),
            F.when(has("收藏"), F.lit(rules.ACTION_SAVE)).when(t.rlike("关注|评论|私信|收藏|转发|主页|链接"), F.lit(rules.ACTION_CTA))
            .otherwise(F.lit(rules.ACTION_DEFAULT)).alias("action"),
        ),
    ).drop("__title", "__first", "__head")


def joined_prefix(rows: DataFrame, keys, pos: str, column: str, limit: int) -> DataFrame:
    """Per key the texts in order, joined without gaps and clipped to ``limit``. Only rows that begin inside the
    first ``limit`` characters are gathered, so the group's size does not matter."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    t = rows.select(*keys, pos, text.clean_text(column).alias("__t")).filter("__t <> ''")
    t = scans.scan(t, keys, pos, __before=scans.sum_before(F.length("__t"))).filter(F.col("__before") <= limit)
    listed = F.array_sort(F.collect_list(F.struct(pos, "__t")))
    joined = F.array_join(F.transform(listed, lambda x: x["__t"]), "")
    return t.groupBy(*keys).agg(text.clip_text(joined, limit).alias("speech"))


def structure_timeline(utts: DataFrame, key: str = "media_id", pos: str = "pos") -> DataFrame:
    """Equal time bins per item with their speech and function. ``utts``: key, pos, text, start_ms, end_ms.
    4 to 8 rows by number of utterances; an utterance belongs to the bin holding its midpoint; empty bins drop out."""
    u = utts.filter(text.clean_text("text") != "")
    known = F.when(F.col("end_ms") != 0, F.col("end_ms")).otherwise(F.when(F.col("start_ms") != 0, F.col("start_ms")))
    size = u.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.max(known).alias("__known"))
    n18 = F.floor(F.col("__n") / 18)
    size = size.select(
        key, F.least(F.lit(8), F.greatest(F.lit(4), F.when(n18 == 0, F.lit(4)).otherwise(n18))).alias("n_rows"),
        F.coalesce("__known", F.col("__n") * 1000).cast("long").alias("duration_ms"))
    mid2 = F.when(F.col("end_ms").isNotNull(), F.col("start_ms") + F.col("end_ms")).otherwise(F.col("start_ms") * 2)
    placed = u.join(size, key).withColumn("__mid2", mid2).filter((F.col("__mid2") >= 0) & (F.col("__mid2") < 2 * F.col("duration_ms")))
    placed = placed.withColumn("bin", F.floor(F.col("__mid2") * F.col("n_rows") / (2 * F.col("duration_ms"))))
    # The quotient is exact up to 2^53; beyond, integer comparison puts border cases right.
    placed = placed.withColumn(
        "bin",
        F.when(F.col("__mid2") * F.col("n_rows") < F.col("bin") * 2 * F.col("duration_ms"), F.col("bin") - 1).otherwise(F.col("bin")))
    speech = joined_prefix(placed, [key, "bin"], pos, "text", 120)
    rows = speech.join(size, key)
    edge = lambda i: F.bround(F.col("duration_ms") * i / F.col("n_rows") / 1000.0, 0).cast("long").cast("string")
    return rows.select(
        key, F.col("bin").cast("int").alias("bin"), F.concat(edge(F.col("bin")), F.lit("-"), edge(F.col("bin") + 1), F.lit("s")).alias("time"),
        (F.col("duration_ms") * F.col("bin") / F.col("n_rows")).alias("start_ms"), "speech",
        text.segment_label("bin", "n_rows", "speech").alias("function"))


def nearest_frame(rows: DataFrame, frames: DataFrame, key: str = "media_id", at: str = "start_ms", row_id: str = "bin",
                  width: int = 60_000) -> DataFrame:
    """Nearest key frame (``frame_ms``, ``index``, ...) to each row; equal distance goes to the one listed first."""
    return joins.nearest(rows, frames, key, at, "frame_ms", "index", width, row_id)


def sentence_buckets(df: DataFrame, column: str = "text", ends: str = rules.SENTENCE_ENDS) -> DataFrame:
    """Timeline of a text without times: five fixed buckets of equal sentence counts. Row-local, no shuffle."""
    rest = [c for c in df.columns if c != column]
    s = df.select(*rest, text.split_sentences(column, ends).alias("__s"))
    chunk = F.greatest(F.lit(1), F.floor(F.size("__s") / 5).cast("int"))
    i = F.col("bucket")
    part = F.array_join(F.slice("__s", i * chunk + 1, chunk), " ")
    full = s.filter(F.size("__s") > 0).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        *rest, "bucket", F.get(F.array(*[F.lit(x) for x in rules.BUCKET_LABELS]), i).alias("time"),
        F.when(part == "", F.lit(rules.MISSING_TEXT)).otherwise(part).alias("speech"),
        F.get(F.array(*[F.lit(x) for x in rules.BUCKET_FUNCTIONS]), i).alias("function"))
    none = F.explode(F.array(*[
        F.struct(F.lit(b).alias("bucket"), F.lit(t).alias("time"), F.lit(rules.MISSING_TEXT).alias("speech"), F.lit(f).alias("function"))
        for b, t, f in ((0, "0-3s", "Hook"), (1, "3s+", "主体内容"))]))
    return full.unionByName(s.filter(F.size("__s") == 0).select(*rest, none.alias("r")).select(*rest, "r.*"))


def retention_flags(utts: DataFrame, key: str = "media_id", suspense: str = r"为什么|怎么|如何|吗|？|\?",
                    emotion: str = "错|难|亏|焦虑|别|不是|真正|问题", least: int = 30) -> DataFrame:
    """Signals that keep people watching: many utterances, a question, charged words. Blank utterances do not count. One
    partial aggregate."""
    return utts.filter(text.clean_text("text") != "").groupBy(key).agg(
        (F.count(F.lit(1)) >= least).alias("dense"), F.bool_or(F.col("text").rlike(suspense)).alias("suspense"),
        F.bool_or(F.col("text").rlike(emotion)).alias("emotion"), F.count(F.lit(1)).alias("n_utterances"))


def anchor_timeline(utts: DataFrame, anchors: str, key: str = "media_id", pos: str = "pos", rows_used: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Timeline cut where the transcript itself announces a new part (pattern ``anchors``), with a flag when a
    timeline of ``rows_used`` rows would be coarser than the announced parts. ``speech`` is the part's whole text, or its
    first ``max_chars`` characters where that is asked for."""
    hit = F.col("text").rlike(anchors).cast("int")
    u = scans.scan(utts.withColumn("__hit", hit), key, pos, part=scans.sum_upto("__hit"))
    spans = u.groupBy(key, "part").agg(
        F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count(F.lit(1)).alias("n_utterances"))
    if max_chars is None:
        said = u.groupBy(key, "part").agg(joined_text(pos, text.clean_text("text"), "").alias("speech"))
    else:
        said = joined_prefix(u, [key, "part"], pos, "text", max_chars)
    out = spans.join(said, [key, "part"], "left")
    if rows_used is not None:
        total = u.groupBy(key).agg((F.sum("__hit") > rows_used).alias("too_coarse"))
        out = out.join(total, key)
    return out


def judgments(rows: DataFrame) -> DataFrame:
    """Adds what a breakdown says of a video in a line: one_line_judgment, hook_retention, migration_formula and visual_rhythm.

    Reads text, hook, pain (the skeleton's), likes, n_comments and n_frames; nulls count as empty or 0. Without text the
    judgment rests on the public counts. Worked out in the row."""
    said, hook = F.coalesce("text", F.lit("")), F.coalesce("hook", F.lit(""))
    has = lambda c, word: F.contains(c, F.lit(word))
    million, model = said.rlike(rules.MILLION), has(said, "对标")
    told = lambda words, *parts: F.concat(*[x for w, p in zip(words, [*parts, F.lit("")]) for x in (F.lit(w), p)])
    spoken = F.when(million & model, rules.JUDGED_MILLION).otherwise(told(rules.JUDGED, text.clip_text(hook, 28), text.clip_text(F.coalesce("pain", F.lit("")), 24)))
    counted = (F.coalesce("likes", F.lit(0)) > 0) | (F.coalesce("n_comments", F.lit(0)) > 0)
    stay = F.when(hook == rules.NO_MATERIAL, rules.NO_MATERIAL).when(hook.rlike(rules.MILLION) & has(said, "三条"), rules.STAY_RESULT).when(
        has(said, "心理问题") & model, rules.STAY_REVERSAL).otherwise(rules.STAY_DEFAULT)
    formula = F.when(million & model, rules.FORMULA_MILLION).when(hook != rules.NO_MATERIAL, told(rules.FORMULA, text.clip_text(hook, 24))).otherwise(rules.NO_MATERIAL)
    return rows.withColumns({
        "one_line_judgment": F.when(said != "", spoken).when(counted, rules.JUDGED_BY_METRICS).otherwise(rules.JUDGED_WEAKLY),
        "hook_retention": stay, "migration_formula": formula,
        "visual_rhythm": F.when(F.coalesce("n_frames", F.lit(0)) > 0, rules.VISUAL_READY).otherwise(rules.VISUAL_MISSING)})


def video_breakdown(videos: DataFrame, utts: DataFrame, comments: DataFrame, frames: DataFrame) -> DataFrame:
    """One breakdown row per video: hook and its class, skeleton, retention flags, comment demand, frame count, judgments
    (``likes`` of the videos counts where there is one). Blank utterances are left out; a question in the speech or in the comments makes suspense."""
    utts = utts.filter(text.clean_text("text") != "")
    head = scans.top_k(utts, "media_id", ["pos"], 2).groupBy("media_id").agg(
        text.clip_text(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: text.clean_text(x["text"])), ""), 64).alias("opening"))
    flags = retention_flags(utts)
    demand = comment_summary(comments).select("media_id", "demand", (F.size("questions") > 0).alias("asked"), F.size("first").alias("n_comments"))
    n_frames = frames.groupBy("media_id").agg(F.count(F.lit(1)).alias("n_frames"))
    v = videos.join(head, "media_id", "left").join(flags, "media_id", "left").join(demand, "media_id", "left").join(n_frames, "media_id", "left")
    v = v.withColumn("n_comments", F.coalesce("n_comments", F.lit(0))).withColumn("n_frames", F.coalesce("n_frames", F.lit(0).cast("long")))
    v = v.withColumn("suspense", F.coalesce("suspense", F.lit(False)) | F.coalesce("asked", F.lit(False))).drop("asked")
    source = F.when(F.coalesce("text", F.lit("")) == "", F.coalesce("title", F.lit(""))).otherwise(F.col("text"))
    v = content_skeleton(v).withColumn("hook", F.coalesce("opening", text.first_sentence(source)))
    v = v.withColumn("hook_type", text.hook_type("hook")).drop("opening")
    judged = judgments(v.withColumn("pain", F.col("skeleton.pain")).withColumn("likes", F.col("likes") if "likes" in videos.columns else F.lit(0)))
    return judged.drop("pain", *[c for c in ("likes",) if c not in videos.columns])
