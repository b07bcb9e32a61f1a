"""Queries over text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.catalog.base import query, table
from cuemill.functions import text

WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x0B]+"
CLEAN = f"trim(regexp_replace(text, '{WS}', ' ', 'g'))"


def sq(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


@query("clean_text", "P5", f"SELECT doc_id, {CLEAN} AS cleaned FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_text("text").alias("cleaned"))


@query("clip_text", "P6", f"""
WITH c AS (SELECT doc_id, text, {CLEAN} AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(substring(t, 1, 80)) || '...' END AS clipped,
  CASE WHEN length(text) <= 120 THEN text
       ELSE regexp_replace(substring(text, 1, 119), '^{WS}|{WS}$', '', 'g') || '...' END AS truncated FROM c""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.clip_text("text", 80).alias("clipped"), text.truncate_text("text", 120).alias("truncated")
    )


SLUG = r"regexp_replace(regexp_replace(regexp_replace({c}, '[^\p{{L}}\p{{N}}_-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


@query("slugify", "P14", f"""
SELECT doc_id, substring(CASE WHEN s = '' THEN 'video' ELSE s END, 1, 48) AS slug
FROM (SELECT doc_id, {SLUG.format(c="CASE WHEN coalesce(text, '') = '' THEN 'video' ELSE text END")} AS s FROM documents)""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.slugify("text").alias("slug"))


@query("strip_markdown", "P16", f"""
SELECT doc_id,
 trim(regexp_replace(regexp_replace(regexp_replace(text, '!\\[[\\s\\S]*?\\]\\([^)]+\\)', '', 'g'),
   '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '{WS}', ' ', 'g')) AS page_text,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\\[([^\\]]*)\\]\\([^)]+\\)', '\\1', 'g'),
   '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[`*_~>#-]', '', 'g'), '{WS}', ' ', 'g')) AS article_text
FROM (SELECT doc_id, '![pic ' || source || '](i/' || doc_id || '.png) [' || lang || '](http://x.org/' || doc_id || ') ' || text AS text
  FROM documents)""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    md = F.concat(F.lit("![pic "), "source", F.lit("](i/"), F.col("doc_id").cast("string"), F.lit(".png) ["), "lang",
                  F.lit("](http://x.org/"), F.col("doc_id").cast("string"), F.lit(") "), "text")
    return d.select("doc_id", text.strip_md(md, "page").alias("page_text"), text.strip_md(md, "article").alias("article_text"))


@query("extract_entities", "P17", r"""
SELECT doc_id,
 regexp_extract_all(text, '(?i)((?:https?://)?(?:[A-Za-z0-9_-]+\.)+[a-z]{2,}(?:/[^\s]*)?)', 1) AS links,
 regexp_extract_all(text, '(?:^|[^A-Za-z0-9_@/])@([A-Za-z0-9_]{2,15})', 1) AS mentions,
 regexp_extract_all(text, '(?:^|[^&A-Za-z0-9_])#([\p{L}\p{N}_]+)', 1) AS topics
FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.extract_entities("text").alias("e")).select("doc_id", "e.*")


@query("drop_hashtags", "P17", r"""
SELECT page_id, regexp_replace(regexp_replace(t, '#\S+', '', 'g'), '^[ \-—、,，]+|[ \-—、,，]+$', '', 'g') AS title
FROM (SELECT page_id, regexp_extract(html, '<title>([^<]+)</title>', 1) AS t FROM pages)""")
def _(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]+)</title>", 1)
    return table(spark, sf, "pages").select("page_id", text.drop_hashtags(title).alias("title"))


@query("length_report", "P18", """
SELECT doc_id, length(text)::BIGINT AS characters,
  (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::BIGINT AS utf16_units,
  (length(text) - length(replace(text, chr(10), '')))::BIGINT AS newlines, length(text)::BIGINT AS "count",
  length(text) >= 100 AS within_minimum, length(text) >= 100 AND length(text) <= 2000 AS within_range,
  length(text) <= 2000 AS within_limit, (2000 - length(text))::BIGINT AS margin FROM documents""")
def _(spark, sf):
    r = text.length_report("text", 100, 2000)
    return table(spark, sf, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.*")


@query("display_width", "P19", f"""
WITH c AS (SELECT doc_id, text, length(text) AS n, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS a,
   regexp_replace(text, '^{WS}|{WS}$', '', 'g') AS s FROM documents),
d AS (SELECT *, length(s) AS sn, length(regexp_replace(s, '[^\\x00-\\x7F]', '', 'g')) AS sa FROM c)
SELECT doc_id, (a * 55 + (n - a) * 100) / 100.0 AS width, (a * 50 + (n - a) * 100) / 100.0 AS layout_width,
  CASE WHEN s = '' THEN 0 ELSE greatest(1, ceil(((sa * 50 + (sn - sa) * 100) / 100.0)::DOUBLE / 17.0)::INT) END::INT AS lines FROM d""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.display_width("text").alias("width"), text.display_width("text", 50).alias("layout_width"),
        text.wrapped_lines("text", 17).alias("lines"))


STRIP_SQL = "regexp_replace(tok, '^[ \\t\\r\\n，。！？；：、,.!?;:…“”‘’\"'']+|[ \\t\\r\\n，。！？；：、,.!?;:…“”‘’\"'']+$', '', 'g')"


@query("filler_tokens", "P20", f"""
WITH t AS (SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '')) AS tok FROM documents),
s AS (SELECT doc_id, lang, {STRIP_SQL} AS k FROM t)
SELECT doc_id, lang, count(*) FILTER (regexp_matches(k, '^[thede]+$')) AS fillers,
  count(*) FILTER (regexp_matches(k, '[thede]') AND NOT regexp_matches(k, '^[thede]+$')) AS embedded, count(*) AS tokens
FROM s GROUP BY 1, 2""")
def _(spark, sf):
    t = table(spark, sf, "documents").select(
        "doc_id", "lang", F.explode(F.filter(F.split("text", "[ \n]+"), lambda x: x != "")).alias("tok"))
    f = text.is_filler("tok", "[thede]")
    e = text.has_embedded_filler("tok", "[thede]")
    return t.groupBy("doc_id", "lang").agg(
        F.count_if(f).alias("fillers"), F.count_if(e).alias("embedded"), F.count(F.lit(1)).alias("tokens"))


@query("strip_punctuation", "P22", r"""
SELECT doc_id, regexp_replace(replace(regexp_replace(
   regexp_replace(regexp_replace(text, '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'),
   '[，。！？；：、,.!?;:…“”‘’]', '', 'g'), chr(1), '.'), '^\s+|\s+$', '', 'g') AS bare FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.strip_punct("text").alias("bare"))


@query("sentence_ends", "P23", r"""
WITH dl AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, (generate_subscripts(ls, 1) - 1)::INT AS line_no FROM dl),
s AS (SELECT doc_id, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM l)
SELECT doc_id, line_no, regexp_matches(t, '[，。！？；：、,.!?;:]$') AND NOT regexp_matches(t, '[0-9]\.$') AS ends FROM s""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d.select("doc_id", "line_no", text.ends_sentence("line").alias("ends"))


@query("comparable_text", "P24", r"""
SELECT doc_id, lower(regexp_replace(text, '[\p{P}\p{Z}]', '', 'g')) AS strict_text,
  lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS folded_text FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.comparable_text("text").alias("strict_text"), text.comparable_text("text", "fold").alias("folded_text"))


@query("replace_phrases", "P25", """
SELECT doc_id, replace(replace(replace(text, 'the ', 'THE '), 'THE of', 'the-of'), ' de ', ' DE ') AS replaced FROM documents""")
def _(spark, sf):
    phrases = [("the ", "THE "), ("THE of", "the-of"), ("", "x"), (" de ", " DE ")]
    return table(spark, sf, "documents").select("doc_id", text.apply_phrases("text", phrases).alias("replaced"))


SENTENCES_SQL = (
    "list_filter(list_transform(string_split(regexp_replace(t, '([.。！？!?])', '\\1' || chr(1), 'g'), chr(1)), "
    "lambda x: trim(x)), lambda x: x <> '')"
)


@query("split_sentences", "P26", f"""
WITH c AS (SELECT doc_id, {CLEAN} AS t FROM documents)
SELECT doc_id, {SENTENCES_SQL} AS sentences,
  CASE WHEN t = '' THEN '素材不足' WHEN regexp_matches(t, '(.{{1,80}}?[.。！？!?])') THEN trim(regexp_extract(t, '(.{{1,80}}?[.。！？!?])', 1))
   ELSE substring(t, 1, 80) END AS first_sentence FROM c""")
def _(spark, sf):
    ends = ".。！？!?"
    return table(spark, sf, "documents").select(
        "doc_id", text.split_sentences("text", ends).alias("sentences"), text.first_sentence("text", ends).alias("first_sentence"))


@query("syllable_units", "P31", r"""
SELECT doc_id, (len(regexp_extract_all(text, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]'))
  + len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[+.#_-][A-Za-z0-9]+)*')))::BIGINT AS units FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.syllable_units("text").alias("units"))


@query("content_key", "P35", """
SELECT doc_id, substring(sha256(doc_id::VARCHAR || '|' || coalesce(lang, '') || '|' || text || '|' || least(lang, source) || ',' ||
  greatest(lang, source)), 1, 16) AS key FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.content_key("doc_id", "lang", "text", refs=F.array("source", "lang")).alias("key"))


TYPO = "'约' || doc_id || '页内容,用' || lang || '写成１２３' || source || '共' || (n_chars % 97) || 'GB占' || (n_chars % 100) || ' %对吗？？真的！！“' || text || '”'"


@query("typeset_cjk", "P36", r"""
WITH s AS (SELECT doc_id, translate(""" + TYPO + r""", '０１２３４５６７８９', '0123456789') AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(t, '([\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}])([A-Za-z0-9])', '\1 \2', 'g') AS t FROM s),
b AS (SELECT doc_id, regexp_replace(t, '([A-Za-z0-9%°])([\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}])', '\1 \2', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '(^|[^A-Za-z0-9/._-])(\d+(?:\.\d+)?)(GB|MB|KB|TB|kg|km|cm|mm|ms|px)([^A-Za-z0-9]|$)', '\1\2 \3\4', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(t, '(\d)\s+([%°])', '\1\2', 'g') AS t FROM c),
e AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([？?])[？?]+', '\1', 'g'), '([！!])[！!]+', '\1', 'g') AS t FROM d)
SELECT doc_id, regexp_replace(regexp_replace(t, '“([^“”]*)”', '「\1」', 'g'), '‘([^‘’]*)’', '『\1』', 'g') AS typeset FROM e""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    s = F.concat(F.lit("约"), F.col("doc_id").cast("string"), F.lit("页内容,用"), "lang", F.lit("写成１２３"), "source", F.lit("共"),
                 (F.col("n_chars") % 97).cast("string"), F.lit("GB占"), (F.col("n_chars") % 100).cast("string"),
                 F.lit(" %对吗？？真的！！“"), "text", F.lit("”"))
    return d.select("doc_id", text.typeset(s).alias("typeset"))


@query("literal_newlines", "P40", r"""
SELECT page_id, CASE WHEN url LIKE 'http://%' THEN 'https://' || substring(url, 8) ELSE url END AS https_url, c AS content,
  (length(t) - length(c))::BIGINT AS removed_chars, ((length(c) - length(replace(c, '\n', ''))) // 2)::BIGINT AS remaining
FROM (SELECT *, regexp_replace(regexp_replace(t, '^(?:\s*\\n\s*)+', ''), '(?:\s*\\n\s*)+$', '') AS c
  FROM (SELECT page_id, url, ' \n' || '\n ' || url || '\n' || html || '\n ' AS t FROM pages))""")
def _(spark, sf):
    from cuemill.functions import urls
    p = table(spark, sf, "pages")
    t = F.concat(F.lit(" \\n\\n "), "url", F.lit("\\n"), "html", F.lit("\\n "))
    return p.select("page_id", urls.to_https("url").alias("https_url"), text.strip_literal_newlines(t).alias("s")).select(
        "page_id", "https_url", "s.*")


@query("report_title_split", "P43", r"""
WITH s AS (SELECT doc_id, '# Report ' || doc_id || chr(10) || '理论视角：x' || chr(10) || text || chr(10) || '  解释视角: y' AS t FROM documents),
l AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM s)
SELECT doc_id, trim(regexp_extract(ls[1], '^#\s+(.+?)\s*$', 1)) AS title,
  regexp_replace(array_to_string(list_filter(ls[2:], lambda x: NOT regexp_matches(x, '^\s*(理论视角|理论依据|解释视角)\s*[：:]')), chr(10)),
   '^\s+|\s+$', '', 'g') AS body FROM l""")
def _(spark, sf):
    from cuemill.operators import articles
    d = table(spark, sf, "documents")
    t = F.concat(F.lit("# Report "), F.col("doc_id").cast("string"), F.lit("\n理论视角：x\n"), "text", F.lit("\n  解释视角: y"))
    return articles.split_report(d.select("doc_id", t.alias("text"))).select("doc_id", "title", "body")


HOOKS = [("contrast", "not|never|wrong"), ("question", r"\?|why|how"), ("result", r"(?i)\d|result"), ("identity", "you|who")]


@query("hook_type", "P27", f"""
WITH c AS (SELECT doc_id, {CLEAN} AS t FROM documents),
f AS (SELECT doc_id, CASE WHEN t = '' THEN '素材不足' WHEN regexp_matches(t, '(.{{1,80}}?[.!?])') THEN trim(regexp_extract(t, '(.{{1,80}}?[.!?])', 1))
   ELSE substring(t, 1, 80) END AS hook FROM c)
SELECT doc_id, hook, CASE WHEN hook = '素材不足' THEN hook WHEN regexp_matches(hook, 'not|never|wrong') THEN 'contrast'
  WHEN regexp_matches(hook, '\\?|why|how') THEN 'question' WHEN regexp_matches(hook, '(?i)\\d|result') THEN 'result'
  WHEN regexp_matches(hook, 'you|who') THEN 'identity' ELSE 'pain' END AS hook_type,
 CASE WHEN hook = '素材不足' THEN hook WHEN regexp_matches(hook, '不是|别再|很多人|误区|错了|以为') THEN '反常识 / 纠偏'
  WHEN regexp_matches(hook, '为什么|怎么|如何|吗|？|\\?') THEN '问题悬念' WHEN regexp_matches(hook, '(?i)\\d|万|元|offer|结果|拿到|做到|涨') THEN '结果前置'
  WHEN regexp_matches(hook, '你|普通人|新手|老板|打工人|求职|博主') THEN '身份召唤' ELSE '痛点直戳' END AS label FROM f""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.first_sentence("text", ".!?").alias("hook"))
    return d.select("doc_id", "hook", text.hook_type("hook", HOOKS, "pain").alias("hook_type"), text.hook_type("hook").alias("label"))


@query("question_turns", "P29", """
SELECT conv_id, turn, regexp_matches(text, '\\?|pour|que|the') AS question,
  regexp_matches(text, '@|回复|请问|求问|想问|怎么|如何|有没有|能不能|可以吗|吗|？|\\?|博主|主播|老师|求|指路|讲讲|展开说|我也|我现在|我就是|有人') AS interaction
FROM conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.is_question("text", r"\?|pour|que|the").alias("question"), text.is_interaction("text").alias("interaction"))


@query("segment_labels", "P30", """
WITH n AS (SELECT conv_id, turn, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'Hook / 结果问题' WHEN regexp_matches(text, 'pas |the in') THEN 'negation'
  WHEN turn >= n - 1 THEN '收束 / 行动' WHEN turn <= greatest(1, n * 0.35) THEN '场景/痛点' WHEN turn <= greatest(2, n * 0.7) THEN '方法/案例'
  ELSE '执行要求' END AS label FROM n""")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    n = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return c.join(n, "conv_id").select(
        "conv_id", "turn", text.segment_label("turn", "n", "text", [("negation", "pas |the in")]).alias("label"))


@query("clean_lines", "P15", r"""
WITH dl AS (SELECT doc_id, list_filter(list_transform(string_split(text || chr(10) || '![](x) hidden' || chr(10) || '分享' || chr(10) || '大家都在搜 x', chr(10)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '![](')) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, (generate_subscripts(ls, 1) - 1)::INT AS line_no FROM dl)
SELECT doc_id, line_no, line, line IN ('...', '分享', '回复', '作者赞过', '加载中', '留下你的精彩评论吧') OR starts_with(line, '大家都在搜')
  OR starts_with(line, '[![') AS noise FROM l""")
def _(spark, sf):
    from cuemill.operators import videos
    d = table(spark, sf, "documents")
    t = F.concat("text", F.lit("\n![](x) hidden\n分享\n大家都在搜 x"))
    return videos.clean_lines(d.select("doc_id", t.alias("text")), "text")


@query("loose_contains", "P10", """
SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON
  right(c_name, 9) = right(s_name, 9) AND contains(lower(replace(c_name, ' ', '')), lower(replace(right(s_name, 9), ' ', '')))""")
def _(spark, sf):
    from cuemill.operators import videos
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.right("c_name", F.lit(9)).alias("code"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.right("s_name", F.lit(9)).alias("code"), F.array(F.right("s_name", F.lit(9))).alias("names"))
    return c.join(s, "code").filter(videos.author_matches("c_name", "names")).select("c_custkey", "s_suppkey")


@query("fence_runs", "P45", """
SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(text, '[*]+'), lambda x: length(x))), 0)::INT AS longest FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.longest_run("text", "*").cast("int").alias("longest"))


def skeleton_text(d):
    """Documents with keyword-bearing sentences derived from their own fields."""
    return F.concat(
        F.when(F.col("lang") == "en", F.lit("对标五个标准，")).when(F.col("lang") == "de", F.lit("心理问题和对标，")).otherwise(F.lit("")),
        F.when(F.col("n_chars") % 3 == 0, F.lit("很多人求职拿offer。")).when(F.col("n_chars") % 3 == 1, F.lit("账号内容第一步，收藏！")).otherwise(F.lit("")),
        F.col("text"))


SK = """CASE WHEN lang = 'en' THEN '对标五个标准，' WHEN lang = 'de' THEN '心理问题和对标，' ELSE '' END ||
 CASE n_chars % 3 WHEN 0 THEN '很多人求职拿offer。' WHEN 1 THEN '账号内容第一步，收藏！' ELSE '' END || text"""
KEYS = ["第一", "第二", "方法", "步骤", "关键", "核心", "你要", "一定要"]


@query("content_skeleton", "P28", f"""
WITH b AS (SELECT doc_id, lang, {SK} AS text FROM documents),
c AS (SELECT doc_id, lang, {CLEAN} AS t, text AS raw FROM b),
f AS (SELECT *, CASE WHEN t = '' THEN '素材不足' WHEN regexp_matches(t, '(.{{1,80}}?[。！？!?])') THEN trim(regexp_extract(t, '(.{{1,80}}?[。！？!?])', 1))
   ELSE substring(t, 1, 80) END AS hook FROM c),
h AS (SELECT *, lang || ' ' || hook AS head, CASE {" ".join(f"WHEN contains(raw, {sq(k)}) THEN instr(raw, {sq(k)})" for k in KEYS)} ELSE 0 END AS kpos FROM f),
m AS (SELECT *, trim(regexp_replace(substring(raw, kpos, 120), '{WS}', ' ', 'g')) AS mt FROM h)
SELECT doc_id,
 CASE WHEN regexp_matches(head, '(?i)求职|offer|面试|简历|应届|实习') THEN '求职/职业转型人群' WHEN regexp_matches(head, '赚钱|商业|副业|老板|生意|变现') THEN '想提升商业化能力的人'
  WHEN regexp_matches(head, '博主|账号|内容|流量|抖音|小红书') THEN '内容创作者' ELSE '需结合账号定位判断' END AS audience,
 CASE WHEN regexp_matches(head, '(?i)面试|简历|offer') THEN '求职决策或面试准备场景' WHEN regexp_matches(head, '账号|内容|视频|直播|选题') THEN '内容生产和账号增长场景'
  WHEN regexp_matches(head, '赚钱|商业|副业|客户') THEN '个人商业化或获客场景' ELSE '素材不足' END AS scene,
 CASE WHEN contains(raw, '对标') AND regexp_matches(raw, '100万|一百万|赚钱|挣钱') THEN '想赚到第一个100万，但不知道该找谁对标、如何照着更成熟的人做。'
  WHEN contains(raw, '心理问题') AND contains(raw, '对标') THEN '不是没有方法，而是不愿意承认自己需要对齐更高标准。' ELSE hook END AS pain,
 CASE WHEN contains(raw, '心理问题') AND contains(raw, '对标') THEN '表面是方法问题，实际被归因为不愿意和更高标准的对标保持一致。'
  WHEN regexp_matches(raw, '不是[^。！？!?]{{2,50}}而是[^。！？!?]{{2,60}}') THEN regexp_extract(raw, '不是[^。！？!?]{{2,50}}而是[^。！？!?]{{2,60}}')
  WHEN regexp_matches(raw, '很多人[^。！？!?]{{2,80}}') THEN regexp_extract(raw, '很多人[^。！？!?]{{2,80}}')
  WHEN regexp_matches(raw, '真正[^。！？!?]{{2,80}}') THEN regexp_extract(raw, '真正[^。！？!?]{{2,80}}') ELSE '反差不明显或素材不足' END AS contrast,
 CASE WHEN contains(raw, '对标') AND contains(raw, '五个标准') THEN '用“三条大原则”先建立判断，再用“找对标的五个标准”把抽象赚钱问题拆成可执行筛选。' WHEN kpos > 0 THEN
   CASE WHEN length(mt) <= 90 THEN mt ELSE rtrim(substring(mt, 1, 90)) || '...' END ELSE '方法段需要人工复核' END AS method,
 CASE WHEN regexp_matches(raw, '(?i)\\d|万|元|offer|案例|客户') THEN '口播中包含数字或案例型证明' ELSE '证明素材不足' END AS proof,
 CASE WHEN contains(raw, '收藏') THEN '用“视频有点长，收藏慢慢看”引导收藏。' WHEN regexp_matches(raw, '关注|评论|私信|收藏|转发|主页|链接') THEN '包含显性互动或转化动作'
   ELSE '未识别到明确 CTA' END AS action FROM m""")
def _(spark, sf):
    from cuemill.operators import videos
    d = table(spark, sf, "documents")
    v = d.select("doc_id", skeleton_text(d).alias("text"), F.col("lang").alias("title"), F.lit(0).alias("n_comments"))
    return videos.content_skeleton(v).select("doc_id", "skeleton.*")
