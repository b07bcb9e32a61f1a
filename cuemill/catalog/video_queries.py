"""Queries over video metadata, comments, ranking and reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.catalog import views
from cuemill.catalog.base import query, table
from cuemill.catalog.text_queries import CLEAN
from cuemill.functions import numbers
from cuemill.operators import scans, videos, words


@query("parse_counts", "P7", r"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN format('{:,}', floor(l_extendedprice)::BIGINT) WHEN 2 THEN l_quantity::INT || '.' || (l_orderkey % 10) || '万' WHEN 3 THEN l_quantity::INT || 'k'
  WHEN 4 THEN '暂无' WHEN 5 THEN '' WHEN 6 THEN '约' || l_quantity::INT || '.' || (l_partkey % 10) || 'K 赞' ELSE l_quantity::INT || '.' || (l_partkey % 10) END AS raw FROM lineitem),
n AS (SELECT *, try_cast(regexp_extract(replace(raw, ',', ''), '([\d.]+)', 1) AS DOUBLE) AS v FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, raw, coalesce(floor(v * CASE WHEN contains(raw, '万') THEN 10000.0::DOUBLE WHEN contains(lower(raw), 'k') THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END + 0.5::DOUBLE)::BIGINT, 0) AS n FROM n""")
def _(spark, sf):
    q, i = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    raw = (
        F.when(i == 1, F.format_number(F.floor("l_extendedprice").cast("long"), 0)).when(i == 2, F.concat(q, F.lit("."), (F.col("l_orderkey") % 10).cast("string"), F.lit("万"))).when(i == 3, F.concat(q, F.lit("k")))
        .when(i == 4, "暂无").when(i == 5, "").when(i == 6, F.concat(F.lit("约"), q, F.lit("."), (F.col("l_partkey") % 10).cast("string"), F.lit("K 赞"))).otherwise(F.concat(q, F.lit("."), (F.col("l_partkey") % 10).cast("string"))))
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return d.withColumn("n", numbers.parse_count("raw"))


@query("format_counts", "P8", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice)::BIGINT // 10 ELSE floor(o_totalprice)::BIGINT END AS n FROM orders),
x AS (SELECT *, n // 1000 AS t0, n % 1000 AS r, n / 10000.0::DOUBLE - floor(n / 10000.0::DOUBLE) AS part, ((n // 1000 % 10) * 2 + 1) / 20.0::DOUBLE AS mid FROM o),
t AS (SELECT *, t0 + CASE WHEN r > 500 OR (r = 500 AND (part > mid OR (part = mid AND t0 % 2 = 1))) THEN 1 ELSE 0 END AS a, t0 + CASE WHEN r > 500 OR (r = 500 AND part >= mid) THEN 1 ELSE 0 END AS b FROM x)
SELECT o_orderkey, CASE WHEN n >= 10000 THEN (a // 10)::VARCHAR || CASE WHEN a % 10 = 0 THEN '' ELSE '.' || (a % 10) END || '万' ELSE n::VARCHAR END AS report,
  CASE WHEN n >= 100000 THEN ((n + 5000) // 10000)::VARCHAR || '万' WHEN n >= 10000 THEN (b // 10)::VARCHAR || CASE WHEN b % 10 = 0 THEN '' ELSE '.' || (b % 10) END || '万' ELSE format('{:,}', n) END AS card FROM t""")
def _(spark, sf):
    p = F.floor("o_totalprice").cast("long")
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.floor(p / 10)).otherwise(p).alias("n"))
    return o.select("o_orderkey", numbers.format_count("n").alias("report"), numbers.format_count("n", "card").alias("card"))


AGE = """CASE event_id % 11 WHEN 0 THEN '刚刚' WHEN 1 THEN (event_id % 60) || '分钟前' WHEN 2 THEN (event_id % 24) || '小时前' WHEN 3 THEN '昨天' WHEN 4 THEN '前天' WHEN 5 THEN (event_id % 30) || '天前' WHEN 6 THEN (event_id % 9) || ' 周前'
 WHEN 7 THEN (event_id % 12) || '月前' WHEN 8 THEN (event_id % 3 + 1) || '年前' WHEN 9 THEN strftime(ts, '%Y.%m.%d') ELSE '' END"""


def age_text():
    i = F.col("event_id")
    n = lambda m, s: F.concat((i % m).cast("string"), F.lit(s))
    k = i % 11
    return (
        F.when(k == 0, "刚刚").when(k == 1, n(60, "分钟前")).when(k == 2, n(24, "小时前")).when(k == 3, "昨天").when(k == 4, "前天").when(k == 5, n(30, "天前")).when(k == 6, n(9, " 周前"))
        .when(k == 7, n(12, "月前")).when(k == 8, F.concat((i % 3 + 1).cast("string"), F.lit("年前"))).when(k == 9, F.date_format("ts", "yyyy.MM.dd")).otherwise(""))


@query("age_days", "P9", f"""
SELECT event_id, raw, CASE event_id % 11 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN event_id % 30 WHEN 6 THEN (event_id % 9) * 7 WHEN 7 THEN (event_id % 12) * 30
  WHEN 9 THEN date_diff('day', ts::DATE, DATE '2024-02-15') END::BIGINT AS age FROM (SELECT *, {AGE} AS raw FROM events)""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", age_text().alias("raw"))
    return e.withColumn("age", numbers.age_days("raw", F.lit("2024-02-15").cast("date")))


@query("to_seconds", "P3", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN value * 10 / 1000.0::DOUBLE WHEN value * 10 > 1000 THEN value * 10 / 1000.0::DOUBLE ELSE value * 10 END AS seconds FROM events""")
def _(spark, sf):
    t = F.col("event_type")
    v = F.when(t == "error", "n/a").otherwise((F.col("value") * 10).cast("string"))
    return table(spark, sf, "events").select("event_id", numbers.to_seconds(v, t == "view").alias("seconds"))


@query("time_formats", "P33", """
WITH m AS (SELECT event_id, (value * 100000)::BIGINT AS ms FROM events), c AS (SELECT *, round_even(ms / 10.0::DOUBLE, 0)::BIGINT AS cs, round_even(ms / 1000.0::DOUBLE, 0)::BIGINT AS s FROM m)
SELECT event_id, (cs // 360000)::VARCHAR || ':' || format('{:02d}', cs % 360000 // 6000) || ':' || format('{:02d}', cs % 6000 // 100) || '.' || format('{:02d}', cs % 100) AS ass,
 cs * 10 AS back_ms, (ms // 60000)::VARCHAR || ':' || format('{:02d}', ms // 1000 % 60) AS short, format('{:02d}', s // 3600) || '-' || format('{:02d}', s % 3600 // 60) || '-' || format('{:02d}', s % 60) AS label FROM c""")
def _(spark, sf):
    m = table(spark, sf, "events").select("event_id", F.round(F.col("value") * 100_000).cast("long").alias("ms"))
    return m.select("event_id", numbers.ass_time("ms").alias("ass"), numbers.parse_ass_time(numbers.ass_time("ms")).alias("back_ms"), numbers.stamp("ms").alias("short"), numbers.stamp("ms", "hh-mm-ss").alias("label"))


@query("speed_factor", "P32", "SELECT event_id, CASE WHEN value / 20 < 2.4 THEN 1.12 WHEN value / 20 < 2.7 THEN 1.08 WHEN value / 20 < 3.0 THEN 1.05 ELSE 1.0 END::DOUBLE AS speed FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", numbers.speed_factor(F.col("value") / 20).alias("speed"))


@query("sample_times", "P34", """
WITH d AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT * 1000 AS d FROM orders), i AS (SELECT *, CASE WHEN d <= 12000000 THEN 2000000.0::DOUBLE WHEN d <= 60000000 THEN 3000000.0::DOUBLE WHEN d <= 180000000 THEN 5000000.0::DOUBLE
  ELSE greatest(6000000.0::DOUBLE, d / 28.0::DOUBLE) END AS iv FROM d), c AS (SELECT *, least(28, greatest(1, ceil(d / iv)::INT)) AS n FROM i)
SELECT o_orderkey, unnest(CASE WHEN d <= 0 THEN [0::BIGINT] WHEN n = 1 THEN [least(d // 2, greatest(0, d - 100000))] ELSE list_transform(range(n), lambda k: least(d - 100000, (k * d) // n + 250000)) END) AS at_us FROM c""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.explode(numbers.sample_times_us(F.floor("o_totalprice").cast("long") * 1000)).alias("at_us"))


PART = "SELECT p_partkey, '#' || lpad(to_hex(p_partkey * 7919 % 16777216), 6, '0') AS c1, CASE p_partkey % 4 WHEN 0 THEN 'White' WHEN 1 THEN '#' || lpad(to_hex(p_size * 80), 3, '0') WHEN 2 THEN 'rgb(' || p_size || ', ' || (p_partkey % 256) || ',10)' ELSE 'teal' END AS c2 FROM part"


@query("contrast", "P42", f"""
WITH p AS ({PART}), ch AS (SELECT p_partkey, p_partkey * 7919 % 16777216 AS a, CASE p_partkey % 4 WHEN 0 THEN [255, 255, 255] WHEN 1 THEN [(p_size * 80) // 256 * 17, (p_size * 80) // 16 % 16 * 17, (p_size * 80) % 16 * 17] WHEN 2 THEN [p_size, p_partkey % 256, 10] END AS c2 FROM part),
v AS (SELECT p_partkey, [a // 65536, a // 256 % 256, a % 256] AS c1, c2 FROM ch),
l AS (SELECT p_partkey, list_transform(c1, lambda x: CASE WHEN x / 255.0::DOUBLE <= 0.04045 THEN x / 255.0::DOUBLE / 12.92 ELSE pow((x / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END) AS x, list_transform(c2, lambda x: CASE WHEN x / 255.0::DOUBLE <= 0.04045 THEN x / 255.0::DOUBLE / 12.92 ELSE pow((x / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END) AS y FROM v),
m AS (SELECT p_partkey, x[1] * 0.2126 + x[2] * 0.7152 + x[3] * 0.0722 AS x, y[1] * 0.2126 + y[2] * 0.7152 + y[3] * 0.0722 AS y FROM l)
SELECT p_partkey, CASE WHEN y IS NOT NULL THEN round((greatest(x, y) + 0.05) / (least(x, y) + 0.05), 6) END AS ratio FROM m""")
def _(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    c1 = F.concat(F.lit("#"), F.lpad(F.hex(k * 7919 % 16777216), 6, "0"))
    c2 = F.when(k % 4 == 0, "White").when(k % 4 == 1, F.concat(F.lit("#"), F.lpad(F.hex(s * 80), 3, "0"))).when(k % 4 == 2, F.concat(F.lit("rgb("), s.cast("string"), F.lit(", "), (k % 256).cast("string"), F.lit(",10)"))).otherwise("teal")
    return table(spark, sf, "part").select("p_partkey", F.round(numbers.contrast(c1, c2), 6).alias("ratio"))


@query("media_shape", "P44", """
WITH p AS (SELECT p_partkey, p_size * 40 AS w, CASE WHEN p_partkey % 3 = 0 THEN p_size * 40 * 9 // 16 WHEN p_partkey % 3 = 1 THEN (p_partkey % 50) * 40 ELSE p_size * 40 END AS h FROM part)
SELECT p_partkey, CASE WHEN w > 0 AND h > 0 THEN CASE WHEN w > h THEN 'landscape' WHEN h > w THEN 'portrait' ELSE 'square' END END AS shape,
  CASE WHEN w > 0 AND h > 0 THEN CASE WHEN w > h AND abs(w / h::DOUBLE - 16.0::DOUBLE / 9) <= 0.01 AND h < 1080 THEN 1920 ELSE w END END::BIGINT AS width,
  CASE WHEN w > 0 AND h > 0 THEN CASE WHEN w > h AND abs(w / h::DOUBLE - 16.0::DOUBLE / 9) <= 0.01 AND h < 1080 THEN 1080 ELSE h END END::BIGINT AS height,
  CASE WHEN h <> 0 THEN w::DOUBLE / h END AS ratio FROM p""")
def _(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf, "part").select("p_partkey", (s * 40).alias("w"), F.when(k % 3 == 0, F.floor(s * 40 * 9 / 16)).when(k % 3 == 1, k % 50 * 40).otherwise(s * 40).alias("h"))
    size = numbers.delivery_size("w", "h")
    return p.select("p_partkey", numbers.orientation("w", "h").alias("shape"), size["width"].alias("width"), size["height"].alias("height"), numbers.fraction(F.concat_ws("/", F.col("w").cast("string"), F.col("h").cast("string"))).alias("ratio"))


@query("engagement_ratios", "P52", """
WITH m AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS collects, sum(CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE 0 END)::BIGINT AS likes FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN likes <> 0 THEN collects::DOUBLE / likes END AS collect_rate FROM m""")
def _(spark, sf):
    m = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("collects"), F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_linenumber")).otherwise(0)).alias("likes"))
    return m.select("l_orderkey", numbers.engagement_ratio("collects", "likes").alias("collect_rate"))


@query("reveal_offset", "P47", """
SELECT event_id, least(greatest((value * 1000)::BIGINT - 20000, 0), 30000) AS "offset" FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.round(F.col("value") * 1000).cast("long").alias("t"))
    return e.select("event_id", numbers.reveal_offset("t", F.lit(20_000).cast("long"), F.lit(50_000).cast("long")).alias("offset"))


@query("array_diff", "A18", """
WITH p AS (SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: abs((z[1] * 1000)::INT - (z[2] * 1000)::INT)::DOUBLE) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, list_sum(d) / len(d) AS mean_abs, len(list_filter(d, lambda x: x >= 20))::DOUBLE / len(d) AS changed_share, list_max(d) AS max_abs,
  list_sum(d) / len(d) >= 2 OR (len(list_filter(d, lambda x: x >= 20))::DOUBLE / len(d) >= 0.004 AND list_max(d) >= 35) AS visible FROM p""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.rint((x.cast("float") * F.lit(1000).cast("float")).cast("double")).cast("int")).alias("v"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return j.select("vec_id", numbers.array_diff("v", "w").alias("d")).select("vec_id", "d.*")


@query("alpha_share", "A18", """
SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.2))::DOUBLE / len(embedding) AS share, len(list_filter(embedding, lambda x: x > 0.2))::DOUBLE / len(embedding) > 0.0001 AS visible FROM embeddings""")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", numbers.alpha_share("embedding", 0.2).alias("a")).select("vec_id", "a.*")


# --- comments -------------------------------------------------------------------------------------------

COMMENTS = "WITH c AS (SELECT conv_id AS media_id, turn AS pos, text, CASE WHEN role = 'assistant' THEN length(text) % 50 ELSE 0 END AS likes FROM conversations)"


def comments(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("media_id"), F.col("turn").alias("pos"), "text", F.when(F.col("role") == "assistant", F.length("text") % 50).otherwise(0).alias("likes"))


@query("top_comments", "T1", COMMENTS + """
SELECT media_id, pos, likes, rank FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY likes DESC, pos) AS rank FROM c WHERE length(trim(text)) >= 2) WHERE rank <= 3""")
def _(spark, sf):
    return videos.top_comments(comments(spark, sf), k=3).select("media_id", "pos", "likes", "rank")


@query("liked_or_fallback", "T6", COMMENTS + """,
l AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY pos) AS rank FROM c WHERE likes >= 30), f AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY pos) AS rank FROM c WHERE likes < 30 AND regexp_matches(text, 'que|the'))
SELECT media_id, pos, likes, rank, '有赞' AS signal FROM l WHERE rank <= 2 UNION ALL SELECT media_id, pos, likes, rank, '互动' FROM f WHERE rank <= 2 AND media_id NOT IN (SELECT media_id FROM l)""")
def _(spark, sf):
    r = videos.liked_or_fallback(comments(spark, sf), k=2, min_likes=30, interaction=F.col("text").rlike("que|the"))
    return r.select("media_id", "pos", "likes", "rank", "signal")


@query("comment_summary", "A7", COMMENTS + """,
l AS (SELECT media_id, list(text ORDER BY pos)[1:5] AS x FROM c WHERE likes > 0 GROUP BY 1), q AS (SELECT media_id, list(text ORDER BY pos)[1:5] AS x FROM c WHERE regexp_matches(text, 'que|the') GROUP BY 1), a AS (SELECT media_id, list(text ORDER BY pos)[1:8] AS x FROM c GROUP BY 1)
SELECT a.media_id, coalesce(l.x, []) AS liked, coalesce(q.x, []) AS questions, a.x AS "first", CASE WHEN q.x IS NOT NULL THEN 'questions' WHEN l.x IS NOT NULL THEN 'liked' ELSE 'none' END AS demand
FROM a LEFT JOIN l ON a.media_id = l.media_id LEFT JOIN q ON a.media_id = q.media_id""")
def _(spark, sf):
    return videos.comment_summary(comments(spark, sf), question=F.col("text").rlike("que|the"))


@query("comment_signals", "A27", COMMENTS + """,
s AS (SELECT *, unnest(list_filter([CASE WHEN regexp_matches(text, 'que|the') THEN 'ask' END, CASE WHEN regexp_matches(text, 'pas|not') THEN 'doubt' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'fact' END], lambda x: x IS NOT NULL)) AS signal FROM c)
SELECT media_id, signal, count(*) AS n, arg_min(text, [-likes, pos]) AS sample, max(likes) AS top_likes FROM s GROUP BY 1, 2""")
def _(spark, sf):
    return videos.comment_signals(comments(spark, sf), [("ask", "que|the"), ("doubt", "pas|not"), ("fact", "[0-9]")])


@query("attach_previous", "J11", "WITH " + views.LINES + """,
v AS (SELECT doc_id, line_no, line, CASE WHEN length(line) >= 60 THEN line END AS t, nullif(regexp_extract(line, '^([A-Z][a-z]+) ', 1), '') AS a, CASE WHEN regexp_matches(line, '[0-9]') THEN regexp_extract(line, '([0-9]+)', 1) END AS n FROM lines)
SELECT doc_id, line_no, pt AS text, pa AS author, pn AS count_text FROM (SELECT *, last_value(t IGNORE NULLS) OVER b AS pt, last_value(a IGNORE NULLS) OVER b AS pa, first_value(n IGNORE NULLS) OVER f AS pn FROM v
  WINDOW b AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) WHERE suffix(line, '.')""")
def _(spark, sf):
    line = F.col("line")
    a, n = F.regexp_extract(line, "^([A-Z][a-z]+) ", 1), F.regexp_extract(line, "([0-9]+)", 1)
    r = videos.attach_previous(
        views.doc_lines(spark, sf), "doc_id", "line_no", line.endswith("."), F.when(F.length(line) >= 60, line), F.when(a != "", a), F.when(n != "", n))
    return r.select("doc_id", "line_no", "text", "author", "count_text")


def detail_pages(spark, sf):
    """A detail page per conversation: header, counts, publish line and one comment per turn."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.regexp_replace("text", r"\s+", " ").alias("t"))
    block = F.concat(F.lit("[u"), F.col("turn").cast("string"), F.lit("](//www.douyin.com/user/x)\n"), F.col("t"), F.lit("\n...\n"), F.col("turn").cast("string"), F.lit("天前·home\n分享\n"), (F.length("t") % 9).cast("string"), F.lit("\n回复"))
    g = c.groupBy("conv_id").agg(words.joined_text("turn", block, "\n").alias("body"), F.max("turn").alias("n"))
    head = F.concat(F.lit("# Video "), F.col("conv_id").cast("string"), F.lit("\n\n1.5万\n\n"), F.col("n").cast("string"), F.lit("\n\n7\n\n9\n\n举报\n\n发布时间：2024-01-0"), (F.col("n") % 9 + 1).cast("string"), F.lit(" 10:30\n\n@someone here\n全部评论\n"))
    return g.select(F.col("conv_id").alias("page_id"), F.concat(head, "body").alias("text"))


@query("parse_comments", "J11,S7", r"""
WITH c AS (SELECT conv_id AS page_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s, length(regexp_replace(text, '\s+', ' ', 'g')) % 9 AS likes FROM conversations)
SELECT page_id, 'u' || turn AS author, CASE WHEN regexp_matches(s, '^[^:：]{1,32}[:：](.+)$') THEN trim(regexp_extract(s, '^[^:：]{1,32}[:：](.+)$', 1)) ELSE s END AS text, turn || '天前·home' AS time, likes::BIGINT AS likes FROM c WHERE length(s) >= 2""")
def _(spark, sf):
    return videos.parse_comments(detail_pages(spark, sf)).drop("pos")


@query("parse_detail", "S7", """
SELECT conv_id AS page_id, 'Video ' || conv_id AS title, 'someone here' AS author, '2024-01-0' || (max(turn) % 9 + 1) || ' 10:30' AS published_at, 15000::BIGINT AS likes, max(turn) AS comments, 7::BIGINT AS collects, 9::BIGINT AS shares, 4 AS metric_lines FROM conversations GROUP BY 1""")
def _(spark, sf):
    # The first user link of the page stands in the comments; without the header form the @ name is the author.
    p = detail_pages(spark, sf)
    return videos.parse_detail(p)


VISIBLE = r"trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


def visible():
    """All words of a page on one line, without its tags."""
    return F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))


@query("parse_search", "S6", rf"""
SELECT page_id, (100000 + page_id)::VARCHAR AS id, 'https://www.douyin.com/video/' || (100000 + page_id) AS url, t AS title, 'Author ' || page_id AS author, (page_id % 9 + 1) || '天前' AS relative_time, (page_id * 3)::BIGINT AS search_metric
FROM (SELECT page_id, {VISIBLE} AS t FROM pages) WHERE t <> '' AND page_id % 4 <> 3""")
def _(spark, sf):
    i = F.col("page_id").cast("string")
    n = F.col("page_id")
    tail = F.when(n % 4 == 3, F.lit("](/other)")).otherwise(F.concat(F.lit("](//www.douyin.com/video/"), (n + 100_000).cast("string"), F.lit(")")))
    t = F.concat(F.lit("menu\n-   [![](cover)\n"), (n * 3).cast("string"), F.lit("赞\n"), visible(), F.lit("\n@Author "), i, F.lit(" "), (n % 9 + 1).cast("string"), F.lit("天前\n"), tail)
    return videos.parse_search(table(spark, sf, "pages").select("page_id", t.alias("text"))).drop("at_link")


@query("page_evidence", "A24", rf"""
WITH p AS (SELECT page_id, 'https://v.example/video/' || page_id AS i, CASE WHEN page_id % 5 = 0 THEN url WHEN page_id % 5 = 1 THEN 'https://v.example/video/1' || page_id ELSE 'https://v.example/video/' || page_id END AS u, CASE WHEN contains(html, '$$$') THEN '' ELSE {VISIBLE} END AS t,
  CASE WHEN page_id % 3 > 0 THEN '2024-01-01' END AS d, len(regexp_extract_all(html, '<p>')) AS m, regexp_matches(html, '</html>\s*$') AS whole FROM pages)
SELECT page_id, regexp_extract(u, '/video/(\d+)', 1) AS video_id, list_filter([CASE WHEN regexp_extract(u, '/video/(\d+)', 1) = '' THEN 'not_a_detail_page' END, CASE WHEN page_id % 5 = 1 THEN 'id_differs' END, CASE WHEN t = '' THEN 'title_missing' END,
  CASE WHEN d IS NULL THEN 'publish_time_missing' END, CASE WHEN m < 4 OR NOT whole THEN 'metrics_not_stable' END], lambda x: x IS NOT NULL) AS errors, NOT (page_id % 5 IN (0, 1) OR t = '' OR d IS NULL OR m < 4 OR NOT whole) AS ok FROM p""")
def _(spark, sf):
    n, i = F.col("page_id"), F.col("page_id").cast("string")
    base = F.concat(F.lit("https://v.example/video/"), i)
    p = table(spark, sf, "pages").select(
        "page_id", base.alias("input_url"), F.when(n % 5 == 0, F.col("url")).when(n % 5 == 1, F.concat(F.lit("https://v.example/video/1"), i)).otherwise(base).alias("current_url"),
        F.when(F.contains(F.col("html"), F.lit("$$$")), "").otherwise(visible()).alias("title"), F.when(n % 3 > 0, "2024-01-01").alias("published_at"), F.lit(True).alias("has_publish_time"),
        F.regexp_count("html", F.lit("<p>")).alias("metric_lines"), F.col("html").rlike(r"</html>\s*\z").alias("has_end_marker"))
    return videos.page_evidence(p).select("page_id", "video_id", "errors", "ok")


# --- ranking, reuse, sets ---------------------------------------------------------------------------------

SEARCH = """WITH s AS (SELECT o_custkey AS query_id, o_orderkey AS pos, CASE WHEN o_orderkey % 9 > 0 THEN 'u' || o_orderkey ELSE '' END AS url, o_orderpriority AS author, (floor(o_totalprice)::BIGINT) // 1000 AS likes FROM orders)"""


def search(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 9 > 0, F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))).otherwise("").alias("url"),
        F.col("o_orderpriority").alias("author"), F.floor(F.floor("o_totalprice").cast("long") / 1000).alias("likes"))


@query("rank_search", "T2", SEARCH + """
SELECT query_id, pos, url, likes, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY likes DESC, pos) AS rank FROM s WHERE url <> '' AND contains(author, 'URGENT')) WHERE rank <= 2""")
def _(spark, sf):
    return videos.rank_search(search(spark, sf), n=2, match=F.contains(F.col("author"), F.lit("URGENT"))).select("query_id", "pos", "url", "likes", "rank")


@query("select_result", "T2", SEARCH + """,
a AS (SELECT query_id, arg_min(url, [-likes, pos]) AS url FROM s WHERE url <> '' AND contains(author, 'URGENT') GROUP BY 1), b AS (SELECT query_id, arg_min(url, pos) AS url FROM s WHERE url <> '' GROUP BY 1)
SELECT b.query_id, coalesce(a.url, b.url) AS url FROM b LEFT JOIN a ON a.query_id = b.query_id""")
def _(spark, sf):
    return videos.select_result(search(spark, sf), match=F.contains(F.col("author"), F.lit("URGENT"))).select("query_id", "url")


@query("recent_candidates", "T3", """
WITH c AS (SELECT o_custkey AS k, o_orderkey AS pos, CASE WHEN o_orderkey % 10 > 0 THEN date_diff('day', o_orderdate::DATE, DATE '1999-01-01') END AS age FROM orders WHERE o_orderstatus <> 'P')
SELECT k, pos, age::INT AS age_days, rank FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS rank FROM c WHERE age IS NULL OR age <= 700) WHERE rank <= 3""")
def _(spark, sf):
    c = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos"), "o_orderstatus", F.when(F.col("o_orderkey") % 10 > 0, F.datediff(F.lit("1999-01-01").cast("date"), F.to_date("o_orderdate"))).alias("age_days"))
    return videos.recent_candidates(c, "k", "pos", 3, 700, F.col("o_orderstatus") != "P", True).select("k", "pos", "age_days", "rank")


@query("evidence_score", "A12", """
WITH f AS (SELECT o_custkey AS run_id, o_orderpriority AS p, o_orderkey % 4 AS size FROM orders)
SELECT run_id, (max(CASE WHEN p = '1-URGENT' AND size > 0 THEN 32 ELSE 0 END) + max(CASE WHEN p = '2-HIGH' AND size > 0 THEN 16 ELSE 0 END) + max(CASE WHEN p = '5-LOW' AND size > 0 THEN 1 ELSE 0 END))::BIGINT AS score FROM f GROUP BY 1""")
def _(spark, sf):
    f = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("path"), (F.col("o_orderkey") % 4).alias("size"))
    return videos.evidence_score(f, [("1-URGENT", 32), ("2-HIGH", 16), ("5-LOW", 1)])


@query("best_run", "T5", """
SELECT o_custkey, arg_min(o_orderkey, [-(floor(o_totalprice)::BIGINT // 50000), epoch_us(o_orderdate), o_orderkey]) AS run_id, max(floor(o_totalprice)::BIGINT // 50000) AS score, count(*) AS n_runs FROM orders GROUP BY 1""")
def _(spark, sf):
    r = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("run_id"), F.floor(F.floor("o_totalprice").cast("long") / 50_000).alias("score"), views.micros("o_orderdate").alias("mtime"))
    return videos.best_run(r, "o_custkey").select("o_custkey", "run_id", "score", "n_runs")


HOSTKEY = r"regexp_extract(url, '^https?://([^/]+)', 1)"


@query("match_runs", "J10,T5,U4", rf"""
WITH k AS (SELECT page_id, lower({HOSTKEY}) AS h, regexp_extract(url, '\b(\d{{3,6}})\b', 1) AS i FROM pages),
r AS (SELECT page_id AS request_id, unnest(['h:' || h, 'i:' || i]) AS key FROM k), x AS (SELECT page_id AS run_id, page_id % 7 AS score, 1000 - page_id AS mtime, unnest(['h:' || h, 'i:' || i]) AS key FROM k)
SELECT request_id, arg_min(run_id, [-score, mtime, run_id]) AS run_id FROM r JOIN x ON r.key = x.key WHERE r.key <> 'i:' GROUP BY 1""")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://"), F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("/")).alias("site"), F.regexp_extract("url", r"\b(\d{3,6})\b", 1).alias("num"))
    k = videos.source_keys(p, ["site"], ["num"])
    runs = k.select(F.col("page_id").alias("run_id"), (F.col("page_id") % 7).alias("score"), (1000 - F.col("page_id")).alias("mtime"), "source_keys")
    return videos.match_runs(k.select(F.col("page_id").alias("request_id"), "source_keys"), runs).select("request_id", "run_id")


@query("completeness", "A13", """
WITH e AS (SELECT user_id AS run_id, bool_or(event_type = 'view' AND value > 100) AS m, bool_or(event_type = 'click' AND value > 100) AS s, bool_or(event_type = 'purchase' AND value > 90) AS v, bool_or(event_type = 'signup' AND value > 120) AS t, bool_or(event_type = 'error' AND value > 120) AS f FROM events GROUP BY 1)
SELECT run_id, list_filter([CASE WHEN run_id % 2 = 0 AND NOT (m AND s) THEN 'collect' END, CASE WHEN NOT v THEN 'prepare_video' END, CASE WHEN v AND NOT t THEN 'transcribe' END, CASE WHEN v AND NOT f THEN 'extract_frames' END], lambda x: x IS NOT NULL) AS failed_stages,
  NOT ((run_id % 2 = 0 AND NOT (m AND s)) OR NOT v OR (v AND NOT t) OR (v AND NOT f)) AS evidence_complete FROM e""")
def _(spark, sf):
    has = lambda t, n, name: F.bool_or((F.col("event_type") == t) & (F.col("value") > n)).alias(name)
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        has("view", 100, "has_metadata"), has("click", 100, "has_screenshot"), has("purchase", 90, "has_video"), has("signup", 120, "has_transcript"), has("error", 120, "has_frames"))
    return videos.completeness(e.withColumn("is_url", F.col("run_id") % 2 == 0).withColumn("draft_ok", F.lit(True))).select("run_id", "failed_stages", "evidence_complete")


@query("keep_first", "U1", "SELECT min(doc_id) AS doc_id, text, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def _(spark, sf):
    return scans.keep_first(table(spark, sf, "documents").select("doc_id", "text", "source"), "text", "doc_id")


@query("union_candidates", "U2", """
WITH u AS (SELECT c_nationkey AS url, c_custkey AS pos, 'customer' AS origin, 0 AS n FROM customer UNION ALL SELECT s_nationkey + 20, s_suppkey, 'supplier', 1 FROM supplier)
SELECT url, arg_min(pos, [n, pos]) AS pos, arg_min(origin, [n, pos]) AS origin FROM u GROUP BY 1""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("url"), F.col("c_custkey").alias("pos"))
    s = table(spark, sf, "supplier").select((F.col("s_nationkey") + 20).alias("url"), F.col("s_suppkey").alias("pos"))
    return videos.union_candidates(("customer", c), ("supplier", s)).select("url", "pos", "origin")


@query("set_minus", "U3", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return words.unknown_ids(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey")


@query("select_tracks", "U5", """
WITH p AS (SELECT page_id, [url, replace(url, '://', '://media-audio.'), 'x'] AS media, CASE WHEN page_id % 3 = 0 THEN [url || '#a'] ELSE [] END AS audio, CASE WHEN page_id % 2 = 0 THEN [replace(url, '://', '://media-audio.'), url || '#v'] ELSE [] END AS video FROM pages)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN video[2] ELSE media[1] END AS video_url, CASE WHEN page_id % 3 = 0 THEN audio[1] ELSE media[2] END AS audio_url FROM p""")
def _(spark, sf):
    n, u = F.col("page_id"), F.col("url")
    a = F.replace(u, F.lit("://"), F.lit("://media-audio."))
    none = F.array().cast("array<string>")
    p = table(spark, sf, "pages").select(
        "page_id", F.array(u, a, F.lit("x")).alias("media"), F.when(n % 3 == 0, F.array(F.concat(u, F.lit("#a")))).otherwise(none).alias("audio"),
        F.when(n % 2 == 0, F.array(a, F.concat(u, F.lit("#v")))).otherwise(none).alias("video"))
    return p.select("page_id", videos.select_tracks("media", "audio", "video").alias("t")).select("page_id", "t.*")


@query("match_account", "P10", """
WITH c AS (SELECT c_custkey, c_nationkey AS account_id, c_mktsegment || ' ' || c_name AS author FROM customer)
SELECT c.account_id, c_custkey FROM c WHERE (account_id % 2 = 0 AND contains(lower(replace(author, ' ', '')), 'machinerycust')) OR (account_id % 2 = 1 AND contains(lower(author), '#00000000'))""")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("account_id"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("author"))
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("account_id"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("Machinery Cust"))).otherwise(F.array(F.lit(""), F.lit("#0000 0000"))).alias("names"))
    return videos.match_account(c, a).select("account_id", "c_custkey")


# --- breakdown ---------------------------------------------------------------------------------------------

UTT = "WITH u AS (SELECT conv_id AS media_id, turn AS pos, text, turn * 9000 + length(text) AS start_ms, turn * 9000 + 8000 AS end_ms FROM conversations)"


def utterances(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("media_id"), F.col("turn").alias("pos"), "text", (F.col("turn") * 9000 + F.length("text")).alias("start_ms"), (F.col("turn") * 9000 + 8000).alias("end_ms"))


TIMELINE = UTT + f""",
s AS (SELECT media_id, least(8, greatest(4, CASE WHEN count(*) // 18 = 0 THEN 4 ELSE count(*) // 18 END)) AS n, max(end_ms) AS d FROM u GROUP BY 1),
p AS (SELECT u.*, n, d, ((start_ms + end_ms) * n) // (2 * d) AS bin, {CLEAN} AS t FROM u JOIN s ON u.media_id = s.media_id WHERE start_ms + end_ms < 2 * d),
g AS (SELECT media_id, bin, min(n) AS n, min(d) AS d, string_agg(t, '' ORDER BY pos) AS full_text FROM p GROUP BY 1, 2),
tl AS (SELECT media_id, bin::INT AS bin, n, d, CASE WHEN length(full_text) <= 120 THEN full_text ELSE rtrim(substring(full_text, 1, 120)) || '...' END AS speech FROM g)
"""


@query("structure_timeline", "A5", TIMELINE + """
SELECT media_id, bin, round_even(d * bin / n / 1000.0::DOUBLE, 0)::BIGINT || '-' || round_even(d * (bin + 1) / n / 1000.0::DOUBLE, 0)::BIGINT || 's' AS time, speech,
  CASE WHEN bin = 0 THEN 'Hook / 结果问题' WHEN bin >= n - 1 THEN '收束 / 行动' WHEN bin <= greatest(1, n * 0.35) THEN '场景/痛点' WHEN bin <= greatest(2, n * 0.7) THEN '方法/案例' ELSE '执行要求' END AS function FROM tl""")
def _(spark, sf):
    return videos.structure_timeline(utterances(spark, sf)).drop("start_ms")


@query("nearest_frame", "J4", """
WITH f AS (SELECT user_id AS media_id, event_id AS i, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'view'), r AS (SELECT user_id AS media_id, event_id AS bin, epoch_us(ts) // 1000000 AS s FROM events WHERE event_type = 'click')
SELECT r.media_id, bin, arg_min(i, [abs(t - s), i]) AS i FROM r LEFT JOIN f ON r.media_id = f.media_id GROUP BY 1, 2""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("media_id"), "event_id", "event_type", F.floor(views.micros("ts") / 1_000_000).alias("s"))
    rows = e.filter("event_type = 'click'").select("media_id", F.col("event_id").alias("bin"), F.col("s").alias("start_ms"))
    frames = e.filter("event_type = 'view'").select("media_id", F.col("event_id").alias("index"), F.col("s").alias("frame_ms"))
    return videos.nearest_frame(rows, frames, width=86_400).select("media_id", "bin", F.col("nearest.index").alias("i"))


@query("sentence_buckets", "A6", f"""
WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({CLEAN}, '([.!?])', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
b AS (SELECT doc_id, s, greatest(1, len(s) // 5) AS k, unnest(range(5)) AS bucket FROM c WHERE len(s) > 0)
SELECT doc_id, bucket::INT AS bucket, ['0-3s','3-8s','8-20s','20-45s','45s+'][bucket + 1] AS time, CASE WHEN len(s[bucket * k + 1:(bucket + 1) * k]) = 0 THEN '素材不足' ELSE array_to_string(s[bucket * k + 1:(bucket + 1) * k], ' ') END AS speech,
  ['Hook','场景/痛点','冲突升级','方法/案例','CTA/收束'][bucket + 1] AS function FROM b
UNION ALL SELECT doc_id, 0, '0-3s', '素材不足', 'Hook' FROM c WHERE len(s) = 0 UNION ALL SELECT doc_id, 1, '3s+', '素材不足', '主体内容' FROM c WHERE len(s) = 0""")
def _(spark, sf):
    return videos.sentence_buckets(table(spark, sf, "documents").select("doc_id", "text"), "text", ".!?")


@query("retention_flags", "A8", UTT + " SELECT media_id, count(*) >= 5 AS dense, bool_or(regexp_matches(text, '\\?|que')) AS suspense, bool_or(regexp_matches(text, 'pas|not')) AS emotion, count(*) AS n_utterances FROM u WHERE regexp_matches(text, '\\S') GROUP BY 1")
def _(spark, sf):
    return videos.retention_flags(utterances(spark, sf), suspense=r"\?|que", emotion="pas|not", least=5)


@query("anchor_timeline", "W24", UTT + f""",
h AS (SELECT *, regexp_matches(text, 'pas|not|der') AS hit, {CLEAN} AS t FROM u), p AS (SELECT *, sum(hit::INT) OVER (PARTITION BY media_id ORDER BY pos) AS part FROM h),
g AS (SELECT media_id, part, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_utterances, string_agg(t, '' ORDER BY pos) AS ft FROM p GROUP BY 1, 2), z AS (SELECT media_id, sum(hit::INT) > 3 AS too_coarse FROM h GROUP BY 1)
SELECT g.media_id, part::BIGINT AS part, first_pos, last_pos, n_utterances, ft AS speech, too_coarse FROM g JOIN z ON g.media_id = z.media_id""")
def _(spark, sf):
    return videos.anchor_timeline(utterances(spark, sf), "pas|not|der", rows_used=3)


@query("video_judgments", "A8,P28", f"""
WITH b AS (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN '' ELSE CASE n_chars % 5 WHEN 0 THEN '第一个100万 ' WHEN 1 THEN '心理问题 ' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '对标 三条 ' ELSE '' END || text END AS text,
  CASE n_chars % 4 WHEN 0 THEN '素材不足' WHEN 1 THEN '一百万 ' || text ELSE text END AS hook, text AS pain, n_chars % 2 AS likes, n_chars % 3 AS n_comments, doc_id % 3 AS n_frames FROM documents),
c AS (SELECT *, {CLEAN.replace("text", "hook")} AS h, {CLEAN.replace("text", "pain")} AS p, regexp_matches(text, '100万|一百万') AND contains(text, '对标') AS m FROM b)
SELECT doc_id, CASE WHEN text <> '' THEN CASE WHEN m THEN '先用“第一个100万”给结果诱因，再把赚钱问题收束成“对标一致性”和“心理阻抗”，让用户愿意收藏长视频。'
    ELSE '用“' || CASE WHEN length(h) <= 28 THEN h ELSE rtrim(substring(h, 1, 28)) || '...' END || '”先制造停留，再围绕' || CASE WHEN length(p) <= 24 THEN p ELSE rtrim(substring(p, 1, 24)) || '...' END || '推进。' END
  WHEN likes > 0 OR n_comments > 0 THEN '公开视频有互动信号，但缺少音频和画面证据，不能完整判断爆款结构。' ELSE '素材不足，当前只能基于标题/评论做弱判断' END AS one_line_judgment,
 CASE WHEN hook = '素材不足' THEN '素材不足' WHEN regexp_matches(hook, '100万|一百万') AND contains(text, '三条') THEN '结果问题足够具体，紧跟“三条”制造可获得感。' WHEN contains(text, '心理问题') AND contains(text, '对标') THEN '把方法问题转成心理问题，有冒犯感和反常识停留点。' ELSE '开头能快速点名问题或结果。' END AS hook_retention,
 CASE WHEN m THEN '结果问题 + 三条判断 + 反常识归因 + 标准清单 + 收藏提示。' WHEN hook <> '素材不足' THEN '不是泛讲主题，先抛出“' || CASE WHEN length(h) <= 24 THEN h ELSE rtrim(substring(h, 1, 24)) || '...' END || '”，再给具体场景和方法。' ELSE '素材不足' END AS migration_formula,
 CASE WHEN n_frames > 0 THEN '已抽帧，可进一步读图判断' ELSE '画面素材不足' END AS visual_rhythm FROM c""")
def _(spark, sf):
    n, i, said = F.col("n_chars"), F.col("doc_id"), F.col("text")
    head = F.when(n % 5 == 0, "第一个100万 ").when(n % 5 == 1, "心理问题 ").otherwise("")
    d = table(spark, sf, "documents").select(
        "doc_id", F.when(n % 7 == 0, "").otherwise(F.concat(head, F.when(i % 2 == 0, "对标 三条 ").otherwise(""), said)).alias("text"),
        F.when(n % 4 == 0, "素材不足").when(n % 4 == 1, F.concat(F.lit("一百万 "), said)).otherwise(said).alias("hook"), said.alias("pain"),
        (n % 2).alias("likes"), (n % 3).alias("n_comments"), (i % 3).alias("n_frames"))
    return videos.judgments(d).select("doc_id", "one_line_judgment", "hook_retention", "migration_formula", "visual_rhythm")


@query("video_breakdown", "A5,A7,A8,P26,P27,P28")
def _(spark, sf):
    u = utterances(spark, sf)
    v = u.groupBy("media_id").agg(words.joined_text("pos", "text", " ").alias("text"), F.lit("").alias("title"))
    fr = table(spark, sf, "events").select(F.col("user_id").alias("media_id"), "event_id")
    return videos.video_breakdown(v, u, comments(spark, sf), fr)
