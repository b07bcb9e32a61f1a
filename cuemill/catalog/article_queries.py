"""Queries over articles, pages and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.catalog import views
from cuemill.catalog.base import query, table
from cuemill.catalog.frame_queries import REGIONS
from cuemill.catalog.text_queries import WS
from cuemill.functions import numbers, text, urls
from cuemill.operators import articles
from cuemill.sources import readers, writers

HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':\d*$', ''), '\.+$', '')"
MIXED_SQL = "CASE page_id % 5 WHEN 0 THEN replace(url, '://', '://user:pw@') WHEN 1 THEN upper(url) WHEN 2 THEN 'ftp' || url WHEN 3 THEN url || '.' ELSE url END"


def mixed_urls(p):
    n, u = F.col("page_id"), F.col("url")
    return (F.when(n % 5 == 0, F.replace(u, F.lit("://"), F.lit("://user:pw@"))).when(n % 5 == 1, F.upper(u)).when(n % 5 == 2, F.concat(F.lit("ftp"), u)).when(n % 5 == 3, F.concat(u, F.lit("."))).otherwise(u))


@query("allowed_urls", "P11", rf"""
SELECT page_id, regexp_matches(u, '^(?i)https?://') AND NOT contains(regexp_extract(u, '://([^/?#]*)', 1), '@') AND (h = 'example.com' OR suffix(h, '.example.com') OR h = 'example.net' OR suffix(h, '.example.net')) AS allowed
FROM (SELECT page_id, u, {HOST} AS h FROM (SELECT page_id, {MIXED_SQL} AS u FROM pages))""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", urls.is_allowed_url(mixed_urls(p), ["example.com", "example.net"]).alias("allowed"))


@query("canonical_urls", "P12", rf"""
WITH u AS (SELECT page_id, {MIXED_SQL.replace("ELSE url END", "ELSE url || ';x=1' END")} AS u FROM pages),
p AS (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(u, '://([^/?#]*)', 1)) AS n, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS pa, regexp_extract(u, '(\?[^#]*)', 1) AS q FROM u)
SELECT page_id, CASE WHEN s NOT IN ('http', 'https') THEN u ELSE s || '://' || n || CASE WHEN regexp_replace(regexp_replace(pa, ';[^/]*$', ''), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_replace(pa, ';[^/]*$', ''), '/+$', '') END
  || CASE WHEN suffix(n, 'example.org') THEN '' WHEN q = '?' THEN '' ELSE q END END AS canonical FROM p""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    u = F.when(F.col("page_id") % 5 == 4, F.concat("url", F.lit(";x=1"))).otherwise(mixed_urls(p))
    return p.select("page_id", urls.canonical_url(u, ["example.org"]).alias("canonical"))


@query("media_ids", "P13", r"SELECT page_id, regexp_extract(url, '\b(\d{3,6})\b', 1) AS media_id FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.extract_media_id("url", 3, 6).alias("media_id"))


def article_text():
    n = F.col("n_chars")
    front = F.concat(F.lit("---\ntitle: \"Doc "), F.col("doc_id").cast("string"), F.lit("\"\nauthor: 'a b'\n  and c\n# note\ntags: x\n---\n"))
    return F.when(F.col("lang") == "de", F.concat(front, "text")).when(n % 2 == 0, F.concat(F.lit("![p](i.png)\n\n## Sub\n\n# Head "), "source", F.lit(" #\n\n|t|\n\n"), "text")).otherwise(F.concat(F.lit("> quoted\n"), "text"))


ART = """CASE WHEN lang = 'de' THEN '---' || chr(10) || 'title: "Doc ' || doc_id || '"' || chr(10) || 'author: ''a b''' || chr(10) || '  and c' || chr(10) || '# note' || chr(10) || 'tags: x' || chr(10) || '---' || chr(10) || text
 WHEN n_chars % 2 = 0 THEN '![p](i.png)' || chr(10) || chr(10) || '## Sub' || chr(10) || chr(10) || '# Head ' || source || ' #' || chr(10) || chr(10) || '|t|' || chr(10) || chr(10) || text ELSE '> quoted' || chr(10) || text END"""
CLEAN_ART = "trim(regexp_replace(regexp_replace(regexp_replace(@@, '[`*_~>#-]', '', 'g'), '<[^>]+>', '', 'g'), '" + WS + "', ' ', 'g'))"


@query("article_meta", "P37,S11", rf"""
WITH b AS (SELECT doc_id, source, lang, n_chars, CASE WHEN lang = 'de' THEN text WHEN n_chars % 2 = 0 THEN chr(10) || chr(10) || '## Sub' || chr(10) || chr(10) || '# Head ' || source || ' #' || chr(10) || chr(10) || '|t|' || chr(10) || chr(10) || text ELSE '> quoted' || chr(10) || text END AS body FROM documents),
pa AS (SELECT *, list_filter(list_transform(regexp_split_to_array(body, '\n{{2,}}'), lambda p: {CLEAN_ART.replace("@@", r"array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND x[1] <> '#' AND x[1] <> '|' AND x[1:3] <> '```'), ' ')")}), lambda x: x <> '') AS ps,
  list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND x[1] <> '!' AND x[1] <> '>') AS ls FROM b)
SELECT doc_id, CASE WHEN lang = 'de' THEN 'Doc ' || doc_id WHEN n_chars % 2 = 0 THEN 'Head ' || source WHEN regexp_matches(body, '(?m)^\s*#\s+(.+?)\s*#*\s*$') THEN trim(regexp_replace(regexp_extract(body, '(?m)^\s*#\s+(.+?)\s*#*\s*$', 1), '[`*_~>#-]', '', 'g'))
   ELSE coalesce(trim(regexp_replace(regexp_replace(ls[1], '[`*_~>#-]', '', 'g'), '{WS}', ' ', 'g')), '') END AS title,
 CASE WHEN lang = 'de' THEN 'a b' || chr(10) || 'and c' END AS author, CASE WHEN len(ps) = 0 THEN '' WHEN length(ps[1]) <= 120 THEN ps[1] ELSE regexp_replace(substring(ps[1], 1, 119), '^\s+|\s+$', '', 'g') || '...' END AS summary FROM pa""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", article_text().alias("text"))
    return articles.article_meta(d).select("doc_id", "title", F.col("frontmatter")["author"].alias("author"), "summary")


def image_text():
    return F.concat(F.lit("intro ![al "), "source", F.lit("](a_(1(2(3(4))))_"), F.col("doc_id").cast("string"), F.lit(".png \"t\") mid "), "text", F.lit(" \\![no](x) ![](<b c.jpg>) end"))


@query("extract_images", "P38", r"""
WITH g AS (SELECT doc_id, source, ' mid ' || text || ' \![no](x) ' AS mid FROM documents)
SELECT doc_id, 1 AS ordinal, 'al ' || source AS alt, 'a_(1(2(3(4))))_' || doc_id || '.png' AS destination, 'IMAGE_1' AS placeholder, 'intro ' AS before, left(mid, 100) AS after FROM g
UNION ALL SELECT doc_id, 2, '', 'b c.jpg', 'IMAGE_2', right(mid, 100), ' end' FROM g""")
def _(spark, sf):
    return articles.extract_images(table(spark, sf, "documents").select("doc_id", image_text().alias("text")))


@query("replace_images", "P38", r"""
SELECT doc_id, 'intro IMAGE_1 mid ' || text || ' \![no](x) IMAGE_2 end' AS rewritten, 2 AS n_images, 0 AS image_marks_left FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", image_text().alias("text"))
    return articles.replace_images(d).select("doc_id", "rewritten", "n_images", "image_marks_left")


PICS = """replace(html, '<br>', '<img alt="p" src="i' || page_id || '.png"><IMG src=''j.gif''><br>')"""


def pictured():
    return F.replace(F.col("html"), F.lit("<br>"), F.concat(F.lit('<img alt="p" src="i'), F.col("page_id").cast("string"), F.lit(".png\"><IMG src='j.gif'><br>")))


@query("html_images", "P38,J23", f"""
WITH t AS (SELECT page_id, regexp_extract_all({PICS}, '(?i)(<img\\b[^>]*>)', 1) AS ts FROM pages), x AS (SELECT page_id, unnest(ts) AS tag, generate_subscripts(ts, 1)::INT AS ordinal FROM t)
SELECT page_id, ordinal, regexp_extract(tag, 'alt="([^"]*)"', 1) AS alt, CASE WHEN regexp_matches(tag, 'src="') THEN regexp_extract(tag, 'src="([^"]*)"', 1) ELSE regexp_extract(tag, 'src=''([^'']*)''', 1) END AS source FROM x""")
def _(spark, sf):
    return articles.html_images(table(spark, sf, "pages").select("page_id", pictured().alias("html")))


@query("extract_links", "P39", r"""
WITH h AS (SELECT page_id, replace(replace(html, 'href="/', 'href="https://x.org/'), '<footer>', '<footer><a class="z" href=''http://y.org/a''><b>Y</b> home</a><a href="https://x.org/">  </a>') AS html FROM pages),
m AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*\shref=(?:"(https?://[^"'']+)"|''(https?://[^"'']+)'')[^>]*>(.*?)</a>', 1) AS a, regexp_extract_all(html, '(?is)<a\b[^>]*\shref=(?:"(https?://[^"'']+)"|''(https?://[^"'']+)'')[^>]*>(.*?)</a>', 2) AS b,
  regexp_extract_all(html, '(?is)<a\b[^>]*\shref=(?:"(https?://[^"'']+)"|''(https?://[^"'']+)'')[^>]*>(.*?)</a>', 3) AS t FROM h),
x AS (SELECT page_id, unnest(a) AS a, unnest(b) AS b, unnest(t) AS t, generate_subscripts(a, 1) AS i FROM m), y AS (SELECT page_id, i, CASE WHEN coalesce(a, '') <> '' THEN a ELSE b END AS href, trim(regexp_replace(regexp_replace(regexp_replace(t, '<[^>]+>', '', 'g'), '[`*_~>#-]', '', 'g'), '\s+', ' ', 'g')) AS l FROM x),
f AS (SELECT page_id, href, min(i) AS i, arg_min(l, i) AS l FROM y GROUP BY 1, 2)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i))::INT AS ordinal, href, CASE WHEN l = '' THEN href ELSE l END AS label FROM f""")
def _(spark, sf):
    h = F.replace(F.replace(F.col("html"), F.lit('href="/'), F.lit('href="https://x.org/')), F.lit("<footer>"), F.lit("<footer><a class=\"z\" href='http://y.org/a'><b>Y</b> home</a><a href=\"https://x.org/\">  </a>"))
    return articles.extract_links(table(spark, sf, "pages").select("page_id", h.alias("html")))


ALLOWED = """'section', 'div', 'p', 'h2', 'h3', 'h4', 'h5', 'h6', 'blockquote', 'strong', 'mark', 'em', 's', 'del', 'span', 'code', 'pre', 'a', 'img', 'figure', 'figcaption', 'hr',
 'table', 'thead', 'tbody', 'tr', 'th', 'td', 'sup', 'sub'"""
GATE_HTML = """replace(replace(html, '<article>', '<article id="output" style="color:#000;font-size:12px;font-family:x;line-height:1" data-k="1" onclick="f()">'), '<br>', '<img src=""><a href="javascript:x" style="position: fixed">$$</a>')"""


@query("html_gate", "P41", rf"""
WITH h AS (SELECT page_id, {GATE_HTML} AS html FROM pages),
t AS (SELECT page_id, html, regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)((?:\s[^>]*)?)/?>', 1) AS ns, regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)((?:\s[^>]*)?)/?>', 2) AS attrs FROM h),
x AS (SELECT page_id, unnest(ns) AS n0, coalesce(unnest(attrs), '') AS a FROM t),
y AS (SELECT page_id, lower(n0) AS n, a, regexp_extract(a, '(?i)\sstyle\s*=\s*"([^"]*)"', 1) AS st, regexp_extract(a, '(?i)\sid\s*=\s*"([^"]*)"', 1) AS id FROM x),
i AS (SELECT page_id, unnest(list_filter([CASE WHEN n IN ('style', 'script', 'iframe', 'object', 'form') THEN 'forbidden_element' END, CASE WHEN n NOT IN ({ALLOWED}) THEN 'unsupported_element:' || n END, CASE WHEN st = '' THEN 'missing_inline_style:' || n END,
  CASE WHEN NOT (regexp_matches(st, '(?i)(?:^|;)\s*font-family\s*:\s*[^;\s]') AND regexp_matches(st, '(?i)(?:^|;)\s*font-size\s*:\s*[^;\s]') AND regexp_matches(st, '(?i)(?:^|;)\s*line-height\s*:\s*[^;\s]') AND regexp_matches(st, '(?i)(?:^|;)\s*color\s*:\s*[^;\s]')) THEN 'incomplete_text_style:' || n END,
  CASE WHEN regexp_matches(st, '(?i)position\s*:\s*(?:fixed|sticky)|background-image\s*:|url\(|expression\(') THEN 'unsupported_css' END, CASE WHEN regexp_matches(a, '(?i)\s(?:href|src)\s*=\s*"\s*(?:javascript|vbscript):') THEN 'unsafe_url' END,
  CASE WHEN n = 'img' AND NOT regexp_matches(a, 'src="[^"]') THEN 'missing_image_source' END] || list_transform(list_filter(list_transform(regexp_extract_all(a, '\s([A-Za-z-]+)\s*=', 1), lambda k: lower(k)), lambda k: k = 'class' OR starts_with(k, 'data-') OR starts_with(k, 'on') OR (k = 'id' AND id <> 'output')),
   lambda k: 'forbidden_attribute:' || k), lambda z: z IS NOT NULL)) AS issue FROM y
  UNION ALL SELECT page_id, 'missing_or_duplicate_output_wrapper' FROM h WHERE len(regexp_extract_all(html, '(?i)<[a-z0-9]+\b[^>]*\sid\s*=\s*["'']output["'']')) <> 1
  UNION ALL SELECT page_id, 'raw_markup' FROM h WHERE regexp_matches(array_to_string(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1), chr(1)), ':::|\$\$|\\(?:text|times|rightarrow|underbrace)\b|\\n'))
SELECT h.page_id, coalesce(list_sort(list(DISTINCT issue) FILTER (issue IS NOT NULL)), []) AS issues, count(issue) = 0 AS ok FROM h LEFT JOIN i ON h.page_id = i.page_id GROUP BY 1""")
def _(spark, sf):
    h = F.replace(F.replace(F.col("html"), F.lit("<article>"), F.lit('<article id="output" style="color:#000;font-size:12px;font-family:x;line-height:1" data-k="1" onclick="f()">')), F.lit("<br>"), F.lit('<img src=""><a href="javascript:x" style="position: fixed">$$</a>'))
    return articles.html_gate(table(spark, sf, "pages").select("page_id", h.alias("html")))


@query("copy_gate", "P41", r"""
SELECT page_id, list_sort(list_filter([CASE WHEN NOT regexp_matches(h, '(?i)<body\b') THEN 'missing_copy_body' END, CASE WHEN regexp_matches(h, '(?i)<(?:style|script|button|iframe|form|object)\b') THEN 'forbidden_copy_element' END,
  CASE WHEN regexp_matches(h, '(?i)<img\b|<a\b[^>]*\shref\s*=') THEN 'copy_requires_image_positions_and_plain_links' END, CASE WHEN regexp_matches(h, '(?i)<[a-z][a-z0-9]*[^>]*\s(?:id|class|data-[a-z-]+|on[a-z]+)\s*=') THEN 'forbidden_copy_attribute' END], lambda x: x IS NOT NULL)) AS issues,
  NOT regexp_matches(h, '(?i)<(?:style|script|button|iframe|form|object)\b|<img\b|<a\b[^>]*\shref\s*=|<[a-z][a-z0-9]*[^>]*\s(?:id|class|data-[a-z-]+|on[a-z]+)\s*=') AND regexp_matches(h, '(?i)<body\b') AS ok
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html ELSE '<body>' || regexp_extract(html, '(?s)<article>(.*)</article>', 0) || '</body>' END AS h FROM pages)""")
def _(spark, sf):
    h = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.concat(F.lit("<body>"), F.regexp_extract("html", "(?s)<article>(.*)</article>", 0), F.lit("</body>")))
    return articles.copy_gate(table(spark, sf, "pages").select("page_id", h.alias("html")))


META_HTML = """CASE page_id % 4 WHEN 0 THEN replace(html, '<title>', '<meta name="author" content="A B"><meta content=''about'' name="description"><title>') WHEN 1 THEN regexp_replace(html, '<title>[^<]*</title>', '') WHEN 2 THEN replace(html, '<body>', '<body><p>Short.</p>') ELSE html END"""


@query("html_meta", "P50", rf"""
WITH h AS (SELECT page_id, {META_HTML} AS h FROM pages),
m AS (SELECT *, regexp_extract(h, '(?i)<title>([^<]+)</title>', 1) AS t, trim(regexp_replace(regexp_extract(h, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS h1, regexp_replace(regexp_extract(h, '(?i)<p[^>]*>([^<]+)</p>', 1), '^\s+|\s+$', '', 'g') AS p FROM h)
SELECT page_id, CASE WHEN t <> '' THEN t ELSE h1 END AS title, CASE WHEN page_id % 4 = 0 THEN 'A B' ELSE '' END AS author,
 CASE WHEN page_id % 4 = 0 THEN 'about' WHEN length(p) > 120 THEN substring(p, 1, 117) || '...' WHEN length(p) > 20 THEN p ELSE '' END AS summary, length(coalesce(nullif(regexp_extract(h, '(?is)<body[^>]*>(.*)</body>', 1), ''), h))::INT AS body_chars FROM m""")
def _(spark, sf):
    n, h = F.col("page_id"), F.col("html")
    x = (F.when(n % 4 == 0, F.replace(h, F.lit("<title>"), F.lit("<meta name=\"author\" content=\"A B\"><meta content='about' name=\"description\"><title>")))
         .when(n % 4 == 1, F.regexp_replace(h, "<title>[^<]*</title>", "")).when(n % 4 == 2, F.replace(h, F.lit("<body>"), F.lit("<body><p>Short.</p>"))).otherwise(h))
    return articles.html_meta(table(spark, sf, "pages").select("page_id", x.alias("html")))


@query("emphasis_blocks", "P51", """
WITH l AS (SELECT doc_id, lang, len(string_split(text, chr(10))) AS n, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS f,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*(?:#{1,6}\\s|[-*+]\\s|\\d+\\.\\s|!\\[)'))) AS bad FROM documents)
SELECT doc_id, 0 AS block_no, n AS start_line, n + 2 AS end_line, 1 AS n_lines, NULL AS problem FROM l WHERE lang = 'en'
UNION ALL SELECT doc_id, 0, 4, 4 + n + 1, f, CASE WHEN f = 0 THEN 'empty' WHEN bad > 0 THEN 'not_a_paragraph' END FROM l WHERE lang = 'de'
UNION ALL SELECT doc_id, 0, 0, 2, 1, 'not_a_paragraph' FROM l WHERE lang = 'fr' UNION ALL SELECT doc_id, 1, 3, NULL, f, 'unclosed' FROM l WHERE lang = 'fr'
UNION ALL SELECT doc_id, 0, 0, NULL, 0, 'nested' FROM l WHERE lang = 'es' UNION ALL SELECT doc_id, 1, 1, 2, 0, 'empty' FROM l WHERE lang = 'es'""")
def _(spark, sf):
    e, t = "::: emphasis\n", F.col("text")
    x = (F.when(F.col("lang") == "en", F.concat(t, F.lit("\n" + e + "A line.\n:::\n"))).when(F.col("lang") == "de", F.concat(F.lit("```\n" + e + ":::\n```\n" + e), t, F.lit("\n:::")))
         .when(F.col("lang") == "fr", F.concat(F.lit(e + "# h\n:::\n" + e), t)).otherwise(F.concat(F.lit(e + e + ":::\n"), t)))
    return articles.emphasis_blocks(table(spark, sf, "documents").select("doc_id", x.alias("text")))


ASSETS = """WITH n AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS w FROM pages),
a AS (SELECT CASE WHEN length(w) % 3 = 0 THEN 'b' ELSE 'a' END AS root, 'img/' || w || CASE WHEN length(w) % 2 = 0 THEN '.png' ELSE '.txt' END AS path FROM n WHERE page_id < 1000000 AND length(w) > 3 UNION ALL SELECT 'c', 'img/' || w || '.png' FROM n WHERE length(w) = 6),
p AS (SELECT path, count(DISTINCT root) AS r FROM a GROUP BY 1),
f AS (SELECT page_id, w, CASE WHEN length(w) % 7 = 0 THEN '/img/' || w WHEN length(w) % 7 = 1 THEN 'https://x/' || w WHEN length(w) % 7 = 2 THEN '../' || w ELSE './img/' || w || CASE WHEN length(w) % 2 = 0 THEN '.png' ELSE '.txt' END END AS ref FROM n)"""


@query("resolve_assets", "J23", ASSETS + """
SELECT page_id, w, ref, CASE WHEN ref LIKE '/%' THEN 'absolute' WHEN ref LIKE 'https:%' THEN 'remote' WHEN ref LIKE '../%' THEN 'outside' WHEN r IS NULL THEN 'missing' WHEN r > 1 THEN 'ambiguous' WHEN NOT suffix(ref, '.png') THEN 'unsupported' ELSE 'ok' END AS status
FROM f LEFT JOIN p ON substring(ref, 3) = p.path""")
def _(spark, sf):
    w, n = F.col("w"), F.length("w")
    nav = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("w"))
    ext = F.when(n % 2 == 0, ".png").otherwise(".txt")
    assets = nav.filter(n > 3).select(F.when(n % 3 == 0, "b").otherwise("a").alias("root"), F.concat(F.lit("img/"), w, ext).alias("path")).unionByName(
        nav.filter(n == 6).select(F.lit("c").alias("root"), F.concat(F.lit("img/"), w, F.lit(".png")).alias("path")))
    ref = F.when(n % 7 == 0, F.concat(F.lit("/img/"), w)).when(n % 7 == 1, F.concat(F.lit("https://x/"), w)).when(n % 7 == 2, F.concat(F.lit("../"), w)).otherwise(F.concat(F.lit("./img/"), w, ext))
    return articles.resolve_assets(nav.withColumn("ref", ref), assets)


@query("markdown_image_refs", "J23", """
SELECT doc_id, 0 AS ref_no, 'a_(1(2(3(4))))_' || doc_id || '.png' AS ref, '' AS width FROM documents UNION ALL SELECT doc_id, 1, '<b c.jpg>', '' FROM documents UNION ALL SELECT doc_id, 2, 'pics/' || lang || '.png', (n_chars % 900 + 1)::VARCHAR FROM documents""")
def _(spark, sf):
    t = F.concat(image_text(), F.lit(" ![[ pics/"), "lang", F.lit(".png | "), (F.col("n_chars") % 900 + 1).cast("string"), F.lit("]]"))
    return articles.markdown_image_refs(table(spark, sf, "documents").select("doc_id", t.alias("text")))


@query("forbidden_keys", "P49", """
SELECT event_id, unnest(['a.k', 'l[1].k', 'l[1].d[0].k']) AS path FROM events""")
def _(spark, sf):
    p = F.col("props")
    j = F.concat(F.lit('{"a":'), p, F.lit(',"l":[1,{"k":2,"d":['), p, F.lit("]}]}"))
    return articles.forbidden_keys(table(spark, sf, "events").select("event_id", j.alias("props")), "props", ("k",))


@query("link_safety", "P53", r"""
WITH n AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages),
m AS (SELECT page_id, CASE length(h) % 8 WHEN 0 THEN 'javascript:' || h WHEN 1 THEN 'https:/' || h WHEN 2 THEN 'C:' || h WHEN 3 THEN 'MailTo:x' || h WHEN 4 THEN 'gopher:' || h WHEN 5 THEN substring(h, 2) WHEN 6 THEN '/' || h ELSE h END AS h, length(h) % 8 AS k FROM n)
SELECT page_id, h AS href, CASE k WHEN 0 THEN 'unsafe_scheme' WHEN 1 THEN 'safe' WHEN 2 THEN 'absolute_path' WHEN 3 THEN 'safe' WHEN 4 THEN 'unknown_scheme' WHEN 5 THEN 'relative' WHEN 6 THEN 'safe' ELSE 'absolute_path' END AS safety FROM m""")
def _(spark, sf):
    h = F.col("h")
    k = F.length(h) % 8
    nav = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h"))
    x = (F.when(k == 0, F.concat(F.lit("javascript:"), h)).when(k == 1, F.concat(F.lit("https:/"), h)).when(k == 2, F.concat(F.lit("C:"), h)).when(k == 3, F.concat(F.lit("MailTo:x"), h)).when(k == 4, F.concat(F.lit("gopher:"), h))
         .when(k == 5, F.substring(h, F.lit(2), F.length(h))).when(k == 6, F.concat(F.lit("/"), h)).otherwise(h))
    return nav.select("page_id", x.alias("href"), urls.link_safety(x).alias("safety"))


@query("extract_tasks", "P45", r"""
WITH dl AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, (generate_subscripts(ls, 1) - 1)::INT AS line_no FROM dl)
SELECT doc_id, line_no, length(line) % 3 = 0 AS done, trim(line) AS task FROM l WHERE length(line) % 3 < 2 AND trim(line) <> ''""")
def _(spark, sf):
    x = F.array_join(F.transform(F.split("text", "\n"), lambda s: F.when(F.length(s) % 3 == 0, F.concat(F.lit("- [x] "), s)).when(F.length(s) % 3 == 1, F.concat(F.lit(" * [ ] "), s)).otherwise(s)), "\n")
    return articles.extract_tasks(table(spark, sf, "documents").select("doc_id", x.alias("text")))


# --- files ------------------------------------------------------------------------------------------------


@query("stamped_text", "S3,S4", "WITH " + views.LINES + r""",
s AS (SELECT doc_id AS media_id, line_no, line FROM lines), h AS (SELECT media_id, bool_or(length(line) % 2 = 0 AND regexp_matches(line, '\S')) AS any_stamp FROM s GROUP BY 1)
SELECT s.media_id, (row_number() OVER (PARTITION BY s.media_id ORDER BY line_no) - 1)::INT AS pos, line_no + 0.5::DOUBLE AS start, line_no + 2.0::DOUBLE AS "end", trim(line) AS text FROM s WHERE length(line) % 2 = 0 AND regexp_matches(line, '\S')
UNION ALL SELECT doc_id, 0, NULL, NULL, text FROM documents JOIN h ON doc_id = media_id WHERE NOT any_stamp AND regexp_matches(text, '\S')""")
def _(spark, sf):
    x = F.array_join(F.transform(F.split("text", "\n"), lambda s, i: F.when(F.length(s) % 2 == 0, F.concat(F.lit("["), i.cast("string"), F.lit(".5-"), (i + 2).cast("string"), F.lit("] "), s)).otherwise(s)), "\n")
    return readers.stamped_rows(table(spark, sf, "documents").select(F.col("doc_id").alias("media_id"), x.alias("text")))


@query("subtitle_lines", "S9,S10", "WITH " + views.LINES + """
SELECT doc_id AS media_id, line_no, line_no * 3000 + 40 AS start_ms, line_no * 3000 + 1230 AS end_ms, '{a} ' || line AS text FROM lines WHERE line_no % 2 = 0""")
def _(spark, sf):
    c = views.doc_lines(spark, sf).select(F.col("doc_id").alias("media_id"), F.col("line_no").alias("cue_no"), (F.col("line_no") * 3000 + 40).alias("start_ms"), (F.col("line_no") * 3000 + 1230).alias("end_ms"), F.concat(F.lit("{a} "), "line").alias("text"))
    from cuemill.operators.words import joined_text
    lines = writers.ass_lines(c).withColumn("value", F.when(F.col("cue_no") % 2 == 1, F.replace(F.col("value"), F.lit(",Caption,"), F.lit(",Other,"))).otherwise(F.col("value")))
    return readers.ass_rows(lines.groupBy("media_id").agg(joined_text("cue_no", "value", "\n").alias("text")))


@query("whisper_segments", "S2", """
SELECT conv_id AS media_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS utt_pos, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, turn * 1500.0::DOUBLE AS start_time, turn * 1500.0::DOUBLE + 1250 AS end_time FROM conversations WHERE length(text) % 4 > 0""")
def _(spark, sf):
    t = F.when(F.length("text") % 4 > 0, F.col("text")).otherwise(F.lit(" "))
    seg = F.struct(F.col("turn"), t.alias("text"), (F.col("turn") * 1.5).alias("start"), (F.col("turn") * 1.5 + 1.25).alias("end"), F.array(F.struct(F.lit(" w").alias("word"), F.lit(0.0).alias("start"), F.lit(0.1).alias("end"))).alias("words"))
    raw = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("media_id")).agg(F.array_sort(F.collect_list(seg)).alias("segments"))
    return readers.whisper_rows(raw).drop("words")


@query("sniff_images", "S13", """
SELECT doc_id, CASE WHEN strlen(text) + [12, 4, 3, 4, 2, 0][doc_id % 6 + 1] < 12 THEN NULL ELSE CASE doc_id % 6 WHEN 0 THEN 'image/webp' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/gif' WHEN 4 THEN 'image/bmp' END END AS image_type, NOT (doc_id % 6 IN (1, 2) AND strlen(text) + [12, 4, 3, 4, 2, 0][doc_id % 6 + 1] >= 12 AND strlen(text) + CASE doc_id % 6 WHEN 1 THEN 4 ELSE 3 END <= 3000) AS needs_conversion FROM documents""")
def _(spark, sf):
    i = F.col("doc_id") % 6
    magic = F.when(i == 0, "524946460000000057454250").when(i == 1, "89504E47").when(i == 2, "FFD8FF").when(i == 3, "47494638").when(i == 4, "424D").otherwise("")
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.unhex(magic), F.encode("text", "UTF-8")).alias("content"))
    return readers.sniff_images(d, max_bytes=3000).drop("content")


@query("comment_rows", "S5,S15", """
SELECT c_custkey AS media_id, CASE WHEN c_custkey % 3 = 0 THEN 'Customer' ELSE c_name END AS title, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END AS likes, CASE WHEN c_custkey % 5 > 0 THEN 0 END AS pos, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS text FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    metrics = F.when(k % 2 == 0, F.struct(k.alias("likes"), F.lit(1).cast("long").alias("comments"), F.lit(0).cast("long").alias("collects"), F.lit(0).cast("long").alias("shares")))
    com = F.when(k % 5 > 0, F.array(F.struct(none.alias("author"), F.col("c_mktsegment").alias("text"), none.alias("time"), k.alias("likes"), none.alias("signal"))))
    v = table(spark, sf, "customer").select(
        k.alias("media_id"), F.lit("/in/Customer.mp4").alias("input"), none.alias("url"), F.when(k % 3 == 0, " ").otherwise(F.col("c_name")).alias("title"), none.alias("author"), none.alias("publishedAt"), metrics.alias("metrics"), com.alias("comments"))
    v = readers.with_default_metadata(v)
    return v.select("media_id", "title", F.col("metrics.likes").alias("likes"), F.posexplode_outer("comments").alias("pos", "c")).select("media_id", "title", "likes", "pos", "c.text")


@query("fingerprint", "S12")
def _(spark, sf):
    return readers.fingerprint(spark, sf, "*.parquet")


# --- streaming twins in batch form --------------------------------------------------------------------------


@query("latest_stage", "ST1,S8", """
WITH e AS (SELECT user_id AS run_id, event_type AS stage, epoch_us(ts) AS at_us, event_id AS seq, CASE WHEN value > 60 THEN 'succeeded' WHEN value > 30 THEN 'running' ELSE 'failed' END AS status, floor(value)::INT AS exit_code FROM events)
SELECT run_id, stage, arg_max(status, [at_us, seq]) AS status, arg_max(exit_code, [at_us, seq]) AS exit_code, min(at_us) FILTER (status = 'running') AS started_us, max(at_us) FILTER (status <> 'running') AS finished_us, count(*) AS n_events FROM e GROUP BY 1, 2""")
def _(spark, sf):
    from cuemill.streaming import streams
    v = F.col("value")
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.timestamp_micros(views.micros("ts")).alias("at"), F.col("event_id").alias("seq"),
        F.when(v > 60, "succeeded").when(v > 30, "running").otherwise("failed").alias("status"), F.floor(v).cast("int").alias("exit_code"))
    r = streams.latest_stage(e)
    return r.select("run_id", "stage", "status", "exit_code", F.unix_micros("started_at").alias("started_us"), F.unix_micros("finished_at").alias("finished_us"), "n_events")


@query("pause_sessions", "ST2", """
WITH e AS (SELECT user_id AS media_id, epoch_us(ts) AS t FROM events), b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY media_id ORDER BY t) < 7200000000 THEN 0 ELSE 1 END AS n FROM e),
g AS (SELECT *, sum(n) OVER (PARTITION BY media_id ORDER BY t) AS g FROM b)
SELECT media_id, min(t) AS start_us, max(t) AS last_us, count(*) AS n FROM g GROUP BY media_id, g""")
def _(spark, sf):
    from cuemill.streaming import streams
    e = table(spark, sf, "events").select(F.col("user_id").alias("media_id"), F.timestamp_micros(views.micros("ts")).alias("at"))
    s = streams.pause_sessions(e, "2 hours")
    return s.select("media_id", F.unix_micros("start_at").alias("start_us"), F.unix_micros("last_at").alias("last_us"), "n")


@query("speech_regions_stream", "ST3", REGIONS + " SELECT media_id, start_frame, end_frame, peak FROM regions WHERE closed")
def _(spark, sf):
    from cuemill.streaming import streams
    from cuemill.session import stage
    f = stage(views.frames(spark, sf).select("media_id", "frame", F.col("value").alias("p_speech")), "frames")
    live = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 4).parquet(f.inputFiles()[0].rsplit("/", 1)[0])
    return streams.drain(streams.speech_regions_stream(live, 60, 25, 2), "regions")
