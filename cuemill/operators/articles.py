"""Articles, Markdown documents and HTML pages. Row-local expressions unless a join is named."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions import rules, text, urls

FRONTMATTER = r"(?s)^\x{FEFF}?---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)(.*)$"


def unquote(c: Column) -> Column:
    t = F.trim(c)
    inner = F.regexp_extract(t, r"(?s)^(?:\"(.*)\"|'(.*)')$", 0)
    return F.when((inner != "") & (F.length(t) >= 2), F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def frontmatter(c) -> Column:
    """Struct of the frontmatter as a map (later keys win; indented lines join the key above) and the body."""
    t = F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"^\x{FEFF}", "")
    has = t.rlike(FRONTMATTER)
    head = F.regexp_extract(t, FRONTMATTER, 1)
    # An indented, non-comment line continues the value above: mark it before splitting into lines.
    folded = F.regexp_replace(F.regexp_replace(head, r"\r\n", "\n"), r"\n[ \t]+(?=[^\s#])", "\u0001")
    lines = F.filter(F.split(folded, "\n"), lambda x: x.rlike(r"^[A-Za-z0-9_-]+\s*:"))
    entry = lambda x: F.struct(
        F.regexp_extract(x, r"^([A-Za-z0-9_-]+)\s*:", 1).alias("key"),
        F.trim(F.array_join(F.transform(F.split(F.regexp_extract(x, r"(?s)^[A-Za-z0-9_-]+\s*:\s*(.*)$", 1), "\u0001"), unquote), "\n")).alias("value"))
    entries = F.transform(lines, entry)
    last = F.filter(entries, lambda e: F.size(F.filter(entries, lambda o: o["key"] == e["key"])) == 1)
    repeated = F.filter(entries, lambda e: F.size(F.filter(entries, lambda o: o["key"] == e["key"])) > 1)
    newest = F.transform(
        F.array_distinct(F.transform(repeated, lambda e: e["key"])),
        lambda k: F.element_at(F.filter(repeated, lambda e: e["key"] == k), -1))
    none = F.map_from_entries(F.slice(entries, 1, 0))
    return F.struct(
        F.when(has, F.map_from_entries(F.concat(last, newest))).otherwise(none).alias("frontmatter"),
        F.when(has, F.regexp_extract(t, FRONTMATTER, 2)).otherwise(t).alias("body"))


def _clean_summary(c: Column) -> Column:
    return text.clean_text(F.regexp_replace(text.strip_md(c, "article"), "<[^>]+>", ""))


def article_meta(df: DataFrame, column: str = "text", max_length: int = 120) -> DataFrame:
    """Add frontmatter, body, title (frontmatter, first heading, first plain line) and summary (first usable paragraph)."""
    d = df.withColumn("__fm", frontmatter(column)).select("*", "__fm.frontmatter", "__fm.body").drop("__fm")
    body = F.col("body")
    heading = F.regexp_extract(body, r"(?m)^\s*#\s+(.+?)\s*#*\s*$", 1)
    lines = F.transform(F.split(body, r"\r?\n"), text.clean_ends)
    plain = F.filter(lines, lambda x: (x != "") & ~x.startswith("!") & ~x.startswith(">"))
    title = F.coalesce(
        F.when(F.col("frontmatter")["title"] != "", F.col("frontmatter")["title"]),
        F.when(heading != "", text.strip_md(heading, "article")), text.strip_md(F.get(plain, F.lit(0)), "article"), F.lit(""))
    paragraphs = F.split(F.regexp_replace(body, r"!\[[^\]]*\]\([^)]+\)", ""), r"\n{2,}")

    def flat(p):
        kept = F.filter(
            F.transform(F.split(p, r"\r?\n"), text.clean_ends),
            lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("|") & ~x.startswith("```"))
        return _clean_summary(F.array_join(kept, " "))

    usable = F.filter(F.transform(paragraphs, flat), lambda x: x != "")
    return d.withColumn("title", title).withColumn("summary", text.truncate_text(F.coalesce(F.get(usable, F.lit(0)), F.lit("")), max_length))


def image_address(depth: int = 8) -> str:
    """Pattern of an image's address: no blanks outside brackets, brackets nested up to ``depth`` deep. Every part is possessive
    (no two can begin alike), so a long or unbalanced address is read once."""
    plain = r"[^()\\]++|\\[\s\S]"
    inner = rf"\((?:{plain})*+\)"
    for _ in range(depth - 1):
        inner = rf"\((?:{plain}|{inner})*+\)"
    return rf"<[^>]*+>|(?:[^()\s\\]++|\\.|{inner})++"


IMAGE = rf"(?<!\\)!\[((?:[^\]\\]++|\\.)*+)\]\(\s*+({image_address()})(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)"


def extract_images(df: DataFrame, column: str = "text", prefix: str = "IMAGE_", context: int = 100) -> DataFrame:
    """One row per Markdown image in order: alt, destination, placeholder and the text either side.
    Brackets in an address may nest eight deep; ``image_marks_left`` tells what the grammar could not read."""
    rest = [c for c in df.columns if c != column]
    d = df.select(*rest, column, F.split(column, IMAGE).alias("__gaps"),
                  F.regexp_extract_all(column, F.lit(IMAGE), F.lit(1)).alias("__alts"),
                  F.regexp_extract_all(column, F.lit(IMAGE), F.lit(2)).alias("__dests"))
    d = d.select(*rest, "__gaps", F.posexplode(F.arrays_zip("__alts", "__dests")).alias("i", "m"))
    return d.select(
        *rest, (F.col("i") + 1).alias("ordinal"), F.col("m.__alts").alias("alt"),
        F.regexp_replace(F.col("m.__dests"), "^<|>$", "").alias("destination"),
        F.concat(F.lit(prefix), (F.col("i") + 1).cast("string")).alias("placeholder"),
        F.right(F.get("__gaps", F.col("i")), F.lit(context)).alias("before"),
        F.left(F.get("__gaps", F.col("i") + 1), F.lit(context)).alias("after"))


def replace_images(df: DataFrame, column: str = "text", prefix: str = "IMAGE_") -> DataFrame:
    """Body with each image replaced by its numbered placeholder, the count, and unread image marks."""
    gaps = F.split(column, IMAGE)
    parts = F.transform(gaps, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(prefix), i.cast("string"), x)))
    out = df.withColumn("rewritten", F.array_join(parts, "")).withColumn("n_images", F.size(gaps) - 1)
    return out.withColumn("image_marks_left", F.regexp_count("rewritten", F.lit(r"(?<!\\)!\[[^\]]*\]\(")).cast("int"))


def html_images(pages: DataFrame, page_id: str = "page_id", column: str = "html") -> DataFrame:
    """One row per ``<img>`` in order with alt and source."""
    tags = F.regexp_extract_all(column, F.lit(r"(?i)(<img\b[^>]*>)"), F.lit(1))
    t = pages.select(page_id, F.posexplode(tags).alias("i", "tag"))
    return t.select(page_id, (F.col("i") + 1).alias("ordinal"), attribute("tag", "alt").alias("alt"), attribute("tag", "src").alias("source"))


def attribute(c, name: str) -> Column:
    """Value of an attribute in a tag; empty when it is absent."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(
        F.nullif(F.regexp_extract(c, rf'(?i)\s{name}\s*=\s*"([^"]*)"', 1), F.lit("")),
        F.regexp_extract(c, rf"(?i)\s{name}\s*=\s*'([^']*)'", 1))


LINK = r"""(?is)<a\b[^>]*\shref=(?:"(https?://[^"']+)"|'(https?://[^"']+)')[^>]*>(.*?)</a>"""


def extract_links(pages: DataFrame, page_id: str = "page_id", column: str = "html", pattern: str = LINK) -> DataFrame:
    """Distinct absolute links per page in first-seen order, with their text (or the address). Row-local:
    repeats are dropped inside the row, so nothing is shuffled."""
    zipped = F.arrays_zip(
        F.regexp_extract_all(column, F.lit(pattern), F.lit(1)).alias("d"), F.regexp_extract_all(column, F.lit(pattern), F.lit(2)).alias("s"),
        F.regexp_extract_all(column, F.lit(pattern), F.lit(3)).alias("t"))
    found = F.transform(zipped, lambda x: F.struct(F.when(x["d"] != "", x["d"]).otherwise(x["s"]).alias("href"), x["t"].alias("label")))
    hrefs = F.transform(found, lambda x: x["href"])
    first = F.filter(F.transform(found, lambda x, i: F.struct(x["href"].alias("href"), x["label"].alias("label"), (F.array_position(hrefs, x["href"]) == i + 1).alias("new"))), lambda x: x["new"])
    rows = pages.select(page_id, F.posexplode(first).alias("i", "l"))
    label = _clean_summary(F.regexp_replace(F.col("l.label"), "<[^>]+>", ""))
    return rows.select(page_id, (F.col("i") + 1).alias("ordinal"), F.col("l.href").alias("href"),
                       F.when(label == "", F.col("l.href")).otherwise(label).alias("label"))


def html_tags(pages: DataFrame, page_id: str = "page_id", column: str = "html") -> DataFrame:
    """One row per opening tag, in order: name and attribute text."""
    pattern = r"<([a-zA-Z][a-zA-Z0-9]*)((?:\s[^>]*)?)/?>"
    zipped = F.arrays_zip(F.regexp_extract_all(column, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(column, F.lit(pattern), F.lit(2)).alias("attrs"))
    t = pages.select(page_id, F.posexplode(zipped).alias("tag_no", "t"))
    return t.select(page_id, "tag_no", F.lower("t.name").alias("tag"), F.coalesce("t.attrs", F.lit("")).alias("attrs"))


def tag_issues(tag: Column, attrs: Column, allowed=tuple(rules.ALLOWED_TAGS)) -> Column:
    """Array of issue codes of one opening tag."""
    style = attribute(attrs, "style")
    ident = attribute(attrs, "id")
    props = ["font-family", "font-size", "line-height", "color"]
    complete = F.lit(True)
    for p in props:
        complete = complete & style.rlike(rf"(?i)(?:^|;)\s*{p}\s*:\s*[^;\s]")
    bad_names = F.array_distinct(F.filter(
        F.transform(F.regexp_extract_all(attrs, F.lit(r"\s([A-Za-z-]+)\s*="), F.lit(1)), lambda a: F.lower(a)),
        lambda a: (a == "class") | a.startswith("data-") | a.startswith("on") | ((a == "id") & (ident != "output"))))
    single = F.array_compact(F.array(
        F.when(tag.isin(*rules.FORBIDDEN_TAGS), F.lit("forbidden_element")),
        F.when(~tag.isin(*allowed), F.concat(F.lit("unsupported_element:"), tag)),
        F.when(style == "", F.concat(F.lit("missing_inline_style:"), tag)),
        F.when(~complete, F.concat(F.lit("incomplete_text_style:"), tag)),
        F.when(style.rlike(r"(?i)position\s*:\s*(?:fixed|sticky)|background-image\s*:|url\(|expression\("), F.lit("unsupported_css")),
        F.when(attribute(attrs, "src").rlike(r"(?i)^\s*(?:javascript|vbscript):") | attribute(attrs, "href").rlike(r"(?i)^\s*(?:javascript|vbscript):"), F.lit("unsafe_url")),
        F.when((tag == "img") & (attribute(attrs, "src") == ""), F.lit("missing_image_source"))))
    return F.concat(single, F.transform(bad_names, lambda a: F.concat(F.lit("forbidden_attribute:"), a)))


def html_gate(pages: DataFrame, page_id: str = "page_id", column: str = "html", allowed=tuple(rules.ALLOWED_TAGS)) -> DataFrame:
    """Distinct compatibility issues per page, in order, and the verdict. Tags are read by pattern: style that is
    inherited and contrast through nesting are outside it. All inside the row, so no shuffle."""
    pattern = r"<([a-zA-Z][a-zA-Z0-9]*)((?:\s[^>]*)?)/?>"
    zipped = F.arrays_zip(
        F.regexp_extract_all(column, F.lit(pattern), F.lit(1)).alias("name"),
        F.regexp_extract_all(column, F.lit(pattern), F.lit(2)).alias("attrs"))
    per_tag = F.flatten(F.transform(zipped, lambda t: tag_issues(F.lower(t["name"]), t["attrs"], allowed)))
    outputs = F.regexp_count(column, F.lit(r"(?i)<[a-z0-9]+\b[^>]*\sid\s*=\s*[\"']output[\"']"))
    raw = F.regexp_replace(column, r"(?is)<(pre|code)\b.*?</\1>", "")
    paragraphs = F.array_join(F.regexp_extract_all(raw, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), "\u0001")
    whole = F.array_compact(F.array(
        F.when(outputs != 1, F.lit("missing_or_duplicate_output_wrapper")),
        F.when(paragraphs.rlike(r":::|\$\$|\\(?:text|times|rightarrow|underbrace)\b|\\n"), F.lit("raw_markup"))))
    issues = F.array_sort(F.array_distinct(F.concat(whole, per_tag)))
    return pages.select(page_id, issues.alias("issues")).withColumn("ok", F.size("issues") == 0)


def copy_gate(pages: DataFrame, page_id: str = "page_id", column: str = "html") -> DataFrame:
    """Issues of a page meant for pasting: no script parts, pictures or live links, no ids, classes or handlers."""
    c = F.col(column)
    attrs = F.array_join(F.regexp_extract_all(c, F.lit(r"<[a-zA-Z][a-zA-Z0-9]*((?:\s[^>]*)?)>"), F.lit(1)), " ")
    checks = [
        (~c.rlike(r"(?i)<body\b"), "missing_copy_body"),
        (c.rlike(r"(?i)<(?:style|script|button|iframe|form|object)\b"), "forbidden_copy_element"),
        (c.rlike(r"(?i)<img\b") | c.rlike(r"(?i)<a\b[^>]*\shref\s*="), "copy_requires_image_positions_and_plain_links"),
        (attrs.rlike(r"(?i)\s(?:id|class|data-[a-z-]+|on[a-z]+)\s*="), "forbidden_copy_attribute"),
    ]
    issues = F.array_sort(F.array_compact(F.array(*[F.when(x, F.lit(code)) for x, code in checks])))
    return pages.select(page_id, issues.alias("issues")).withColumn("ok", F.size("issues") == 0)


def html_meta(pages: DataFrame, page_id: str = "page_id", column: str = "html") -> DataFrame:
    """Title, author, summary and the body part of HTML pages."""
    c = F.col(column)
    some = lambda x: F.when(x != "", x)

    def meta(name):
        return F.coalesce(
            some(F.regexp_extract(c, rf"""(?i)<meta\s+name=["']{name}["']\s+content=["']([^"']+)["']""", 1)),
            some(F.regexp_extract(c, rf"""(?i)<meta\s+content=["']([^"']+)["']\s+name=["']{name}["']""", 1)))

    h1 = F.trim(F.regexp_replace(F.regexp_extract(c, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1), "<[^>]+>", ""))
    title = F.coalesce(some(F.regexp_extract(c, r"(?i)<title>([^<]+)</title>", 1)), h1, F.lit(""))
    p = text.clean_ends(F.regexp_extract(c, r"(?i)<p[^>]*>([^<]+)</p>", 1))
    first_p = F.when(F.length(p) > 20, F.when(F.length(p) > 120, F.concat(F.substring(p, 1, 117), F.lit("..."))).otherwise(p))
    output = F.regexp_extract(c, r"""(?is)<div\s+id=["']output["'][^>]*>(.*)</div>\s*</body>""", 1)
    body = F.coalesce(some(output), some(F.regexp_extract(c, r"(?is)<body[^>]*>(.*)</body>", 1)), c)
    return pages.select(
        page_id, title.alias("title"), F.coalesce(meta("author"), F.lit("")).alias("author"),
        F.coalesce(meta("description"), first_p, F.lit("")).alias("summary"), F.length(body).alias("body_chars"))


def split_report(df: DataFrame, column: str = "text") -> DataFrame:
    """Take the leading first-level heading as title; drop annotation lines from the rest."""
    d = df.withColumn("__lines", F.split(column, r"\r?\n"))
    d = d.withColumn("__first", F.array_position(F.transform("__lines", lambda x: x.rlike(r"(?U)\S")), True).cast("int"))
    head = F.when(F.col("__first") > 0, F.regexp_extract(F.get("__lines", F.col("__first") - 1), r"(?U)^#\s+(.+?)\s*$", 1))
    d = d.withColumn("title", F.coalesce(head, F.lit("")))
    rest = F.filter("__lines", lambda x, i: (i != F.col("__first") - 1) | (F.col("title") == ""))
    kept = F.filter(rest, lambda x: ~x.rlike(r"^\s*(理论视角|理论依据|解释视角)\s*[：:]"))
    d = d.withColumn("body", text.clean_ends(F.array_join(kept, "\n")))
    return d.withColumn("title", text.clean_ends("title")).drop("__lines", "__first")


def extract_tasks(df: DataFrame, column: str = "text") -> DataFrame:
    """Checklist lines in order: done or open, and the task."""
    rest = [c for c in df.columns if c != column]
    lines = df.select(*rest, F.posexplode(F.split(column, r"\r?\n")).alias("line_no", "line"))
    mark = r"^\s*[-*]\s+\[([ xX])\]\s+(.*\S)\s*$"
    return lines.filter(F.col("line").rlike(mark)).select(
        *rest, "line_no", (F.lower(F.regexp_extract("line", mark, 1)) == "x").alias("done"), F.regexp_extract("line", mark, 2).alias("task"))


def emphasis_blocks(df: DataFrame, column: str = "text") -> DataFrame:
    """``::: emphasis`` to ``:::`` blocks outside code fences, with what is wrong with each: nested, unclosed, empty or
    not_a_paragraph. A fold over the document's own lines, so it stays inside the row."""
    rest = [c for c in df.columns if c != column]
    block = F.array().cast("array<struct<start_line:int,end_line:int,n_lines:int,problem:string>>")
    zero = F.lit(0)
    start = F.struct(zero.alias("line"), F.lit("").alias("fence"), F.lit(-1).alias("open"), zero.alias("n"), zero.alias("bad"), block.alias("blocks"))

    def done(s, end, problem):
        row = F.struct(s["open"].alias("start_line"), end.alias("end_line"), s["n"].alias("n_lines"), problem.alias("problem"))
        return F.concat(s["blocks"], F.array(row))

    def step(s, raw):
        t = text.clean_ends(raw)
        token = F.substring(F.regexp_extract(t, "^(`{3,}|~{3,})", 1), 1, 1)
        closed = s["open"] < 0
        fence = F.when((token != "") & closed, F.when(s["fence"] == token, F.lit("")).otherwise(token)).otherwise(s["fence"])
        opens = (fence == "") & (t == "::: emphasis")
        closes = (fence == "") & (t == ":::") & ~closed
        inside = ~closed & ~opens & ~closes
        verdict = F.when(s["n"] == 0, "empty").when(s["bad"] > 0, "not_a_paragraph")
        blocks = F.when(opens & ~closed, done(s, F.lit(None).cast("int"), F.lit("nested"))).when(closes, done(s, s["line"], verdict)).otherwise(s["blocks"])
        odd = raw.rlike(r"^\s*(?:#{1,6}\s|[-*+]\s|\d+\.\s|!\[)")
        return F.struct(
            (s["line"] + 1).alias("line"), fence.alias("fence"), F.when(opens, s["line"]).when(closes, F.lit(-1)).otherwise(s["open"]).alias("open"),
            F.when(opens, zero).otherwise(s["n"] + (inside & (t != "")).cast("int")).alias("n"),
            F.when(opens, zero).otherwise(s["bad"] + (inside & odd).cast("int")).alias("bad"), blocks.alias("blocks"))

    def finish(s):
        return F.when(s["open"] >= 0, done(s, F.lit(None).cast("int"), F.lit("unclosed"))).otherwise(s["blocks"])

    found = F.aggregate(F.split(column, r"\r?\n"), start, step, finish)
    return df.select(*rest, F.posexplode(found).alias("block_no", "b")).select(*rest, "block_no", "b.*")


def resolve_assets(refs: DataFrame, assets: DataFrame, suffixes=tuple(rules.IMAGE_SUFFIXES)) -> DataFrame:
    """Match image references to an inventory (root, path): ok, missing, ambiguous, unsupported, outside, remote or bad width.
    ``refs`` keeps its columns; it needs ``ref`` and may carry ``width``."""
    raw = F.trim(F.regexp_replace("ref", r"\\", "/"))
    norm = F.regexp_replace(F.regexp_replace(raw, r"^(?:\./)+", ""), "/+", "/")
    r = refs.withColumn("__path", norm)
    per_path = assets.groupBy(F.col("path").alias("__apath")).agg(F.count_distinct("root").alias("__roots"))
    j = r.join(per_path, F.col("__path") == F.col("__apath"), "left")
    width_bad = (F.col("width") != "") & ~F.col("width").rlike("^[1-9][0-9]{0,3}$") if "width" in refs.columns else F.lit(False)
    status = (
        F.when(raw.rlike(r"^(?:/|[A-Za-z]:/)") | (raw == ""), "absolute")
        .when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "remote")
        .when(raw.rlike(r"(?:^|/)\.\.(?:/|$)"), "outside")
        .when(F.coalesce(width_bad, F.lit(False)), "bad_width")
        .when(F.col("__roots").isNull(), "missing")
        .when(F.col("__roots") > 1, "ambiguous")
        .when(~F.lower(F.regexp_extract("__path", r"\.([^./]*)$", 1)).isin(*suffixes), "unsupported")
        .otherwise("ok"))
    return j.withColumn("status", status).drop("__path", "__apath", "__roots")


def markdown_image_refs(df: DataFrame, column: str = "text") -> DataFrame:
    """References of both image forms, ``![alt](path)`` and ``![[path|width]]``, with ref and width."""
    rest = [c for c in df.columns if c != column]
    md = F.transform(F.regexp_extract_all(column, F.lit(IMAGE), F.lit(2)), lambda x: F.struct(x.alias("ref"), F.lit("").alias("width")))
    wiki = r"!\[\[([^\]|]+?)(?:\|([^\]]+))?\]\]"
    ob = F.zip_with(
        F.regexp_extract_all(column, F.lit(wiki), F.lit(1)), F.regexp_extract_all(column, F.lit(wiki), F.lit(2)),
        lambda p, w: F.struct(F.trim(p).alias("ref"), F.trim(F.coalesce(w, F.lit(""))).alias("width")))
    return df.select(*rest, F.posexplode(F.concat(md, ob)).alias("ref_no", "r")).select(*rest, "ref_no", "r.ref", "r.width")


def parse_nested(document: str):
    """JSON nested deeper than the C parser goes: the pure Python one, whose calls take no C stack, with room for all its levels."""
    import json
    import sys

    decoder, usual = json.JSONDecoder(), sys.getrecursionlimit()
    decoder.scan_once = json.scanner.py_make_scanner(decoder)
    sys.setrecursionlimit(usual + 3 * (document.count("{") + document.count("[")))
    try:
        return decoder.decode(document)
    finally:
        sys.setrecursionlimit(usual)


def forbidden_keys(df: DataFrame, column: str, keys=tuple(rules.FORBIDDEN_SKIN_KEYS)) -> DataFrame:
    """Paths of forbidden keys anywhere in a JSON column, like ``a.b[0].c``, at any depth; null and text that is no JSON have none.
    A document is parsed once; containers wait in a list with a link to the one around them, and only the paths that are
    found are spelled out."""
    rest = [c for c in df.columns if c != column]
    wanted = frozenset(keys)

    def spelled(link) -> str:
        steps = []
        while link is not None:
            step, link = link
            steps.append(f"[{step}]" if isinstance(step, int) else f".{step}" if link is not None else step)
        return "".join(reversed(steps))

    def paths(document: str | None) -> list[str]:
        import json

        try:
            try:
                waiting = [(None, json.loads(document or "null"))]
            except RecursionError:
                waiting = [(None, parse_nested(document))]
        except ValueError:
            return []
        found = []
        while waiting:
            link, held = waiting.pop()
            named = isinstance(held, dict)
            if named:
                found += [spelled((key, link)) for key in held.keys() & wanted]
            if named or isinstance(held, list):
                waiting += [((step, link), x) for step, x in (held.items() if named else enumerate(held)) if isinstance(x, (dict, list))]
        return found

    @F.pandas_udf("array<string>")
    def found(documents: pd.Series) -> pd.Series:
        return documents.map(paths)

    return df.select(*rest, F.explode(found(F.col(column))).alias("path"))


def link_report(pages: DataFrame, page_id: str = "page_id", column: str = "html") -> DataFrame:
    """Every href of a page in order with its safety class."""
    hrefs = F.regexp_extract_all(column, F.lit(r"""(?i)<a\b[^>]*\shref=["']([^"']*)["']"""), F.lit(1))
    t = pages.select(page_id, F.posexplode(hrefs).alias("link_no", "href"))
    return t.withColumn("safety", urls.link_safety("href"))
