"""Text columns. Every function takes a Column (or name) and returns a Column of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.functions import rules


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def char_class(chars: str, negate: bool = False) -> str:
    """A regex class of literal characters, safe in Java and RE2."""
    return "[" + ("^" if negate else "") + "".join("\\" + x if x in r"\]^-[&" else x for x in chars) + "]"


def clean_text(c) -> Column:
    """Every run of Unicode whitespace becomes one space; ends trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"(?U)\s+", " "))


def clip_text(c, limit: int = 80) -> Column:
    """Cleaned text; when longer than ``limit`` the first ``limit`` characters and ``...``."""
    t = clean_text(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit)), F.lit("...")))


def truncate_text(c, limit: int) -> Column:
    """Article variant: at most ``limit - 1`` characters before ``...``."""
    t = _c(c)
    cut = F.regexp_replace(F.substring(t, 1, max(0, limit - 1)), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(cut, F.lit("...")))


def slugify(c, default: str = "video", limit: int = 48) -> Column:
    t = F.when(F.coalesce(_c(c), F.lit("")) == "", F.lit(default)).otherwise(_c(c))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_-]+", "-")
    t = F.regexp_replace(F.regexp_replace(t, "-+", "-"), "^-|-$", "")
    return F.substring(F.when(t == "", F.lit(default)).otherwise(t), 1, limit)


def strip_md(c, mode: str = "page") -> Column:
    """Plain text of inline Markdown. ``page``: images vanish. ``article``: alt text stays and marks go."""
    t = F.coalesce(_c(c), F.lit(""))
    if mode == "page":
        t = F.regexp_replace(t, r"!\[[\s\S]*?\]\([^)]+\)", "")
        t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1")
    else:
        t = F.regexp_replace(t, r"!\[([^\]]*)\]\([^)]+\)", "$1")
        t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1")
        t = F.regexp_replace(t, r"[`*_~>#-]", "")
    return clean_text(t)


LINK_PATTERN = r"(?i)((?:https?://)?(?:[A-Za-z0-9_-]+\.)+[a-z]{2,}(?:/[^\s]*)?)"
MENTION_PATTERN = r"(?:^|[^A-Za-z0-9_@/])@([A-Za-z0-9_]{2,15})"
TOPIC_PATTERN = r"(?:^|[^&A-Za-z0-9_])#([\p{L}\p{N}_]+)"


def extract_entities(c) -> Column:
    """Struct of links, @mentions and #topics, each in order of appearance."""
    t = F.coalesce(_c(c), F.lit(""))
    return F.struct(
        F.regexp_extract_all(t, F.lit(LINK_PATTERN), F.lit(1)).alias("links"),
        F.regexp_extract_all(t, F.lit(MENTION_PATTERN), F.lit(1)).alias("mentions"),
        F.regexp_extract_all(t, F.lit(TOPIC_PATTERN), F.lit(1)).alias("topics"),
    )


def drop_hashtags(c) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(c), r"#\S+", ""), "^[ \\-—、,，]+|[ \\-—、,，]+$", "")


def length_report(c, minimum: int | None = None, limit: int | None = None, unit: str = "codepoint") -> Column:
    """Length in code points, UTF-16 units and newlines, and the answer to each bound that is given."""
    t = F.coalesce(_c(c), F.lit(""))
    chars = F.length(t).cast("long")
    units = (F.length(F.encode(t, "UTF-16LE")) / 2).cast("long")
    n = chars if unit == "codepoint" else units
    unknown = F.lit(None).cast("boolean")
    ok_min = unknown if minimum is None else n >= minimum
    ok_max = unknown if limit is None else n <= limit
    bounds = [b for b, given in ((ok_min, minimum), (ok_max, limit)) if given is not None]
    in_range = unknown if not bounds else bounds[0] if len(bounds) == 1 else bounds[0] & bounds[1]
    return F.struct(
        chars.alias("characters"),
        units.alias("utf16_units"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long").alias("newlines"),
        n.alias("count"),
        ok_min.alias("within_minimum"),
        in_range.alias("within_range"),
        ok_max.alias("within_limit"),
        (F.lit(None).cast("long") if limit is None else F.lit(limit) - n).alias("margin"),
    )


def display_width(c, ascii_hundredths: int = 55) -> Column:
    """Width in full-width units: ASCII counts 0.55 (layout variant 0.50), all else 1. Closed form, no loop."""
    t = F.coalesce(_c(c), F.lit(""))
    ascii_n = F.length(F.regexp_replace(t, r"[^\x00-\x7F]", ""))
    return (ascii_n * ascii_hundredths + (F.length(t) - ascii_n) * 100) / F.lit(100.0)


def wrapped_lines(c, units: float) -> Column:
    t = clean_ends(c)
    lines = F.greatest(F.lit(1), F.ceil(display_width(t, 50) / F.lit(float(units))).cast("int"))
    return F.when(t == "", F.lit(0)).otherwise(lines)


def clean_ends(c) -> Column:
    """Strip Unicode whitespace at both ends."""
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"(?U)^\s+|\s+$", "")


def normalized_token(c, strippable: str = rules.STRIPPABLE) -> Column:
    cls = char_class(strippable)
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), f"^{cls}+|{cls}+$", "")


def is_filler(c, pattern: str = char_class(rules.FILLER_CHARS)) -> Column:
    """All of the stripped token is filler. ``pattern`` is one filler unit, a character class by default."""
    return normalized_token(c).rlike(f"^(?:{pattern})+$")


def has_filler(c, pattern: str = char_class(rules.FILLER_CHARS)) -> Column:
    return normalized_token(c).rlike(pattern)


def has_embedded_filler(c, pattern: str = char_class(rules.FILLER_CHARS)) -> Column:
    return has_filler(c, pattern) & ~is_filler(c, pattern)


def needs_space(prev: Column, cur: Column) -> Column:
    """A space goes between two ASCII words, or at a Latin word's border with anything that is not one."""
    a, b = prev.rlike(rules.ASCII_WORD), cur.rlike(rules.ASCII_WORD)
    la, lb = prev.rlike(rules.LATIN_WORD), cur.rlike(rules.LATIN_WORD)
    return (a & b) | (la & ~b) | (lb & ~a)


def join_tokens(tokens) -> Column:
    """Join an array of tokens, leaving out empty ones."""
    kept = F.filter(_c(tokens), lambda x: x != "")
    spaced = F.transform(
        kept,
        lambda x, i: F.when((i > 0) & needs_space(F.get(kept, i - 1), x), F.concat(F.lit(" "), x)).otherwise(x),
    )
    return F.array_join(spaced, "")


def strip_punct(c, chars: str = rules.DISPLAY_PUNCTUATION) -> Column:
    """Drop display punctuation, keeping a dot between two digits."""
    others = char_class(chars.replace(".", ""))
    return clean_ends(F.regexp_replace(F.coalesce(_c(c), F.lit("")), rf"(?<!\p{{Nd}})\.|\.(?!\p{{Nd}})|{others}", ""))


def ends_sentence(c) -> Column:
    t = clean_ends(c)
    return t.rlike(char_class(rules.SENTENCE_PUNCTUATION) + "$") & ~t.rlike(r"\p{Nd}\.$")


def comparable_text(c, mode: str = "strict") -> Column:
    """``strict``: lower case without punctuation and separators. ``fold``: letters and digits only."""
    t = F.coalesce(_c(c), F.lit(""))
    return F.lower(F.regexp_replace(t, r"[\p{P}\p{Z}]" if mode == "strict" else r"[^\p{L}\p{N}]+", ""))


def apply_phrases(c, phrases) -> Column:
    """Replace phrases one after another, in list order."""
    out = _c(c)
    for source, target in phrases:
        if source:
            out = F.replace(out, F.lit(source), F.lit(target))
    return out


def split_sentences(c, ends: str = rules.SENTENCE_ENDS) -> Column:
    parts = F.split(clean_text(c), f"(?<={char_class(ends)})")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def first_sentence(c, ends: str = rules.SENTENCE_ENDS, missing: str = rules.MISSING_TEXT) -> Column:
    t = clean_text(c)
    # A sentence ends at the first end mark after the first character, so it begins at most 80 characters before that. The
    # pattern tries 80 characters at every place; without such a mark it is not tried, else from there on.
    end, others = char_class(ends), char_class(ends, negate=True)
    upto = F.length(F.regexp_extract(t, f"(?s)^.{others}*+{end}", 0))
    near = F.substring(t, F.greatest(F.lit(1), upto - 80), F.length(t))
    hit = F.when(upto > 0, F.regexp_extract(near, f"(.{{1,80}}?{end})", 1)).otherwise("")
    return F.when(t == "", F.lit(missing)).when(hit != "", F.trim(hit)).otherwise(F.substring(t, 1, 80))


def first_label(c, ordered_rules, default) -> Column:
    """Label of the first rule whose pattern is found in the text."""
    text = _c(c)
    out = None
    for label, pattern in ordered_rules:
        out = F.when(text.rlike(pattern), F.lit(label)) if out is None else out.when(text.rlike(pattern), F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def hook_type(c, hook_rules=tuple(rules.HOOK_RULES), default: str = rules.HOOK_DEFAULT) -> Column:
    t = _c(c)
    return F.when(t == rules.MISSING_TEXT, F.lit(rules.MISSING_TEXT)).otherwise(first_label(t, hook_rules, default))


def segment_label(i, n, c, text_rules=tuple(rules.SEGMENT_RULES)) -> Column:
    """Function of a timeline row: first row, then keywords, then place in the whole."""
    i, n, t = _c(i), _c(n), _c(c)
    out = F.when(i == 0, F.lit(rules.SEGMENT_FIRST))
    for label, pattern in text_rules:
        out = out.when(t.rlike(pattern), F.lit(label))
    out = out.when(i >= n - 1, F.lit(rules.SEGMENT_LAST))
    out = out.when(i * 100 <= F.greatest(F.lit(100), n * 35), F.lit(rules.SEGMENT_EARLY))
    out = out.when(i * 100 <= F.greatest(F.lit(200), n * 70), F.lit(rules.SEGMENT_MIDDLE))
    return out.otherwise(F.lit(rules.SEGMENT_DEFAULT))


def is_question(c, pattern: str = rules.COMMENT_QUESTION) -> Column:
    return F.coalesce(_c(c), F.lit("")).rlike(pattern)


def is_interaction(c, pattern: str = rules.COMMENT_INTERACTION) -> Column:
    return F.coalesce(_c(c), F.lit("")).rlike(pattern)


def is_noise_line(c, literals=tuple(rules.NOISE_LINES), prefixes=tuple(rules.NOISE_PREFIXES)) -> Column:
    line = _c(c)
    out = line.isin(*literals)
    for p in prefixes:
        out = out | line.startswith(p)
    return out


def syllable_units(c, cjk: str = rules.CJK, token: str = rules.ASCII_TOKEN) -> Column:
    t = F.coalesce(_c(c), F.lit(""))
    return (F.regexp_count(t, F.lit(cjk)) + F.regexp_count(t, F.lit(token))).cast("long")


def contains_loose(a, b) -> Column:
    squeeze = lambda x: F.lower(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)\s+", ""))
    return F.contains(squeeze(a), squeeze(b))


def content_key(*parts, refs=None, length: int = 16) -> Column:
    """Hex key of ordered parts and a sorted list of references."""
    cols = [F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts]
    if refs is not None:
        cols.append(F.array_join(F.array_sort(_c(refs)), ","))
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, length)


def typeset(c) -> Column:
    """Chinese typesetting: spaces between CJK and Latin or digits, units, ASCII digits, no stacked ?!, corner quotes.
    URLs, mail addresses and paths inside CJK text keep their inner text (only their outer border gains a space)."""
    t = F.translate(_c(c), "０１２３４５６７８９", "0123456789")
    t = F.regexp_replace(t, f"({rules.CJK})([A-Za-z0-9])", "$1 $2")
    t = F.regexp_replace(t, f"([A-Za-z0-9%°])({rules.CJK})", "$1 $2")
    t = F.regexp_replace(t, r"(?<![A-Za-z0-9/._-])(\d+(?:\.\d+)?)(GB|MB|KB|TB|kg|km|cm|mm|ms|px)(?![A-Za-z0-9])", "$1 $2")
    t = F.regexp_replace(t, r"(\d)\s+([%°])", "$1$2")
    t = F.regexp_replace(t, r"([？?])[？?]+", "$1")
    t = F.regexp_replace(t, r"([！!])[！!]+", "$1")
    return F.regexp_replace(F.regexp_replace(t, "“([^“”]*)”", "「$1」"), "‘([^‘’]*)’", "『$1』")


def longest_run(c, char: str) -> Column:
    """Length of the longest run of one character."""
    runs = F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(f"({char_class(char)}+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda x: F.length(x))), F.lit(0))


def strip_literal_newlines(c) -> Column:
    """Struct of the text without literal ``\\n`` at its edges, the number removed, and how many stay inside."""
    t = F.coalesce(_c(c), F.lit(""))
    cut = F.regexp_replace(F.regexp_replace(t, r"^(?:\s*\\n\s*)+", ""), r"(?:\s*\\n\s*)+$", "")
    return F.struct(
        cut.alias("content"),
        (F.length(t) - F.length(cut)).cast("long").alias("removed_chars"),
        F.regexp_count(cut, F.lit(r"\\n")).cast("long").alias("remaining"),
    )


def body_lines(c) -> Column:
    """Trimmed, non-empty lines without image-only lines, as an array."""
    lines = F.transform(F.split(F.coalesce(_c(c), F.lit("")), r"\r?\n"), lambda x: clean_ends(x))
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("![]("))
