"""Number, time, colour and shape columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.functions import rules


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_seconds(c, force=False) -> Column:
    """Milliseconds or seconds to seconds: milliseconds when forced or above 1000. Not a number becomes null."""
    v = _c(c).try_cast("double")
    forced = force if isinstance(force, Column) else F.lit(bool(force))
    return F.when(forced | (v > 1000), v / F.lit(1000.0)).otherwise(v)


def parse_count(c) -> Column:
    """Displayed count to a number: ``1.2万`` is 12000, ``3k`` is 3000, thousands commas go, junk is 0."""
    t = F.trim(F.replace(F.coalesce(_c(c), F.lit("")), F.lit(","), F.lit("")))
    n = F.regexp_extract(t, r"([\d.]+)", 1).try_cast("double")
    scale = F.when(F.contains(t, F.lit("万")), F.lit(10000.0)).when(F.contains(F.lower(t), F.lit("k")), F.lit(1000.0)).otherwise(F.lit(1.0))
    return F.coalesce(F.floor(n * scale + F.lit(0.5)).cast("long"), F.lit(0).cast("long"))


def _tenths_of_wan(n: Column, tie_up: bool) -> Column:
    """n / 10000 in tenths, rounded as the binary quotient rounds (not as its decimal text does)."""
    tenths, rest = F.floor(n / 1000), n % 1000
    x = n / F.lit(10000.0)
    part = x - F.floor(x)
    middle = ((tenths % 10) * 2 + 1) / F.lit(20.0)
    tie = F.lit(True) if tie_up else (tenths % 2 == 1)
    up = (rest > 500) | ((rest == 500) & ((part > middle) | ((part == middle) & tie)))
    return (tenths + F.when(up, 1).otherwise(0)).cast("long")


def format_count(c, style: str = "report") -> Column:
    """Number to its short form in units of ten thousand; ``card`` adds thousands commas and drops decimals from 100000."""
    n = F.coalesce(_c(c).cast("long"), F.lit(0).cast("long"))
    tenths = _tenths_of_wan(n, tie_up=style == "card")
    short = F.concat(
        (F.floor(tenths / 10)).cast("string"),
        F.when(tenths % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("."), (tenths % 10).cast("string"))),
        F.lit("万"),
    )
    if style == "report":
        return F.when(n >= 10000, short).otherwise(n.cast("string"))
    whole = F.concat(F.floor((n + 5000) / 10000).cast("string"), F.lit("万"))
    return F.when(n >= 100000, whole).when(n >= 10000, short).when(n >= 1000, F.format_number(n, 0)).otherwise(n.cast("string"))


def age_days(c, as_of) -> Column:
    """Age in days of a relative or absolute date text on the day ``as_of``. ``N年前`` has no rule and stays null."""
    t = F.trim(F.coalesce(_c(c), F.lit("")))
    number = lambda unit: F.regexp_extract(t, rf"(\d+)\s*{unit}", 1).try_cast("long")
    iso = F.regexp_extract(F.translate(t, "./", "--"), r"^(\d{4}-\d{1,2}-\d{1,2})", 1)
    day = F.try_to_date(F.when(iso != "", iso), "yyyy-M-d")
    return (
        F.when(t == "", F.lit(None).cast("long"))
        .when(t.rlike("刚刚|分钟前|小时前"), F.lit(0))
        .when(t.rlike("昨天"), F.lit(1))
        .when(t.rlike("前天"), F.lit(2))
        .when(t.rlike(r"\d\s*天前"), number("天前"))
        .when(t.rlike(r"\d\s*周前"), number("周前") * 7)
        .when(t.rlike(r"\d\s*月前"), number("月前") * 30)
        .otherwise(F.datediff(_c(as_of), day))
        .cast("long")
    )


def speed_percent(units, active_ms) -> Column:
    """Speed tier in percent from speech units and active milliseconds."""
    rate = _c(units) * F.lit(1000.0) / _c(active_ms)
    out = None
    for below, percent in rules.SPEED_TIERS:
        out = F.when(rate < below, F.lit(percent)) if out is None else out.when(rate < below, F.lit(percent))
    return out.otherwise(F.lit(100))


def speed_factor(rate) -> Column:
    r = _c(rate)
    out = None
    for below, percent in rules.SPEED_TIERS:
        out = F.when(r < below, F.lit(percent / 100)) if out is None else out.when(r < below, F.lit(percent / 100))
    return out.otherwise(F.lit(1.0))


def ass_time(ms) -> Column:
    """Milliseconds to ``h:mm:ss.cc``; half centiseconds go to the even one; negatives become zero."""
    cs = F.greatest(F.bround(_c(ms) / F.lit(10.0), 0).cast("long"), F.lit(0).cast("long"))
    return F.format_string(
        "%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs % 360000 / 6000), F.floor(cs % 6000 / 100), cs % 100
    )


def parse_ass_time(c) -> Column:
    """``h:mm:ss.cc`` back to milliseconds."""
    p = F.split(_c(c), ":")
    return (
        F.get(p, F.lit(0)).try_cast("long") * 3_600_000
        + F.get(p, F.lit(1)).try_cast("long") * 60_000
        + F.bround(F.get(p, F.lit(2)).try_cast("decimal(12,3)") * 1000, 0).cast("long")
    )


def stamp(ms, style: str = "m:ss") -> Column:
    """``m:ss`` of the whole seconds, or the file-name form ``hh-mm-ss`` of the rounded ones."""
    if style == "m:ss":
        s = F.floor(_c(ms) / 1000)
        return F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    s = F.greatest(F.bround(_c(ms) / F.lit(1000.0), 0).cast("long"), F.lit(0).cast("long"))
    return F.format_string("%02d-%02d-%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def sample_times_us(duration_us, max_frames: int = 28) -> Column:
    """Times at which to look at a video: every 2, 3 or 5 s by length, else evenly; never in the last 0.1 s."""
    d = _c(duration_us)
    interval = (
        F.when(d <= 12_000_000, F.lit(2_000_000.0))
        .when(d <= 60_000_000, F.lit(3_000_000.0))
        .when(d <= 180_000_000, F.lit(5_000_000.0))
        .otherwise(F.greatest(F.lit(6_000_000.0), d / F.lit(float(max_frames))))
    )
    count = F.least(F.lit(max_frames), F.greatest(F.lit(1), F.ceil(d / interval).cast("int")))
    middle = F.array(F.least(F.floor(d / 2), F.greatest(F.lit(0).cast("long"), d - 100_000)))
    grid = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.least(d - 100_000, F.floor(i * d / count) + 250_000))
    return F.when(d <= 0, F.array(F.lit(0).cast("long"))).when(count == 1, middle).otherwise(grid)


def _channel(value: Column, i: int) -> Column:
    short = F.substring(value, 2 + i, 1)
    text = F.when(F.length(value) == 4, F.concat(short, short)).otherwise(F.substring(value, 2 + 2 * i, 2))
    hexed = F.conv(text, 16, 10).cast("int")
    dec = F.regexp_extract(value, r"^rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)$", i + 1).try_cast("int")
    named = F.when(value == "white", F.lit(255)).when(value == "black", F.lit(0))
    return F.when(value.rlike("^#(?:[0-9a-f]{3}|[0-9a-f]{6})$"), hexed).otherwise(F.coalesce(named, dec))


def luminance(c) -> Column:
    value = F.lower(F.trim(_c(c)))

    def linear(i):
        x = _channel(value, i) / F.lit(255.0)
        return F.when(x <= 0.04045, x / F.lit(12.92)).otherwise(F.pow((x + 0.055) / F.lit(1.055), F.lit(2.4)))

    return linear(0) * 0.2126 + linear(1) * 0.7152 + linear(2) * 0.0722


def contrast(a, b) -> Column:
    """WCAG contrast ratio of two colours; null when either is not a known form."""
    x, y = luminance(a), luminance(b)
    ratio = (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)
    return F.when(x.isNotNull() & y.isNotNull(), ratio)


def orientation(w, h) -> Column:
    w, h = _c(w), _c(h)
    return F.when((w > 0) & (h > 0), F.when(w > h, "landscape").when(h > w, "portrait").otherwise("square"))


def delivery_size(w, h) -> Column:
    """Delivery size: 16:9 landscape below 1080 lines grows to 1920x1080, all else stays."""
    w, h = _c(w).cast("long"), _c(h).cast("long")
    small_wide = (w > h) & (F.abs(w / h - F.lit(16.0) / F.lit(9.0)) <= 0.01) & (h < 1080)
    size = F.when(small_wide, F.struct(F.lit(1920).cast("long").alias("width"), F.lit(1080).cast("long").alias("height"))).otherwise(
        F.struct(w.alias("width"), h.alias("height"))
    )
    return F.when((w > 0) & (h > 0), size)


def fraction(c) -> Column:
    """``30000/1001`` or a plain number to a double; missing and zero denominators become null."""
    t = _c(c)
    top = F.regexp_extract(t, r"^\s*([0-9.]+)\s*/", 1).try_cast("double")
    bottom = F.regexp_extract(t, r"/\s*([0-9.]+)\s*$", 1).try_cast("double")
    value = F.when(F.contains(t, F.lit("/")), F.when(bottom != 0, top / bottom)).otherwise(t.try_cast("double"))
    return F.when(~t.isin("", "0/0", "N/A"), value)


def engagement_ratio(part, whole) -> Column:
    return F.try_divide(_c(part).cast("double"), _c(whole).cast("double"))


def reveal_offset(trigger_ms, chapter_start_ms, chapter_end_ms) -> Column:
    """Reveal time as an offset inside its chapter, never below 0 or past the end."""
    length = _c(chapter_end_ms) - _c(chapter_start_ms)
    return F.least(F.greatest(_c(trigger_ms) - _c(chapter_start_ms), F.lit(0).cast("long")), length)


def array_diff(a, b, step: float = 20.0, mean_limit: float = 2.0, share_limit: float = 0.004, max_limit: float = 35.0) -> Column:
    """Compare two number arrays place by place: mean and maximum difference, share at or above ``step``, visible or not."""
    n = F.least(F.size(_c(a)), F.size(_c(b)))
    diffs = F.slice(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(1), n)
    total = F.aggregate(diffs, F.lit(0.0), lambda s, x: s + x)
    mean = F.when(n > 0, total / n).otherwise(F.lit(0.0))
    share = F.when(n > 0, F.size(F.filter(diffs, lambda x: x >= step)) / n).otherwise(F.lit(0.0))
    top = F.coalesce(F.array_max(diffs), F.lit(0.0))
    return F.struct(
        mean.alias("mean_abs"), share.alias("changed_share"), top.alias("max_abs"),
        ((mean >= mean_limit) | ((share >= share_limit) & (top >= max_limit))).alias("visible"),
    )


def alpha_share(a, above: float = 4.0) -> Column:
    """Share of values above a level, and whether any of them shows."""
    n = F.size(_c(a))
    share = F.when(n > 0, F.size(F.filter(_c(a), lambda x: x > above)) / n).otherwise(F.lit(0.0))
    return F.struct(share.alias("share"), (share > 0.0001).alias("visible"))
