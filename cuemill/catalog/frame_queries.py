"""Queries over frame series (events of each user in time order)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.catalog import views
from cuemill.catalog.base import query
from cuemill.operators import frames as fr
from cuemill.session import stage

FR = "WITH " + views.FRAMES


@query("frame_levels", "A9", FR + """
SELECT media_id, (frame // 4)::BIGINT AS frame, round(CASE WHEN avg(v * v) <= 1 THEN -96.0 ELSE 20 * log10(sqrt(avg(v * v)) / 32768.0) END, 6) AS level_db
FROM (SELECT media_id, frame, floor(value * 100)::DOUBLE AS v FROM frames) GROUP BY 1, 2""")
def _(spark, sf):
    s = views.frames(spark, sf).select("media_id", F.col("frame").alias("i"), F.floor(F.col("value") * 100).alias("v"))
    return fr.frame_levels(s, 4).withColumn("level_db", F.round("level_db", 6))


@query("noise_threshold", "A10", FR + """
, n AS (SELECT media_id, value - 60 AS l, row_number() OVER (PARTITION BY media_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY media_id) AS c FROM frames)
SELECT media_id, l AS noise_floor, greatest(-44.0, least(-30.0, l + 11.0)) AS threshold FROM n WHERE i = least(c - 1, floor(c * 0.2))""")
def _(spark, sf):
    return fr.noise_threshold(views.frames(spark, sf).select("media_id", "frame", (F.col("value") - 60).alias("level_db")))


@query("activity", "A10", FR + """
, n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY media_id) AS c FROM frames),
t AS (SELECT media_id, greatest(-44.0, least(-30.0, value - 60 + 11.0)) AS threshold FROM n WHERE i = least(c - 1, floor(c * 0.2)))
SELECT f.media_id, frame, value - 60 >= threshold AS active FROM frames f JOIN t ON f.media_id = t.media_id""")
def _(spark, sf):
    f = stage(views.frames(spark, sf).select("media_id", "frame", (F.col("value") - 60).alias("level_db")), "frames")
    return fr.activity(f, fr.noise_threshold(f)).select("media_id", "frame", "active")


def active(spark, sf):
    return views.frames(spark, sf).select("media_id", "frame", (F.col("value") >= 30).alias("active"))


SMOOTH = FR + """,
a0 AS (SELECT media_id, frame, value >= 30 AS a FROM frames),
a1 AS (SELECT *, a OR coalesce(lag(a) OVER x AND lead(a) OVER x, false) AS c FROM a0 WINDOW x AS (PARTITION BY media_id ORDER BY frame)),
sm AS (SELECT media_id, frame, c AND NOT coalesce(NOT lag(c) OVER x AND NOT lead(c) OVER x, false) AS smoothed FROM a1 WINDOW x AS (PARTITION BY media_id ORDER BY frame))
"""


@query("smooth_activity", "W8", SMOOTH + " SELECT * FROM sm")
def _(spark, sf):
    return fr.smooth(active(spark, sf)).select("media_id", "frame", "smoothed")


REGIONS = FR + """,
ev AS (SELECT *, CASE WHEN value >= 60 THEN 1 WHEN value < 25 AND lag(value) OVER (PARTITION BY media_id ORDER BY frame) < 25 THEN 0 END AS e FROM frames),
st AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY frame), 0) AS s FROM ev),
ch AS (SELECT *, CASE WHEN s = 1 AND coalesce(lag(s) OVER (PARTITION BY media_id ORDER BY frame), 0) = 0 THEN 1 ELSE 0 END AS o FROM st),
gr AS (SELECT *, sum(o) OVER (PARTITION BY media_id ORDER BY frame) AS g, max(frame) OVER (PARTITION BY media_id) AS mx FROM ch),
regions AS (SELECT media_id, min(frame) AS start_frame, CASE WHEN max(frame) < max(mx) THEN max(frame) ELSE max(mx) + 1 END AS end_frame, max(value) AS peak,
  max(frame) < max(mx) AS closed FROM gr WHERE s = 1 GROUP BY media_id, g)
"""


@query("speech_regions", "W7", REGIONS + " SELECT * FROM regions")
def _(spark, sf):
    return fr.speech_regions(views.frames(spark, sf), "value", 60, 25, 2)


@query("region_times", "W7", REGIONS + """
SELECT media_id, 176667 + start_frame * 32000 AS region_start_us, 176667 + CASE WHEN closed THEN end_frame * 32000 ELSE 5000000 + media_id END AS region_end_us, peak FROM regions""")
def _(spark, sf):
    f = views.frames(spark, sf)
    m = f.select("media_id").distinct().select("media_id", F.lit(176667).cast("long").alias("offset_us"), (F.col("media_id") + 5_000_000).alias("duration_us"))
    return fr.region_times(fr.speech_regions(f, "value", 60, 25, 2), m)


@query("quiet_runs", "W9", SMOOTH + """,
q AS (SELECT *, sum(CASE WHEN smoothed THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY frame) AS g FROM sm)
SELECT media_id, min(frame) AS quiet_first, max(frame) AS quiet_last FROM q WHERE NOT smoothed GROUP BY media_id, g""")
def _(spark, sf):
    return fr.quiet_runs(stage(fr.smooth(active(spark, sf)), "smooth")).drop("quiet_no")


@query("first_quiet_run", "W9", SMOOTH + """,
q2 AS (SELECT a.media_id, a.frame FROM sm a JOIN sm b ON a.media_id = b.media_id AND b.frame = a.frame + 1 WHERE NOT a.smoothed AND NOT b.smoothed)
SELECT s.media_id, s.frame AS query_id, min(q2.frame) AS quiet_frame FROM sm s LEFT JOIN q2 ON s.media_id = q2.media_id AND q2.frame >= s.frame AND q2.frame + 1 <= s.frame + 12 GROUP BY 1, 2""")
def _(spark, sf):
    f = stage(fr.smooth(active(spark, sf)), "smooth")
    asked = f.select("media_id", F.col("frame").alias("query_id"), F.col("frame").alias("from_frame"), (F.col("frame") + 12).alias("to_frame"))
    return fr.first_quiet_run(asked, f).select("media_id", "query_id", "quiet_frame")


@query("nearest_quiet", "W10", SMOOTH + """,
qu AS (SELECT media_id, frame * 10000 AS t FROM (SELECT *, lag(smoothed) OVER (PARTITION BY media_id ORDER BY frame) AS p FROM sm) WHERE NOT smoothed AND NOT coalesce(p, false)),
asked AS (SELECT media_id, frame, frame * 10000 + 3000 AS target, frame * 10000 - 45000 AS lo, frame * 10000 + 52000 AS hi FROM sm)
SELECT a.media_id, frame AS query_id, min_by(t, [abs(t - target), t]) AS nearest FROM asked a LEFT JOIN qu ON a.media_id = qu.media_id
 AND t >= floor(lo / 10000) * 10000 AND t <= floor(hi / 10000) * 10000 GROUP BY 1, 2""")
def _(spark, sf):
    f = stage(fr.smooth(active(spark, sf)), "smooth")
    t = F.col("frame") * 10_000
    asked = f.select("media_id", F.col("frame").alias("query_id"), (t - 45_000).alias("lo"), (t + 52_000).alias("hi"), (t + 3_000).alias("target"))
    return fr.nearest_quiet(asked, f).select("media_id", "query_id", "nearest")


@query("nearest_zero_cross", "W11", FR + """,
s AS (SELECT media_id, frame AS i, floor(value * 100)::BIGINT - 3459 AS v, lag(floor(value * 100)::BIGINT - 3459) OVER (PARTITION BY media_id ORDER BY frame) AS p FROM frames),
z AS (SELECT media_id, i FROM s WHERE p IS NOT NULL AND (v = 0 OR p = 0 OR (p < 0 AND v > 0) OR (p > 0 AND v < 0)))
SELECT s.media_id, s.i AS query_id, coalesce(min_by(z.i, [abs(z.i - s.i), z.i]), s.i) AS nearest FROM s LEFT JOIN z ON s.media_id = z.media_id AND z.i BETWEEN s.i - 2 AND s.i + 2 GROUP BY 1, 2""")
def _(spark, sf):
    s = stage(views.frames(spark, sf).select("media_id", F.col("frame").alias("i"), (F.floor(F.col("value") * 100) - 3459).alias("v")), "samples")
    asked = s.select("media_id", F.col("i").alias("query_id"), (F.col("i") - 2).alias("lo"), (F.col("i") + 2).alias("hi"), F.col("i").alias("target"))
    return fr.nearest_zero_cross(asked, s).select("media_id", "query_id", "nearest")


@query("match_onset", "J3", FR + """,
rg AS (SELECT media_id, frame * 200000 + (event_id * 7919) % 150000 AS rs, frame * 200000 + (event_id * 7919) % 150000 + 100000 * (1 + event_id % 5) AS re, value AS peak FROM frames WHERE value > 30),
en AS (SELECT media_id, frame AS entry_id, frame * 200000 AS fs, CASE frame % 3 WHEN 0 THEN 'opening' WHEN 1 THEN 'after-filler' ELSE 'normal' END AS cx,
  CASE WHEN frame % 5 <> 0 THEN frame * 200000 - (event_id % 7) * 30000 END AS pe FROM frames),
wn AS (SELECT *, CASE cx WHEN 'opening' THEN greatest(0, fs - 300000) WHEN 'after-filler' THEN CASE WHEN pe IS NOT NULL THEN greatest(pe + 40000, fs - 120000) END ELSE fs - 80000 END AS lo,
  fs + CASE WHEN cx = 'normal' THEN 450000 ELSE 600000 END AS hi FROM en)
SELECT w.media_id, entry_id, min_by(rs, [abs(rs - fs), rs]) AS onset_us FROM wn w LEFT JOIN rg ON w.media_id = rg.media_id AND rs BETWEEN lo AND hi AND re >= fs - 40000 GROUP BY 1, 2""")
def _(spark, sf):
    f = stage(views.frames(spark, sf), "frames")
    n, e = F.col("frame"), F.col("event_id")
    rs = n * 200_000 + (e * 7919) % 150_000
    regions = f.filter("value > 30").select("media_id", rs.alias("region_start_us"), (rs + (e % 5 + 1) * 100_000).alias("region_end_us"), F.col("value").alias("peak"))
    cx = F.when(n % 3 == 0, "opening").when(n % 3 == 1, "after-filler").otherwise("normal")
    entries = f.select("media_id", n.alias("entry_id"), (n * 200_000).alias("first_start_us"), cx.alias("entry_context"),
                       F.when(n % 5 != 0, n * 200_000 - (e % 7) * 30_000).alias("predecessor_end_us"))
    return fr.match_onset(entries, regions).select("media_id", "entry_id", "onset_us")


@query("activity_ratio", "A11", """
WITH s AS (SELECT user_id AS media_id, sum(CASE WHEN value < 20 THEN (value * 100)::BIGINT ELSE 0 END)::BIGINT AS q, count(*) * 400 AS d FROM events GROUP BY 1)
SELECT media_id, d AS duration_us, least(d, q) AS silence_us, greatest(0, d - least(d, q)) AS active_us, greatest(0, d - least(d, q))::DOUBLE / d AS active_ratio FROM s""")
def _(spark, sf):
    e = views.table(spark, sf, "events").withColumnRenamed("user_id", "media_id")
    m = e.groupBy("media_id").agg((F.count(F.lit(1)) * 400).alias("duration_us"))
    return fr.activity_ratio(e.filter("value < 20").select("media_id", F.round(F.col("value") * 100).cast("long").alias("silence_us")), m)


def boundary_inputs(spark, sf):
    """Events as a small spoken timeline: one word of 200 ms per event, 20 frames of 10 ms and 100 samples per word."""
    f = stage(views.frames(spark, sf), "frames")
    n = F.col("frame")
    word_len = F.floor(F.col("value") * 100) % 150_000 + 40_000
    w = f.select("media_id", n.alias("pos"), (n * 200_000).alias("start_us"), (n * 200_000 + word_len).alias("end_us"), (F.col("value") < 12).alias("filler"))
    cells = f.select("media_id", n, "value", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    act = cells.select("media_id", (n * 20 + F.col("k")).alias("frame"), ((F.col("k") * 10_000 < F.floor(F.col("value") * 100) % 150_000 + 40_000) & (F.col("value") >= 12)).alias("smoothed"))
    smp = f.select("media_id", n, "value", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k")).select(
        "media_id", (n * 100 + F.col("k")).alias("i"), (F.floor(F.col("value") * 100) * (F.col("k") + 1) % 401 - 200).alias("v"))
    reg = f.filter("value > 50").select("media_id", (n * 200_000 + F.col("event_id") % 60_000).alias("region_start_us"), (n * 200_000 + 180_000).alias("region_end_us"), (F.col("value") / 500).alias("peak"))
    return w, act, smp, reg


def boundary_segments(w):
    """Segments between fillers, their entry context and the word after."""
    from cuemill.operators import scans

    x = scans.scan(w, "media_id", "pos", None, pe=scans.lag("end_us"), pf=scans.lag("filler"), ns=scans.lead("start_us"))
    r = stage(scans.runs(x, "media_id", "pos", ~F.col("filler"), "seg_no"), "runs")
    s = r.groupBy("media_id", "seg_no").agg(
        F.min("start_us").alias("source_start_us"), F.max_by("end_us", "pos").alias("source_end_us"), F.max_by("ns", "pos").alias("next_word_start_us"),
        F.min_by(F.struct("start_us", "pe", "pf"), "pos").alias("f"))
    gap = F.col("source_start_us") - F.col("f.pe")
    disc = F.coalesce(F.col("f.pf") & (gap <= 900_000), F.lit(False))
    s = s.select(
        "media_id", "seg_no", "source_start_us", "source_end_us", F.col("source_end_us").alias("last_end_us"), "next_word_start_us",
        F.when(F.col("seg_no") == 1, "opening").when(disc, "after-filler").otherwise("normal").alias("entry_context"), F.col("source_start_us").alias("first_start_us"),
        F.col("f.pe").alias("predecessor_end_us"), disc.alias("discarded"), (disc & gap.between(-20_000, 12_000)).alias("continuous"))
    return stage(s, "segments")


REFINED = FR + """,
w AS (SELECT media_id, frame AS pos, event_id, value, floor(value * 100)::BIGINT AS c, frame * 200000 AS a, frame * 200000 + floor(value * 100)::BIGINT % 150000 + 40000 AS b, value < 12 AS filler FROM frames),
x AS (SELECT *, {'pe': lag(b) OVER o, 'pf': lag(filler) OVER o} AS before, {'a': lead(a) OVER o} AS following, sum(filler::INT) OVER o AS island FROM w WINDOW o AS (PARTITION BY media_id ORDER BY pos)),
s0 AS (SELECT media_id, island, min(a) AS a, max(b) AS b, min_by(before, pos) AS before, max_by(following, pos) AS following FROM x WHERE NOT filler GROUP BY 1, 2),
s1 AS (SELECT media_id, row_number() OVER o AS seg_no, a, b, before.pe AS pe, coalesce(before.pf AND a - before.pe <= 900000, false) AS disc, following.a AS nw, lead(a) OVER o AS nxt FROM s0 WINDOW o AS (PARTITION BY media_id ORDER BY a)),
win AS (SELECT media_id, max(pos) * 200000 + 200000 AS w1 FROM w GROUP BY 1),
s2 AS (SELECT s1.*, w1, CASE WHEN seg_no = 1 THEN 'opening' WHEN disc THEN 'after-filler' ELSE 'normal' END AS cx, coalesce(disc AND a - pe BETWEEN -20000 AND 12000, false) AS cont,
  CASE WHEN nw >= b THEN least(w1, b + 350000, coalesce(nxt, w1) - 10000, nw) ELSE least(w1, b + 350000, coalesce(nxt, w1) - 10000) END AS tail FROM s1 JOIN win USING (media_id)),
act AS (SELECT media_id, pos * 20 + k AS f, NOT (k * 10000 < c % 150000 + 40000 AND value >= 12) AS q FROM w, range(20) t(k)),
qf AS (SELECT media_id, f, q AND coalesce(lead(q) OVER o, false) AS opens, q AND coalesce(lag(q) OVER o, true) AS settled FROM act WINDOW o AS (PARTITION BY media_id ORDER BY f)),
t AS (SELECT s2.media_id, seg_no, min(f) * 10000 AS quiet FROM s2 JOIN qf ON qf.media_id = s2.media_id AND opens AND f >= greatest(0, b - 20000) // 10000 AND f + 1 <= tail // 10000 GROUP BY 1, 2),
e0 AS (SELECT s2.*, quiet, CASE WHEN quiet IS NULL THEN b ELSE greatest(b, quiet) END AS off FROM s2 LEFT JOIN t USING (media_id, seg_no)),
e1 AS (SELECT *, CASE WHEN quiet IS NULL THEN least(tail, greatest(b, b + 20000)) ELSE least(tail, off + 100000) END AS en FROM e0),
e2 AS (SELECT *, quiet IS NOT NULL AND en - off >= 19500 AS tail_clear, greatest(en, b + least(20000, greatest(0, tail - b))) AS r1 FROM e1),
e3 AS (SELECT *, greatest(0, CASE WHEN seg_no = 1 THEN 0 ELSE lag(r1) OVER (PARTITION BY media_id ORDER BY seg_no) + 10000 END) AS base FROM e2),
e4 AS (SELECT *, CASE WHEN NOT cont AND pe IS NOT NULL THEN greatest(base, pe + CASE WHEN disc THEN 15000 ELSE 5000 END) ELSE base END AS low,
  CASE cx WHEN 'opening' THEN 32000 WHEN 'after-filler' THEN 30000 ELSE 55000 END AS room, CASE cx WHEN 'opening' THEN 60000 WHEN 'after-filler' THEN 60000 ELSE 90000 END AS most,
  CASE cx WHEN 'opening' THEN greatest(0, a - 300000) WHEN 'after-filler' THEN greatest(pe + 40000, a - 120000) ELSE a - 80000 END AS o0, a + CASE cx WHEN 'normal' THEN 450000 ELSE 600000 END AS o1,
  CASE WHEN least(b - 250000, a + 2000) < greatest(base, pe - 4000) THEN a ELSE greatest(base, pe - 4000) END AS z0,
  CASE WHEN least(b - 250000, a + 2000) < greatest(base, pe - 4000) THEN a ELSE least(b - 250000, a + 2000) END AS z1 FROM e3),
smp AS (SELECT media_id, pos * 100 + k AS i, (c * (k + 1)) % 401 - 200 AS v FROM w, range(100) t(k)),
cr AS (SELECT media_id, i FROM (SELECT *, lag(v) OVER (PARTITION BY media_id ORDER BY i) AS p FROM smp) WHERE p IS NOT NULL AND (v = 0 OR p = 0 OR (p < 0) <> (v < 0))),
mx AS (SELECT media_id, max(i) AS mi FROM smp GROUP BY 1),
e5 AS (SELECT e4.*, greatest(1, floor(z0 * 500 / 1000000)::BIGINT) AS i0, least(mi, ceil(z1 * 500 / 1000000)::BIGINT) AS i1, least(mi, greatest(1, round_even(a * 500 / 1000000, 0)::BIGINT)) AS it,
  greatest(low, a - most) AS q0, least(a - 20000, b - 250000) AS q1 FROM e4 JOIN mx USING (media_id)),
zz AS (SELECT e.media_id, seg_no, min_by(i, [abs(i - it), i]) AS z FROM e5 e JOIN cr ON cr.media_id = e.media_id AND cont AND i BETWEEN i0 AND i1 GROUP BY 1, 2),
oo AS (SELECT e.media_id, seg_no, min_by({'s': rs, 'p': peak}, [abs(rs - a), rs]) AS o FROM e5 e JOIN (SELECT media_id, pos * 200000 + event_id % 60000 AS rs, pos * 200000 + 180000 AS re, value / 500 AS peak FROM w WHERE value > 50) r
  ON r.media_id = e.media_id AND NOT cont AND rs BETWEEN o0 AND o1 AND re >= a - 40000 GROUP BY 1, 2),
qq AS (SELECT e.media_id, seg_no, min_by(f * 10000, [abs(f * 10000 - greatest(q0, a - room)), f]) AS q FROM e5 e JOIN qf ON qf.media_id = e.media_id AND settled AND NOT cont AND q1 >= q0 AND f BETWEEN q0 // 10000 AND q1 // 10000 GROUP BY 1, 2),
f0 AS (SELECT e5.*, o.s AS ons, o.p AS peak, qq.q AS q,
  CASE WHEN cont THEN coalesce(z, least(i1, greatest(i0, it))) * 2000 WHEN o.s IS NOT NULL THEN greatest(low, o.s - room) ELSE coalesce(qq.q, greatest(q0, least(q1, a - 20000))) END AS r0
  FROM e5 LEFT JOIN zz USING (media_id, seg_no) LEFT JOIN oo USING (media_id, seg_no) LEFT JOIN qq USING (media_id, seg_no)),
f1 AS (SELECT *, CASE WHEN cont OR ons IS NULL THEN a ELSE ons END AS onset FROM f0),
f2 AS (SELECT *, greatest(0, onset - r0) AS head, greatest(0, r1 - off) AS tailroom, coalesce(disc AND NOT cont AND r0 <= pe + 500, false) AS leak FROM f1),
f3 AS (SELECT *, CASE WHEN cont THEN r0 >= pe - 4500 AND r0 <= a + 2500 WHEN ons IS NOT NULL THEN head >= 19500 ELSE q IS NOT NULL END AS clean FROM f2)
SELECT media_id, seg_no, r0 AS refined_start_us, r1 AS refined_end_us, cx AS entry_context,
  CASE WHEN cont THEN 'continuous-speech-zero-cross-splice' WHEN ons IS NOT NULL THEN 'silero-speech-onset' ELSE 'energy-trough-near-asr' END AS entry_strategy, clean AND NOT leak AS entry_clean, tail_clear,
  onset AS speech_onset_us, CASE WHEN NOT cont THEN peak END AS onset_peak, head AS headroom_us, off AS speech_offset_us, tailroom AS tailroom_us,
  CASE WHEN clean AND NOT leak AND cont THEN 4 WHEN clean AND NOT leak AND head >= 40000 THEN 8 ELSE 0 END AS fade_in_ms, CASE WHEN tail_clear AND tailroom >= 20000 THEN 8 ELSE 0 END AS fade_out_ms,
  list_filter([CASE WHEN NOT clean THEN CASE WHEN cont THEN 'unsafe_continuous_splice_boundary' ELSE 'no_quiet_entry_boundary' END END, CASE WHEN leak THEN 'discarded_filler_tail_may_leak' END,
    CASE WHEN NOT tail_clear THEN 'no_confirmed_quiet_tail' END, CASE WHEN r1 <= r0 THEN 'invalid_refined_bounds' END], lambda v: v IS NOT NULL) AS errors FROM f3
"""


@query("refine_boundaries", "W20", REFINED)
def _(spark, sf):
    w, act, smp, reg = boundary_inputs(spark, sf)
    s = boundary_segments(w)
    win = w.groupBy("media_id").agg(F.lit(0).cast("long").alias("window_start_us"), (F.max("pos") * 200_000 + 200_000).alias("window_end_us"))
    return fr.refine_boundaries(s.join(win, "media_id"), act, reg, smp, sample_rate=500)
