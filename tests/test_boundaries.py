"""Refined boundaries against a plain walk over the same small inputs, segment after segment."""

import math
import random

from cuemill.functions import rules as R
from cuemill.operators import frames as fr


def walk(segs, active, regions, samples, win, rate):
    """The rule read segment by segment; times in microseconds."""
    out, prev_end = [], win[0]
    idx = lambda t: min(len(active) - 1, max(0, t // R.FRAME_US))
    for n, s in enumerate(segs):
        first, pred, cont, cx = s["first"], s["pred"], s["cont"], s["cx"]
        base = win[0] if n == 0 else max(win[0], prev_end + 10_000)
        least = base
        if pred is not None and not cont:
            least = max(base, pred + (15_000 if s["disc"] else 5_000))
        nxt = segs[n + 1]["a"] if n + 1 < len(segs) else win[1]
        tail = min(win[1], s["b"] + R.MAX_TAIL_US, nxt - 10_000)
        if s["nw"] is not None and s["nw"] >= s["last"]:
            tail = min(tail, s["nw"])
        quiet, run = None, 0
        for i in range(idx(max(0, s["last"] - 20_000)), idx(tail) + 1):
            run = 0 if active[i] else run + 1
            if run == R.QUIET_RUN_FRAMES:
                quiet = (i - 1) * R.FRAME_US
                break
        if quiet is not None:
            off = max(s["last"], quiet)
            end = min(tail, off + R.TARGET_TAIL_US)
            clear = end - off >= R.MIN_TAIL_US - R.EPS_US
        else:
            off, clear = s["last"], False
            end = min(tail, max(s["b"], s["last"] + R.MIN_TAIL_US))
        end = max(end, s["last"] + min(R.MIN_TAIL_US, max(0, tail - s["last"])))
        low, high = {"opening": (max(0, first - 300_000), first + 600_000), "after-filler": (None if pred is None else max(pred + 40_000, first - 120_000), first + 600_000), "normal": (first - 80_000, first + 450_000)}[cx]
        hits = [] if low is None or cont else [r for r in regions if low <= r[0] <= high and r[1] >= first - 40_000]
        if cont:
            lo, hi = max(base, pred - R.SPLICE_PREROLL_US), min(s["b"] - 250_000, first + R.SPLICE_POSTROLL_US)
            if hi < lo:
                lo = hi = first
            lo_i, hi_i = max(1, math.floor(lo * rate / 1e6)), min(len(samples) - 1, math.ceil(hi * rate / 1e6))
            t = min(len(samples) - 1, max(1, round(first * rate / 1e6)))
            cross = [i for i in range(lo_i, hi_i + 1) if samples[i] == 0 or samples[i - 1] == 0 or samples[i] * samples[i - 1] < 0]
            pick = min(cross, key=lambda i: (abs(i - t), i)) if cross else min(hi_i, max(lo_i, t))
            start, strategy, onset = round(pick * 1e6 / rate), "splice", first
            clean = pred - R.SPLICE_PREROLL_US - R.EPS_US <= start <= first + R.SPLICE_POSTROLL_US + R.EPS_US
        elif hits:
            onset = min(hits, key=lambda r: (abs(r[0] - first), r[0]))[0]
            start, strategy = max(least, onset - R.HEADROOM_US[cx]), "onset"
            clean = max(0, onset - start) >= R.MIN_HEADROOM_US - R.EPS_US
        else:
            onset, strategy = first, "quiet"
            lo, hi = max(least, first - R.HEADROOM_LIMIT_US[cx]), min(first - R.MIN_HEADROOM_US, s["b"] - 250_000)
            target = max(lo, first - R.HEADROOM_US[cx])
            grid = [i * R.FRAME_US for i in range(idx(lo), idx(hi) + 1) if not active[i] and not (i and active[i - 1])] if hi >= lo else []
            clean = bool(grid)
            start = min(grid, key=lambda v: (abs(v - target), v)) if grid else max(lo, min(hi, first - R.MIN_HEADROOM_US))
        leak = s["disc"] and not cont and start <= pred + R.EPS_US
        out.append((n + 1, start, end, strategy, clean and not leak, clear))
        prev_end = end
    return out


def test_against_a_walk(spark):
    names = {R.SPLICE_ENTRY: "splice", R.ONSET_ENTRY: "onset", "energy-trough-near-asr": "quiet"}
    rate, all_in, want = 1000, {k: [] for k in "segs ctx frames regions samples next win".split()}, {}
    for media in range(6):
        rnd = random.Random(media)
        t, segs, pred, disc = 300_000, [], None, False
        for n in range(8):
            gap = rnd.choice([-10_000, 5_000, 10_000, 60_000, 200_000])
            first = t + (gap if disc else rnd.choice([20_000, 90_000, 300_000]))
            last = first + rnd.choice([300_000, 600_000, 900_000])
            cont = bool(disc and -20_000 <= first - pred <= 12_000)
            nw = last + rnd.choice([15_000, 40_000, 150_000])
            segs.append(dict(a=first, b=last, last=last, first=first, pred=pred, disc=disc, cont=cont, nw=nw, cx="opening" if n == 0 else "after-filler" if disc else "normal"))
            disc = rnd.random() < 0.6
            pred = nw + rnd.choice([60_000, 120_000])
            t = pred
        win = (0, t + 200_000)
        n_frames = win[1] // R.FRAME_US + 5
        active = [rnd.random() < 0.45 for _ in range(n_frames)]
        regions = [(s["first"] + rnd.randint(-90_000, 90_000), s["last"]) for s in segs if rnd.random() < 0.4]
        samples = [rnd.randint(-50, 200) for _ in range(win[1] * rate // 1_000_000 + 10)]
        want[media] = walk(segs, active, regions, samples, win, rate)
        all_in["segs"] += [(media, i + 1, s["a"], s["b"], s["last"]) for i, s in enumerate(segs)]
        all_in["ctx"] += [(media, i + 1, s["cx"], s["first"], s["pred"], s["disc"], s["cont"]) for i, s in enumerate(segs)]
        all_in["frames"] += [(media, i, a) for i, a in enumerate(active)]
        all_in["regions"] += [(media, a, b, 0.9) for a, b in regions]
        all_in["samples"] += [(media, i, v) for i, v in enumerate(samples)]
        all_in["next"] += [(media, i + 1, s["nw"]) for i, s in enumerate(segs)]
        all_in["win"] += [(media, *win)]
    schemas = dict(
        segs="media_id long, seg_no long, source_start_us long, source_end_us long, last_end_us long",
        ctx="media_id long, seg_no long, entry_context string, first_start_us long, predecessor_end_us long, discarded boolean, continuous boolean", frames="media_id long, frame long, smoothed boolean",
        regions="media_id long, region_start_us long, region_end_us long, peak double", samples="media_id long, i long, v int", next="media_id long, seg_no long, next_word_start_us long",
        win="media_id long, window_start_us long, window_end_us long")
    d = {k: spark.createDataFrame(v, schemas[k]) for k, v in all_in.items()}
    segments = d["segs"].join(d["ctx"], ["media_id", "seg_no"]).join(d["next"], ["media_id", "seg_no"]).join(d["win"], "media_id")
    got = fr.refine_boundaries(segments, d["frames"], d["regions"], d["samples"], sample_rate=rate).collect()
    for media in want:
        mine = sorted((r.seg_no, r.refined_start_us, r.refined_end_us, names[r.entry_strategy], r.entry_clean, r.tail_clear) for r in got if r.media_id == media)
        assert mine == want[media], media
    assert {x[3] for m in want.values() for x in m} == {"splice", "onset", "quiet"}


def test_only_samples_near_a_splice_are_ordered(spark, monkeypatch):
    """Two splices, at 0.95 s and 49.95 s, in a minute of samples; entries in between are no splices."""
    seen = []
    facts = fr.crossing_facts
    monkeypatch.setattr(fr, "crossing_facts", lambda samples: seen.append(samples) or facts(samples))
    a = [950_000, 20_000_000, 49_950_000]
    segments = spark.createDataFrame(
        [(1, n + 1, t, t + 800_000, t + 800_000, None, "after-filler", t, t - 5_000, True, n != 1, 0, 60_000_000) for n, t in enumerate(a)],
        "media_id long, seg_no long, source_start_us long, source_end_us long, last_end_us long, next_word_start_us long, entry_context string, first_start_us long, "
        "predecessor_end_us long, discarded boolean, continuous boolean, window_start_us long, window_end_us long")
    samples = spark.range(60_000).selectExpr("1L AS media_id", "id AS i", "IF(id % 7 < 3, 5, -5) AS v")
    frames = spark.range(6_000).selectExpr("1L AS media_id", "id AS frame", "false AS smoothed")
    regions = spark.createDataFrame([], "media_id long, region_start_us long, region_end_us long, peak double")
    got = {r.seg_no: r.refined_start_us for r in fr.refine_boundaries(segments, frames, regions, samples, sample_rate=1000).collect()}
    # The sign changes at 0 and 3 modulo 7.
    for n in (1, 3):
        at = a[n - 1] // 1000
        near = min((i for i in range(at - 4, at + 3) if i % 7 in (0, 3)), key=lambda i: (abs(i - at), i))
        assert got[n] == near * 1000
    assert 0 < seen[0].count() <= 4 * fr.SAMPLE_CELL


def test_quiet_ranges_hold_the_quiet_frames_and_no_others(spark, monkeypatch):
    """Over many blocks of eight frames, for items that begin anywhere."""
    monkeypatch.setattr(fr, "FRAME_BUCKET", 8)
    rnd = random.Random(9)
    active = {(m, f): rnd.random() < 0.3 for m in range(4) for f in range(m * 5, 70 + m)}
    frames = spark.createDataFrame([(m, f, a) for (m, f), a in active.items()], "media_id long, frame long, smoothed boolean")
    quiet = lambda m, f, none: not active.get((m, f), none)
    for run in (1, 2, 3):
        got = fr.quiet_facts(frames, "smoothed", run).collect()
        spread = lambda a, b: sorted((r.media_id, f) for r in got for f in range(r[a], r[b] + 1))
        assert spread("opens", "opens_to") == sorted(k for k in active if all(quiet(k[0], k[1] + i, True) for i in range(run)))
        assert spread("settled", "settled_to") == sorted(k for k in active if quiet(*k, True) and quiet(k[0], k[1] - 1, False))
        assert all(r[a] > r[b] or r[a] // 8 == r[b] // 8 for r in got for a, b in (("opens", "opens_to"), ("settled", "settled_to")))


def test_frames_are_swept_as_ranges(spark, monkeypatch):
    """A long silence is one fact a block, not one a frame."""
    seen = []
    sweep = fr.joins.sweep
    monkeypatch.setattr(fr.joins, "sweep", lambda *a: seen.append(a[4]) or sweep(*a))
    segments = spark.createDataFrame(
        [(1, 1, 1_000_000, 1_800_000, 1_800_000, None, "opening", 1_000_000, None, False, False, 0, 60_000_000)],
        "media_id long, seg_no long, source_start_us long, source_end_us long, last_end_us long, next_word_start_us long, entry_context string, first_start_us long, "
        "predecessor_end_us long, discarded boolean, continuous boolean, window_start_us long, window_end_us long")
    samples = spark.range(600).selectExpr("1L AS media_id", "id AS i", "1 AS v")
    frames = spark.range(6_000).selectExpr("1L AS media_id", "id AS frame", "id BETWEEN 100 AND 181 AS smoothed")
    regions = spark.createDataFrame([], "media_id long, region_start_us long, region_end_us long, peak double")
    got = fr.refine_boundaries(segments, frames, regions, samples, sample_rate=10).collect()
    assert [(r.refined_start_us, r.refined_end_us, r.entry_clean, r.tail_clear) for r in got] == [(970_000, 1_920_000, True, True)]
    assert seen[0]["tail"][0].count() <= 4 and seen[1]["quiet"][0].count() <= 4
