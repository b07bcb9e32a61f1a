"""Mix sources to target weights: budgets per source, filled by subset sums over the counts of document lengths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.common import WORD, ranks, rest
from cuemill.session import stage


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target words per source. ``sources``: one row (source, source_size) per source; so this table, not the documents,
    is what one task sorts.

    Sources by code point, null last, take the weights in turn and share ``share`` x all words. No target passes ``most`` x
    its source's size; what is over is shared again by weight. That is a level L with target = min(most x size, L x weight):
    going through the sources by size per weight, L is the largest of (total - caps before) / (weights from here on)."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), place % len(weights))
    d = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    d = d.withColumn("total", F.sum("source_size").over(everything) * float(share))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn("level", (F.col("total") - before) / onward)
    level = F.max("level").over(everything)
    return d.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def best_sum(sizes: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size, at most ``free``, sum to ``budget`` or as near below it as any choice does: a bounded-knapsack DP,
    all sums in a bit set, multiplicities in powers of two."""
    took = np.zeros(len(sizes), dtype=np.int64)
    if budget <= 0:
        return took
    mask, bits, steps = (1 << (budget + 1)) - 1, 1, []
    for i in np.argsort(sizes, kind="stable"):
        size = int(sizes[i])
        if size <= 0:
            continue
        open_, lot = int(min(free[i], budget // size)), 1
        while open_ > 0:
            lot = min(lot, open_)
            steps.append((i, lot, size, bits))
            bits |= (bits << (lot * size)) & mask
            open_ -= lot
            lot *= 2
    at = bits.bit_length() - 1
    for i, lot, size, was in reversed(steps):
        if not (was >> at) & 1:
            took[i] += lot
            at -= lot * size
    return took


def fill_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int = 32768) -> np.ndarray:
    """How many documents of each size to take so that their sizes sum to ``budget`` or just below it.

    Every size gives its proportional share, rounded down; the longest that fit follow until at most ``dp_budget`` is
    open; ``best_sum`` over the counts left closes the gap."""
    took = np.zeros(len(sizes), dtype=np.int64)
    whole = int((sizes * counts).sum())
    if budget <= 0 or whole == 0:
        return took
    if budget >= whole:
        return counts.copy()
    took[:] = [int(c) * budget // whole for c in counts]
    left = budget - int((took * sizes).sum())
    some = np.flatnonzero(sizes > 0)
    longest = some[np.argsort(-sizes[some], kind="stable")]
    for i in longest:
        if left <= dp_budget:
            break
        more = min(int(counts[i] - took[i]), (left - dp_budget) // int(sizes[i]) + 1, left // int(sizes[i]))
        took[i] += more
        left -= more * int(sizes[i])
    if left <= dp_budget:
        took += best_sum(sizes, counts - took, left)
    return took


def fill_exactly(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int = 32768, dp_bits: int = 1 << 30) -> np.ndarray:
    """``fill_budget``, and where that misses the budget, documents are given back, more each time, and ``best_sum`` fills the
    larger gap, up to the whole budget without any share, until the budget is met or the bit sets of the next try would
    pass ``dp_bits`` bits together."""
    took = keep = fill_budget(sizes, counts, budget, dp_budget)
    whole = int((sizes * counts).sum())
    left = goal = min(budget, whole) - int((took * sizes).sum()) if budget > 0 else 0
    some = np.flatnonzero(sizes > 0)
    while left > 0 and took.any() and budget < whole:
        # Give back of every size, so that the gap about doubles, and fill it anew.
        goal = max(2 * goal, 2 * dp_budget)
        took = took * max(0, budget - goal) // budget
        gap = budget - int((took * sizes).sum())
        lots = sum(min(int(c), gap // int(k)).bit_length() for k, c in zip(sizes[some], (counts - took)[some]))
        if lots * gap > dp_bits:
            break
        again = took + best_sum(sizes, counts - took, gap)
        left = budget - int((again * sizes).sum())
        if left < budget - int((keep * sizes).sum()):
            keep = again
    return keep


def keys_of(id_, text, source, seed: int) -> dict:
    """The seeded draw of a row, and a second hash; together they stand for its id, text and source."""
    return {"draw": F.xxhash64(F.lit(seed), id_, text, source), "draw2": F.xxhash64(source, text, id_)}


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17,
) -> DataFrame:
    """How often the mix takes each document: columns id, size (words), source_size, target, repeats, taken (words).

    A source whose target is ``t`` takes every document floor(t / size) times; the rest of the budget is filled by
    ``fill_exactly`` from the source's counts of documents by size, first with one more of each; where that misses the budget,
    with as many more as ``most`` allows. The documents of a size are drawn by a seeded hash of id and text. Reruns agree. No document is taken more than ``most`` times.

    * Null text: size 0; such documents are taken 0 words, 0 repeats. Null source: a source of its own, last in order.
    * Rows with one id are drawn apart unless their texts agree too; then either may be drawn, and the results are equal.
    * Empty table: no rows. Other columns play no part and are not returned.

    Documents of one source and length are ranked by many tasks (``ranks``); histograms hold one row per source and length."""
    sized = stage(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            *[c.alias(k) for k, c in keys_of(F.col(id_col), F.col(text_col), F.col(source_col), seed).items()],
        ),
        "mix-sizes",
    )
    histogram = stage(sized.groupBy("source", "size").agg(F.count("*").alias("rows")), "mix-histogram")
    targets = stage(source_targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).cast("long").alias("source_size")), weights, share, most), "mix-targets")

    def plan(h: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(h["source_size"].iloc[0]), float(h["target"].iloc[0])
        base = min(int(most), int(target // whole)) if whole else 0
        h = h.sort_values("size")
        open_ = round(target) - base * whole
        sizes, rows = h["size"].to_numpy(np.int64), h["rows"].to_numpy(np.int64) * (h["size"].to_numpy() > 0)
        extra = fill_exactly(sizes, rows, open_ if base < int(most) else 0)
        if base + 1 < int(most) and (extra * sizes).sum() < open_:
            more = fill_exactly(sizes, rows * (int(most) - base), open_)
            extra = more if (more * sizes).sum() > (extra * sizes).sum() else extra
        return pd.DataFrame({"source": h["source"], "size": h["size"], "rows": h["rows"], "base": base, "extra": extra, "source_size": whole, "target": target})

    with_target = histogram.join(F.broadcast(targets) if targets.count() <= 100_000 else targets, histogram["source"].eqNullSafe(targets["source"])).select(histogram["source"], "size", "rows", "source_size", "target")
    plans = stage(with_target.groupBy("source").applyInPandas(plan, "source string, size long, rows long, base long, extra long, source_size long, target double"), "mix-plan")
    ranked = ranks(sized, ["source", "size"], "draw", ["doc_id"])
    p = plans.select(F.col("source").alias("plan_source"), F.col("size").alias("plan_size"), "rows", "base", "extra", "source_size", "target")
    met = ranked.join(p, ranked["source"].eqNullSafe(p["plan_source"]) & (ranked["size"] == p["plan_size"]))
    repeats = F.when(F.col("size") > 0, F.col("base") + F.floor(F.col("extra") / F.col("rows")) + (F.col("rank") < F.col("extra") % F.col("rows")).cast("long")).otherwise(F.lit(0)).cast("long")
    return met.select(F.col("doc_id").alias(id_col), "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"), "draw", "draw2")


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """The mixed corpus: every document as often as ``mix`` takes it, with its columns. Documents taken 0 times go.

    Rows that agree in id, text and source share the repeats that ``mix`` gives them."""
    plan = mix(docs, id_col, text_col, source_col, seed=seed, **options).groupBy("draw", "draw2").agg(F.sum("repeats").alias("repeats"), F.count("*").alias("copies")).where("repeats > 0")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), rest(docs, id_col, text_col, source_col))
    met = d.withColumns(keys_of(F.col("id"), F.col("text"), F.col("source"), seed)).join(plan.hint("shuffle_hash"), ["draw", "draw2"])
    copy = F.when(F.col("copies") > 1, F.row_number().over(Window.partitionBy("draw", "draw2").orderBy("draw"))).otherwise(1) - 1
    each = F.floor(F.col("repeats") / F.col("copies")) + (copy < F.col("repeats") % F.col("copies")).cast("long")
    taken = met.withColumn("each", each).where("each > 0").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), "each")))
    own = {id_col: F.col("id"), text_col: F.col("text"), source_col: F.col("source")}
    return taken.select(*[(own[c] if c in own else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
