"""Joins on time: containment, as-of and nearest. All bucket or scan; none pairs up a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.operators import scans
from cuemill.session import hashed, whole


def with_buckets(df: DataFrame, lower, upper, width: int, name: str = "__bucket") -> DataFrame:
    """One row per bucket of ``width`` that [lower, upper] touches."""
    lo, hi = F.floor(lower / width), F.floor(upper / width)
    return df.withColumn(name, F.explode(F.sequence(lo, F.greatest(lo, hi))))


def beside_rows(df: DataFrame, key: str, pos: str, **columns) -> DataFrame:
    """Add columns of the row ``offset`` places on: ``name=(column, offset)``. ``pos`` is dense inside ``key``. Each row sends its
    value to the position that asks for it, so rows meet by (key, pos): no window, and no key gathers."""
    own = F.struct(*[c for c in df.columns if c not in (key, pos)])
    kind = df.select(own.alias("r")).schema["r"].dataType
    none = {n: F.lit(None).cast(df.schema[c].dataType) for n, (c, _) in columns.items()}
    sent = [F.struct(F.col(pos).cast("long").alias("p"), own.alias("r"), *[v.alias(n) for n, v in none.items()])]
    for name, (c, offset) in columns.items():
        sent.append(F.struct((F.col(pos) - offset).cast("long").alias("p"), F.lit(None).cast(kind).alias("r"), *[(F.col(c) if n == name else v).alias(n) for n, v in none.items()]))
    rows = df.select(key, F.explode(F.array(*sent)).alias("s")).select(key, "s.*")
    met = rows.groupBy(key, "p").agg(F.first("r", True).alias("r"), *[F.first(n, True).alias(n) for n in columns])
    return met.filter("r IS NOT NULL").select(key, F.col("p").alias(pos), "r.*", *columns)


def sweep(rows: DataFrame, key: str, pos: str, asks: dict, facts: dict, steps: dict | None = None) -> DataFrame:
    """Look up several kinds of facts in one ordered pass: the nearest at or before, and at or after, a point of each row, moved
    into its window.

    ``asks``: kind -> (condition, at, lo, hi), integer columns of ``rows``; ``facts``: kind -> (DataFrame of key, at and payload columns,
    bucket width). Adds ``<kind>_before`` and ``<kind>_after``, structs of ``at`` and payload, null where none lies in [lo, hi].

    A fact with a column ``to`` stands for one at each of ``at``, ``at`` + step, ..., ``to``, with the step of its kind (``steps``, 1 by
    default); all lie in one bucket, and such facts don't overlap.

    All sources are stacked and dealt by (key, kind, time bucket); a row asks in each bucket that its window touches, so the
    windows should be short against the width. Running values inside a bucket find the facts, and one aggregate per row
    puts the buckets together. Facts and rows are read once; rows take no part in a join."""
    payload = {}
    for df, _ in facts.values():
        payload |= {f.name: f.dataType for f in df.schema if f.name not in (key, "at", "to")}
    own = F.struct(*[c for c in rows.columns if c not in (key, pos)])
    own_type = rows.select(own.alias("r")).schema["r"].dataType
    nothing = F.lit(None).cast(own_type)
    long = lambda c: c.cast("long")
    parts = [F.struct(F.lit("").alias("kind"), long(F.lit(None)).alias("at"), long(F.lit(None)).alias("lo"), long(F.lit(None)).alias("hi"), F.array(F.col(pos).cast("long")).alias("buckets"), own.alias("row"))]
    for kind, (when, at, lo, hi) in asks.items():
        width = facts[kind][1]
        buckets = F.sequence(F.floor(lo / width), F.floor(F.greatest(lo, hi) / width))
        ask = F.struct(F.lit(kind).alias("kind"), long(F.least(hi, F.greatest(lo, at))).alias("at"), long(lo).alias("lo"), long(hi).alias("hi"), buckets.alias("buckets"), nothing.alias("row"))
        parts.append(F.when(when & (hi >= lo), ask))
    asked = rows.select(key, F.col(pos).cast("long").alias("__pos"), F.explode(F.array_compact(F.array(*parts))).alias("a"))
    asked = asked.select(key, "__pos", "a.kind", "a.at", "a.lo", "a.hi", "a.row", F.explode("a.buckets").alias("bucket"), *[F.lit(None).cast(t).alias(f"f_{n}") for n, t in payload.items()], long(F.lit(None)).alias("to"))
    stacked = asked
    for kind, (df, width) in facts.items():
        have = [(F.col(n) if n in df.columns else F.lit(None).cast(t)).alias(f"f_{n}") for n, t in payload.items()]
        fact = df.select(key, F.lit(None).cast("long").alias("__pos"), F.lit(kind).alias("kind"), long(F.col("at")).alias("at"), long(F.lit(None)).alias("lo"), long(F.lit(None)).alias("hi"),
                         nothing.alias("row"), F.floor(F.col("at") / width).alias("bucket"), *have, long(F.col("to") if "to" in df.columns else F.lit(None)).alias("to"))
        stacked = stacked.unionByName(fact)
    fact = F.when(F.col("__pos").isNull(), F.struct("at", *[F.col(f"f_{n}").alias(n) for n in payload], "to"))
    cell = Window.partitionBy(key, "kind", "bucket")
    span = (Window.unboundedPreceding, Window.currentRow)
    seen = stacked.withColumn("before", F.max(fact).over(cell.orderBy("at").rangeBetween(*span)))
    seen = seen.withColumn("after", F.min(fact).over(cell.orderBy(F.desc("at")).rangeBetween(*span))).filter("__pos IS NOT NULL")
    moved = lambda side, at: F.struct(at.alias("at"), *[side[n].alias(n) for n in payload])
    prev, nxt, at = F.col("before"), F.col("after"), F.col("at")

    def nearby(kind):
        last, following = prev["at"], nxt["at"]
        step = (steps or {}).get(kind, 1)
        if "to" in facts[kind][0].columns:
            # In a range the last place at or before the asked one, and the one after it if it is still in the range.
            last = F.least(prev["to"], last + F.floor((at - last) / step) * step)
            following = F.coalesce(F.when(last == at, last), F.when(last + step <= prev["to"], last + step), following)
        source = F.when(following < nxt["at"], prev).otherwise(F.coalesce(nxt, prev))
        of = lambda side, x: F.when((F.col("kind") == kind) & x.between(F.col("lo"), F.col("hi")), moved(side, x))
        return of(prev, last), of(source, following)

    found = [x for kind in asks for before, after in [nearby(kind)] for x in (F.max(before).alias(f"{kind}_before"), F.min(after).alias(f"{kind}_after"))]
    met = seen.groupBy(key, "__pos").agg(F.first("row", True).alias("row"), *found)
    return met.select(key, F.col("__pos").alias(pos), "row.*", *[f"{k}_{s}" for k in asks for s in ("before", "after")])


def nearer(kind: str, target: Column) -> Column:
    """Of the facts that ``sweep`` found, the one nearer to ``target``; the earlier at equal distances."""
    before, after = F.col(f"{kind}_before"), F.col(f"{kind}_after")
    closer = F.coalesce(F.abs(after["at"] - target) < F.abs(before["at"] - target), F.lit(False))
    return F.when(before["at"].isNull() | closer, after).otherwise(before)


LEVELS = 32


def range_cells(lower: Column, upper: Column, width: int) -> Column:
    """Cells (level, place) of doubling width that make up the range [lower, upper] of buckets of ``width``: at most two a level,
    so a range over a whole item has fewer than 64, and none covers a bucket outside. Level k has cells of 2^k buckets."""
    a, b = F.floor(lower / width).cast("long"), F.greatest(F.floor(lower / width), F.floor(upper / width)).cast("long") + 1
    cell = lambda k, at: F.struct(k.cast("int").alias("level"), at.cast("long").alias("place"))
    shift = lambda c, k: F.call_function("shiftright", c, k)
    odd = lambda c: c.bitwiseAND(1) == 1

    def of_level(k: Column) -> Column:
        # Ends of the range in cells of this level, what the finer levels have taken left out.
        lo, hi = shift(a + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), shift(b, k)
        return F.array_compact(F.array(F.when((lo < hi) & odd(lo), cell(k, lo)), F.when((lo < hi) & odd(hi), cell(k, hi - 1))))

    levels = F.sequence(F.lit(0), F.least(F.lit(LEVELS - 1), F.floor(F.log2(b - a)).cast("int") + 1))
    return F.when(b - a == 1, F.array(cell(F.lit(0), a))).otherwise(F.flatten(F.transform(levels, of_level)))


def bucketed_range_join(
    points: DataFrame, ranges: DataFrame, keys, at, lower, upper, condition: Column, width: int, how: str = "inner", long_ranges: bool = False
) -> DataFrame:
    """Join each point to the ranges holding it: equi join on (keys, time bucket), ``condition`` as residual.
    A point lies in exactly one bucket, so no pair comes out twice. The bucket keeps one long item spread.

    With ``long_ranges``, for a small table of ranges that may reach over whole items, a range is cut into cells of doubling
    width instead (``range_cells``), a few rows and not one per bucket. A point is looked up once in each level that some range
    uses, which a subquery over the ranges finds first; cells of a range don't overlap. Inner joins only."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if long_ranges and how != "inner":
        raise ValueError("an outer join needs ranges by buckets")
    if not long_ranges:
        left, right = points.withColumn("__cell", F.floor(at / width)), with_buckets(ranges, lower, upper, width, "__cell")
        return joined_on_cells(left, right, keys, condition, how)
    right = ranges.withColumn("__cell", F.explode(range_cells(lower, upper, width)))
    used = right.select(F.array_sort(F.collect_set("__cell.level")).alias("levels"))
    levels = used.scalar()
    place = F.floor(at / width).cast("long")
    left = points.withColumn("__level", F.explode(levels)).withColumn("__cell", F.struct(F.col("__level").alias("level"), F.call_function("shiftright", place, F.col("__level")).alias("place"))).drop("__level")
    return joined_on_cells(left, right, keys, condition, how)


def joined_on_cells(left: DataFrame, right: DataFrame, keys: list[str], condition: Column, how: str) -> DataFrame:
    match = condition
    if whole(left, keys):
        right = hashed(right, *keys)
    for k in keys + ["__cell"]:
        right = right.withColumnRenamed(k, f"__r_{k.strip('_')}")
        match = (F.col(k) == F.col(f"__r_{k.strip('_')}")) & match
    return left.join(right, match, how).drop("__cell", *[f"__r_{k.strip('_')}" for k in keys + ["__cell"]])


def asof(points: DataFrame, facts: DataFrame, keys, at: str, fact_at: str, fact_tie: str, width: int,
         point_id: str, next_too: bool = False) -> DataFrame:
    """For every point the last fact at or before it (``prev``) and, on request, the first at or after (``next``).

    The two tables are stacked and scanned once in time order by blocks of ``width``; nothing is paired up.
    Facts tie by ``fact_tie``. At equal times ``prev`` is the fact listed first, and so is ``next``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    fact = F.struct(*[c for c in facts.columns if c not in keys]).alias("__fact")
    point = F.struct(*[c for c in points.columns if c not in keys]).alias("__point")
    none_fact = F.lit(None).cast(facts.select(fact).schema[0].dataType).alias("__fact")
    none_point = F.lit(None).cast(points.select(point).schema[0].dataType).alias("__point")

    # Order at one instant: facts from last to first listed, points, facts from first to last listed. So the last fact
    # before a point and the next one after it are both the first listed, and one scan finds both.
    tie = F.col(fact_tie).cast("long")
    turns = [F.struct(F.lit(0).alias("side"), (-tie).alias("tie"))] + ([F.struct(F.lit(2).alias("side"), tie.alias("tie"))] if next_too else [])
    f = facts.select(*keys, F.col(fact_at).alias("__at"), F.explode(F.array(*turns)).alias("__t"), fact, none_point)
    f = f.select(*keys, "__at", F.col("__t.side").alias("__side"), F.col("__t.tie").alias("__tie"), "__fact", "__point")
    p = points.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"),
                      F.col(point_id).cast("long").alias("__tie"), none_fact, point)
    specs = {"prev": scans.last_upto(F.when(F.col("__side") == 0, F.col("__fact")))}
    if next_too:
        specs["next"] = scans.next_from(F.when(F.col("__side") == 2, F.col("__fact")))
    out = scans.scan(f.unionByName(p), keys, ["__at", "__side", "__tie"], scans.by_span("__at", width), **specs).filter("__side = 1")
    return out.select(*keys, *[F.col("__point")[c].alias(c) for c in points.columns if c not in keys], *specs)


def nearest(points: DataFrame, facts: DataFrame, keys, at: str, fact_at: str, fact_tie: str, width: int,
            point_id: str) -> DataFrame:
    """The fact nearest in time to each point; equal distances go to the fact listed first (``fact_tie``)."""
    both = asof(points, facts, keys, at, fact_at, fact_tie, width, point_id, next_too=True)
    d_prev = F.col(at) - F.col("prev")[fact_at]
    d_next = F.col("next")[fact_at] - F.col(at)
    take_next = F.col("prev").isNull() | (d_next < d_prev) | (
        (d_next == d_prev) & (F.col("next")[fact_tie] < F.col("prev")[fact_tie])
    )
    return both.withColumn("nearest", F.when(F.col("next").isNotNull() & take_next, F.col("next")).otherwise(F.col("prev"))).drop(
        "prev", "next"
    )
