"""Helpers shared by the corpus operators: reading tables, distributed ranks, connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of all contracts: blank and the five control characters from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def rest(df: DataFrame, *used: str):
    """The columns an operator has no use for, as one struct ``row`` that it hands through under no name of its own."""
    names = [c for c in df.columns if c not in used]
    return F.struct(*[F.col(f"`{c}`") for c in names]).alias("row") if names else F.lit(None).cast("struct<none:int>").alias("row")


def unpack(df: DataFrame, order: Sequence[str], made: Sequence[str] = ()) -> DataFrame:
    """Undo ``rest``: columns in the order of the input; a column the operator made replaces one of the same name."""
    back = [F.col(f"`{c}`") if c in made or c in df.columns else F.col(f"row.`{c}`").alias(c) for c in order]
    return df.select(*back, *[F.col(c) for c in made if c not in order])


def slices_by_bytes(batches, column: int = 1, most: int = 4 << 20):
    """Arrow batches in pieces whose strings (or binaries) in ``column`` have at most ``most`` bytes together; one longer value
    is a piece by itself. Rows without such bytes are cut at 8,192."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        at = 0
        while at < len(batch):
            done = ends[at - 1] if at else 0
            upto = min(max(int(np.searchsorted(ends, done + most, side="right")), at + 1), at + 8192, len(batch))
            yield batch.slice(at, upto - at)
            at = upto


def tidied(run):
    """A task's function over Arrow batches that hands free memory back to the system, now and then and at its end. Workers
    serve one task after another; otherwise each keeps the most that any of its tasks needed."""

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        pool = pa.default_memory_pool()

        def freed():
            for batch in batches:
                yield batch
                del batch
                pool.release_unused()

        yield from run(freed())
        pool.release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
        if trim:
            trim(0)

    return wrapped


def beside(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A written table of keys, to be joined with texts: broadcast if it has at most ``rows`` rows, so the texts stay where they
    are; beyond that the build side of a shuffled hash join."""
    return F.broadcast(df) if df.count() <= rows else df.hint("shuffle_hash")


def ranks(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], buckets: int = 4096) -> DataFrame:
    """Column ``rank``: place of each row from 0 among the rows of its key, by ``order``, an evenly spread 64-bit hash.

    Rows are ranked inside (key, slice of the hash range) and the counts of the lower slices are added, so a key that
    holds a third of all rows is ranked by many tasks. ``df`` is read twice; hand in a written table."""
    cut = df.withColumn("rank_slice", F.shiftright(order, 64 - (buckets.bit_length() - 1)))
    counts = stage(cut.groupBy(*keys, "rank_slice").agg(F.count("*").alias("rows")), "rank-counts")
    before = Window.partitionBy(*keys).orderBy("rank_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"start_{k}") for k in keys], F.col("rank_slice").alias("start_rank_slice"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rank_before"))
    same = cut["rank_slice"] == starts["start_rank_slice"]
    for k in keys:
        same = same & cut[k].eqNullSafe(starts[f"start_{k}"])
    inside = Window.partitionBy(*keys, "rank_slice").orderBy(order, *ties)
    numbered = cut.withColumn("rank_place", F.row_number().over(inside))
    return numbered.join(starts, same).withColumn("rank", F.col("rank_before") + F.col("rank_place") - 1).select(*df.columns, "rank")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of ``edges`` (src, dst: long): one row (node, component) per node, its smallest reachable node.

    Alternates the large-star and the small-star step until the edges are stars: each node has one edge, to a node that has
    none. Each step writes the smallest neighbour of every node, then joins it back, so the join of a node with very many
    edges can be split. Loops are left out; no edges give no rows."""

    def toward_least(links: DataFrame) -> DataFrame:
        least = stage(links.groupBy("a").agg(F.min("b").alias("m")), "least").withColumnRenamed("a", "node")
        return links.join(least, links["a"] == least["node"]).select("a", "b", F.least("a", "m").alias("m"))

    def stars(df: DataFrame) -> bool:
        ends = df.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("top")).union(df.select("v", F.lit(0), F.lit(1)))
        mixed = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("top").alias("top")).where(F.col("down") + F.col("top") > 1)
        return mixed.count() == 0  # one job; looking for a first row would be several where there is none

    now = stage(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges"
    )
    for _ in range(limit):
        if stars(now):
            leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).union(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        large = stage(toward_least(both).where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        small = toward_least(large.select(F.col("u").alias("a"), F.col("v").alias("b")))
        pairs = F.explode(F.array(F.struct(F.col("b").alias("u"), F.col("m").alias("v")), F.struct(F.col("a").alias("u"), F.col("m").alias("v"))))
        now = stage(small.select(pairs.alias("p")).select("p.*").where("u <> v").distinct(), "small-star")
    raise RuntimeError(f"components did not settle in {limit} rounds")
