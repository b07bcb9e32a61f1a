"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuemill.llm.common import components
from cuemill.session import stage

GROUP = ("label", "dims", "tab", "bucket", "pair")


def hash_plan(vectors: int, cosine: float, miss: float) -> tuple[int, int]:
    """Bits per key and number of tables. Bits grow with the number of vectors, so buckets stay small; tables follow so that a
    pair at the threshold shares no bucket with probability ``miss`` at most. One bit agrees with 1 - angle / pi."""
    bits = min(24, max(8, round(math.log2(max(vectors, 1) / 256))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree)) if agree < 1 else 1


def bucket_keys(reps: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``reps`` (id, label, dims, size, vec) with ``keys``: one bucket per table, from the signs of ``bits`` projections."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = [None] * len(batch)
            vec, dims = batch.column("vec").to_pylist(), batch.column("dims").to_pylist()
            for d in set(dims):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, tables * bits))
                rows = [i for i, x in enumerate(dims) if x == d]
                v = np.array([vec[i] for i in rows], np.float64)
                signs = (v / np.abs(v).max(axis=1, keepdims=True)) @ planes[d] > 0
                found = signs.reshape(len(rows), tables, bits) @ (1 << np.arange(bits))
                for i, k in zip(rows, found.astype(np.int32)):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int32()))], names=[*batch.schema.names, "keys"])

    return reps.mapInArrow(run, T.StructType([*reps.schema.fields, T.StructField("keys", T.ArrayType(T.IntegerType()))]))


def linked(v: np.ndarray, w: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of ``v`` and ``w`` have a cosine of at least ``cosine``, in double precision."""
    v, w = (x / np.abs(x).max(axis=1, keepdims=True) for x in (v, w))
    dot = v @ w.T
    return dot / (np.sqrt((v * v).sum(axis=1))[:, None] * np.sqrt((w * w).sum(axis=1))[None, :]) >= cosine


def block_links(table: dict[str, list], cosine: float):
    """Links among the vectors of one block pair: ids, linked vectors first met in this table, smallest id linked here."""
    ids, sizes, block = (np.array(table[c]) for c in ("id", "size", "block"))
    keys = np.array(table["keys"])
    v = np.array(table["vec"], np.float64)
    tab = table["tab"][0]
    link = linked(v, v, cosine)
    np.fill_diagonal(link, False)
    link &= link.T
    if table["cross"][0]:
        link &= block[:, None] != block[None, :]
    at = np.flatnonzero(link.any(axis=1))
    if not len(at):
        return None
    link, ids, sizes, keys = link[np.ix_(at, at)], ids[at], sizes[at], keys[at]
    fresh = link.copy()
    for t in range(tab):
        fresh &= keys[:, t][:, None] != keys[:, t][None, :]
    least = ids.copy()
    while True:
        lower = np.minimum(least, np.where(link, least[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (lower == least).all():
            return ids, fresh @ sizes, least
        least = lower


def compare_buckets(placed: DataFrame, cosine: float) -> DataFrame:
    """(id, links, other) from rows sorted by ``GROUP``: a task holds one block pair at a time."""
    names = ("id", "size", "block", "cross", "keys", "vec", "tab")

    def run(batches):
        now, held = None, {c: [] for c in names}
        found = [[], [], []]

        def close():
            if len(held["id"]) > 1 and (x := block_links(held, cosine)):
                for f, a in zip(found, x):
                    f.append(a)

        def out():
            cols = [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]
            for f in found:
                f.clear()
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["id", "links", "other"])

        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in {*names, *GROUP}}
            for i, g in enumerate(zip(*[cols[c] for c in GROUP])):
                if g != now:
                    close()
                    now, held = g, {c: [] for c in names}
                for c in names:
                    held[c].append(cols[c][i])
            yield out()
        close()
        yield out()

    return placed.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, "id long, links long, other long")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, miss: float = 1e-7, lot: int = 512, seed: int = 5
) -> DataFrame:
    """Links between vectors of one label at a cosine of ``cosine`` or more: id, n_links (other vectors linked directly),
    component_id (smallest id reachable), kept (id = component_id), per row. Other columns are not read.

    * A null label, a null or empty vector, a null, NaN or infinite component, or a zero vector: no links, own component.
      Vectors of different lengths are not linked.
    * Rows that agree in id, label and vector are one vector; each gets its result. Rows without id: no links, component
      null, kept. An empty table gives no rows.

    Equal vectors of a label are one class, so copies cost one comparison; every member counts as a link. In each table the
    vectors of a bucket are compared with numpy, in blocks of about ``lot``: a large bucket becomes many block pairs in many
    tasks, with no cap. A link counts in the first table that holds its pair. Components come from Spark joins."""
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    d = d.withColumn("ok", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & fine, F.lit(False)))
    d = d.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("label", "vec")), "h2": F.when(F.col("ok"), F.xxhash64("vec", "label"))})
    single = d.where("ok").groupBy("h1", "h2", "id").agg(F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = stage(single.groupBy("h1", "h2").agg(F.min(F.struct("id", "label", "vec")).alias("rep"), F.count("*").alias("size")).select("h1", "h2", "size", "rep.*").withColumn("dims", F.size("vec")), "vector-classes")
    bits, tables = hash_plan(classes.count(), cosine, miss)
    keyed = stage(bucket_keys(classes.select("id", "label", "dims", "size", "vec"), bits, tables, seed), "bucket-keys")
    spots = keyed.select("id", "label", "dims", F.posexplode("keys").alias("tab", "bucket"))
    full = stage(spots.groupBy("label", "dims", "tab", "bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / lot).cast("int")).drop("n"), "buckets")
    rows = keyed.select("*", F.posexplode("keys").alias("tab", "bucket")).join(full, ["label", "dims", "tab", "bucket"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = rows.withColumn("pair", F.least("block", "partner") * F.col("blocks") + F.greatest("block", "partner")).withColumn("cross", F.col("block") != F.col("partner"))
    found = stage(compare_buckets(placed.select(*GROUP, "id", "size", "block", "cross", "keys", "vec"), cosine), "vector-links")
    counts = found.groupBy(F.col("id").alias("c_id")).agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("id").alias("src"), F.col("other").alias("dst")))
    named = classes.join(counts, F.col("id") == F.col("c_id"), "left").join(joined, F.col("id") == F.col("node"), "left")
    named = stage(named.select("h1", "h2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")), "vector-components")
    out = d.select("id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
