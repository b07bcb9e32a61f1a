"""Line dedup across documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import LOWER, SPACES, UPPER, rest, unpack
from cuemill.session import stage


def line_key(line):
    """A line stripped of white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Lines whose key has ``min_chars`` code points or more and lies in ``min_docs`` documents or more go everywhere but in
    the document with the smallest id; the other lines stay in place, joined by line feeds.

    Returns the columns of ``docs``, with ``kept_text``, ``n_lines`` and ``n_dropped`` (they replace columns of these names).

    * Null or empty text: one empty line, kept text ''. A document that loses all lines keeps its row with text ''.
    * Rows with one id are one document when documents are counted, and each row loses its own lines; rows without id are
      one document that comes last. Repeated rows give repeated results. An empty table gives no rows.
    * Keys are compared by two 64-bit hashes.

    Shuffles: (id, hashes) to count, (id, place, hashes) to find the places to drop, and each text once to put it together.
    A line that a third of all documents hold is counted by partial sums, and its join is one Spark can split."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), rest(docs, id_col, text_col)).withColumn("th", F.xxhash64("text"))
    places = (
        d.select("id", "th", F.posexplode(lines).alias("place", "line"))
        .select("id", "th", "place", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "th", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    repeated = stage(
        places.select("id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.min("id").alias("keeper")).where(F.col("docs") >= min_docs).select("h1", "h2", "keeper"),
        "repeated-lines",
    )
    drops = (
        places.join(repeated, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("drop_id"), F.col("th").alias("drop_th")).agg(F.collect_set("place").alias("drops"))
    )
    met = d.join(drops.hint("shuffle_hash"), d["id"].eqNullSafe(drops["drop_id"]) & d["th"].eqNullSafe(drops["drop_th"]), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    made = met.withColumn("lines", lines).select(
        F.col("id").alias(id_col), F.col("text").alias(text_col), "row", kept.alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"), F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
    )
    return unpack(made, [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")], ("kept_text", "n_lines", "n_dropped"))
