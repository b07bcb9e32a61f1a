"""Licence scans in DataFrame functions: TF-IDF cosine of lines and licence files to templates, inherited along directories."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.common import LOWER, UPPER
from cuemill.session import stage

# Short notices by SPDX identifier.
NOTICES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
)
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.\-_].*)?$"


def tokens(text: Column) -> Column:
    """Lower-case words, numbers and versions of a text, in order."""
    split = F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9.]+")
    return F.filter(F.transform(split, lambda t: F.btrim(t, F.lit("."))), lambda t: t != "")


def template_terms(spark: SparkSession, notices: Sequence[tuple[str, str]]) -> DataFrame:
    """(license, token, weight, norm, idf): TF-IDF of each template, idf from the templates."""
    t = spark.createDataFrame([(i, *n) for i, n in enumerate(notices)], "notice int, license string, text string")
    tf = t.select("notice", "license", F.explode(tokens(F.col("text"))).alias("token")).groupBy("notice", "license", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg((F.log(F.lit(1.0 + len(notices)) / (1 + F.count("*"))) + 1).alias("idf"))
    weighed = tf.join(df, "token").withColumn("weight", F.col("tf") * F.col("idf"))
    norm = weighed.groupBy(F.col("notice").alias("n_notice")).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighed.join(norm, F.col("notice") == F.col("n_notice")).select("notice", "license", "token", "weight", "norm", "idf")


def needed_tokens(terms: list, least: float) -> list[str]:
    """Tokens of which a text that reaches the cosine ``least`` with a template has to hold one: of each template, the rarest,
    until the rest alone can't reach it (a text of the rest only has at most the rest's share of the norm)."""
    found: set[str] = set()
    for notice in {t["notice"] for t in terms}:
        own = sorted((t for t in terms if t["notice"] == notice), key=lambda t: (-t["idf"], t["token"]))
        rest = sum(t["weight"] ** 2 for t in own)
        bar = least**2 * own[0]["norm"] ** 2
        for t in own:
            if rest < bar * (1 - 1e-9):
                break
            found.add(t["token"])
            rest -= t["weight"] ** 2
    return sorted(found)


def able(units: DataFrame, terms: list, templates: int, least: float) -> DataFrame:
    """Units that may reach the cosine ``least`` with a template: of the others, the words that templates have, weighed, are too
    small a part of the whole length, to which each other word adds the largest idf at least. Worked out in the row; the words
    are generated columns, so that they are cut once."""
    idf = {t["token"]: t["idf"] for t in terms}
    known = F.array(*[F.lit(t) for t in sorted(idf)])
    weight = F.create_map(*[F.lit(x) for t in sorted(idf) for x in (t, idf[t])])
    said = units.withColumn("said", F.explode(F.array(tokens(F.col("text")))))
    said = said.withColumn("known", F.explode(F.array(F.filter("said", lambda t: F.array_contains(known, t)))))

    def square(t: Column) -> Column:
        times = F.size(F.filter("known", lambda x: x == t)) * F.element_at(weight, t)
        return times * times

    inside = F.aggregate(F.array_distinct("known"), F.lit(0.0), lambda total, t: total + square(t))
    unseen = (F.size("said") - F.size("known")) * (math.log(1.0 + templates) + 1) ** 2
    most = F.size("known") * F.size("known") * max(idf.values()) ** 2 * (1 - least**2)
    bar = unseen * (least**2 * (1 - 1e-9))
    return said.where(F.when(most < bar, F.lit(False)).otherwise(inside * (1 - least**2) >= bar)).select(*units.columns)


def best_matches(units: DataFrame, terms: DataFrame, templates: int, least: float) -> DataFrame:
    """Best template per unit (id, th, place, text): license and cosine. Words that no template has count with the largest idf."""
    said = units.select("id", "th", "place", F.explode(tokens(F.col("text"))).alias("token")).groupBy("id", "th", "place", "token").agg(F.count("*").alias("tf"))
    idf = terms.select(F.col("token").alias("idf_token"), "idf").distinct()
    unseen = F.lit(1.0 + templates)
    w = said.join(idf, F.col("token") == F.col("idf_token"), "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.log(unseen) + 1))
    size = w.groupBy("id", "th", "place").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), F.sum("tf").alias("words"))
    t = terms.select("notice", "license", F.col("token").alias("t_token"), "weight", "norm")
    dots = w.join(t, F.col("token") == F.col("t_token")).groupBy("id", "th", "place", "notice", "license", "norm").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    s = size.select(F.col("id").alias("s_id"), F.col("th").alias("s_th"), F.col("place").alias("s_place"), "size", "words")
    met = dots.join(s, dots["id"].eqNullSafe(s["s_id"]) & (F.col("th") == F.col("s_th")) & (F.col("place") == F.col("s_place")))
    scored = met.withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6)).where(F.col("score") >= least)
    best = scored.groupBy("id", "th", "place", "words").agg(F.min(F.struct(-F.col("score"), F.col("license"))).alias("b"))
    return best.select("id", "th", "place", "words", (-F.col("b.col1")).alias("score"), F.col("b.license").alias("license"))


def scan_licenses(files: DataFrame, id_col: str = "id", path_col: str = "path", text_col: str = "text", notices: Sequence[tuple[str, str]] = NOTICES, least: float = 0.75, share: float = 0.25) -> DataFrame:
    """Licence of every file: id, license, score, line, inherited_from.

    Each line of a whole text, and each licence file as one text too, is compared with the templates; the best cosine of at
    least ``least`` is the file's own licence. A licence file is one named so, or one of whose words at least ``share`` are
    its notice. A file without one of its own inherits that of the licence file in its nearest directory upwards
    (``inherited_from``: that directory, '' for the root).

    * Null or empty text: no own licence. Null path: nothing inherited. No licence found: license, score and line null.
    * Equal scores: the first licence by name, then the first line; among a directory's licence files the best score, then name.
    * Rows that agree in id, path and text get equal results each; rows with one id are files of their own. An empty table
      gives no rows. Other columns are not read.

    Only lines that hold one of a few needed words (``needed_tokens``) and enough words of templates (``able``) are
    weighed, which leaves out no match. Templates are a
    parameter, so their terms are a small table. A file asks each of its directories once; a directory that a third of
    all files share is a join that Spark can split, against one row per directory."""
    spark = files.sparkSession
    terms = stage(template_terms(spark, notices), "license-terms")
    rows = terms.collect()
    needed = needed_tokens(rows, least)
    pattern = "(?i)(^|[^a-z0-9])(" + "|".join(t.replace(".", r"\.") for t in needed) + ")([^a-z0-9]|$)"
    d = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("path", "text"))
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE), F.lit(False))
    lines = d.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("place", "text")).where(F.col("text").rlike(pattern))
    wholes = d.where(named & F.col("text").rlike(pattern)).select("id", "th", F.lit(-1).alias("place"), "text")
    matches = best_matches(able(lines, rows, len(notices), least).union(wholes), terms, len(notices), least)
    own = stage(
        matches.groupBy("id", "th").agg(F.min(F.struct(-F.col("score"), F.col("license"), F.col("place"), F.col("words"))).alias("b"))
        .select(F.col("id").alias("o_id"), F.col("th").alias("o_th"), (-F.col("b.col1")).alias("score"), F.col("b.license").alias("license"), F.col("b.place").alias("line"), F.col("b.words").alias("notice_words")),
        "own-licenses",
    )
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9.]*[A-Za-z0-9][A-Za-z0-9.]*"))
    narrow = d.select("id", "th", "path", named.alias("named"), words.alias("words"))
    known = stage(narrow.join(own, narrow["id"].eqNullSafe(own["o_id"]) & (F.col("th") == F.col("o_th")), "left").drop("o_id", "o_th"), "licensed")
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    speaks = (F.col("named") | (F.col("notice_words") >= F.col("words") * share)) & F.col("license").isNotNull() & F.col("path").isNotNull()
    folders = stage(known.where(speaks).groupBy(folder.alias("folder")).agg(F.min(F.struct(-F.col("score"), F.col("license"))).alias("b")).select("folder", F.col("b.license").alias("l"), (-F.col("b.col1")).alias("s")), "licence-folders")
    asking = known.where(F.col("license").isNull() & F.col("path").isNotNull()).select("path").distinct()
    up = asking.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("up"))
    depth = F.when(F.col("up") == "", 0).otherwise(F.size(F.split("up", "/")))
    heirs = up.join(folders, F.col("up") == F.col("folder")).groupBy(F.col("path").alias("h_path")).agg(F.max(F.struct(depth.alias("depth"), "up", "l", "s")).alias("h"))
    met = known.join(stage(heirs, "heirs"), (F.col("path") == F.col("h_path")) & F.col("license").isNull(), "left")
    return met.select(
        F.col("id").alias(id_col), F.coalesce("license", "h.l").alias("license"), F.coalesce("score", "h.s").alias("score"),
        F.col("line").cast("long").alias("line"), F.when(F.col("license").isNull(), F.col("h.up")).alias("inherited_from"),
    )
