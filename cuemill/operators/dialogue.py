"""Dialogue records: question and answer cards, evidence, coverage, registers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.functions import text
from cuemill.operators import scans
from cuemill.operators.words import joined_text


def role_runs(turns: DataFrame, key: str = "conv_id", pos: str = "turn") -> DataFrame:
    """Neighbouring turns of one role merged: run_no, role, text, first and last turn."""
    r = scans.change_runs(turns, key, pos, None, ["role"], lambda cur, prev: cur("role") == prev("role"))
    return r.groupBy(key, "run_no").agg(
        F.min("role").alias("role"), joined_text(pos, "text", "\n").alias("text"), F.min(pos).alias("first_turn"), F.max(pos).alias("last_turn"))


def qa_cards(turns: DataFrame, key: str = "conv_id", pos: str = "turn", asker: str = "user", answerer: str = "assistant") -> DataFrame:
    """One card per question run with the answer run right after it; numbered in order of first appearance."""
    f, w = scans.neighbourhood(role_runs(turns, key, pos), key, "run_no", ahead=1)
    body = F.struct("role", "text", "first_turn", "last_turn")
    f = scans.own_rows(f.withColumn("__n", F.lead(body).over(w))).filter(F.col("role") == asker)
    f = scans.scan(f, key, "run_no", None, card=scans.sum_upto(F.lit(1)))
    answered = F.col("__n.role") == answerer
    pick = lambda c: F.when(answered, F.col(f"__n.{c}"))
    return f.select(
        key, F.format_string("AK-%03d", F.col("card").cast("long")).alias("card_id"), F.col("text").alias("question"), pick("text").alias("answer"),
        F.col("first_turn").alias("question_first"), F.col("last_turn").alias("question_last"), pick("first_turn").alias("answer_first"), pick("last_turn").alias("answer_last"))


def unanswered(turns: DataFrame, key: str = "conv_id", pos: str = "turn") -> DataFrame:
    c = qa_cards(turns, key, pos)
    return c.filter(text.clean_ends("answer") == "").select(key, "card_id", "question", "question_first", "question_last")


def verify_quotes(evidence: DataFrame, sources: DataFrame, source_id: str = "source_id") -> DataFrame:
    """Does each quote stand word for word in its source, and where: character offset and line, both from 1."""
    j = evidence.join(sources.select(source_id, F.col("text").alias("__t")), source_id, "left")
    at = F.when(F.col("quote") != "", F.coalesce(F.instr("__t", F.col("quote")), F.lit(0))).otherwise(F.lit(0))
    j = j.withColumn("offset", at)
    head = F.substring(F.col("__t"), F.lit(1), F.col("offset") - 1)
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    return j.withColumn("found", F.col("offset") > 0).withColumn("line", F.when(F.col("offset") > 0, line)).drop("__t")


def find_quotes(quotes: DataFrame, sources: DataFrame, quote_id: str = "item_id", source_id: str = "doc_id", window: int = 8, block_chars: int = 1 << 14) -> DataFrame:
    """Where quotes of any length stand word for word in any source: quote_id, source_id, offset (from 1, the first place).

    Every quote of at least ``window`` characters is posted under one of its grams, the one that fewest other quotes hold; shorter
    quotes under themselves, by length. A text is cut once into blocks that overlap by a gram, each block's distinct grams meet the
    postings, and only pairs of a quote and a source that share the posted gram are compared, on whole texts. A text is read
    once however many quotes there are; the texts of a frequent gram are split by source. Empty and null quotes are nowhere."""
    q = quotes.select(F.col(quote_id).alias("__q"), F.col("text").alias("__quote")).filter(F.length("__quote") > 0)
    n = F.least(F.length("__quote"), F.lit(window))
    grams = q.select("__q", "__quote", n.alias("__n"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("__quote") - n + 1), lambda i: F.substring(F.col("__quote"), i, n)))).alias("__g"))
    held = grams.groupBy(F.col("__g").alias("__held")).agg(F.count(F.lit(1)).alias("__in"))
    rarest = grams.join(held, F.col("__g") == F.col("__held")).groupBy("__q", "__quote", "__n").agg(F.min(F.struct("__in", "__g")).alias("__p"))
    posted = rarest.select("__q", "__quote", F.col("__n").alias("__size"), F.col("__p.__g").alias("__key"))
    sizes = posted.select(F.collect_set("__size").alias("s")).scalar()
    t = sources.select(F.col(source_id).alias("__s"), F.col("text").alias("__t")).filter(F.length("__t") > 0)
    blocks = t.select("__s", F.explode(F.sequence(F.lit(1), F.length("__t"), F.lit(block_chars))).alias("__from"), "__t")
    blocks = blocks.select("__s", F.substring(F.col("__t"), F.col("__from"), F.lit(block_chars + window - 1)).alias("__b"))
    cut = blocks.select("__s", "__b", F.explode(sizes).alias("__size")).filter(F.length("__b") >= F.col("__size"))
    # All grams of a block in one pass: a substring would be counted off from the block's start for each. A pair of surrogates may
    # give a gram that begins inside it; that is one candidate more at most.
    every = F.concat(F.lit("(?s)(?=(.{"), F.col("__size").cast("string"), F.lit("}))"))
    seen = cut.select("__s", F.col("__size").alias("__z"), F.explode(F.array_distinct(F.regexp_extract_all("__b", every, F.lit(1)))).alias("__w"))
    pairs = seen.join(posted.select("__q", "__size", "__key"), (F.col("__w") == F.col("__key")) & (F.col("__z") == F.col("__size"))).select("__s", "__q").distinct()
    met = pairs.join(posted.select("__q", "__quote"), "__q").join(t, "__s").withColumn("offset", F.instr("__t", F.col("__quote")))
    return met.filter("offset > 0").select(F.col("__q").alias(quote_id), F.col("__s").alias(source_id), "offset")


def range_coverage(evidence: DataFrame, sources: DataFrame, source_id: str = "source_id") -> DataFrame:
    """Lines cited at least once against the lines of each source. ``evidence``: line_start, line_end (from 1, inclusive)."""
    e = evidence.withColumn("__id", F.lit(0)) if "evidence_id" not in evidence.columns else evidence.withColumnRenamed("evidence_id", "__id")
    e = scans.scan(e, source_id, ["line_start", "line_end", "__id"], scans.by_span("line_start", 4096), __reach=scans.max_before("line_end"))
    cited = F.greatest(F.lit(0), F.col("line_end") - F.greatest(F.col("line_start") - 1, F.coalesce("__reach", F.lit(0))))
    g = e.groupBy(source_id).agg(F.sum(cited).cast("long").alias("cited_lines"))
    j = sources.select(source_id, "n_lines").join(g, source_id, "left").fillna(0, ["cited_lines"])
    return j.withColumn("ratio", F.coalesce(F.try_divide(F.col("cited_lines").cast("double"), F.col("n_lines").cast("double")), F.lit(0.0)))


def candidate_register(candidates: DataFrame, default_status: str = "待确认", key: str = "text", order: str = "candidate_id") -> DataFrame:
    """Candidates with their status, each linked to the first with the same cleaned text. Copies are counted, then joined back."""
    c = candidates.withColumn("__k", F.sha2(text.clean_text(key), 256))
    first = c.groupBy("__k").agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("copies"))
    j = c.join(first, "__k")
    return j.withColumn("status", F.coalesce("status", F.lit(default_status))).withColumn(
        "duplicate_of", F.when(F.col(order) != F.col("first_id"), F.col("first_id"))).drop("__k", "first_id")


def preserved(df: DataFrame, original: str = "original", edited: str = "edited") -> DataFrame:
    """Is the original kept byte for byte at the end of the edited text, or is it the whole of it?"""
    same = F.sha2(F.col(original), 256) == F.sha2(F.col(edited), 256)
    return df.withColumn("unchanged", same).withColumn("preserved", F.endswith(F.col(edited), F.col(original)))


def fact_table(turns: DataFrame, key: str = "conv_id", pos: str = "turn") -> DataFrame:
    """Who said what, as said: verbatim rows with source place and length."""
    return turns.select(key, pos, "role", "text", F.length("text").cast("long").alias("characters"), F.concat_ws("#", F.col(key).cast("string"), F.col(pos).cast("string")).alias("source"))


def role_profile(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    return turns.groupBy(key, "role").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.length("text").cast("long")).alias("characters"), F.count_if(F.col("text").rlike(r"[?？]")).alias("questions"),
        F.max(F.length("text")).alias("longest"))


def candidate_groups(items: DataFrame, key: str = "candidate_id", pos: str = "pos") -> DataFrame:
    """Items of one candidate: outer times, first template named, number of items and of distinct words.
    The ordered lists are separate (``candidate_members``), so a very large candidate stays spread out."""
    return items.groupBy(key).agg(
        F.min("output_start").alias("output_start"), F.max("output_end").alias("output_end"),
        F.min_by("template", F.when(F.col("template").isNotNull(), F.col(pos))).alias("template"), F.count(F.lit(1)).alias("items"),
        F.when(F.count("output_start") > 0, "mapped").otherwise("dropped").alias("status"))


def candidate_members(items: DataFrame, key: str = "candidate_id", pos: str = "pos", member: str = "word_ids") -> DataFrame:
    """Distinct word ids per candidate with the place each first appears."""
    e = items.select(key, pos, F.posexplode(member).alias("i", "word_id"))
    return e.groupBy(key, "word_id").agg(F.min(F.struct(pos, "i")).alias("p")).select(key, "word_id", F.col(f"p.{pos}").alias(pos), F.col("p.i").alias("i"))
