"""Queries over dialogue records and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.catalog import views
from cuemill.catalog.base import query, table
from cuemill.operators import dialogue, scans

RUNS = """WITH t0 AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'user' WHEN role = 'assistant' AND length(text) % 5 = 0 THEN 'user' ELSE role END AS role, CASE WHEN length(text) % 7 = 0 THEN ' ' ELSE text END AS text FROM conversations),
t1 AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS b FROM t0),
t2 AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM t1),
runs AS (SELECT conv_id, g, min(role) AS role, string_agg(text, chr(10) ORDER BY turn) AS text, min(turn) AS f, max(turn) AS l FROM t2 GROUP BY 1, 2),
nx AS (SELECT *, lead(role) OVER x AS nr, lead(text) OVER x AS nt, lead(f) OVER x AS nf, lead(l) OVER x AS nl FROM runs WINDOW x AS (PARTITION BY conv_id ORDER BY g)),
cards AS (SELECT conv_id, 'AK-' || format('{:03d}', row_number() OVER (PARTITION BY conv_id ORDER BY g)) AS card_id, text AS question, CASE WHEN nr = 'assistant' THEN nt END AS answer,
  f AS question_first, l AS question_last, CASE WHEN nr = 'assistant' THEN nf END AS answer_first, CASE WHEN nr = 'assistant' THEN nl END AS answer_last FROM nx WHERE role = 'user')
"""


def turns(spark, sf):
    n = F.length("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when((F.col("role") == "system") | ((F.col("role") == "assistant") & (n % 5 == 0)), "user").otherwise(F.col("role")).alias("role"),
        F.when(n % 7 == 0, " ").otherwise(F.col("text")).alias("text"))


@query("qa_cards", "C1", RUNS + " SELECT * FROM cards")
def _(spark, sf):
    return dialogue.qa_cards(turns(spark, sf))


@query("unanswered", "C2", RUNS + r" SELECT conv_id, card_id, question, question_first, question_last FROM cards WHERE answer IS NULL OR NOT regexp_matches(answer, '\S')")
def _(spark, sf):
    return dialogue.unanswered(turns(spark, sf))


@query("verify_quotes", "J14", "WITH " + views.LINES + """,
q AS (SELECT doc_id + CASE WHEN line_no % 5 = 4 THEN 1 ELSE 0 END AS source_id, doc_id, line_no, line AS quote FROM lines)
SELECT q.source_id, q.doc_id, line_no, quote, CASE WHEN quote = '' THEN 0 ELSE coalesce(instr(text, quote), 0) END::INT AS "offset", quote <> '' AND coalesce(instr(text, quote), 0) > 0 AS found,
  CASE WHEN quote <> '' AND instr(text, quote) > 0 THEN (length(substring(text, 1, instr(text, quote) - 1)) - length(replace(substring(text, 1, instr(text, quote) - 1), chr(10), '')) + 1)::INT END AS line
FROM q LEFT JOIN documents d ON q.source_id = d.doc_id""")
def _(spark, sf):
    q = views.doc_lines(spark, sf).select((F.col("doc_id") + F.when(F.col("line_no") % 5 == 4, 1).otherwise(0)).alias("source_id"), "doc_id", "line_no", F.col("line").alias("quote"))
    return dialogue.verify_quotes(q, table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), "text"))


@query("benchmark_quotes", "J14", """
WITH k AS (SELECT item_id, trim(text) AS quote FROM benchmark)
SELECT k.item_id, d.doc_id, instr(d.text, quote)::INT AS "offset" FROM k JOIN documents d ON instr(d.text, quote) > 0""")
def _(spark, sf):
    return dialogue.find_quotes(table(spark, sf, "benchmark").select("item_id", F.btrim("text").alias("text")), table(spark, sf, "documents").select("doc_id", "text"))


@query("range_coverage", "C3", "WITH " + views.LINES + """,
n AS (SELECT doc_id AS source_id, max(line_no) + 1 AS n_lines FROM lines GROUP BY 1),
e AS (SELECT doc_id AS source_id, line_no + 1 AS ls, line_no + 1 + length(line) % 4 AS le FROM lines WHERE contains(line, ',')),
c AS (SELECT DISTINCT source_id, unnest(range(ls, le + 1)) AS x FROM e), g AS (SELECT source_id, count(*) AS cited FROM c GROUP BY 1)
SELECT n.source_id, n_lines, coalesce(cited, 0) AS cited_lines, coalesce(cited, 0)::DOUBLE / n_lines AS ratio FROM n LEFT JOIN g ON n.source_id = g.source_id""")
def _(spark, sf):
    x = views.doc_lines(spark, sf).withColumnRenamed("doc_id", "source_id")
    n = x.groupBy("source_id").agg((F.max("line_no") + 1).alias("n_lines"))
    m = F.length("line")
    e = x.filter(F.contains(F.col('line'), F.lit(','))).select("source_id", F.col("line_no").alias("evidence_id"), (F.col("line_no") + 1).alias("line_start"), (F.col("line_no") + 1 + m % 4).alias("line_end"))
    return dialogue.range_coverage(e, n)


@query("candidate_register", "C4,U1", r"""
WITH c AS (SELECT doc_id AS candidate_id, CASE WHEN doc_id % 3 = 0 THEN 'kept' END AS st, trim(regexp_replace(text, '\s+', ' ', 'g')) AS k FROM documents)
SELECT candidate_id, coalesce(st, '待确认') AS status, count(*) OVER (PARTITION BY k) AS copies, CASE WHEN candidate_id <> min(candidate_id) OVER (PARTITION BY k) THEN min(candidate_id) OVER (PARTITION BY k) END AS duplicate_of FROM c""")
def _(spark, sf):
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("candidate_id"), "text", F.when(F.col("doc_id") % 3 == 0, "kept").alias("status"))
    return dialogue.candidate_register(c).select("candidate_id", "status", "copies", "duplicate_of")


@query("preserved", "C5", """
SELECT doc_id, trim(text) = CASE WHEN lang = 'en' THEN text WHEN lang = 'de' THEN '# x' || chr(10) || text ELSE trim(text) || '.' END AS unchanged,
  suffix(CASE WHEN lang = 'en' THEN text WHEN lang = 'de' THEN '# x' || chr(10) || text ELSE trim(text) || '.' END, trim(text)) AS preserved FROM documents""")
def _(spark, sf):
    t = F.col("text")
    edited = F.when(F.col("lang") == "en", t).when(F.col("lang") == "de", F.concat(F.lit("# x\n"), t)).otherwise(F.concat(F.trim(t), F.lit(".")))
    d = table(spark, sf, "documents").select("doc_id", F.trim("text").alias("original"), edited.alias("edited"))
    return dialogue.preserved(d).select("doc_id", "unchanged", "preserved")


@query("fact_table", "C7", "SELECT conv_id, turn, role, text, length(text)::BIGINT AS characters, conv_id::VARCHAR || '#' || turn::VARCHAR AS source FROM conversations")
def _(spark, sf):
    return dialogue.fact_table(table(spark, sf, "conversations"))


@query("role_profile", "C7", """
SELECT conv_id, role, count(*) AS turns, sum(length(text))::BIGINT AS characters, count(*) FILTER (regexp_matches(text, '[?？]')) AS questions, max(length(text))::INT AS longest FROM conversations GROUP BY 1, 2""")
def _(spark, sf):
    return dialogue.role_profile(table(spark, sf, "conversations"))


ITEMS = """WITH i AS (SELECT l_orderkey AS candidate_id, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS pos, CASE WHEN l_quantity > 5 THEN l_quantity::BIGINT END AS s, CASE WHEN l_quantity > 5 THEN l_quantity::BIGINT + l_linenumber END AS e,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS template, l_partkey % 5 AS w1, l_suppkey % 5 AS w2 FROM lineitem)"""


def items(spark, sf):
    q = F.col("l_quantity").cast("long")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("candidate_id"), (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("pos"), F.when(q > 5, q).alias("output_start"),
        F.when(q > 5, q + F.col("l_linenumber")).alias("output_end"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("template"),
        F.array(F.col("l_partkey") % 5, F.col("l_suppkey") % 5).alias("word_ids"))


@query("candidate_groups", "A14", ITEMS + """
SELECT candidate_id, min(s) AS output_start, max(e) AS output_end, arg_min(template, pos) FILTER (template IS NOT NULL) AS template, count(*) AS items, CASE WHEN count(s) > 0 THEN 'mapped' ELSE 'dropped' END AS status FROM i GROUP BY 1""")
def _(spark, sf):
    return dialogue.candidate_groups(items(spark, sf))


@query("candidate_members", "A14", ITEMS + """,
m AS (SELECT candidate_id, pos, 0 AS i, w1 AS word_id FROM i UNION ALL SELECT candidate_id, pos, 1, w2 FROM i)
SELECT candidate_id, word_id, min(pos) AS pos, arg_min(i, [pos, i])::INT AS i FROM m GROUP BY 1, 2""")
def _(spark, sf):
    return dialogue.candidate_members(items(spark, sf))


@query("ordered_events", "T7", """
SELECT event_id, user_id, (row_number() OVER (ORDER BY ts, user_id, event_type, event_id) - 1)::BIGINT AS place FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.lit(1).alias("all"), views.micros("ts").alias("at"), "user_id", "event_type", "event_id")
    return scans.ordinals(e, "all", ["at", "user_id", "event_type", "event_id"], scans.by_span("at", views.EVENT_BLOCK_US), "place").select("event_id", "user_id", "place")
