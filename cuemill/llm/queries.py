"""The queries of the corpus operators, with production parameters over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


LINES_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op1_line_dedup", LINES_SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.lines import drop_repeated_lines

    kept = drop_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


@query("op3_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), added=True)


@query("op9_mixing")
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


NEAR_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)
), reach AS (
  WITH RECURSIVE r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN links l ON r.y = l.x) SELECT x, min(y) AS least FROM r GROUP BY x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least AS component_id, d.doc_id = least AS kept
FROM documents d JOIN reach ON x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op5_minhash_near_dedup", NEAR_SQL)
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=2, percent=80)


@query("op6_quality_rules")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.quality import STATS, quality_rules

    found = quality_rules(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), least_docs=2, across=True)
    return found.select("doc_id", *STATS, "base_failed", "kept", "log_ppl", "low", "high")


VECTORS_SQL = """
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  WITH RECURSIVE r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN links l ON r.y = l.x) SELECT * FROM r
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS n_links, min(r.y) AS component_id, e.vec_id = min(r.y) AS kept
FROM embeddings e JOIN reach r ON r.x = e.vec_id GROUP BY e.vec_id
"""


@query("op2_embedding_near_dedup", VECTORS_SQL)
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


PASSAGE_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), c AS (
  SELECT doc_id, n, k, substring(h, 512 * k + 1, 610) AS part FROM (SELECT *, unnest(range(n // 256 + 1)) AS k FROM d)
), w AS (
  SELECT doc_id, 256 * k + j AS i, hash(substring(part, 2 * j + 1, 100)) AS s FROM (SELECT *, unnest(range(least(256, n - 49 - 256 * k))) AS j FROM c WHERE n - 49 > 256 * k)
), least AS (
  SELECT s, min(doc_id) AS m FROM w GROUP BY s
), hit AS (
  SELECT doc_id, i, CASE WHEN i > lag(i + 50) OVER o THEN 1 ELSE coalesce(lag(0) OVER o, 1) END AS opens FROM w JOIN least USING (s) WHERE m < doc_id WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit) GROUP BY doc_id, g
), gaps AS (
  SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS til, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM spans
), kept AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed,
    string_agg(CASE WHEN k = 1 THEN substring(h, 1, 2 * a) ELSE '' END || substring(h, 2 * b + 1, 2 * (coalesce(til, n) - b)), '' ORDER BY a) AS rest
  FROM gaps g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id
)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query("op10_run_length_index", PASSAGE_SQL)
def run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.rindex import drop_repeated_passages

    found = drop_repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_language_id")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.langid import language_id

    return language_id(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query("op7_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 low quality, 2 good."""
    from cuemill.llm.classifier import classify

    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    ratings = table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    return classify(table(spark, sf_dir, "documents", "doc_id", "text"), ratings).select("doc_id", "expected_grade", F.get("p_at_least", F.lit(0)).alias("p_not_toxic"), F.col("p_top").alias("p_good"), "kept")


LICENSE_SQL = r"""
WITH t(notice, license, text) AS (VALUES
  (0, 'AGPL-3.0', 'This program is licensed under the GNU Affero General Public License, version 3.'), (1, 'Apache-2.0', 'Licensed under the Apache License, Version 2.0.'),
  (2, 'BSD-2-Clause', 'Released under the BSD 2-Clause License.'), (3, 'BSD-3-Clause', 'Released under the BSD 3-Clause License.'), (4, 'CC-BY-4.0', 'Licensed under CC BY 4.0.'),
  (5, 'CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'), (6, 'CC-BY-SA-4.0', 'Licensed under CC BY-SA 4.0.'), (7, 'CC0-1.0', 'Dedicated to the public domain under CC0 1.0.'),
  (8, 'GPL-2.0', 'This work is licensed under the GNU General Public License, version 2.'), (9, 'GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'),
  (10, 'LGPL-3.0', 'This library is licensed under the GNU Lesser General Public License, version 3.'), (11, 'MIT', 'Released under the MIT License.'),
  (12, 'MPL-2.0', 'Subject to the terms of the Mozilla Public License, version 2.0.')
), files AS (
  SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS folder, text FROM documents
), units AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM files
), stacked AS (
  SELECT 't' AS side, notice AS id, 0 AS place, text AS x FROM t UNION ALL SELECT 'd', doc_id, place, line FROM units
), parts AS (
  SELECT side, id, place, unnest(string_split_regex(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9.]+')) AS raw FROM stacked
), tf AS (
  SELECT side, id, place, trim(raw, '.') AS token, count(*) AS tf FROM parts WHERE trim(raw, '.') <> '' GROUP BY 1, 2, 3, 4
), idf AS (
  SELECT token, ln(14.0 / (1 + count(*))) + 1 AS idf FROM tf WHERE side = 't' GROUP BY token
), w AS (
  SELECT tf.*, tf * coalesce(idf, ln(14.0) + 1) AS w FROM tf LEFT JOIN idf ON tf.token = idf.token
), size AS (
  SELECT side, id, place, sqrt(sum(w * w)) AS size, sum(tf)::BIGINT AS words FROM w GROUP BY 1, 2, 3
), dots AS (
  SELECT a.id AS doc_id, a.place, b.id AS notice, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.token = b.token WHERE a.side = 'd' AND b.side = 't' GROUP BY 1, 2, 3
), scored AS (
  SELECT dots.doc_id, dots.place, license, dn.words, round(dot / (tn.size * dn.size), 6) AS score
  FROM dots JOIN t ON t.notice = dots.notice JOIN size tn ON tn.side = 't' AND tn.id = dots.notice JOIN size dn ON dn.side = 'd' AND dn.id = dots.doc_id AND dn.place = dots.place
), own AS (
  SELECT * FROM scored WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license, place) = 1
), known AS (
  SELECT f.*, license, score, place, coalesce(words >= 0.25 * len(regexp_extract_all(text, '[A-Za-z0-9.]*[A-Za-z0-9][A-Za-z0-9.]*')), false) AS speaks FROM files f LEFT JOIN own ON f.doc_id = own.doc_id
), folders AS (
  SELECT folder, license AS l, score AS s FROM known WHERE speaks QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, license) = 1
)
SELECT doc_id, coalesce(license, l) AS license, coalesce(score, s) AS score, place AS line, CASE WHEN license IS NULL AND l IS NOT NULL THEN known.folder END AS inherited_from
FROM known LEFT JOIN folders ON known.folder = folders.folder AND license IS NULL
"""


@query("op4_license_scans", LICENSE_SQL)
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id."""
    from cuemill.llm.licenses import scan_licenses

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    none = F.lit("none")
    files = docs.select("doc_id", F.concat_ws("/", F.coalesce("source", none), F.coalesce("lang", none), F.coalesce(F.col("doc_id").cast("string"), none)).alias("path"), "text")
    return scan_licenses(files, "doc_id")


@query("op12_bpe_encoding")
def bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.bpe import decode_documents, encode_documents

    found = decode_documents(encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path()), tokenizer_path())
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query("op11_cross_tokenizer_alignment")
def cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cuemill.llm.align import align_corpus

    return align_corpus(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), q AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark
), size AS (
  SELECT doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0
), corpus AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM size
), m AS (
  SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM size, corpus
), tf AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY doc_id, term
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term, docs
), scored AS (
  SELECT item_id, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m)))::BIGINT AS score
  FROM (SELECT item_id, unnest(ts) AS term FROM q) i JOIN tf ON tf.term = i.term JOIN w ON w.term = i.term JOIN m ON m.doc_id = tf.doc_id GROUP BY item_id, tf.doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


@query("op13_ranked_lexical_search", SEARCH_SQL)
def ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.lexical import search

    return search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), k=10)
