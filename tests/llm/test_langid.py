import zlib
from collections import Counter

import numpy as np
from fixtures import DOC, SF, extended, odd_documents

from cuemill.llm.langid import Letters, bundles, language_id


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = language_id(docs).collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert len(held) > 40 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_odd_documents(spark):
    rows = odd_documents()
    found = language_id(extended(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}
    for r in found:
        letters = any(c.isalpha() for c in text[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in ("en", "fr", "und")


def test_nothing_to_learn_from(spark):
    assert language_id(spark.createDataFrame([], DOC)).count() == 0
    rows = [(i, "some words", None, None, 0) for i in range(6)]
    assert {(r["lang_pred"], r["score"]) for r in language_id(spark.createDataFrame(rows, DOC)).collect()} == {("und", 0.0)}


def test_bundle_is_the_sum_of_bound_and_rotated_letters():
    letters = Letters(64, 1)
    texts = [letters.symbols("Abba, cab!"), letters.symbols("été 12")]
    assert texts[0].tolist() == [0, *map(ord, "abba"), 0, *map(ord, "cab"), 0]
    got = bundles(texts, 3, letters, np.array([0, 1]), 2)
    for t, v in zip(texts, got):
        vec = letters.table(t).astype(int)
        assert (v == sum(np.roll(vec[i], 2) * np.roll(vec[i + 1], 1) * vec[i + 2] for i in range(len(t) - 2))).all()
