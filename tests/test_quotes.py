"""Quotes of every length against plain substring search."""

import random

from cuemill.operators import dialogue


def test_quotes_of_every_length(spark):
    rng = random.Random(6)
    docs = [(i, "".join(rng.choice("ab cé\n") for _ in range(rng.randint(0, 900)))) for i in range(40)] + [(90, None), (91, ""), (92, "漢字かな交じり文 with one word")]
    quotes = [(100, "a"), (101, "ab"), (102, None), (103, ""), (104, "not there at all"), (105, "漢字"), (106, "word"), (107, "zq")]
    for k in range(60):
        text = rng.choice(docs)[1] or "x"
        at = rng.randrange(len(text)) if text else 0
        quotes.append((k, text[at : at + rng.randint(1, 60)]))
    q, d = spark.createDataFrame(quotes, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = {(i, j, t.index(x) + 1) for i, x in quotes for j, t in docs if x and t and x in t}
    for block in (4096, 16):
        assert {tuple(r) for r in dialogue.find_quotes(q, d, block_chars=block).collect()} == want


def test_no_quotes_and_no_texts(spark):
    q, d = spark.createDataFrame([(1, "a")], "item_id long, text string"), spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert dialogue.find_quotes(q.where("false"), d).count() == 0 == dialogue.find_quotes(q, d.where("false")).count()


def test_grams_of_a_long_text_are_cut_in_one_pass(spark):
    """Places in characters beyond the first plane; and a block of 131,072 characters takes no time with the square of its length."""
    import time

    rng = random.Random(7)
    docs = [(1, "".join(rng.choice("ab\U0001f600\U0001f601\n") for _ in range(300)))]
    quotes = [(k, docs[0][1][at : at + rng.randint(1, 20)]) for k, at in enumerate(rng.sample(range(300), 40))]
    q, d = spark.createDataFrame(quotes, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in dialogue.find_quotes(q, d).collect()} == {(i, 1, docs[0][1].index(x) + 1) for i, x in quotes}
    long = spark.createDataFrame([(1, "abcdefghi " * 52_000 + "the very end")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "the very end")], "item_id long, text string")
    began = time.time()
    assert dialogue.find_quotes(q, long, block_chars=1 << 17).collect()[0].offset == 520_001
    assert time.time() - began < 12
