import math
import random
import re
from collections import Counter

import oracle
import pytest
from fixtures import DOC, SF, extended, odd_documents, rows_of

from cuemill.llm import lexical
from cuemill.llm.queries import QUERIES, SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def bag(text):
    return Counter(TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or "")))


def want(docs, items, k=10):
    bags = [(i, bag(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // n_terms
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, c in bag(text).items() if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if none else i, -s] += 1
    return out


def odd_items(rows, seed=2):
    rng = random.Random(seed)
    words = [w for r in rows if r[1] for w in r[1].split()]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for k in range(30)]
    return items + [(100, None), (101, ""), (102, "...!"), (103, "neverfoundanywhere"), (104, "A shared LINE of text, a Shared line"), (105, rows[3][1]), (106, "ta ta ta É é"), (None, words[5]), (1, "second row of an id " + words[9])]


@pytest.mark.parametrize("blocks", [4096, 7])
def test_ranks_equal_the_plain_model(spark, blocks):
    rows = odd_documents()
    items = odd_items(rows)
    asked = spark.createDataFrame([(*i, 0, 0, "x") for i in items], "item_id long, text string, rank int, score int, doc_id string")
    got = lexical.search(extended(spark, rows).repartition(5), asked, block_items=blocks)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got, *got.columns) == want([(r[0], r[1]) for r in rows], items)


def test_pruning_keeps_every_result(spark):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(int(rng.paretovariate(0.8)) % 300 + 1)), "en", "a", 1) for i in range(1500)]
    docs += [(5000 + i, docs[7][1], "en", "a", 1) for i in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for k in range(40)] + [(900, docs[7][1])]
    table = spark.createDataFrame(docs, DOC)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 10):
        got = lexical.search(table, asked, k=k)
        assert rows_of(got, *got.columns) == want([(d[0], d[1]) for d in docs], items, k)


def test_a_bucket_too_short_is_not_read(spark):
    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([100, 100]), pa.array([1.0, 2.0]), pa.array([[0], [0, 1]], pa.list_(pa.int32())), pa.array([[1], [1, 1]], pa.list_(pa.int64()))], ["doc_id", "m", "norm", "terms", "times"])
    bucket, best = lexical.Bucket(batch, np.array([5, 7])), lexical.Best(1, 10**12)
    bucket.span = None  # would fail if read
    bucket.search(lexical.Item(0, np.array([0, 1]), np.array([1, 1]), 2**0.5, 0), best, np.zeros(2, np.int64))
    assert best.rows == []


def test_empty_tables(spark):
    none, item = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a word")], "item_id long, text string")
    assert lexical.search(none, item).count() == 0
    assert lexical.search(spark.createDataFrame(odd_documents(), DOC), item.where("false")).count() == 0
    assert lexical.search(spark.createDataFrame([(1, None, None, None, None), (2, "--", "", "", 1)], DOC), item).count() == 0


def test_same_as_sql(spark):
    from types import SimpleNamespace

    q = SimpleNamespace(run=QUERIES["op13_ranked_lexical_search"], sql=SQL["op13_ranked_lexical_search"])
    assert oracle.compare(spark, oracle.connect(SF), q, SF) is None
