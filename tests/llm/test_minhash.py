from collections import Counter

import numpy as np
import pytest
from fixtures import DOC, extended, groups, odd_documents, rows_of, shingle_set

from cuemill.llm.common import components
from cuemill.llm.minhash import drop_near_duplicates, near_duplicates, superminhash


def model(rows, width, percent=80):
    sets = [(i, shingle_set(t, width)) for i, t, *_ in rows]
    able = [(i, s) for i, s in sets if i is not None and s]
    linked = [(a, b) for n, (a, s) in enumerate(able) for b, t in able[:n] if 100 * len(s & t) >= percent * len(s | t)]
    root = groups({i for i, _ in sets if i is not None}, linked)
    return Counter((i, len(s), root.get(i), i == root.get(i)) for i, s in sets)


@pytest.mark.parametrize("width", [2, 5])
def test_groups_match_all_pairs(spark, width):
    rows = odd_documents()
    got = rows_of(near_duplicates(extended(spark, rows), width=width), "doc_id", "n_shingles", "component_id", "kept")
    assert got == model(rows, width)


def test_one_of_each_group_stays(spark):
    rows = odd_documents()
    kept = drop_near_duplicates(extended(spark, rows), width=5)
    root = {r[0]: r[2] for r in model(rows, 5)}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, *_ in rows if i is None or root[i] == i)
    assert kept.columns == extended(spark, rows).columns


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_chain_of_buckets_keeps_links_between_non_heads(spark):
    """Documents that resemble their neighbours only: the first of a bucket does not stand for all."""
    words = [f"w{i}" for i in range(260)]
    rows = [(n, " ".join(words[n * 6 : n * 6 + 100]), None, None, 0) for n in range(20)]
    assert rows_of(near_duplicates(spark.createDataFrame(rows, DOC), width=2), "doc_id", "n_shingles", "component_id", "kept") == model(rows, 2)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(4)
    for overlap in (0.3, 0.8):
        agree = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 600).astype(np.uint64)
            shared = int(300 * 2 * overlap / (1 + overlap))
            a, b = pool[:300], np.concatenate([pool[:shared], pool[300 : 600 - shared]])
            s = superminhash(np.concatenate([a, b]), np.repeat([0, 1], 300), 2, 128)
            agree.append((s[0] == s[1]).mean())
        true = shared / (600 - shared)
        assert abs(np.mean(agree) - true) < 0.02
        assert np.var(agree) < true * (1 - true) / 128  # less than that of independent slots


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(300, 420)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain + star + [(5, 5)], "src long, dst long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(300, 420)}, 7: 7}
