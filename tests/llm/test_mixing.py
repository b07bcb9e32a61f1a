import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import DOC, extended, odd_documents

from cuemill.llm.mixing import fill_budget, fill_exactly, mix, take_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing again and again what is over the caps."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_what_is_taken(spark):
    rows = [r for r in odd_documents() if r[0] != 204]  # not the one that is longer than a source's whole budget
    table = extended(spark, rows)
    found = mix(table).collect()
    total = defaultdict(int)
    for _, text, _, source, _ in rows:
        total[source] += size(text)
    target = water(total)
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in found) == Counter((i, size(t), total[s]) for i, t, _, s, _ in rows)
    taken = Counter()
    for r in found:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s in total:
        assert abs(taken[s] - target[s]) <= 3  # what sums of the sizes left over can reach
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, mix(table.repartition(7)).collect()))
    mixed = take_mix(table)
    assert mixed.columns == table.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += size(r["text"])
    assert words == +taken


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], DOC)).count() == 0 and take_mix(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_budget_is_the_best_sum(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(3, 60, 6)).astype(np.int64)
    counts = rng.integers(0, 4, len(sizes)).astype(np.int64)
    whole = int((sizes * counts).sum())
    budget = int(rng.integers(0, whole + 2))
    got = fill_budget(sizes, counts, budget)
    assert (got >= 0).all() and (got <= counts).all() and (got * sizes).sum() <= max(budget, 0)
    start = np.array([int(c) * budget // max(whole, 1) for c in counts]) if budget < whole else counts
    best = max(s for s in (sum(a * b for a, b in zip(x, sizes)) for x in itertools.product(*[range(int(a), int(b) + 1) for a, b in zip(start, counts)])) if s <= budget or s == (start * sizes).sum())
    assert (got * sizes).sum() == best


def most_words(sizes, counts, budget):
    return max(s for s in (sum(a * b for a, b in zip(x, sizes)) for x in itertools.product(*[range(int(c) + 1) for c in counts])) if s <= budget)


@pytest.mark.parametrize("seed", range(12))
def test_long_documents_fill_the_budget(seed):
    """Sizes beyond the last gap: first the reviewer's case, then drawn ones, against all choices."""
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(33_000, 90_000, 4)).astype(np.int64) if seed else np.array([45_000, 50_000, 60_000])
    counts = rng.integers(1, 4, len(sizes)).astype(np.int64) if seed else np.array([1, 1, 1])
    budget = int(rng.integers(1, int((sizes * counts).sum()))) if seed else 95_000
    got = fill_exactly(sizes, counts, budget)
    assert (got >= 0).all() and (got <= counts).all()
    assert (got * sizes).sum() == most_words(sizes, counts, budget)


def test_sources_with_a_document_longer_than_their_target(spark):
    """Every source meets the best sum of floor(target / size) to two of each document, and document 204 stays in."""
    rows = odd_documents() + [(900 + i, "w " * n, lang, "huge", 1) for i, (n, lang) in enumerate([(60_000, "en"), (50_000, "en"), (45_000, "en")])]
    found = mix(extended(spark, rows)).collect()
    taken, target, sizes = Counter(), {}, defaultdict(list)
    for r in found:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        target[r["source"]] = round(r["target"])
        sizes[r["source"]].append(r["size"])
    for s, own in sizes.items():
        base = min(2, target[s] // sum(own))
        sums = 1 << base * sum(own)
        for n in own * (2 - base):
            sums |= sums << n
        best = (sums & ((1 << (target[s] + 1)) - 1)).bit_length() - 1
        assert taken[s] == best
