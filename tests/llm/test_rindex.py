from collections import Counter

import numpy as np
import pytest
from fixtures import DOC, extended, odd_documents, rows_of

from cuemill.llm.rindex import RunLengthIndex, drop_repeated_passages, passages


def model(rows, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    least = {}
    for i, t in texts:
        if i is not None:
            for k in range(len(t) - length + 1):
                least[t[k : k + length]] = min(i, least.get(t[k : k + length], i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        if i is not None:
            for k in range(len(t) - length + 1):
                if least[t[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"lot_bytes": 8000, "bucket_rows": 60}, {"crowd": 1, "lot_bytes": 20_000}])
def test_removed_bytes_match_a_plain_model(spark, options):
    rows = odd_documents()
    found = drop_repeated_passages(extended(spark, rows), **options)
    assert Counter((a, b, c, d, bytes(e)) for a, b, c, d, e in rows_of_bytes(found)) == model(rows, 50)


def rows_of_bytes(df):
    return [tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()]


def test_empty_table(spark):
    assert drop_repeated_passages(spark.createDataFrame([], DOC)).count() == 0


def test_index_finds_windows_of_smaller_documents():
    rng = np.random.default_rng(3)
    for length in (50, 30):
        base = bytes(rng.integers(97, 99, 400).astype(np.uint8))
        parts = [base[a : a + n] for a, n in zip(rng.integers(0, 300, 60), rng.integers(1, 80, 60))]
        docs = rng.integers(0, 10, len(parts)).astype(np.int64)
        index = RunLengthIndex(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), docs, length)
        least = {}
        for p, d in zip(parts, docs):
            for i in range(len(p) - length + 1):
                least[p[i : i + length]] = min(d, least.get(p[i : i + length], d))
        want = {(k, i) for k, p in enumerate(parts) for i in range(len(p) - length + 1) if least[p[i : i + length]] < docs[k]}
        assert set(zip(*(x.tolist() for x in index.earlier()))) == want
        assert len(index.starts) < sum(map(len, parts))  # runs, not rows


def test_passages_hold_every_window_once_under_the_anchor_of_its_bytes():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 101, int(n)).astype(np.uint8)) for n in rng.integers(0, 400, 40)] + [b"a" * 300, b""]
    texts += [t[7:120] for t in texts]
    seen = {}
    for number, start, size, anchor, *_ in zip(*passages(texts, 50)):
        for w in range(size - 49):
            assert (number, start + w) not in seen
            seen[number, start + w] = anchor
    assert len(seen) == sum(max(0, len(t) - 49) for t in texts)
    by_bytes = {}
    for (number, w), anchor in seen.items():
        assert by_bytes.setdefault(texts[number][w : w + 50], anchor) == anchor
