from collections import Counter

import numpy as np
from fixtures import groups, rows_of

from cuemill.llm.vectors import near_vectors

VECTORS = "vec_id long, embedding array<float>, label int, kept string, size string"


def test_links_match_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows, base = [], rng.standard_normal((6, 16))
    for i in range(150):
        v = base[i % 6] + rng.standard_normal(16) * rng.choice([0.01, 0.12, 1.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 2), "own", "own"))
    rows += [(200 + i, rows[0][1], 0, "own", "own") for i in range(30)] + [(260, [x * 7 for x in rows[0][1]], 0, "", "")]
    rows += [(300, None, 0, "", ""), (301, [0.0] * 16, 0, "", ""), (302, [float("nan")] * 16, 0, "", ""), (303, rows[0][1], None, "", ""), (304, [], 0, "", "")]
    rows += [(305, [*rows[0][1][:-1], None], 0, "", ""), (306, [float("inf")] * 16, 0, "", ""), (None, rows[0][1], 0, "", ""), (307, rows[0][1][:8], 0, "", ""), rows[5], rows[5]]
    fine = {}
    for i, v, label, *_ in rows:
        if i is not None and v and label is not None and None not in v:
            x = np.array(v, np.float32).astype(np.float64)
            if np.isfinite(x).all() and x.any():
                fine[i] = (label, x)
    links, count = [], Counter()
    for a, (la, x) in fine.items():
        for b, (lb, y) in fine.items():
            if a < b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.append((a, b))
                count[a] += 1
                count[b] += 1
    root = groups({r[0] for r in rows if r[0] is not None}, links)
    want = Counter((i, count[i] if i is not None else 0, root.get(i), i == root.get(i)) for i, *_ in rows)
    for lot in (512, 8):
        assert rows_of(near_vectors(spark.createDataFrame(rows, VECTORS), lot=lot), "vec_id", "n_links", "component_id", "kept") == want


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
