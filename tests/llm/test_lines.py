import hashlib
from collections import defaultdict

import pytest
from fixtures import DOC, extended, odd_documents, rows_of

from cuemill.llm.lines import drop_repeated_lines

SPACES = " \t\n\x0b\x0c\r"


def key(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def model(rows, min_chars=10, min_docs=2):
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        last = float("inf")
        gone = lambda x: len(holders[key(x)]) >= min_docs and i != min(holders[key(x)], key=lambda d: last if d is None else d)
        stay = [x for x in lines if len(key(x)) < min_chars or not gone(x)]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("min_docs", [2, 5])
def test_lines_match_a_plain_model(spark, min_docs):
    from collections import Counter

    from pyspark.sql import functions as F

    rows = odd_documents()
    found = drop_repeated_lines(extended(spark, rows), min_docs=min_docs)
    got = rows_of(found.withColumn("sha", F.sha2("kept_text", 256)), "doc_id", "n_lines", "n_dropped", "sha")
    assert got == Counter(model(rows, min_docs=min_docs))
    assert "component_id" in found.columns and found.where("component_id <> 'own component_id'").count() == 0


def test_empty_table(spark):
    assert drop_repeated_lines(spark.createDataFrame([], DOC)).count() == 0
