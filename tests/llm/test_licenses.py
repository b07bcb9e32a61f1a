import math
import re
from collections import Counter

from fixtures import extended, odd_documents
from pyspark.sql import functions as F

from cuemill.llm.licenses import NOTICES, scan_licenses

FILE = "id long, path string, text string"
IDF = Counter()


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [t.strip(".") for t in re.split(r"[^a-z0-9.]+", low) if t.strip(".")]


def cosines(text):
    """Best (cosine, licence) of a text by plain TF-IDF vectors."""
    df = Counter(t for _, n in NOTICES for t in set(tokens(n)))
    idf = lambda t: math.log((1 + len(NOTICES)) / (1 + df[t])) + 1
    vec = lambda x: {t: n * idf(t) for t, n in Counter(tokens(x)).items()}
    a = vec(text)
    best = (0, None)
    for name, n in NOTICES:
        b = vec(n)
        dot = sum(a.get(t, 0) * w for t, w in b.items())
        size = math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))
        score = round(dot / size, 6) if size else 0
        if score > best[0] or score == best[0] and best[1] and name < best[1]:
            best = (score, name)
    return best


def test_lines_match_plain_vectors(spark):
    lines = [n for _, n in NOTICES] + ["This file is licensed under the Apache License, Version 2.0", "released the MIT", "License", "the", "words of no licence at all", "Licensed under CC BY-NC 4.0. Ask us.", ""]
    lines += ["Licensed under the MIT License or the Apache License", "version 2.0 of the Mozilla terms", "GNU"]
    rows = [(i, f"d{i}/f", x) for i, x in enumerate(lines)]
    got = {r["id"]: (r["score"] or 0, r["license"]) for r in scan_licenses(spark.createDataFrame(rows, FILE), share=9.0).collect()}
    for i, _, x in rows:
        score, name = cosines(x)
        assert got[i] == ((score, name) if score >= 0.75 else (0, None)), x


def test_nearest_directory(spark):
    mit, gpl = NOTICES[11][1], NOTICES[9][1]
    rows = [
        (1, "a/LICENSE", f"Some words first.\n{mit}\n"), (2, "a/b/c/x.py", "code"), (3, "a/b/COPYING.txt", gpl), (4, "a/y.py", "code"), (5, "z/y.py", "code"),
        (6, "a/b/own.py", f"code\n# {mit}"), (7, None, "code"), (8, "a/b/c/x.py", None), (9, "LICENSE", "nothing known"), (10, "top.py", ""), (4, "a/y.py", "code"),
    ]
    got = Counter((r["id"], r["license"], r["inherited_from"]) for r in scan_licenses(spark.createDataFrame(rows, FILE)).collect())
    gpl3 = "GPL-3.0"
    assert got == Counter([(1, "MIT", None), (2, gpl3, "a/b"), (3, gpl3, None), (4, "MIT", "a"), (4, "MIT", "a"), (5, None, None), (6, "MIT", None), (7, None, None), (8, gpl3, "a/b"), (9, None, None), (10, None, None)])


def test_odd_documents(spark):
    rows = odd_documents()
    files = extended(spark, rows).withColumn("path", F.concat_ws("/", "source", "lang", "doc_id"))
    assert Counter(r["doc_id"] for r in scan_licenses(files, "doc_id").collect()) == Counter(r[0] for r in rows)
    assert scan_licenses(spark.createDataFrame([], FILE)).count() == 0
