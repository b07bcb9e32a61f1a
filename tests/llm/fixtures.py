"""Small tables with the odd cases every operator has to handle, and plain models of the contracts."""

from __future__ import annotations

import random
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def odd_documents(seed: int = 1) -> list[tuple]:
    """Nulls in every column, empty and long texts, copies, near copies, shared lines, shared passages, repeated rows."""
    rng = random.Random(seed)
    syllables = ["ta", "ne", "ri", "so", "lu", "mé", "kö", "pa", "vi", "do"]

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    shared = words(30)
    base = words(120)
    rows: list[tuple] = []
    for i in range(40):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])
        body = "\n".join(words(rng.randint(3, 20)) for _ in range(rng.randint(1, 4)))
        if i % 4 == 0:
            body += "\n" + shared + "\n  A shared LINE of text \t"
        if i % 5 == 0:
            near = base.split()
            near[rng.randrange(len(near))] = words(1)
            body = " ".join(near)
        rows.append((i + 1, body, lang, source, len(body)))
    rows += [(rows[3][0] + 100, rows[3][1], "en", "a", 1), (rows[3][0] + 101, rows[3][1], "fr", "b", 1)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \n\t ", "fr", "b", 4), (203, "12 34 !!", "en", "c", 8)]
    long = words(6000)
    rows += [(204, long, "en", "a", len(long)), (205, "x" * 5000, "fr", "b", 5000), (206, "x" * 5000, "fr", "b", 5000)]
    rows += [(None, rows[0][1], "en", "a", 5), (None, "no id here", None, "a", 5), rows[7], rows[7]]
    return rows


def extended(spark, rows):
    """The rows as a table that also has columns named like what operators make and use."""
    from pyspark.sql import functions as F

    clash = ["n_lines", "kept", "kept_text", "component_id", "id", "th", "row", "place", "rank", "draw", "size", "length", "start", "sequence_id", "lot", "bucket", "label", "score", "node", "words"]
    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit(f"own {c}") for c in clash})


def shingle_set(text: str | None, width: int) -> frozenset:
    w = WORD.findall((text or "").encode().lower())
    if not w:
        return frozenset()
    width = min(width, len(w))
    return frozenset((width, *w[i : i + width]) for i in range(len(w) - width + 1))


def groups(ids, linked) -> dict:
    """Smallest reachable id per id, by repeated merging."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def rows_of(df, *columns) -> Counter:
    return Counter(tuple(r) for r in df.select(*columns).collect())
