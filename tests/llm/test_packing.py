import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import DOC, SF, extended, odd_documents

from cuemill.llm import packing
from cuemill.llm.queries import tokenizer_path


def encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def want_pieces(rows, capacity):
    t, out = encoder(), Counter()
    for i, text, *_ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        starts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity)] if len(ids) > capacity else [0]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            out[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    return out


def check_places(found, capacity):
    placed = defaultdict(list)
    for r in found:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in placed.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= capacity
    return len(placed)


def test_pieces_and_places(spark):
    rows = odd_documents() + [(300, "two  blanks \n\n and more \n x ", "en", "a", 1), (301, " <|endoftext|> don't\tstop ", "en", "a", 1)]
    found = packing.pack_documents(extended(spark, rows), tokenizer_path(), capacity=256).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want_pieces(rows, 256)
    used = check_places(found, 256)
    assert used <= -(-sum(r["length"] for r in found) // 256) + 1


def test_given_texts_are_cut_without_changing_a_token(spark):
    t, rows = encoder(), spark.read.parquet(f"{SF}/documents.parquet").collect()
    for r in rows:
        parts = packing.stretches(r["text"])
        assert "".join(parts) == r["text"]
        assert [i for p in parts for i in t.encode(p, add_special_tokens=False).ids] == t.encode(r["text"], add_special_tokens=False).ids


def test_sequences_can_be_put_together(spark):
    rows = odd_documents()
    parts = packing.stage(packing.pieces(spark.createDataFrame(rows, DOC), tokenizer_path(), capacity=128))
    whole = packing.assemble(packing.pack(parts, 128)).collect()
    assert all(len(r["ids"]) == 4 * sum(s["length"] for s in r["spans"]) <= 4 * 128 for r in whole)


def test_empty_table(spark):
    found = packing.pack_documents(spark.createDataFrame([], DOC), tokenizer_path())
    assert found.count() == 0 and found.columns[-2:] == ["sequence_id", "offset"]


def fewest(sizes, capacity):
    """Fewest bins of a small instance, by trying every place for each size."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= sizes[i]}:
            k = rooms.index(room)
            go(i + 1, [*rooms[:k], room - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_bin_completion_finds_the_fewest(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(10, 70) for _ in range(11)]
    plan = packing.complete_bins(dict(Counter(sizes)), 100)
    assert Counter(k for n, f in plan for k in f * n) == Counter(sizes)
    assert all(sum(f) <= 100 for _, f in plan)
    assert sum(n for n, _ in plan) == fewest(sizes, 100)


def test_completion_beats_best_fit_on_counts():
    counts = {51: 600, 27: 600, 26: 600, 23: 1200, 25: 400, 24: 800}
    plan = packing.complete_bins(counts, 100)
    assert sum(n for n, _ in plan) <= sum(n for n, _ in packing.best_fit(counts, 100))
    total = Counter()
    for n, f in plan:
        for k in f:
            total[k] += n
    assert total == Counter(counts)


def test_query_ids_are_those_of_the_tokenizer_at_its_defaults(spark, tmp_path):
    """A text with an added token, as the query reads it."""
    from tokenizers import Tokenizer

    from cuemill.llm.queries import QUERIES

    rows = [(1, "a <|endoftext|> b", "en", "a", 1), (2, "<|endoftext|><|endoftext|>", "en", "a", 1), (3, "two  blanks \n <|endoftext|>\n x ", "en", "a", 1), (4, "plain text", "en", "a", 1), (5, None, "en", "a", 1)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op3_best_fit_packing"](spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(tokenizer_path())
    assert t.encode(rows[0][1], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = {(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, text, *_ in rows for ids in [t.encode(text or "", add_special_tokens=False).ids + [0]]}
    assert {(r["doc_id"], r["length"], r["ids_crc32"]) for r in found} == want


def test_unfinished_search_goes_on_with_the_greedy_filling():
    counts = {3: 2, 7: 1, 20: 3, 41: 1}
    assert packing.fillings(sorted(counts), counts, 100, 100, 3, effort=0) == [(41, 20, 20, 7, 3, 3)]
    assert packing.fillings(sorted(counts), counts, 100, 0, 3, effort=0) == []
    assert packing.fillings([3], {3: 5}, 10, 10, 3, effort=0) == [(3, 3, 3)]
