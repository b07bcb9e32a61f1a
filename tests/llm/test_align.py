import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from fixtures import DOC, SF, extended, odd_documents, rows_of
from tokenizers import Tokenizer

from cuemill.llm import align, bpe
from cuemill.llm.queries import QUERIES, tokenizer_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = [c.split()[0] for c in align.COUNTED.split(", ")]


@pytest.fixture(scope="module")
def plain():
    """Tokens of both sides of a text by the two libraries: (id, start, end)."""
    t, sp = Tokenizer.from_file(tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(bpe.letters_of_bytes())}

    def spans(ids, parts):
        at, out = 0, []
        for i, p in zip(ids, parts):
            out.append((i, at, at + len(p)))
            at += len(p)
        return out

    def both(text):
        if not text:
            return [], []
        a = t.encode(" " + text, add_special_tokens=False).ids
        pa = [bytes(byte_of[c] for c in t.id_to_token(i)) for i in a]
        b = sp.encode(text)
        pb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(pa) != (" " + text).encode() or b"".join(pb) != (" " + text).encode():
            return [], []
        return spans(a, pa), spans(b, pb)

    return both


def groups_of(a, b):
    ends = sorted({x[2] for x in a} & {x[2] for x in b})
    return [([i for i, _, e in a if s < e <= t], [i for i, _, e in b if s < e <= t]) for s, t in zip([0, *ends], ends)]


def want(plain, rows):
    tokens = [(r[0], *plain(r[1])) for r in rows]
    links = [[(i, j) for i, _, e in a for j, _, f in b if e == f] for _, a, b in tokens]
    counts = Counter(p for x in links for p in x)
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = Counter()
    for (d, a, b), own in zip(tokens, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups_of(a, b))
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out[d, len(a), len(b), len(groups_of(a, b)), len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), digest] += 1
    return out


def short(rows, n=700):
    return [(r[0], r[1] and r[1][:n], *r[2:]) for r in rows]


ODD = [
    (300, "a <|endoftext|> <s>b</s> <0x41>", "en", "a", 1), (301, "\0 two  blanks \n\n and more　x \x1c\x85 ", "en", "a", 1), (302, "漢字かな交じり文" * 30 + "🙂é", "en", "a", 1),
    (303, "a▁b", "en", "a", 1), (304, " lead", "en", "a", 1), (305, "line\nnext\n\nlast \n", "en", "a", 1), (306, "\n", "en", "a", 1), (307, " ", "en", "a", 1), (308, "x\r\ny\n z", "en", "a", 1),
]


@pytest.mark.parametrize("lot", [(8 << 20, 400_000), (300, 50)])
def test_counts_equal_the_plain_model(spark, plain, lot):
    rows = short(odd_documents()) + ODD
    got = rows_of(align.align_corpus(extended(spark, rows).repartition(3), tokenizer_path(), PIECES, lot_tokens=lot[0], lot_pairs=lot[1]), *COLUMNS)
    assert got == want(plain, rows)


def test_overlaps_and_groups(spark, plain):
    rows = short(odd_documents()[:20] + odd_documents()[-12:], 300) + ODD
    found = align.align_documents(extended(spark, rows), tokenizer_path(), PIECES).collect()
    assert len(found) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        if r["doc_id"] is None:
            continue
        a, b = plain(texts[r["doc_id"]])
        assert [(list(g["a"]), list(g["b"])) for g in r["groups"]] == groups_of(a, b)
        assert sorted((o["a"], o["b"], o["together"]) for o in r["overlaps"]) == [(i, j, x[2] == y[2]) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert align.align_corpus(none, tokenizer_path(), PIECES).count() == 0
    assert align.align_documents(none, tokenizer_path(), PIECES).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "a", 0)], DOC)
    assert rows_of(align.align_corpus(blank, tokenizer_path(), PIECES), *COLUMNS) == {(1, 0, 0, 0, 0, 0, 0, ""): 2}


def test_the_query_on_given_texts(spark, plain):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op11_cross_tokenizer_alignment"](spark, SF).collect()}
    tokens = {d[0]: plain(d[1]) for d in docs}
    counts = Counter()
    ends = {}
    for d, (a, b) in tokens.items():
        at = {f: j for j, _, f in b}
        ends[d] = [(i, at[e]) for i, _, e in a if e in at]
        counts.update(ends[d])
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    for d, (a, b) in tokens.items():
        r = got.pop(d)
        assert (r["n_a"], r["n_b"], r["n_links"], r["count_sum"]) == (len(a), len(b), len(ends[d]), sum(counts[p] for p in ends[d]))
        assert r["n_best"] == sum(counts[p] == most[p[1]] for p in ends[d])
    assert not got


def test_stretches_are_cut_as_a_whole_text(plain):
    rng, aligner = random.Random(4), align.Aligner(tokenizer_path(), PIECES, memory=40_000)
    letters = "ab c're\n\t  .é漢ñ1 2 x🙂\x1c▁"
    for _ in range(400):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3)]
        found = aligner.align(texts)
        for k, t in enumerate(texts):
            a, b = plain(t)
            assert found.a.loc[found.a["doc"] == k, "id"].tolist() == [x[0] for x in a]
            assert found.b.loc[found.b["doc"] == k, "id"].tolist() == [x[0] for x in b]
