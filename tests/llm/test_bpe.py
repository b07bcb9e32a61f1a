import hashlib
import json
import random

import numpy as np
import pytest
from fixtures import DOC, SF, extended, odd_documents, rows_of
from tokenizers import Tokenizer

from cuemill.llm import bpe
from cuemill.llm.queries import QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(tokenizer_path())


def want(whole, i, text):
    ids = whole.encode(text or "", add_special_tokens=False).ids
    back = whole.decode(ids, skip_special_tokens=False)
    return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def digests(found):
    return {(r["doc_id"], r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(), hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in found.collect()}


def test_odd_documents(spark, whole):
    rows = odd_documents() + [(300, "a <|endoftext|> b<|endoftext|>", "en", "a", 1), (301, "\0 two  blanks \n\n and more　x \x1c\x85 ", "en", "a", 1), (302, "漢字かな交じり文" * 900 + "🙂é" * 50, "en", "a", 1)]
    found = bpe.decode_documents(bpe.encode_documents(extended(spark, rows), tokenizer_path()), tokenizer_path())
    assert digests(found) == {want(whole, r[0], r[1]) for r in rows}
    assert found.count() == len(rows)


def test_empty_table(spark):
    assert bpe.decode_documents(bpe.encode_documents(spark.createDataFrame([], DOC), tokenizer_path()), tokenizer_path()).count() == 0


def test_the_query_equals_the_library_on_the_given_texts(spark, whole):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert rows_of(QUERIES["op12_bpe_encoding"](spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == {want(whole, r["doc_id"], r["text"]): 1 for r in docs}


def test_random_texts_with_every_kind_of_white_space(whole):
    rng, e = random.Random(3), bpe.Encoder(tokenizer_path())
    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    f = bpe.Encoder(tokenizer_path(), added=False)
    letters = "ab c'stre\n\t  .!?%é漢字ñ1 2  x🙂\x1c\x85́ \0"
    for k in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        if k % 7 == 0:
            s = s[:9] + "<|endoftext|>" + s[9:]
        if k % 500 == 0:
            s = rng.choice("xaé") * rng.randint(1000, 3000) + s
        assert np.frombuffer(e.encode(s), "<u4").tolist() == whole.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(f.encode(s), "<u4").tolist() == plain.encode(s, add_special_tokens=False).ids


def test_letters_and_numbers_are_those_of_the_library():
    from tokenizers.pre_tokenizers import ByteLevel

    parts, cut = ByteLevel(add_prefix_space=False).pre_tokenize_str, bpe.pretokens()
    for c in range(0x80, 0x20000, 3):
        if not 0xD800 <= c < 0xE000:
            for s in (f"a{chr(c)}a", f"1{chr(c)}1", f"!{chr(c)}!"):
                assert len(parts(s)) == len(cut(s)), hex(c)


def test_what_is_remembered_is_bounded(whole):
    e, rng = bpe.Encoder(tokenizer_path(), memory=20_000), random.Random(1)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(50)) for _ in range(4)]
        assert [np.frombuffer(i, "<u4").tolist() for i in e.encode_batch(texts)] == [t.ids for t in whole.encode_batch(texts, add_special_tokens=False)]
        assert e.held < 20_000 + 200 * 400
    long = " ".join(texts * 20)
    assert b"".join(e.encode_batch([long], block=100)) == e.encode(long)


def test_cuts_lie_where_no_token_reaches():
    v, e = bpe.vocabulary(tokenizer_path()), bpe.Encoder(tokenizer_path())
    cut = 0
    for word in ("zqxjk", "naïveté", "xqzw!!", "qqzzvvkkjj", "ünïcødé"):
        parts = e.fragments(word.encode())
        assert b"".join(parts) == word.encode()
        cut += len(parts) - 1
        for a, b in zip(parts, parts[1:]):
            assert not any(a[-1:] + b[:1] in t for t in v.tokens)
    assert cut


def test_decoding_any_ids(spark, whole):
    ids = [[50256, 262], [197, 10253], [], list(range(120, 260)), [60000, 262]]
    df = spark.createDataFrame([(k, bytearray(np.array(i, "<u4").tobytes()), "own") for k, i in enumerate(ids)] + [(9, None, "own")], "doc_id long, ids binary, decoded string")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode_documents(df, tokenizer_path()).collect()}
    assert got == {k: whole.decode(i, skip_special_tokens=False) for k, i in enumerate(ids)} | {9: None}


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_other_files_are_refused(tmp_path, change):
    with open(tokenizer_path(), encoding="utf-8") as f:
        file = json.load(f) | change
    (tmp_path / "t.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "t.json"))
