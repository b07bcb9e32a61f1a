import math
from collections import Counter, defaultdict

import pytest
from fixtures import DOC, WORD, extended, odd_documents

from cuemill.llm import quality
from cuemill.llm.quality import keep_quality, quality_rules


def stats(text):
    text = text or ""
    words = [w.decode() for w in WORD.findall(text.encode())]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    repeated = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line.encode()):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def kneser_ney(rows, lang, order):
    """Interpolated modified Kneser-Ney in plain dictionaries: P(last character | the others)."""
    count = [Counter() for _ in range(order + 1)]
    for _, text, own, *_ in rows:
        if (own or "") == lang:
            for w in set((text or "").lower().encode().split()):
                w = "\x02" + w.decode() + "\x03"
                for i in range(1, len(w)):
                    g = w[max(0, i - order + 1) : i + 1]
                    count[len(g)][g] += 1
    for k in range(order - 1, 0, -1):
        for g in count[k + 1]:
            count[k][g[1:]] += 1
    tables = []
    for k in range(1, order + 1):
        n = [sum(c == x for c in count[k].values()) for x in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0
        d = [max(0.05, min(i - 0.05, i - (i + 1) * y * n[i] / n[i - 1])) if n[0] and n[i - 1] else (0.5, 1.0, 1.5)[i - 1] for i in (1, 2, 3)]
        total, freed = Counter(), Counter()
        cut = lambda c: d[min(c, 3) - 1]
        for g, c in count[k].items():
            total[g[:-1]] += c
            freed[g[:-1]] += cut(c)
        p = {}
        for g, c in count[k].items():
            below = tables[-1][g[1:]] if tables else 1 / (len(count[1]) + 1)
            p[g] = (c - cut(c)) / total[g[:-1]] + freed[g[:-1]] / total[g[:-1]] * below
        tables.append(p)
    return tables


@pytest.mark.parametrize("model_rows", [2_000_000, 0])
def test_counts_and_perplexity(spark, model_rows):
    rows = odd_documents()
    found = quality_rules(extended(spark, rows), order=3, model_rows=model_rows).collect()
    want = Counter((i, *stats(t)) for i, t, *_ in rows)
    assert Counter((r["doc_id"], *[r[s] for s in quality.STATS]) for r in found) == want
    text = {(r[0], r[2] or ""): r[1] for r in rows}
    tables = {lang: kneser_ney(rows, lang, 3) for lang in ("en", "fr", "")}
    for r in found:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed
        if r["n_words"]:
            words = (text[r["doc_id"], r["lang"]] or "").lower().encode().split()
            logs = [math.log(tables[r["lang"]][min(i, 2)][w[max(0, i - 2) : i + 1]]) for w in ("\x02" + w.decode() + "\x03" for w in words) for i in range(1, len(w))]
            assert r["log_ppl"] == pytest.approx(-sum(logs) / len(logs), rel=1e-4)
            assert r["kept"] == (not failed and r["low"] <= r["log_ppl"] <= r["high"])
        else:
            assert not r["kept"]


def test_unknown_words_back_off(spark):
    rows = odd_documents()
    d = spark.createDataFrame(rows, DOC).selectExpr("doc_id id", "text", "coalesce(lang, '') lang")
    table = quality.kneser_ney(quality.word_counts(d), 3)
    grams = table.toArrow()
    model = quality.HashedModel.of(table, 3)
    own = {(x, g): (p, b) for x, g, p, b in zip(*[grams[c].to_pylist() for c in ("lang", "gram", "logp", "backoff")])}

    def log_p(lang, gram):
        if own.get((lang, gram), (None,))[0] is not None:
            return own[lang, gram][0]
        return -15.0 if len(gram) == 1 else own.get((lang, gram[:-1]), (0, 0.0))[1] + log_p(lang, gram[1:])

    for word in ("tane", "zzq", "tézo", "q"):
        marked = "\x02" + word + "\x03"
        assert model.score("en", [word])[0] == pytest.approx(sum(log_p("en", marked[max(0, i - 2) : i + 1]) for i in range(1, len(marked))), rel=1e-4)
    assert list(model.key) == sorted(model.key)


def test_rejected_documents_go(spark):
    rows = odd_documents()
    table = extended(spark, rows)
    verdict = {(r["doc_id"], r["lang"]): r["kept"] for r in quality_rules(table).collect()}
    kept = keep_quality(table)
    assert kept.columns == table.columns
    assert Counter((r["doc_id"], r["lang"] or "") for r in kept.collect()) == Counter((r[0], r[2] or "") for r in rows if verdict[r[0], r[2] or ""])


def test_a_narrow_band_keeps_most_ordinary_documents(spark):
    """Also beside documents in letters that no other has. Those without symbols teach the model too, so they need not score
    worse than every ordinary one."""
    import random

    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    rows = [(i, " ".join(word("aeioutnrsl") for _ in range(80)), "en", "a", 0) for i in range(120)]
    rows += [(500 + i, " ".join(word("qxzjw#$%&"[3 * i : 3 * i + 3] + "vkp") for _ in range(80)), "en", "a", 0) for i in range(3)]
    found = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, DOC), reach=1.0, noise=0.0).collect()}
    assert sum(found[i]["kept"] for i in range(120)) > 100


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], DOC)).count() == 0


def ordinary(rng, n):
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    return word, [(i, " ".join(word("aeioutnrsl") for _ in range(80)), "en", "a", 0) for i in range(n)]


def test_symbols_in_every_word_leave_the_band(spark):
    """Ordinary words in the language's letters stay; strings in letters of no other document go."""
    import random

    word, rows = ordinary(random.Random(3), 120)
    rows += [(500 + i, " ".join(word("qxzjw#$%&") for _ in range(80)), "en", "a", 0) for i in range(3)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows, DOC)).collect()}
    assert [i for i, k in kept.items() if not k] == [500, 501, 502]


@pytest.mark.parametrize("model_rows", [2_000_000, 0])
def test_common_junk_does_not_teach_the_model(spark, model_rows):
    """Symbols at word ends in a tenth of all documents, and letters that one document has for itself."""
    import random

    word, rows = ordinary(random.Random(4), 120)
    rows += [(500 + i, " ".join(word("aeioutnrsl") + "*%$"[j % 3] * 3 for j in range(80)), "en", "a", 0) for i in range(13)]
    rows += [(600, " ".join(word("qxzjwvkp") for _ in range(80)), "en", "a", 0)]
    found = quality_rules(spark.createDataFrame(rows, DOC), least_docs=2, model_rows=model_rows).collect()
    assert {r["doc_id"] for r in found if not r["kept"]} >= {*range(500, 513), 600}
    assert sum(r["kept"] for r in found if r["doc_id"] < 500) >= 114


def test_both_ways_score_unknown_words_alike(spark):
    rows = odd_documents() + [(700, "tane zzq %%% #x# " * 5, "en", "a", 0), (701, "ta#ne## so*** ri%%% qq&&", None, "a", 0)]
    table = spark.createDataFrame(rows, DOC)
    a, b = ({(r["doc_id"], r["lang"], r["word_chars"]): r["log_ppl"] for r in quality_rules(table, least_docs=2, model_rows=m).collect()} for m in (2_000_000, 0))
    assert a.keys() == b.keys() and all(b[k] == (None if v is None else pytest.approx(v, rel=1e-4)) for k, v in a.items())


def running_grams(rows, lang, order, least_docs):
    """Grams of running text and their plain Kneser-Ney tables: occurrences, contexts over word borders."""
    count, docs = [Counter() for _ in range(order + 1)], defaultdict(set)
    for at, (_, text, own, *_) in enumerate(rows):
        words = [w.decode() for w in (text or "").lower().encode().split()]
        if (own or "") == lang and words and 100 * sum(c in "#*$%&|<>" for c in text) <= 10 * len(words):
            line = "\n" + " ".join(words) + " "
            for i in range(1, len(line)):
                g = line[max(0, i - order + 1) : i + 1]
                count[len(g)][g] += 1
                docs[g].add(at)
    for c in count:
        for g in [g for g in c if len(docs[g]) < least_docs]:
            del c[g]
    full = [g for c in count for g in c]
    for k, g, before in {(k, g[-k:], g[-k - 1]) for g in full for k in range(1, len(g))}:
        count[k][g] += 1
    tables, weights = [], {}
    for k in range(1, order + 1):
        n = [sum(c == x for c in count[k].values()) for x in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0
        d = [max(0.05, min(i - 0.05, i - (i + 1) * y * n[i] / n[i - 1])) if n[0] and n[i - 1] else (0.5, 1.0, 1.5)[i - 1] for i in (1, 2, 3)]
        total, freed = Counter(), Counter()
        for g, c in count[k].items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3) - 1]
        weights |= {g: freed[g] / total[g] for g in total}
        p = {}
        for g, c in count[k].items():
            below = tables[-1][g[1:]] if tables else 1 / (len(count[1]) + 1)
            p[g] = (c - d[min(c, 3) - 1]) / total[g[:-1]] + weights[g[:-1]] * below
        tables.append(p)
    return {g: math.log(v) for t in tables for g, v in t.items()}, {g: math.log(w) for g, w in weights.items()}


@pytest.mark.parametrize("model_rows, least_docs", [(2_000_000, 1), (0, 1), (2_000_000, 2), (0, 2)])
def test_running_text_has_the_perplexity_of_a_plain_model(spark, model_rows, least_docs):
    rows = odd_documents() + [(700, "tane zzq %%% #x# " * 5, "en", "a", 0), (701, "a\x00b ta#ne## so*** ri%%% qq&&", None, "a", 0)]
    found = quality_rules(spark.createDataFrame(rows, DOC), order=4, model_rows=model_rows, least_docs=least_docs, across=True).collect()
    assert Counter((r["doc_id"], *[r[s] for s in quality.STATS]) for r in found) == Counter((i, *stats(t)) for i, t, *_ in rows)
    tables = {lang: running_grams(rows, lang, 4, least_docs) for lang in {r["lang"] for r in found}}
    text = defaultdict(list)
    for i, t, lang, *_ in rows:
        text[i, lang or ""].append(t)

    def log_p(lang, gram):
        p, backoff = tables[lang]
        return p[gram] if gram in p else -15.0 if len(gram) == 1 else backoff.get(gram[:-1], 0.0) + log_p(lang, gram[1:])

    def log_ppl(lang, t):
        words = [w.decode() for w in (t or "").lower().encode().split()]
        line = "\n" + " ".join(words) + " "
        return -sum(log_p(lang, line[max(0, i - 3) : i + 1]) for i in range(1, len(line))) / (len(line) - 1) if words else None

    for r in found:
        want = [log_ppl(r["lang"], t) for t in text[r["doc_id"], r["lang"]]]
        assert any(r["log_ppl"] is None if w is None else r["log_ppl"] == pytest.approx(w, rel=1e-4) for w in want)


@pytest.mark.parametrize("order, few", [(2, 100), (3, 900), (5, 12_000)])
def test_a_model_in_parts_scores_alike_and_writes_no_grams_of_documents(spark, order, few):
    """Each part is smaller than the model. What is written beyond the model is small beside the texts."""
    import os
    import random

    from cuemill.session import shared_folder

    rng = random.Random(8)
    rows = odd_documents() + [(700 + i, " ".join("".join(rng.choice("aeioutnrslé漢") for _ in range(rng.randint(1, 7))) for _ in range(400)), "en", "a", 0) for i in range(120)]
    table = spark.createDataFrame(rows + rows[-2:], DOC).coalesce(2)
    folder, size, found = shared_folder(spark), {}, {}
    for model_rows in (2_000_000, few):
        before = set(os.listdir(folder))
        found[model_rows] = quality_rules(table, order=order, least_docs=2, model_rows=model_rows, across=True)
        new = [n for n in os.listdir(folder) if n not in before]
        model = [n for n in new if n.startswith("model-")][0]
        # The model's own tables are the same both ways.
        others = [n for n in new if n.rsplit("-", 1)[0] not in ("grams", "counts", "discounts", "parts", "model")]
        size[model_rows] = sum(os.path.getsize(os.path.join(top, f)) for n in others for top, _, fs in os.walk(os.path.join(folder, n)) for f in fs if f.endswith(".parquet"))
    name = lambda r: repr((r["doc_id"], r["th"], r["lang"], *[r[s] for s in quality.STATS], r["base_failed"], r["kept"]))
    a, b = (sorted((name(r), -1.0 if r["log_ppl"] is None else r["log_ppl"]) for r in found[m].collect()) for m in (2_000_000, few))
    assert len(a) == len(rows) + 2 and [x for x, _ in a] == [x for x, _ in b] and [y for _, y in a] == pytest.approx([y for _, y in b], rel=1e-6)
    assert size[few] - size[2_000_000] < sum(len((r[1] or "").encode()) for r in rows) / 4
    grams = spark.read.parquet(os.path.join(folder, model))
    whole, one = quality.HashedModel.of(grams, order), quality.HashedModel.of(grams, order, 1, 4)
    assert len(one.key) < len(whole.key) or order == 2


def test_keys_are_ordered_stably_also_where_their_first_bits_are_the_same():
    import numpy as np

    rng = np.random.default_rng(1)
    for key in (rng.integers(0, 1 << 64, 5_000, np.uint64), rng.integers(0, 300, 5_000).astype(np.uint64), rng.integers(0, 300, 5_000).astype(np.uint64) << np.uint64(50), np.array([7], np.uint64)):
        assert (quality.by_key(key) == np.argsort(key, kind="stable")).all()


def test_keeping_documents_with_a_model_in_parts(spark):
    """The first stage of the pipeline keeps the same documents, whole."""
    rows = odd_documents()
    table = spark.createDataFrame(rows, DOC).coalesce(2)
    a, b = (sorted(map(repr, keep_quality(table, least_docs=2, across=True, model_rows=m).collect())) for m in (2_000_000, 2_000))
    assert a == b and 0 < len(a) < len(rows)


def test_the_order_of_words_tells(spark):
    """Words that end in a vowel and words that end in a consonant take turns everywhere but in one document."""
    import random

    from cuemill.llm import queries

    rng = random.Random(5)
    word = lambda end: "".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(1, 6))) + rng.choice(end)
    turns = lambda: [word("aeiou" if i % 2 else "tnrsl") for i in range(80)]
    start = {"aeiou": "tnrsl", "tnrsl": "aeiou"}
    linked = lambda ws: [rng.choice(start["aeiou" if w[-1] in "aeiou" else "tnrsl"]) + x for w, x in zip(ws, ws[1:])]
    rows = [(i, " ".join(linked(turns())), "en", "a", 0) for i in range(120)]
    mixed = linked(turns())
    mixed = [w for w in mixed if w[-1] in "aeiou"] + [w for w in mixed if w[-1] not in "aeiou"]
    table = spark.createDataFrame(rows + [(500, " ".join(mixed), "en", "a", 0)], DOC)
    seen = {}
    original, queries.table = queries.table, lambda *_: table
    try:
        seen = {r["doc_id"]: r["kept"] for r in queries.QUERIES["op6_quality_rules"](spark, "").collect()}
    finally:
        queries.table = original
    assert not seen[500] and sum(seen[i] for i in range(120)) >= 114
