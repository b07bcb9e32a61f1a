import math
import random
from collections import Counter

import numpy as np
from fixtures import DOC, extended, odd_documents

from cuemill.llm.classifier import Features, OrdinalModel, classify, fit_ordinal, grade_documents, learn

RATING = "doc_id long, grade int"


def test_grades_of_unseen_documents(spark):
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(60)]
    rows, grade = [], {}
    for i in range(400):
        words = [rng.choice(plain) for _ in range(60)]
        grade[i] = rng.choice([0, 1, 2, 2])
        for _ in range((3, 0, 0)[grade[i]]):
            words[rng.randrange(60)] = rng.choice(["awful", "vile"])
        if grade[i] == 1:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), None, None, 0))
    ratings = spark.createDataFrame([(i, grade[i]) for i in range(300)], RATING)
    found = {r["doc_id"]: r for r in classify(spark.createDataFrame(rows, DOC), ratings).collect()}
    new = range(300, 400)
    assert np.mean([found[i]["kept"] == (grade[i] == 2) for i in new]) > 0.95
    assert np.mean([round(found[i]["expected_grade"]) == grade[i] for i in new]) > 0.9
    for r in found.values():
        a, b = r["p_at_least"]
        assert 1 >= a >= b >= 0 and abs(r["expected_grade"] - a - b) < 1e-9 and r["p_top"] == b


def test_odd_documents_and_ratings(spark):
    rows = odd_documents()
    ratings = spark.createDataFrame([(1, 0), (1, 2), (2, None), (3, 9), (None, 1), (4, 2), (200, 1), (99999, 1)], RATING)
    found = classify(extended(spark, rows), ratings).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    assert classify(extended(spark, rows), ratings.limit(0)).count() == len(rows)
    assert classify(spark.createDataFrame([], DOC), ratings).count() == 0


def test_fit_descends_and_keeps_the_thresholds_in_order():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 200)
    index = np.concatenate([grade, rng.integers(10, 20, 200)])
    row = np.concatenate([np.arange(200), np.arange(200)])
    m = fit_ordinal(index, np.ones(400), row, grade, 4, 32, 1e-4, 200, 0.1)
    assert (np.diff(m.thresholds) > 0).all() and (np.diff(m.weights[:4]) > 0).all()
    assert isinstance(m, OrdinalModel) and (m.above(np.array([0.0, 9.0]))[1] > 0.5).all()


def plain_chances(score: float, thresholds) -> list[float]:
    """Chance of each grade, one sigmoid at a time."""
    upto = [0.0, *(1 / (1 + math.exp(score - t)) for t in thresholds), 1.0]
    return [b - a for a, b in zip(upto, upto[1:])]


def test_whole_query_against_a_plain_likelihood(spark):
    """The fit found through Spark is where the plain penalised likelihood is flat; the grades are those of plain sums."""
    rng, size, ridge = random.Random(8), 1 << 16, 0.02
    words = ["calm", "clear", "dull", "awful", "vile", "Loud", "x9", "###"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for i in range(70)} | {70: "", 71: None}
    bad = lambda t: sum(w in ("awful", "vile") for w in t.split())
    graded = {i: max(0, min(2, 2 - bad(texts[i]) + rng.choice([0, 0, 0, -1, 1]))) for i in range(60)}
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], DOC)
    ratings = spark.createDataFrame(list(graded.items()), RATING)
    model = learn(docs, ratings, "doc_id", "text", "grade", size=size, ridge=ridge, least=1, steps=3000, rate=0.02)

    facts = {i: dict(zip(*map(np.ndarray.tolist, Features(size).of(t or "")))) for i, t in texts.items()}
    often = Counter(graded.values())
    weigh = {g: 1 / math.sqrt(n / len(graded)) for g, n in often.items()}
    whole = sum(weigh[g] for g in graded.values())

    def loss(weights: dict[int, float], thresholds) -> float:
        total = ridge / 2 * sum(w * w for w in weights.values())
        for i, g in graded.items():
            chance = plain_chances(sum(weights.get(f, 0.0) * v for f, v in facts[i].items()), thresholds)[g]
            total -= weigh[g] / whole * math.log(chance)
        return total

    used = {f for i in graded for f in facts[i]}
    assert set(np.flatnonzero(model.weights).tolist()) <= used
    found, cuts, step = {f: float(model.weights[f]) for f in used}, model.thresholds.tolist(), 1e-4
    slopes = [(loss(found | {f: found[f] + step}, cuts) - loss(found | {f: found[f] - step}, cuts)) / (2 * step) for f in used]
    slopes += [(loss(found, [t + step * (k == j) for j, t in enumerate(cuts)]) - loss(found, [t - step * (k == j) for j, t in enumerate(cuts)])) / (2 * step) for k in range(2)]
    assert max(map(abs, slopes)) < 2e-3
    assert loss(found, cuts) < 0.8 * loss(dict.fromkeys(used, 0.0), [-0.7, 0.7])

    rows = {r["doc_id"]: r for r in grade_documents(docs, model).collect()}
    for i in texts:
        chance = plain_chances(sum(found.get(f, 0.0) * v for f, v in facts[i].items()), cuts)
        assert abs(rows[i]["p_at_least"][0] - chance[1] - chance[2]) < 1e-5 and abs(rows[i]["p_top"] - chance[2]) < 1e-5
        assert abs(rows[i]["expected_grade"] - chance[1] - 2 * chance[2]) < 1e-5 and rows[i]["kept"] == (rows[i]["p_top"] >= 0.5)
