import random

from ballast.llm import classifier as C
from tests.llm.fixtures import SCHEMA, documents

WORDS = [f"word{i}" for i in range(300)]


def corpus(n=400, seed=8):
    draw = random.Random(seed)
    rows, truth, labels = [], {}, []
    for i in range(n):
        ws = [draw.choice(WORDS) for _ in range(draw.randrange(30, 120))]
        bad = i % 5 == 0
        if bad and i % 10 == 0:
            ws = [w + draw.choice(["###", "$$$"]) for w in ws]
        elif bad and i % 4 == 1:
            ws[3:3] = ["idiot", "stupid", "blorf"]
        elif bad:
            ws[5:5] = [f"veju{draw.randrange(60)}", f"veju{draw.randrange(60)}"]
        rows.append((i, " ".join(ws), "en", "s", 1))
        truth[i] = bad
        if i % 2 or bad:
            labels.append((i, int(not (bad and i % 10 == 0)), int(bad and i % 10 != 0)))
    return rows, truth, labels


def test_finds_bad_texts_and_keeps_good_ones(spark):
    rows, truth, labels = corpus()
    docs, said = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = C.keep_good(docs, said)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    good = [d for d, bad in truth.items() if not bad]
    bad = [d for d, b in truth.items() if b]
    assert sum(d in ids for d in good) >= 0.98 * len(good)
    assert sum(d in ids for d in bad) <= 0.1 * len(bad)


def test_labellers_alone_and_odd_rows(spark):
    rows, truth, _ = corpus()
    docs = spark.createDataFrame(rows + [(1000 + k, *r[1:]) for k, r in enumerate(documents())], SCHEMA)
    scored = C.score(docs, C.fit(docs)).collect()
    assert len(scored) == docs.count() and all(r.badness == r.badness for r in scored)
    assert sum(r.badness > 0 for r in scored if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 10 == 0) == 40
    empty = docs.where("false")
    assert C.score(empty, C.fit(empty)).count() == 0


def test_labels_that_name_nothing_leave_the_labellers(spark):
    rows, truth, _ = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    junk = {d for d, bad in truth.items() if bad and d % 10 == 0}
    for said in ([], [(10**6 + k, 1, 0) for k in range(50)], [(1, 1, 0), (3, None, None)]):
        labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
        gone = {d for d in truth} - {r.doc_id for r in C.keep_good(docs, labels).collect()}
        assert junk <= gone and sum(not truth[d] for d in gone) <= 2


def test_columns_of_the_same_names_and_repeats(spark):
    rows, truth, labels = corpus()
    docs = spark.createDataFrame(rows + rows[:7], SCHEMA).selectExpr("*", "lang as badness", "lang as quality", "lang as toxic", "lang as features", "lang as votes", "lang as w")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = C.keep_good(docs, said)
    assert kept.columns == docs.columns
    scored = C.score(docs, C.fit(docs, said))
    assert scored.columns == [*(c for c in docs.columns if c != "badness"), "badness"] and scored.count() == len(rows) + 7
    by_text = {}
    for r in scored.collect():
        by_text.setdefault(r.text, set()).add(r.badness)
    assert all(len(x) == 1 for x in by_text.values())


def test_scorer_against_brute_force_descent():
    draw = random.Random(5)
    texts = [sorted(draw.sample(range(12), draw.randrange(1, 6))) for _ in range(200)]
    target = [float((1 in t or (2 in t and 3 in t)) != (draw.random() < 0.2)) for t in texts]
    import math

    import numpy as np

    weights, bias = C.fit_scorer([(np.array(t, np.int32), 1.0, p) for t, p in zip(texts, target)], np.arange(12) + 100, 10, rounds=3000)
    w, b = [0.0] * 12, math.log(sum(target) / (200 - sum(target)))
    for _ in range(4000):  # plain gradient descent on the same loss
        dw, db = [0.02 * x for x in w], 0.0
        for t, p in zip(texts, target):
            e = 1 / (1 + math.exp(-b - sum(w[k] for k in t))) - p
            db += e
            for k in t:
                dw[k] += e
        w, b = [x - 0.02 * d for x, d in zip(w, dw)], b - 0.02 * db
    assert abs(b - bias) < 0.02 and all(abs(w[k] - weights[k + 100]) < 0.02 for k in range(12))


def test_em_finds_which_labeller_is_right():
    draw, patterns, truth = random.Random(3), {}, {}
    for _ in range(4000):
        bad = draw.random() < 0.3
        vote = tuple(int(bad) if draw.random() < acc else int(not bad) for acc in (0.95, 0.9, 0.55))
        patterns[vote] = patterns.get(vote, 0) + 1
        truth.setdefault(vote, []).append(bad)
    posterior = C.fit_labellers(patterns)
    assert posterior[1, 1, 0] > 0.9 and posterior[0, 0, 1] < 0.1
    assert C.fit_labellers({}) == {} and C.fit_labellers({(2, 2, 2): 5}) == {(2, 2, 2): 0.1}


def test_few_bytes_of_feature_sets_still_fit(spark):
    rows, truth, labels = corpus()
    docs, said = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights, bias = C.fit(docs, said, sample_bytes=6_000)
    assert weights.any()
    gone = {r.doc_id for r in C.score(docs, (weights, bias)).where("badness > 0").collect()}
    assert sum(truth[d] for d in gone) >= 0.5 * sum(truth.values()) and sum(not truth[d] for d in gone) <= 0.1 * len(truth)
    few = C.fit(docs, said, few=1)
    assert few[0].any()
