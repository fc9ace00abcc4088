import collections
import math

import pytest
from pyspark.sql import functions as F

from ballast.llm import ngram as N
from tests.llm.fixtures import SCHEMA, by_id, documents, lower, white_words


def model(texts):
    c, b = collections.Counter(), collections.Counter()
    for t in texts:
        x = ["<s>", *white_words(lower(t)), "</s>"]
        c.update(x[1:])
        b.update(zip(x, x[1:]))
    n, v = sum(c.values()), len(c)
    context, ends, levels = collections.Counter(), collections.Counter(), collections.defaultdict(collections.Counter)
    for (u, w), k in b.items():
        context[u] += k
        ends[w] += 1
        levels[u][min(k, 3)] += 1
    cb, ce = collections.Counter(b.values()), collections.Counter(ends.values())
    d, e = (0, *N.discounts(*(cb[k] for k in (1, 2, 3, 4)))), (0, *N.discounts(*(ce[k] for k in (1, 2, 3, 4))))
    total = sum(ends.values())
    spare = sum(e[min(k, 3)] * m for k, m in ce.items())

    def lower_p(w):
        return (max(ends[w] - e[min(ends[w], 3)], 0) + spare / (v + 1)) / total if total else 1 / (v + 1)

    def p(u, w):
        if not context[u]:
            return lower_p(w)
        k = b[u, w]
        return (max(k - d[min(k, 3)], 0) + sum(d[x] * levels[u][x] for x in (1, 2, 3)) * lower_p(w)) / context[u]

    return c, n, v, p


def score(text, c, n, v, p):
    x = ["<s>", *white_words(lower(text)), "</s>"]
    base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x[1:])
    return len(x) - 1, sum(c[w] > 0 for w in x[1:]), base, sum(math.log10(p(u, w)) for u, w in zip(x, x[1:]))


@pytest.mark.parametrize("rows", [documents(), documents()[:3]])
def test_against_brute_force(spark, rows):
    held = F.col("doc_id") % 3 == 1
    c, n, v, p = model([t for d, t, *_ in rows if d is None or d % 3 != 1])
    got = N.score_all(spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")), held).collect()
    assert len(got) == len(rows)
    want = by_id((d, d is not None and d % 3 == 1, *(round(x, 6) for x in score(t, c, n, v, p))) for d, t, *_ in rows)
    assert by_id((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}


def test_probabilities_sum_to_one():
    c, n, v, p = model(["a b a c", "b a d", "a b"])
    for u in ("<s>", "a", "b", "unseen"):
        assert sum(p(u, w) for w in c) + p(u, "<unknown>") == pytest.approx(1)


def test_no_training_and_no_rows(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    assert {r.score for r in N.score_all(df, F.lit(True)).collect()} == {0.0}
    assert N.score_all(df.where("false"), F.lit(False)).count() == 0


def test_a_stored_model_scores_like_the_one_in_one_go(spark):
    from ballast.functions.durable import scratch

    rows, held = documents(), F.col("doc_id") % 3 == 1
    df, path = spark.createDataFrame(rows, SCHEMA), scratch(spark, "model")
    N.fit(df, held, path)
    both = lambda x: by_id((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in x.collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # other blocks than the model has shards
    try:
        assert both(N.score(df, path, held)) == both(N.score_all(df, held))
        c, n, v, p = model([t for d, t, *_ in rows if d is None or d % 3 != 1])
        new = [(1, "w1 w2 never seen before w3"), (2, None), (None, "w7 w7")]
        got = N.score(spark.createDataFrame(new, "doc_id long, text string"), path).collect()
        assert by_id((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == by_id((d, k, round(b, 6), round(x, 6)) for d, t in new for _, k, b, x in [score(t, c, n, v, p)])
        assert N.score(df.where("false"), path).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    empty = scratch(spark, "model")
    N.fit(df, F.lit(True), empty)
    assert {r.score for r in N.score(df, empty).collect()} == {0.0}
