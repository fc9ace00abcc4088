import random

from ballast.llm import jaccard as J
from tests.llm.fixtures import SCHEMA, documents, lower, prose, white_words


def shingles(text, k=5):
    ws = white_words(lower(text))
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute(rows, threshold=0.8):
    """The (doc_id, text) that stay, by comparing every pair."""
    texts = {}
    for d, t, *_ in rows:
        if d is not None:
            texts[t or ""] = min(d, texts.get(t or "", d))
    sets = {t: shingles(t) for t in texts}
    up = {t: t for t in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    names = sorted(texts, key=lambda t: texts[t])
    for i, a in enumerate(names):
        for b in names[:i]:
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for t in names:
        least[find(t)] = min(texts[t], least.get(find(t), texts[t]))
    return sorted(least.values())


def corpus():
    draw, rows = random.Random(12), documents()
    for n in (10, 40, 150):  # from 0.6 to 0.95, both sides of the threshold, and chains
        for _ in range(6):
            ws = [f"{n}x{draw.randrange(10**6)}" for _ in range(n)]
            for _ in range(8):
                rows.append((1000 + len(rows), " ".join(ws), "en", "s", 1))
                ws = list(ws)
                for _ in range(draw.randrange(1, 2 + n // 40)):
                    ws[draw.randrange(n)] = f"y{draw.randrange(10**6)}"
    line = "the same line again and again " * 80  # one line repeated dominates different texts
    rows += [(5000 + k, prose(draw, 60) + " " + line, "en", "s", 1) for k in range(4)]
    body = prose(draw, 200)  # one set of shingles, but other numbers of each
    rows += [(6000, body, "en", "s", 1), (6001, f"{body} {body} {body}", "en", "s", 1), (6002, body + " " + "w1 w2 " * 400, "en", "s", 1)]
    return rows


def test_against_brute_force_jaccard(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    for how in ({}, {"max_tree": 3, "max_group_bytes": 1500}):
        out = J.drop_near_copies(docs, **how)
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == brute(rows)
        assert out.where("doc_id is null").count() == 2
    assert J.drop_near_copies(docs.where("false")).count() == 0


def test_the_pipelines_stage_is_exact(spark):
    import corpus_pipeline

    rows = corpus()
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == brute(rows)


def test_any_order_of_shingles_meets_what_is_similar():
    draw = random.Random(4)
    import numpy as np

    for _ in range(300):
        both = [draw.randrange(2**63) for _ in range(draw.randrange(1, 60))]
        a, b = (np.unique(np.array(both + [draw.randrange(2**63) for _ in range(draw.randrange(8))], np.uint64)) for _ in range(2))
        order = J.Order({h: draw.randrange(5, 9) for h in both if draw.random() < 0.7})
        if J.alike(a, b, 0.8):
            assert set(order.first(a, 0.8).tolist()) & set(order.first(b, 0.8).tolist())
