import random

from ballast.llm import decontaminate as D
from tests.llm.fixtures import SCHEMA, alnum_words, by_id, documents, prose


def brute(text, items, window=10):
    ws, hit, found = alnum_words(text), set(), set()
    for item, t in items:
        iw = alnum_words(t)
        k = min(window, len(iw))
        for s in range(len(iw) - k + 1 if k else 0):
            for i in range(len(ws) - k + 1):
                if ws[i : i + k] == iw[s : s + k]:
                    hit.update(range(i, i + k))
                    found.add(item)
    return len(ws), hit, found


def tables(spark):
    docs = documents()
    draw = random.Random(9)
    items = [(1, None), (2, ""), (3, "one"), (4, " ".join(docs[8][1].split()[5:30])), (5, "TWO, words!"), (6, prose(draw, 14)), (7, " ".join(docs[7][1].split()[:10])), (7, "w1 w2"), (None, "日本 é"), (8, docs[5][1]), (9, docs[5][1])]
    docs += [(100, f"{prose(draw, 5)} {items[5][1]} {prose(draw, 3)}", "en", "s", 1), (101, " ".join(items[5][1].split()[2:13]), "en", "s", 1)]
    return docs, items, spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")


def check(spark, **how):
    docs, items, d, i = tables(spark)
    got = by_id((r.doc_id, r.n_words, sum(s.b - s.a for s in r.spans), tuple(r["items"])) for r in D.match_items(d, i, **how).collect())
    want = by_id((row[0], *(lambda n, h, f: (n, len(h), tuple(sorted(str(x) for x in f if x is not None))))(*brute(row[1], items))) for row in docs)
    return got, want


def test_against_brute_force(spark):
    got, want = check(spark)
    assert got == want


def test_blocks_of_items_give_the_same_hits(spark):
    got, want = check(spark, max_block_bytes=120)
    assert got == want


def test_columns_of_the_same_names(spark):
    docs, items, d, i = tables(spark)
    odd = d.selectExpr("*", "'x' as spans", "'x' as items", "'x' as n_words", "'x' as key", "'x' as block", "'x' as item_id")
    for how in ({}, {"max_block_bytes": 120}):
        assert D.match_items(odd, i, **how).columns == ["doc_id", "n_words", "spans", "items"]
        out = D.decontaminate(odd, i, **how)
        assert out.columns == odd.columns and out.count() == D.decontaminate(d, i, **how).count()


def test_spans_are_cut_and_covered_documents_go(spark):
    docs, items, d, i = tables(spark)
    out = {(r.doc_id, r.lang): r.text for r in D.decontaminate(d, i, max_coverage=0.5).collect()}
    assert (101, "en") not in out and (8, "en") not in [k for k in out if out[k] and brute(out[k], items)[1]]
    for (doc, _), text in out.items():
        before = [t for n, t, *_ in docs if n == doc]
        assert text in before or not brute(text, [x for x in items if x[1] and len(alnum_words(x[1])) >= 10])[1]
    assert out[(0, "en")] is None and out[(1, "en")] == ""


def test_no_items_and_no_documents(spark):
    _, _, d, i = tables(spark)
    assert D.match_items(d, i.where("false")).where("size(spans) > 0").count() == 0
    assert D.match_items(d.where("false"), i).count() == 0
    assert D.decontaminate(d, i.where("false")).count() == d.count()


def test_rows_keep_their_number_whatever_the_number_of_blocks(spark):
    docs, items, d, i = tables(spark)
    odd = [(None, " ".join(docs[8][1].split()[k : k + 20]), "en", "s", 1) for k in (0, 10, 30)] + [docs[8], docs[8]]
    d = d.unionByName(spark.createDataFrame(odd, SCHEMA))
    rows = lambda most: by_id((r.doc_id, r.n_words, tuple((s.a, s.b) for s in r.spans), tuple(r["items"])) for r in D.match_items(d, i, max_block_bytes=most).collect())
    assert len(rows(120)) == d.count() and rows(120) == rows(10**6)


def test_copies_of_an_item_over_a_block_end(spark):
    draw = random.Random(6)
    item, other = prose(draw, 30), prose(draw, 30)
    i = spark.createDataFrame([(k, item) for k in range(20)] + [(99, other)], "item_id long, text string")
    d = spark.createDataFrame([(1, f"x {item} y", "en", "s", 1)], SCHEMA)
    blocks = []
    for block in D._blocks(i, "item_id", "text", 60):
        blocks.append(block)
        assert len(blocks) <= 64
    assert sorted(len(b) for b in blocks) == [1, 20]
    (row,) = D.match_items(d, i, max_block_bytes=60).collect()
    assert sorted(row["items"]) == sorted(map(str, range(20)))


def test_cuts_do_not_depend_on_the_number_of_blocks(spark):
    w = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(ws)) for k, ws in enumerate([w[0:12], w[8:20], w[30:42], w[44:56], ["a1", "a2", "a3", "a4", "a5", "b1", "b2", "b3", "b4", "b5"]])]
    far = [f"f{k}" for k in range(40)]
    texts = [
        " ".join(far[:20] + w[0:20] + far[20:]),  # overlapping passages of two items
        " ".join(far[:8] + w[30:42] + w[44:56] + far[8:16]),  # covered by both together only
        " ".join(far[:20] + ["a1", "a2", "a3", "a4", "a5"] + w[30:42] + ["b1", "b2", "b3", "b4", "b5"] + far[20:]),  # neighbours by a cut only
        None, "", "nothing here",
    ]
    d, i = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    want = {0: " ".join(far[:20]) + "  " + " ".join(far[20:]), 2: " ".join([*far[:20], "a1 a2 a3 a4 a5"]) + "  " + " ".join(["b1 b2 b3 b4 b5", *far[20:]]), 3: None, 4: "", 5: "nothing here"}
    for most in (10**6, 50):
        out = D.decontaminate(d, i, max_block_bytes=most)
        assert out.columns == d.columns and {r.doc_id: r.text for r in out.collect()} == want
