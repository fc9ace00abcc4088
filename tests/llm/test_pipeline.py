"""Each stage of the pipeline, and all of it, against brute force."""

import random

import pytest

import corpus_pipeline as P
from tests.llm import test_decontaminate, test_jaccard
from tests.llm.fixtures import SCHEMA, alnum_words, prose, white_words

JUNK, CLEAN, ITEM = range(9000, 9040), range(2000, 2120), range(7000, 7010)


def rows():
    """Clean, junk and odd documents; copies and near copies of them; passages that repeat; passages of the benchmark."""
    draw = random.Random(21)
    out = test_jaccard.corpus()
    out += [(d, " ".join(f"c{draw.randrange(4000)}" for _ in range(draw.randrange(60, 90))), "en", "s", 1) for d in CLEAN]
    out += [(d, " ".join(w + draw.choice(["###", "$$$", "%%%"]) for w in prose(draw, 70).split()), "en", "s", 1) for d in JUNK]
    items = [(k, " ".join(f"b{draw.randrange(4000)}" for _ in range(30))) for k in range(10)]
    for d, (_, item) in zip(ITEM, items):
        out.append((d, " ".join(f"d{draw.randrange(4000)}" for _ in range(80)) + f" {item} " + " ".join(f"d{draw.randrange(4000)}" for _ in range(15)), "en", "s", 1))
        out.append((d + 100, f"short {item}", "en", "s", 1))
    return out, items


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    docs, items = rows()
    folder = str(tmp_path_factory.mktemp("sf"))
    labels = [(d, int(d not in JUNK), 0) for d, *_ in docs if d is not None and d % 2 == 0]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, items, folder


def repeats(docs):
    """Documents by id with what is left of them without windows that a smaller doc_id has."""
    first = {}
    for d, t in docs:
        ws = white_words(t)
        for i in range(len(ws) - 49 if d is not None else 0):
            w = tuple(ws[i : i + 50])
            first[w] = min(d, first.get(w, d))
    for d, t in docs:
        ws, gone = white_words(t), set()
        for i in range(len(ws) - 49 if d is not None else 0):
            if first[tuple(ws[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        if not gone:
            yield d, t
        elif len(gone) < len(ws):
            yield d, [w for i, w in enumerate(ws) if i not in gone]


def decontaminated(docs, items):
    for d, t in docs:
        n, hit, _ = test_decontaminate.brute(t, items)
        if not hit or len(hit) <= 0.5 * n:
            yield d, [w for i, w in enumerate(alnum_words(t)) if i not in hit]


def stage(spark, k, docs, folder):
    out = P.STAGES[k][1](spark, docs, folder)
    if k < 4:
        assert out.columns == docs.columns
    return out.cache()


def same(x):
    return sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, str(r[1:])))


def test_each_stage(spark, corpus):
    docs, items, folder = corpus
    df = spark.createDataFrame(docs, SCHEMA)
    good = stage(spark, 0, df, folder)
    kept = {r.doc_id for r in good.collect()}
    assert set(CLEAN) <= kept and not kept & set(JUNK) and {r.text for r in good.where("doc_id is null").collect()} == {t for d, t, *_ in docs if d is None}

    near = stage(spark, 1, good, folder)
    assert sorted(r.doc_id for r in near.collect() if r.doc_id is not None) == test_jaccard.brute([tuple(r) for r in good.collect()])
    for k, brute in ((2, lambda x: repeats(x)), (3, lambda x: decontaminated(x, items))):
        out = stage(spark, k, near, folder)
        words = white_words if k == 2 else alnum_words
        want = same((d, t if isinstance(t, list) else words(t)) for d, t in brute([(r.doc_id, r.text) for r in near.collect()]))
        assert same((r.doc_id, words(r.text)) for r in out.collect()) == want
        near = out
    packed = stage(spark, 4, near, folder).collect()
    by_doc, by_bin = {}, {}
    for r in packed:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
        by_bin.setdefault((r.bin, r.size), []).append(r.length)
    want = {}
    for r in near.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(white_words(r.text)) + 1
    assert by_doc == want and all(sum(x) <= size for (_, size), x in by_bin.items())


def test_run_is_the_stages_in_a_row(spark, corpus):
    docs, items, folder = corpus
    rows, df = P.run(spark, folder).collect(), spark.read.parquet(f"{folder}/documents.parquet")
    for k in range(5):
        df = stage(spark, k, df, folder)
    one = lambda rs: sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length) for r in rs)
    assert one(rows) == one(df.collect())
    ids = {r.doc_id for r in rows}
    assert set(CLEAN) <= ids and set(ITEM) <= ids and not ids & set(JUNK) and not ids & {d + 100 for d in ITEM}
