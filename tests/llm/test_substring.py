import hashlib

import numpy as np
import pytest

from ballast.llm import substring as S
from tests.llm.fixtures import SCHEMA, by_id, documents, white_words


def brute(docs):
    first = {}
    for d, t, *_ in docs:
        ws = white_words(t)
        for i in range(len(ws) - 49 if d is not None else 0):
            w = tuple(ws[i : i + 50])
            first[w] = min(d, first.get(w, d))
    for d, t, *_ in docs:
        ws, gone = white_words(t), set()
        for i in range(len(ws) - 49 if d is not None else 0):
            if first[tuple(ws[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        yield d, len(ws), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in gone).encode()).hexdigest()


def test_the_cover_has_a_shift_for_any_two_positions():
    for i in range(S.PERIOD):
        for j in range(S.PERIOD):
            assert any((i + k) % S.PERIOD in S.COVER and (j + k) % S.PERIOD in S.COVER for k in range(S.PERIOD))
    assert S.ANCHOR + S.PERIOD - 1 <= S.WINDOW


def test_against_brute_force(spark):
    docs = documents()
    got = S.judge_repeats(spark.createDataFrame(docs, SCHEMA)).collect()
    want = by_id(brute(docs))
    assert by_id(tuple(r) for r in got) == want
    assert sum(r[2] > 0 for r in want) > 8


def test_texts_keep_what_is_not_repeated(spark):
    docs = documents()
    df = spark.createDataFrame(docs, SCHEMA)
    out = S.remove_repeats(df)
    assert out.columns == df.columns
    got = {(r.doc_id, r.source, r.n_chars): r.text for r in out.collect()}
    for (d, t, _, s, n), (_, words, gone, digest) in zip(docs, brute(docs)):
        if gone and gone == words:
            assert (d, s, n) not in got
        elif gone:
            assert hashlib.sha256(" ".join(white_words(got[d, s, n])).encode()).hexdigest() == digest
        else:
            assert got[d, s, n] == t
    assert S.remove_repeats(df.where("false")).count() == 0


def test_columns_of_the_same_names(spark):
    docs = documents()
    odd = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "'x' as n_words", "'x' as shard", "'x' as block", "'x' as blob", "'x' as removed")
    assert by_id(tuple(r) for r in S.judge_repeats(odd).collect()) == by_id(brute(docs))
    assert S.remove_repeats(odd).columns == odd.columns


def test_rolling_hashes_tell_windows_apart():
    codes = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64)
    codes[200:260] = codes[20:80]
    h = S.Rolling().windows(codes, 50)
    assert (h[200:211] == h[20:31]).all() and len(set(h.tolist())) == len(h) - 11


def test_windows_of_one_first_hash_are_told_apart():
    a, b = np.array([3, 5, 5, 5, 9], np.uint64), np.array([1, 1, 4, 7, 2], np.uint32)
    x, y = np.array([5, 5, 5, 9, 9, 4, 3], np.uint64), np.array([7, 1, 5, 2, 3, 1, 1], np.uint32)
    assert S._found(a, b, x, y).tolist() == [3, 1, -1, 4, -1, -1, 0]


def test_ids_that_are_no_numbers_are_refused(spark):
    with pytest.raises(ValueError, match="integral"):
        S.judge_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
