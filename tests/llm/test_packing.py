import random

from ballast.llm import packing as P
from tests.llm.fixtures import SCHEMA, documents, white_words


def test_every_token_is_packed_once_and_bins_fit(spark):
    docs = documents()
    got = P.pack(P.lengths(spark.createDataFrame(docs, SCHEMA)), permitted=(16, 64, 256), block_rows=20).collect()
    by_bin = {}
    for r in got:
        by_bin.setdefault(r.bin, []).append(r)
    for rows in by_bin.values():
        used, size = sum(r.length for r in rows), rows[0].size
        assert len({r.size for r in rows}) == 1 and used <= size
        assert size == min(c for c in (16, 64, 256) if c >= used)
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    totals = {}
    for r in got:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    want = {}
    for d, t, *_ in docs:
        want[d] = want.get(d, 0) + len(white_words(t)) + 1
    assert totals == want
    assert P.pack(P.lengths(spark.createDataFrame([], SCHEMA))).count() == 0


def test_best_fit_and_downsizing():
    bins = P.pack_block([60, 30, 30, 4], [0, 1, 2, 3], (16, 64), lambda c: c)
    assert sorted((size, sorted(b)) for size, b in bins) == [(64, [0, 3]), (64, [1, 2])]
    # a steep cost makes many small bins cheaper than one large one
    assert all(size == 16 for size, _ in P.pack_block([10] * 6, list(range(6)), (16, 64), lambda c: c**2))


def naive(lens, keys, permitted, cost):
    """Best fit over all bins by a plain search, for each way to open bins; the cheapest, the first of equals."""
    order = sorted(range(len(lens)), key=lambda i: (-lens[i], keys[i]))
    ways = [lambda n, left, c=c: min(s for s in permitted if s >= max(n, c)) for c in sorted(permitted)]
    ways.append(lambda n, left: min((c for c in sorted(permitted) if c >= n), key=lambda c: cost(c) / min(c, max(n, left))))
    best = None
    for way in ways:
        bins, left = [], sum(lens)
        for i in order:
            fits = [b for b in bins if b[0] - b[1] >= lens[i]]
            if not fits:
                fits = [[way(lens[i], left), 0, []]]
                bins.append(fits[0])
            b = min(fits, key=lambda b: b[0] - b[1])
            b[1] += lens[i]
            b[2].append(i)
            left -= lens[i]
        total = sum(cost(min(c for c in permitted if c >= b[1])) for b in bins)
        if best is None or total < best - 1e-9:
            best = total
    return best


def test_against_a_plain_search():
    draw = random.Random(6)
    for k in range(60):
        permitted = tuple(sorted(draw.sample(range(8, 200), draw.randrange(1, 5))))
        lens = [draw.randrange(1, permitted[-1] + 1) for _ in range(draw.randrange(0, 40))]
        cost = draw.choice([lambda c: float(c), lambda c: c**1.5, P.padded_cost])
        bins = P.pack_block(lens, list(range(len(lens))), permitted, cost)
        assert sorted(i for _, b in bins for i in b) == list(range(len(lens)))
        assert all(size == min(c for c in permitted if c >= sum(lens[i] for i in b)) for size, b in bins)
        assert abs(sum(cost(size) for size, _ in bins) - naive(lens, list(range(len(lens))), permitted, cost)) < 1e-6


def test_ids_stay_as_they_were(spark):
    big = 2**60 + 1
    rows = [(big, "a b c", 1), (None, "d", 2), (big, "e", 3), (-5, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long").selectExpr("*", "1 as piece", "2 as bin", "3 as block", "4 as n")
    got = P.pack(P.lengths(df)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in got) == [(False, -5, 1), (False, big, 2), (False, big, 4), (True, 0, 2)]
    strings = spark.createDataFrame([("x", "a"), (None, "b c")], "doc_id string, text string")
    assert {(r.doc_id, r.length) for r in P.pack(P.lengths(strings)).collect()} == {("x", 2), (None, 3)}


def test_rows_without_an_id_are_dealt_over_blocks(spark):
    measured = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN id % 2 WHEN id % 3 = 1 THEN id END AS doc_id", "id % 50 + 1 AS length")  # a third have none, a third share two
    got = P.pack(measured, permitted=(16, 64), block_rows=400).collect()
    blocks = {}
    for r in got:
        if r.doc_id is None:
            blocks[r.bin >> 32] = blocks.get(r.bin >> 32, 0) + 1
    assert len(got) == 4000 and len(blocks) == 10 and max(blocks.values()) < 250
