import random

import xxhash

from ballast.llm import simhash as S
from tests.llm.fixtures import SCHEMA, by_id, documents, lower, white_words


def print_of(text, k):
    ws = white_words(lower(text))
    shingles = [" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, ids, radius):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a in pairs:
        for b in pairs:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    least = {}
    for p in pairs:
        for d in ids[p]:
            if d is not None:
                least[find(p)] = min(d, least.get(find(p), d))
    return {p: least.get(find(p)) for p in pairs}


def test_against_brute_force(spark):
    docs = documents()
    prints = [print_of(t, 3) for _, t, *_ in docs]
    ids = {}
    for (d, *_), p in zip(docs, prints):
        ids.setdefault(p, []).append(d)
    want = components(list(ids), ids, 2)
    got = S.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()
    assert by_id((r.doc_id, int.from_bytes(r.fingerprint), r.component_id) for r in got) == by_id((d, p, want[p]) for (d, *_), p in zip(docs, prints))


def test_links_of_near_fingerprints_whatever_the_tree_size(spark):
    draw = random.Random(5)
    base = [draw.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for b in base:
        for _ in range(12):
            for k in draw.sample(range(64), draw.randrange(1, 4)):
                b ^= 1 << k
            prints.add(b)
    prints = sorted(prints)
    want = components(prints, {p: [p] for p in prints}, 2)
    df = spark.createDataFrame([(p.to_bytes(8),) for p in prints], "fingerprint binary")
    for most in (20_000, 3):
        from ballast.operators.components import connected_components

        links = S.near_links(df, S.exact_bands(64, 2), 2, most)
        roots = {int.from_bytes(r.node): int.from_bytes(r.root) for r in connected_components(links, "a", "b").collect()}
        assert {p: roots.get(p, p) for p in prints} == want


def test_forest_skips_linked_subtrees_but_loses_none():
    draw = random.Random(2)
    forest, values = S.Forest(3), []
    for _ in range(400):
        x = draw.getrandbits(10)
        near = forest.add(x)
        roots = {forest.find(i) for i, v in enumerate(values) if (v ^ x).bit_count() <= 3}
        assert roots <= {forest.find(n) for n in near} | {forest.find(len(values))}
        values.append(x)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d", "x"), (1, "e f g h i", "x"), (2, "a b c d", "x"), (None, "a b c d", None)], "doc_id long, text string, fingerprint string").selectExpr("*", "1 as component_id", "'k' as node", "'r' as root")
    got = S.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1)]
    assert S.near_duplicates(df.where("false")).count() == 0
