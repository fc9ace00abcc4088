"""Alignment against plain loops over both libraries' own tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import sentencepiece
from tokenizers import Tokenizer

from ballast.llm import align as A
from tests.llm.fixtures import SCHEMA, documents

_A = Tokenizer.from_file(A.BYTE_LEVEL)
_A.encode_special_tokens = True
_B = sentencepiece.SentencePieceProcessor(model_file=A.PIECES)
_BYTE = A._spelled()


def spans(sizes):
    at, out = 0, []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def cut(text):
    if not text:
        return None
    a, b = _A.encode(" " + text, add_special_tokens=False), _B.encode(text)
    a_bytes = [bytes(_BYTE[c] for c in t) for t in a.tokens]
    b_bytes = [bytes([int(p[3:5], 16)]) if _B.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, _B.id_to_piece(i)) for i in b)]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return None
    return a.ids, b, spans(map(len, a_bytes)), spans(map(len, b_bytes))


def brute(rows):
    cuts, links, holds = [cut(t) for _, t in rows], [], Counter()
    for c in cuts:
        links.append([(i, j) for i, (s, e) in zip(c[0], c[2]) for j, (p, q) in zip(c[1], c[3]) if s < q and p < e] if c else [])
        holds.update(set(links[-1]))
    most = defaultdict(int)
    for (i, _), n in holds.items():
        most[i] = max(most[i], n)
    out = []
    for (doc, _), c, ls in zip(rows, cuts, links):
        groups, a, b = [], [], []
        if c:
            ends = sorted([(e, 0, i) for i, (_, e) in zip(c[0], c[2])] + [(e, 1, j) for j, (_, e) in zip(c[1], c[3])])
            for k, (e, side, i) in enumerate(ends):
                (b if side else a).append(str(i))
                if k and ends[k - 1][0] == e:
                    groups.append(",".join(a) + "|" + ",".join(b))
                    a, b = [], []
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if c else ""
        out.append((doc, len(c[0]) if c else 0, len(c[1]) if c else 0, len(groups), len(ls), sum(holds[x] == most[x[0]] for x in ls), sum(holds[x] for x in ls), digest))
    return sorted(out, key=str)


def odd():
    draw = random.Random(2)
    texts = ["▁a", "<s> <|endoftext|> <0x41> <unk>", "\x00 \n\t", "日本語 🎉 é ß", "x" * 700, "  a  b ", " ", "it's 'RE ½ ٣ #### ++", "​\xa0  '’s"]
    texts += [" ".join(draw.choice(["the", "naïve", "tokens", "straße", "zz9", "\n"]) for _ in range(draw.randrange(1, 60))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(900 + i, texts[12]) for i in range(20)]  # a third are copies


def table(rows):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows), key=str)


def test_against_plain_loops(spark):
    rows = odd() + [(1000 + k if r[0] is not None else None, r[1]) for k, r in enumerate(documents())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(A.align(docs).collect()) == brute(rows)
    # many blocks: merges of groups, more than once; small buffers: many runs
    assert table(A.align(docs.repartition(4, "text"), fan=2, shards=3, buffer=300).collect()) == brute(rows)


def test_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(documents(), SCHEMA).selectExpr("doc_id", "text", "1 AS n_a", "'x' AS block", "2 AS __block")
    assert A.align(docs).count() == len(documents())
    assert A.align(docs.where("false")).count() == 0
    assert A.align(spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")).collect() == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [r for r in rows if not r[1] or len(r[1]) < 6000]  # the loops above are slow
    assert table(A.align(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)


def test_splitter_and_millions_of_spaces():
    from pathlib import Path

    cutter = A.Cutter(Path(A.BYTE_LEVEL).read_bytes(), Path(A.PIECES).read_bytes())
    for text in ("a" * 20000, " " * 60000 + "b", "\n" * 60000, "ab " * 30000, "\n", " \n", "a \n\n  b\nc ", "\r\n\t", "x\x1c\x1d y.\x1f", "a\u00a0\u2003 b\t\n c\u3000", "\u00a0"):
        made, = cutter.cut([text])
        assert made[:2] == (len(_A.encode(" " + text, add_special_tokens=False).ids), len(_B.encode(text)))


def test_merge_holds_chunks():
    import numpy as np

    draw, old = np.random.default_rng(1), A.CHUNK
    A.CHUNK = 7
    try:
        runs, want = [], Counter()
        for _ in range(12):
            keys = np.unique(draw.integers(0, 200, draw.integers(1, 90)))
            counts = draw.integers(1, 9, len(keys))
            want.update(dict(zip(keys.tolist(), counts.tolist())))
            runs.append(A.run_of(keys, counts))
        got = [x for keys, counts in A.merged(runs) for x in zip(keys.tolist(), counts.tolist())]
    finally:
        A.CHUNK = old
    assert got == sorted(want.items())
