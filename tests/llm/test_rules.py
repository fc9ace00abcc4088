from collections import Counter

from ballast.llm import rules as R
from tests.llm.fixtures import SCHEMA, by_id, documents, white_words


def brute(t):
    ws, t = white_words(t), t or ""
    lines = [x for x in t.split("\n") if white_words(x)]
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    count = Counter(wins)
    again = {i + j for i, w in enumerate(wins) if count[w] > 1 for j in range(8)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_measures_against_brute_force(spark):
    docs = documents() + [(200 + k, t, None, None, 0) for k, t in enumerate(["a b c d e f g h " * 4, "x\ny\nx\n \nx", "# $ | <b> & %", "A B C D E F G H I " * 3 + "a"])]
    assert max(len(white_words(d[1])) for d in docs) > 3000
    got = R.cascade(spark.createDataFrame(docs, SCHEMA).selectExpr("*", "lang as n_words", "lang as passed", "lang as kept")).collect()
    assert by_id((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == by_id((d, *brute(t)) for d, t, *_ in docs)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)


def test_order_is_greedy_and_changes_no_verdict(spark):
    rules = [R.Rule("dear", lambda t: len(t.words) > 3), R.Rule("cheap", lambda t: len(t.words) > 5), R.Rule("idle", lambda t: False)]
    cost, sets = {"dear": 9.0, "cheap": 1.0, "idle": 1.0}, {0b11: 50, 0b01: 5, 0: 100}
    assert [r.name for r in R.order(rules, cost, sets)] == ["cheap", "dear", "idle"]
    docs = spark.createDataFrame(documents(), SCHEMA)
    assert by_id((r.doc_id, r.passed) for r in R.cascade(docs, rules).collect()) == by_id((d, len(white_words(t)) <= 3) for d, t, *_ in documents())
    assert R.cascade(docs.where("false")).count() == 0


def test_copies_of_a_text_do_not_fill_the_sample(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "'one text that is everywhere' as text")
    _, sets = R.measure(df, R.RULES, sample_rows=500)
    assert 350 < sum(sets.values()) < 650
