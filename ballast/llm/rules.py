"""Quality rules as a short-circuit cascade.

Rules are cheap or costly functions of one text; a text is kept if no rule rejects it. Each rule's cost and what it rejects are
measured on a bounded sample, and the rules are then ordered greedily: next comes the one with the most rejections, among
texts that the earlier ones let through, per unit of cost. The order changes how much work is done and never the verdict.

Nulls and empties: a null text has no words, like an empty one. Repeated rows are judged alike. Very long texts are measured whole, in time near linear to their length.
Rules of equal gain keep the order they were given in, as all do if there are no rows. Other columns play no part.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.text import as_bytes

#: Rows of the sample on which cost and selectivity are measured, about.
SAMPLE_ROWS = 2000
WINDOW = 8


class Text:
    """Measures of one text, each made when first asked for."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, b" \t\n\r\x0b\x0c").decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, b"#*$%&|<>"))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_stutter(self) -> int:
        return sum(a == b for a, b in zip(self.words, self.words[1:]))

    @cached_property
    def n_upper(self) -> int:
        return len(self.text) - len(self.text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    @cached_property
    def n_lower(self) -> int:
        return len(self.text) - len(self.text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))

    @cached_property
    def n_repeat_words(self) -> int:
        n = len(self.words)
        if n <= WINDOW:
            return 0
        ids: dict[bytes, int] = {}
        x = np.fromiter((ids.setdefault(w, len(ids)) for w in self.words), np.int64, n)
        span = 1
        while span < WINDOW:  # names of windows of twice the length, from the names of two halves
            _, x = np.unique(x[:-span] * np.int64(x.max() + 1) + x[span:], return_inverse=True)
            span *= 2
            if int(x.max()) + 1 == len(x):
                return 0
        again = np.bincount(x)[x] > 1
        edge = np.zeros(n + 1, np.int64)
        edge[: len(again)] += again
        edge[WINDOW : WINDOW + len(again)] -= again
        return int((np.cumsum(edge)[:n] > 0).sum())


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true of a text that the rule refuses."""

    name: str
    rejects: Callable[[Text], bool]


#: Production rules.
RULES = [
    Rule("few words", lambda t: len(t.words) < 20),
    Rule("repeated windows", lambda t: 100 * t.n_repeat_words > 30 * len(t.words)),
    Rule("repeated lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("symbols", lambda t: 10 * t.n_symbols > len(t.words)),
    Rule("word length", lambda t: not 2 * len(t.words) <= t.word_chars <= 20 * len(t.words)),
    Rule("stutter", lambda t: 10 * t.n_stutter > 3 * len(t.words)),
    Rule("shouting", lambda t: t.n_upper > t.n_lower),
]


def measure(docs: DataFrame, rules: list[Rule], *, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], dict[int, int]]:
    """Seconds per text of each rule, and texts by the set of rules (as bits) that reject them, on a sample."""
    own = docs.select(F.col(text).alias("text"))
    sample = own.sample(min(1.0, sample_rows / max(1, own.count())), seed=42)  # by row, so copies of one text do not come together

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, sets = [0.0] * len(rules), Counter()
        for batch in it:
            for t in as_bytes(batch.column(0)):
                bits = 0
                for k, rule in enumerate(rules):
                    own = Text(t)
                    began = time.perf_counter()
                    bits |= bool(rule.rejects(own)) << k
                    spent[k] += time.perf_counter() - began
                sets[bits] += 1
        rows = [(f"cost {k}", s, 0) for k, s in enumerate(spent)] + [(f"set {bits}", 0.0, n) for bits, n in sets.items()]
        yield pa.RecordBatch.from_pydict({"what": [r[0] for r in rows], "s": [r[1] for r in rows], "n": [r[2] for r in rows]}, schema=pa.schema([("what", pa.string()), ("s", pa.float64()), ("n", pa.int64())]))

    found = {r["what"]: (r["s"], r["n"]) for r in sample.mapInArrow(run, "what string, s double, n long").groupBy("what").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    sets = {int(k[4:]): n for k, (_, n) in found.items() if k.startswith("set ")}
    total = max(1, sum(sets.values()))
    return {rule.name: found.get(f"cost {k}", (0.0, 0))[0] / total for k, rule in enumerate(rules)}, sets


def order(rules: list[Rule], cost: dict[str, float], sets: dict[int, int]) -> list[Rule]:
    """``rules`` by rejections per cost among what those before let through; ties keep their order."""
    left, rest, out = dict(enumerate(rules)), dict(sets), []
    while left:
        gain = {k: sum(n for bits, n in rest.items() if bits >> k & 1) / max(cost[r.name], 1e-9) for k, r in left.items()}
        best = max(left, key=lambda k: (gain[k], -k))
        out.append(left.pop(best))
        rest = {bits: n for bits, n in rest.items() if not bits >> best & 1}
    return out


def cascade(docs: DataFrame, rules: list[Rule] | None = None, *, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, passed)`` for each row.

    ``passed``: no rule rejects the text. The measures are exact for each text; rules share those that they ask for.
    """
    rules = rules or RULES
    ordered = order(rules, *measure(docs, rules, text=text, sample_rows=sample_rows))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for t in map(Text, as_bytes(batch.column(1))):
                passed = not any(rule.rejects(t) for rule in ordered)
                n = len(t.words)
                rows.append((n, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, n < 20 or 100 * t.n_repeat_words > 30 * n, passed))
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.bool_()) for c in columns[5:])], names=["doc_id", *longs, "base_failed", "passed"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in longs)}, base_failed boolean, passed boolean")


def op8_rules(spark, sf_dir: str) -> DataFrame:
    """Measures and the cascade's verdict for each document."""
    got = cascade(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.withColumn("kept", ~F.col("base_failed") & F.col("passed")).drop("passed")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_distinct FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
wins AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM wins) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, 8) r(j) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines - n_distinct, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, len(list_filter(list_zip(ws, list_slice(ws, 2, len(ws))), lambda z: z[1] = z[2])) AS n_stutter,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 2 * n_dup_lines > n_lines OR 10 * n_symbols > n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_stutter > 3 * n_words OR n_upper > n_lower) AS kept
FROM m
"""
