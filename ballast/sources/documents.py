"""A list in one JSON document, read in splits, so that a document of any size is many tasks' work.

Spark's text reader cuts files at closing braces, wherever a split begins. Whether a split begins inside a string, how deep, and whether inside the list
asked for, follows from all before it, but what a split does to these states is a function of them that can be found without knowing them:

1. each split tells, for a beginning outside and inside of a string, which of both its end is and by how much the depth changes;
2. with these put together in order (a row for each split), each tells, for a beginning outside and inside of the list, the same of its end and how many entries end in it;
3. with these put together, each cuts its entries, whose numbers are known; those that go on over splits are put together by number.

An entry is bounded by a row (2 GB), a document is not.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.functions.durable import cut

_MARK = b"}"
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*("?)|[\[\]{},]', re.DOTALL)
_REST = re.compile(rb'(?:[^"\\]|\\.)*("?)', re.DOTALL)


@dataclass
class State:
    """Where a reader of a document is: in a string, how deep, in the list asked for."""

    in_string: bool = False
    depth: int = 0
    in_list: bool = False


def scan(pieces: Iterator[bytes], state: State, field: str | None) -> Iterator[bytes | None]:
    """Goes through pieces with the brace behind each, and moves ``state``. Yields the bytes of entries as they come, and None at the end of each."""
    level = 1 if field is None else 2  # the depth of entries
    key = re.compile(re.escape(json.dumps(field).encode()) + rb"\s*:\s*\Z") if field is not None else None
    for piece in pieces:
        at, start = 0, 0
        if state.in_string:
            end = _REST.match(piece)
            at, state.in_string = end.end(), not end[1]
        for m in _TOKEN.finditer(piece, at) if not state.in_string else ():
            c = m[0][:1]
            if c == b'"':
                state.in_string = not m[1]
            elif c in b"[{":
                state.depth += 1
                if not state.in_list and state.depth == level and c == b"[" and (key is None or key.search(piece, max(0, m.start() - 4096), m.start())):
                    state.in_list, start = True, m.end()
            elif c in b"]}":
                state.depth -= 1
                if state.in_list and state.depth < level:
                    yield piece[start : m.start()]
                    yield None
                    state.in_list = False
            elif state.in_list and state.depth == level:
                yield piece[start : m.start()]
                yield None
                start = m.end()
        if state.in_list:
            yield piece[start:]
        if not state.in_string:
            state.depth -= 1
        if state.in_list:
            yield _MARK


def _splits(it: Iterator[pa.RecordBatch], extra: int) -> Iterator[tuple[tuple, list[bytes]]]:
    """``(path, block, more columns)`` and the pieces of each split, which come in order."""
    rows = (r for b in it for r in zip(*(c.to_pylist() for c in b.columns)))
    for key, found in groupby(rows, key=lambda r: r[: 2 + extra]):
        yield key, [r[-1] for r in found]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])


def _strings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first question, of each split."""
    for (path, block), pieces in _splits(it, 0):
        out, inside = State(), State(in_string=True)
        for state in (out, inside):
            for _ in scan(iter(pieces), state, None):
                pass
        yield _batch([(path, block, out.in_string, out.depth, inside.in_string, inside.depth)], ["path", "block", "out_string", "out_depth", "in_string", "in_depth"])


def _lists(field: str | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The second question, of each split."""
        for (path, block, in_string, depth), pieces in _splits(it, 2):
            ends, states = [], [State(in_string, depth, inside) for inside in (False, True)]
            for state in states:
                ends.append(sum(x is None for x in scan(iter(pieces), state, field)))
            yield _batch([(path, block, states[0].in_list, ends[0], states[1].in_list, ends[1])], ["path", "block", "out_list", "out_ends", "in_list", "in_ends"])

    return run


def _entries(field: str | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries, and parts of entries, of each split."""
        for (path, block, in_string, depth, in_list, number), pieces in _splits(it, 4):
            held, parts, size = [], [], 0
            for x in scan(iter(pieces), State(in_string, depth, in_list), field):
                if x is None:
                    held.append((path, number, block, b"".join(parts)))
                    size += len(held[-1][3])
                    number, parts = number + 1, []
                    if size > 4_000_000:
                        yield _batch(held, ["path", "number", "block", "part"])
                        held, size = [], 0
                else:
                    parts.append(x)
            if parts:
                held.append((path, number, block, b"".join(parts)))
            if held:
                yield _batch(held, ["path", "number", "block", "part"])

    return run


def _begin_strings(pdf: pd.DataFrame) -> pd.DataFrame:
    in_string, depth, rows = False, 0, []
    for r in pdf.sort_values("block").itertuples():
        rows.append((r.path, r.block, in_string, depth))
        depth += int(r.in_depth if in_string else r.out_depth)
        in_string = bool(r.in_string if in_string else r.out_string)
    return pd.DataFrame(rows, columns=["path", "block", "in_string", "depth"])


def _begin_lists(pdf: pd.DataFrame) -> pd.DataFrame:
    in_list, number, rows = False, 0, []
    for r in pdf.sort_values("block").itertuples():
        rows.append((r.path, r.block, r.in_string, r.depth, in_list, number))
        number += int(r.in_ends if in_list else r.out_ends)
        in_list = bool(r.in_list if in_list else r.out_list)
    return pd.DataFrame(rows, columns=["path", "block", "in_string", "depth", "in_list", "number"])


def read_json_list(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """``(path, number, text)``: the entries of the list that a document is, or that one field of it is, as JSON texts.

    An empty list gives no rows, and so does a document without the list. The field's name stands in the document as ``json.dumps`` writes it.
    """
    raw = spark.read.option("lineSep", _MARK.decode()).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("__order"), F.col("value").cast("binary").alias("value"))

    def asked(begin: DataFrame, *columns: str) -> DataFrame:
        # a split stays whole in a join by it, whichever kind Spark takes; its pieces are put in order again
        return raw.join(begin, ["path", "block"]).sortWithinPartitions("path", "block", "__order").select("path", "block", *columns, "value")

    strings = raw.select("path", "block", "value").mapInArrow(_strings, "path string, block long, out_string boolean, out_depth long, in_string boolean, in_depth long")
    at = cut(strings.groupBy("path").applyInPandas(_begin_strings, "path string, block long, in_string boolean, depth long"))
    lists = asked(at, "in_string", "depth").mapInArrow(_lists(field), "path string, block long, out_list boolean, out_ends long, in_list boolean, in_ends long")
    both = lists.join(at, ["path", "block"])
    begin = cut(both.groupBy("path").applyInPandas(_begin_lists, "path string, block long, in_string boolean, depth long, in_list boolean, number long"))
    parts = asked(begin, "in_string", "depth", "in_list", "number").mapInArrow(_entries(field), "path string, number long, block long, part binary")
    whole = parts.groupBy("path", "number").agg(F.sort_array(F.collect_list(F.struct("block", "part"))).alias("parts"))
    text = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["part"])).cast("string")
    return whole.select("path", "number", F.btrim(text, F.lit(" \t\r\n")).alias("text")).where("text <> ''")


def read_json_document(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """A list in one JSON document per file: the document itself, or one of its fields; a row per entry.

    ``schema`` has the columns of an entry, or the field as an array of entries.
    """
    kind = T.StructType.fromDDL(schema)
    kind = kind[field].dataType.elementType if field is not None else kind
    rows = read_json_list(spark, path, field).select(F.from_json("text", kind).alias("item"))
    return rows.select("item.*")
