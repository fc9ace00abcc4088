"""A list in a JSON document, read over splits, against the standard library."""

import json
import random

import pytest

from ballast.sources import documents

MB = "spark.sql.files.maxPartitionBytes"


def value(draw, depth=0):
    kind = draw.randrange(8 if depth < 3 else 5)
    if kind < 3:
        return "".join(draw.choice(['"', "\\", "}", "{", "[", "]", ",", "a", "é", "\n", " ", "日", '":[']) for _ in range(draw.randrange(20)))
    if kind < 5:
        return draw.choice([None, True, 1.5, -3, 10**12])
    if kind == 5:
        return [value(draw, depth + 1) for _ in range(draw.randrange(4))]
    return {draw.choice(["a", "b}", "items", '"q']): value(draw, depth + 1) for _ in range(draw.randrange(4))}


@pytest.mark.parametrize("size", ["100", "1700", "10m"])
def test_lists_over_splits(spark, tmp_path, size):
    draw = random.Random(len(size))
    want = {}
    for k in range(4):
        rows = [value(draw) for _ in range([0, 1, 60, 400][k])]
        indent = [None, 1, None, 2][k]
        (tmp_path / f"plain{k}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=k % 2 == 0))
        doc = {"first": [1, {"items": [2]}], "text": 'no "items": [ here }', "items": rows, "last": {"items": [3]}, "more": [[4]]}
        (tmp_path / f"field{k}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=k % 2 == 0))
        want[f"plain{k}.json"] = want[f"field{k}.json"] = rows
    old = spark.conf.get(MB)
    spark.conf.set(MB, size)
    try:
        for kind, field in (("plain", None), ("field", "items")):
            got = {}
            for r in documents.read_json_list(spark, str(tmp_path / f"{kind}*.json"), field).collect():
                got.setdefault(r.path.rpartition("/")[2], []).append((r.number, json.loads(r.text)))
            for k in range(4):
                name = f"{kind}{k}.json"
                assert [x for _, x in sorted(got.get(name, []), key=lambda x: x[0])] == want[name], name
        assert documents.read_json_list(spark, str(tmp_path / "plain*.json"), "items").count() == 0
    finally:
        spark.conf.set(MB, old)


def test_typed_entries_and_several_tasks(spark, tmp_path):
    rows = [{"a": i, "t": "x}" * (i % 50)} for i in range(2000)]
    (tmp_path / "d.json").write_text(json.dumps({"items": rows}))
    old = spark.conf.get(MB)
    spark.conf.set(MB, "20000")
    try:
        got = documents.read_json_document(spark, str(tmp_path / "d.json"), "items array<struct<a:int,t:string>>", "items")
        assert sorted(map(tuple, got.collect())) == [(r["a"], r["t"]) for r in rows]
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "d.json")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set(MB, old)
