"""The log of scored rows: writers that fail, writers that meet; sizes of written files; states of partitions; quantiles."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.operators import report
from ballast.sources import log, tables

SCHEMA = "suite string, qid long, score double"


def rows(spark, ids, suite="s"):
    return spark.createDataFrame([(suite, i, i / 2) for i in ids], SCHEMA)


def ids(df):
    return sorted((str(r.suite), r.qid) for r in df.collect())


def test_a_writer_that_fails_before_its_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    log.append_scored(rows(spark, range(5)), path, "suite", "qid")

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(log, "_create_once", dies)
        with pytest.raises(RuntimeError):
            log.append_scored(rows(spark, range(8)), path, "suite", "qid")
    assert ids(log.read_log(spark, path, SCHEMA)) == [("s", i) for i in range(5)]
    # a writer that dies at its manifest leaves an empty one, whose number is not used again
    log._create_once(spark, f"{path}/commits/{2:012d}.json", "")
    got = log.append_scored(rows(spark, range(8)), path, "suite", "qid")
    assert ids(got) == [("s", i) for i in range(8)] and log.committed(spark, path)[0] == 3
    assert ids(log.append_scored(rows(spark, range(8)), path, "suite", "qid")) == ids(got) and log.committed(spark, path)[0] == 3
    assert log.vacuum(spark, path) == 1 and ids(log.read_log(spark, path, SCHEMA)) == ids(got)


def test_two_writers(spark, tmp_path, monkeypatch):
    path, create, met = str(tmp_path / "log"), log._create_once, []

    def late(*a):
        if not met:  # another writer commits just before
            met.append(1)
            log.append_scored(rows(spark, range(3, 9)), path, "suite", "qid")
        return create(*a)

    log.append_scored(rows(spark, [0]), path, "suite", "qid")
    monkeypatch.setattr(log, "_create_once", late)
    got = log.append_scored(rows(spark, range(6)), path, "suite", "qid")
    assert ids(got) == [("s", i) for i in range(9)]
    last, batches = log.committed(spark, path)
    assert last == 3 and len(batches) == 3


def test_odd_rows_of_the_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert log.append_scored(rows(spark, []), path, "suite", "qid").count() == 0
    odd = rows(spark, [1, 2], None)
    assert log.append_scored(odd, path, "suite", "qid").count() == 2 and log.append_scored(odd, path, "suite", "qid").count() == 2


def test_file_sizes(spark, tmp_path):
    draw = random.Random(1)
    data = [(i, draw.choice(["train"] * 8 + ["dev", None]), "x" * draw.randrange(400)) for i in range(9000)] + [(7, "train", "same" * 50)] * 4500  # a third is one row
    df = spark.createDataFrame(data, "id long, split string, text string")
    tables.write_split_partitions(df, str(tmp_path / "out"), 200_000)
    sizes = {}
    for f in Path(tmp_path / "out").rglob("part-*"):
        sizes.setdefault(f.parent.name, []).append(f.stat().st_size)
    assert set(sizes) == {"split=train", "split=dev", "split=__HIVE_DEFAULT_PARTITION__"}
    assert len(sizes["split=train"]) > 8 and all(100_000 <= x <= 400_000 for x in sizes["split=train"])
    back = spark.read.schema("id long, split string, text string").json(str(tmp_path / "out"))
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    tables.write_split_partitions(df.where("false"), str(tmp_path / "none"))
    tables.write_split_partitions(df.limit(1), str(tmp_path / "one"))


def test_states_add_up(spark):
    df = spark.createDataFrame([(f"s{i % 3}", i % 40, "t" * (i % 5) if i % 7 else None) for i in range(500)], "split string, a int, b string")
    whole = tables.partition_state(df)
    one, two = (tables.partition_state(df.where(x)) for x in ("a < 13", "a >= 13"))
    key = lambda s: sorted(map(tuple, tables.state_digest(s).collect()))
    assert key(tables.merged_state(one, two)) == key(whole) == sorted(map(tuple, tables.partition_fingerprint(df.repartition(5, "b")).collect()))
    assert key(tables.remaining_state(whole, two)) == key(one)
    assert tables.remaining_state(whole, whole).count() == 0


def test_quantiles_against_numpy(spark, monkeypatch):
    draw = np.random.default_rng(2)
    groups = {"even": draw.normal(size=3000), "ties": draw.integers(0, 3, 2500).astype(float), "one": np.array([4.5]), "hot": np.full(4000, 7.0), "few": draw.normal(size=11), "odd": np.array([np.inf, -np.inf, 0.0, 1.0])}
    data = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("none", None), (None, 3.0), ("few", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5, "v")
    for accuracy, small in ((report.ACCURACY, report.SMALL), (2000, 500)):  # the second brackets the large groups
        monkeypatch.setattr(report, "ACCURACY", accuracy)
        monkeypatch.setattr(report, "SMALL", small)
        got = {r.g: r for r in report.quantiles(df, "v", [0.95, 0.0, 0.5, 1.0, 0.501], "g", more={"m": F.sum("v")}).collect()}
        assert set(got) == set(groups) - {"none"} | {None}
        for g, xs in groups.items():
            assert got[g].n == len(xs)
            if g != "odd":
                assert np.allclose(got[g].q, np.quantile(xs, [0.95, 0.0, 0.5, 1.0, 0.501])) and np.isclose(got[g].m, xs.sum())
        whole = report.quantiles(df.where("g <> 'odd'"), "v", [0.5]).first()
        xs = np.concatenate([x for g, x in groups.items() if g != "odd"])
        assert whole.n == len(xs) and np.isclose(whole.q[0], np.quantile(xs, 0.5))
    assert report.quantiles(df.where("false"), "v", [0.5], "g").count() == 0


def test_runs_over_changed_partitions_are_refused(spark):
    from ballast.operators import compare

    one = spark.createDataFrame([("test", i, "a") for i in range(9)], "split string, id long, text string")
    prints = [tables.partition_fingerprint(x) for x in (one, one.repartition(3, "id"), one.where("id <> 4"))]
    means = spark.createDataFrame([("d", 0.5)], "dataset string, accuracy double")
    assert compare.run_comparison(means, means, prints[0], prints[1], ["accuracy"]).first().accuracy_change == 0
    with pytest.raises(ValueError, match="differ"):
        compare.run_comparison(means, means, prints[0], prints[2], ["accuracy"])
