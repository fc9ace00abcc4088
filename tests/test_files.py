"""Many small files: written by the tasks, verified by more than one."""

import hashlib
from pathlib import Path
from urllib.parse import unquote

import pytest
from pyspark.errors import AnalysisException

from ballast.plans import sources as plans
from ballast.sources import tables


def test_a_file_per_row(spark, tmp_path):
    raw = {999: b"a", 1000: b"", 2001: b"\xff\n"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in raw.items()], "n long, raw binary")
    rows = plans._files(df, str(tmp_path / "f"), "n", "raw").collect()
    assert {(r.path, r.bytes, r.sha256) for r in rows} == {(f"{tmp_path}/f/{k // 1000}/{k}", len(v), hashlib.sha256(v).hexdigest()) for k, v in raw.items()}
    assert all(Path(r.path).read_bytes() == raw[int(r.path.rpartition("/")[2])] for r in rows)
    plans._files(df.where("false"), str(tmp_path / "none"), "n", "raw")
    assert tables.read_images(spark, f"{tmp_path}/none/*").count() == 0


def test_a_small_manifest_is_dealt(spark, tmp_path):
    for k in range(40):
        (tmp_path / str(k)).write_bytes(b"x")
    manifest = spark.createDataFrame([(f"{tmp_path}/{k}", 2, "00") for k in range(40)], "path string, bytes long, sha256 string")
    found = tables.verify_large_files(manifest)
    assert found.count() == 40 and found.rdd.getNumPartitions() > 1


def test_pictures_are_listed_in_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LISTED", 4, raising=False)
    colours = {}
    for k, folder in enumerate(("a[1]", "b*", "c")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        for level in (0, 5, 9):
            (name := tmp_path / "in" / folder / f"{level} %.png").write_bytes(plans._png(bytes([k, level % 5, 0]) * 4, level))
            colours[str(name)] = (k, level % 5)
    (tmp_path / "in" / "d.png").write_bytes(plans._png(bytes([9, 0, 0]) * 4, 9))
    colours[str(tmp_path / "in" / "d.png")] = (9, 0)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.hive.filesourcePartitionFileCacheSize")}
    df = tables.read_pixels(spark, f"{tmp_path}/in/*")
    assert not any(f.endswith(".png") for f in df.inputFiles())  # the plan holds no picture's file
    rows = df.collect()
    assert len(rows) == 10 and {unquote(r.path).partition(":")[2].lstrip("/") for r in rows} == {x.lstrip("/") for x in colours}
    found = {unquote(r.path).partition(":")[2].replace("//", "/").replace("//", "/"): r.pixel_key for r in rows}
    for c in set(colours.values()):
        rgb = bytes((0, c[1], c[0])) * 4  # Spark's pixels are blue, green, red
        assert {found[x] for x in colours if colours[x] == c} == {"pixels:" + hashlib.sha256(b"2x2:" + rgb).hexdigest()}
    assert before == {k: spark.conf.get(k) for k in before}
    assert [len(x) for x in tables._listings(spark, f"{tmp_path}/in/*")] == [1, 1, 2]


def test_no_pictures(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert tables.read_pixels(spark, f"{tmp_path}/*").count() == 0
    for missing in (f"{tmp_path}/none", f"{tmp_path}/none/*"):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            tables.read_pixels(spark, missing)
